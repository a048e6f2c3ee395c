"""Sources and sinks: tables of answers, manifests as JSON, file trees."""
