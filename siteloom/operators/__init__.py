"""DataFrame operators: manifests, closure, crawling, reports."""
