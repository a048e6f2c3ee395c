"""Column functions: they stay in the JVM unless their module says otherwise."""
