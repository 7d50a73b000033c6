"""Column builders: geometry, gates and scores. All are row-local and stay in the JVM."""
