"""Column builders: expressions that stay in the JVM."""
