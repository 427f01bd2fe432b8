"""Column expressions; all are built-in functions, so plans stay inside the JVM."""
