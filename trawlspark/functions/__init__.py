"""Column expressions. Everything here is evaluated on the JVM by Spark."""
