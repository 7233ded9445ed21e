"""Column expressions (JVM side) used by the operators."""
