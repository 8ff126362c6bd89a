"""Column functions. All of them are JVM-side expressions."""
