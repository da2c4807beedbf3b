"""Column functions: everything here returns a Column built from JVM-side expressions."""
