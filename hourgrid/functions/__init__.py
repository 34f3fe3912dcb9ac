"""Column expressions: everything here takes and returns columns and stays in the JVM."""
