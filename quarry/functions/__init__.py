"""Column functions: every function takes and returns ``Column`` objects built from native
Spark expressions, so they stay inside the JVM and whole-stage codegen where Spark allows."""
