"""Column expressions: no action, no shuffle, all inside Spark's code generation."""
