"""Column-level building blocks that stay inside whole-stage code generation."""
