"""Column builders, all inside code generation."""
