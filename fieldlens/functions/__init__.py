"""Column builders: geometric and presentational functions that stay inside code generation."""
