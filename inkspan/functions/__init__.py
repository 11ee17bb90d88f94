"""Column builders: pure expressions over built-in functions, one module a subject."""
