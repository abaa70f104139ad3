"""Column builders: text, scope and scoring expressions."""
