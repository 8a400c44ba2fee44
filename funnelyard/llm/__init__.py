"""Training-data operators: one module per operator, see the package README section."""
