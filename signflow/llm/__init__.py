"""Training-data operators: one module per operator, each with its driver query."""
