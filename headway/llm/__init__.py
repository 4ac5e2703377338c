"""Training-data operators: one module for each."""
