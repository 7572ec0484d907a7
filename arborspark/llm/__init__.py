"""Training-data operators: one module per operator, each DataFrame in and DataFrame out."""
