"""Training-data operators: dedup, filters, mixing, search, tokens, formatting."""
