"""Training-data operators: language, duplicates, contamination, quality, tokens, archives."""
