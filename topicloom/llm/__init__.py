"""Training-data operators: dedup, formatting, packing, mixing, archives, privacy, language ID, search."""
