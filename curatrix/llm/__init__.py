"""Training-data operators: language, quality, private data, secrets, archives, duplicates, search, packing."""
