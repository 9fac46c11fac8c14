"""Training-data operators: secrets, language, packing, shards, duplicates, token files, media."""
