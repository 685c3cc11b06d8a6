"""Training-data operators: text quality, deduplication, decontamination, tokens, archives."""
