"""Training-data operators: near duplicates, packing, quality, search, language, tokens, archives, filters, personal data."""
