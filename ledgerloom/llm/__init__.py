"""Training-data operators: quality, language, search, tokens, URLs, duplicates, mixing, toxicity, licences."""
