"""Training-data operators: deduplication, filtering, tokenizing, scoring and formatting of text corpora."""
