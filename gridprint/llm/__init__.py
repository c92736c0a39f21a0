"""Training-data operators: scans, deduplication, mixing, tokenisation, extraction."""
