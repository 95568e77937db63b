"""Training-data operators: language ID, toxicity, dedup, mixing, LM scoring, WARC, packing."""
