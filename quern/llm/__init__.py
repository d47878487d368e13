"""Training-data operators: tokenising, classifying, mixing, deduplicating and scanning document tables."""
