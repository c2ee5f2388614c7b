"""Training-data operators: mixing, filtering, scanning, search, dedup, scoring, encoding."""
