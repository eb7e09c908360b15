"""Column functions over captures, payloads, ranges and names."""
