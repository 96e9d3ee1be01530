"""Operators for building training corpora: overlaps, near-duplicates, groups, packing, leaks and abusive content."""
