"""Corpus preparation: cleaning, matching, encoding and packing of incident report texts."""
