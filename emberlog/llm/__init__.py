"""Operators that prepare text corpora: cleaning, deduplication, mixing, packing and sharding."""
