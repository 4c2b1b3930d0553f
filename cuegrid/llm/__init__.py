"""Training-data operators: scoring, deduplication, decontamination, sharding and packing of corpora."""
