"""Training-data operators: deduplication, language ID, scoring, decontamination, mixing and sharding."""
