"""Training-data operators: dedup, filters, classifiers, mixing and sharding."""
