"""Training-data operators: language id, packing, near-duplicates, filters, sharding."""
