"""Training-data operators: filtering, fingerprints, near-duplicates, packing and mixing."""
