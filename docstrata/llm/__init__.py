"""Training-data operators: packing, toxicity, decontamination, search, dedup, quality, sharding, counts, licences."""
