"""Training-data operators: dedup, token stores, fingerprints, sharding,
mixing, URL filters, tokenization and toxicity scoring on Spark."""
