"""Training-data operators: decontamination, language ID, PII, token output, sharding, toxicity, quality resampling, near-dedup, mixing and media."""
