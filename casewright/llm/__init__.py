"""Training-data operators: packing, licence scans, near-duplicates, tokenizing, PII, toxicity, language ID."""
