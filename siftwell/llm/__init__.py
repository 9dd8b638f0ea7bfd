"""Training-data operators: near-duplicate joins, repeat removal, mixing, fingerprints, licences, BPE, secrets, quality, HTML."""
