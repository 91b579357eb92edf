"""Operators that prepare training text: rules, mixing, shards, scans, language, fingerprints, quality, packing."""
