"""Operators for preparing training data: fingerprints, chat formatting, packing, exact search,
secret scans, deduplication, mixing and toxicity.  Nothing else in the library imports this package."""
