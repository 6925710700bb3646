"""Operators of a training-data pipeline: sharding, deduplication, fingerprints,
toxicity, pseudonyms, near-duplicate joins, packing, chat formatting, language
identification and tokenization.  Nothing else in the library imports this
subpackage."""
