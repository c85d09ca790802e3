"""Training-data operators: sharding, packing, substring dedup, language-model scoring, media
columns, near-duplicate joins, quality rules, URL filters, source mixing, web archives, conversation tries,
tokenizer alignment and MinHash groups.

Nothing else in the library imports this subpackage.
"""
