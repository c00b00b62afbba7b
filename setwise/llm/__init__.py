"""Operators for preparing training text: deduplication, filtering, labelling, sharding and tokenising."""
