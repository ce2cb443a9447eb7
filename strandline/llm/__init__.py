"""Operators for preparing text corpora: tokens, packing, dedup, filters, archives."""
