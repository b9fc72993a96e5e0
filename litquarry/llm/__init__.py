"""Operators for training-data pipelines: tokens, packing, deduplication, decontamination, WARC.

Nothing outside this subpackage imports it.
"""
