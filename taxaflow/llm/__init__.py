"""Training-data operators: scoring, extraction, search, packing, near duplicates and decontamination.

Nothing outside this subpackage imports it.
"""
