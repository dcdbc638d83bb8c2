"""Training-data operators: deduplication, decontamination, filtering, extraction, formatting and mixing.

Nothing else in the library imports this subpackage.
"""
