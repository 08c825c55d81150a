"""Training-data operators: language identification, deduplication, classification, mixing, packing.

Nothing else in the library imports this subpackage.
"""
