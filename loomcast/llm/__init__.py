"""Training-data operators: packing, dedup, language ID, archives, tokenisation, binary records.

Nothing else in the library imports this subpackage.
"""
