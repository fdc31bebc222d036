"""Training-data operators: tokenising, extraction, packing, scans, search, filters and near-duplicate joins.

Nothing else in the library imports this subpackage.
"""
