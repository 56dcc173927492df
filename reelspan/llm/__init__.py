"""Training-data operators: deduplication, joins on similarity, archives, scans, search and packing.

Nothing else in the library imports this subpackage.
"""
