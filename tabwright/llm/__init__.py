"""Operators of a training-data pipeline: near-duplicates, counting, scanning, filtering, packing, output.

Nothing else in the library imports this subpackage. ``queries`` holds the registered ``opN_*`` queries.
"""
