"""Training-data operators: formatting, sharding, near-duplicates, filters, archives.

Nothing outside this subpackage imports it.
"""
