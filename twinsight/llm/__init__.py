"""Training-data operators: deduplication, token counting, filtering, packing, archives.

Nothing outside this folder imports it.
"""
