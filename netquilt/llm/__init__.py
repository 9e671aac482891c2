"""Operators for large text corpora: filtering, near-duplicates, search, sharding, archives.

Nothing outside this package imports it; ``__spark_entry__`` registers its
queries only when the package is there.
"""
