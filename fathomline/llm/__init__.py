"""Operators for preparing training corpora: extraction, filtering, deduplication, packing and mixing.

Nothing else in the library imports this subpackage; ``queries.py`` here registers its queries.
"""
