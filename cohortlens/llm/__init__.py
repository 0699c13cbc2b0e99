"""Operations on text corpora: quality, duplicates, contamination, formatting, tokens, placement.

Nothing else in the library imports this subpackage.
"""
