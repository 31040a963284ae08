"""Operations for large training-data pipelines (tokenising, filtering, deduplication, search).

Nothing outside this subpackage imports it; it can be removed as a whole.
"""
