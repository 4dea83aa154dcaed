"""Training-data pipeline operators (dedup, filtering, tokenising, packing).

Nothing outside this subpackage imports it.
"""
