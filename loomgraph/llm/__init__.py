"""Training-data operators: token accounting, deduplication, quality, toxicity, licences and packing.

Nothing outside this subpackage imports it; ``queries.py`` lists its queries and their SQL.
"""
