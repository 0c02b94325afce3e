"""Training-data operators: dedup, tokenizing, packing, filtering, formatting.

Nothing outside this subpackage imports it. ``tesserine.llm.registry`` lists
the queries and their SQL.
"""
