"""Training-data operators: scoring, extraction, near-duplicate search, packing.

Each module holds one operator with its general interface and the query that applies it to
the driver's tables; ``registry`` lists the queries and their SQL. Nothing outside this
subpackage imports it.
"""
