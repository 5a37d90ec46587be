"""Training-data operators: tokenisers, near-duplicate joins, filters, scoring and packing.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its queries
(``umbra.llm.registry``) only where it can be imported.
"""
