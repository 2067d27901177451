"""Operators of a large-scale training-data pipeline.

Nothing outside this package imports it; ``__spark_entry__`` adds its
queries (``tablework.llm.queries``) when the package is present.
"""
