"""Operators for large-scale training-data preparation, as Spark jobs.

Nothing outside this subpackage imports it (``corpus_pipeline.py`` is counted
as part of it); the registry adds its queries only when it can be imported.
"""
