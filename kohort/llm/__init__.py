"""Operators of a training-data pipeline, each a Spark job of its own method.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
