"""Operators for large training-data pipelines.

One module per operator; ``queries.py`` registers them with their oracle SQL.
Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
