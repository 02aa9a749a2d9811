"""Operators a large training-data pipeline needs, one module per operator.

Nothing outside this subpackage imports it.  ``queries`` registers one query
per operator; ``corpus_pipeline.py`` at the repository top chains five of them.
"""
