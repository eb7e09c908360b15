"""Operators that prepare text corpora and vectors for model training.

Nothing outside this subpackage imports it; it can be removed without touching the capture engine.
"""
