"""Operators that prepare large text and vector corpora for model training.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; `queries.py` holds the thin registered queries.
"""
