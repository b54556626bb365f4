"""Operators that prepare text corpora for language-model training.

Each operator is one module; `queries` holds the thin registered queries.  Nothing
outside this subpackage imports it.
"""
