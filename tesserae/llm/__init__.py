"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  Every module holds one operator with a
general interface plus the thin ``opN_<name>(spark, sf_dir)`` query that applies it to a table.
"""
