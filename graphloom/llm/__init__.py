"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it. Every operator takes DataFrames with
the columns it names; other columns, also ones whose names clash with its own
working columns, are ignored because each operator first projects what it reads.
"""
