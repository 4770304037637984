"""Operators of a training-data pipeline over ``documents``, ``embeddings`` and ``conversations``.

Nothing else in the library imports this subpackage.  Each operator module
has a general function (texts, spans and tables in and out) and a thin
``opN_<name>(spark, sf_dir)`` query that derives the contract's columns.
"""
