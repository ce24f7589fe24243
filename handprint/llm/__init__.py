"""Operators for building language-model training data from a corpus.

Nothing else in the library imports this subpackage.  ``queries.QUERIES``
and ``queries.SQL`` list its registered queries and their DuckDB SQL.
"""
