"""Operators for preparing language-model training data on Spark.

Nothing outside this subpackage imports it.  Each module holds one operator
with a general interface; ``queries.py`` holds the thin contract queries.
"""
