"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Each module holds one operator
with a general interface plus the thin ``op<N>_<name>`` query over the driver
tables; ``queries.py`` gathers the queries and their SQL.
"""
