"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it.  Each module holds one operator
with a general interface and real outputs; ``queries.py`` derives from them the
thin ``opN_<name>`` queries.
"""
