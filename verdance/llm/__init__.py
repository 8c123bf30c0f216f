"""Operators for preparing training text at scale.

Nothing outside this package imports it.  ``registry.queries()`` and
``registry.oracle_sql()`` list what it offers to the entry module.
"""
