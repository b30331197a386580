"""Operators for preparing language-model training data.

Every module holds one operator with its own general interface and one thin
``opN_*`` query over the given tables.  Nothing outside this subpackage imports
it.
"""

from __future__ import annotations


def queries():
    """Name -> ``f(spark, sf_dir)`` for all operators of this subpackage."""
    from tapeloom.llm import catalog

    return catalog.queries()


def oracle_sql():
    """Name -> DuckDB SQL for those queries that SQL can express."""
    from tapeloom.llm import catalog

    return catalog.oracle_sql()
