"""All registered queries of the analytics engine and their DuckDB twins."""

from __future__ import annotations

from functools import partial

from tapeloom.plans import graph, learned
from tapeloom.plans import market  # noqa: F401  registers the queries


def flagship(spark, sf_dir):
    return graph.run(spark, sf_dir, "entry_scan" if "entry_scan" in graph.QUERIES else "b1_daily_bars")


#: Folds over sequences: tested against plain Python.
NO_SQL = {"p6_latent_states", "p6_latent_states_whole"}


def queries():
    return {name: partial(_run, name) for name in graph.QUERIES} | learned.QUERIES


def _run(name, spark, sf_dir):
    return graph.run(spark, sf_dir, name)


def oracle_sql():
    plain = {name: graph.duckdb_sql(name) for name in graph.QUERIES if name not in NO_SQL}
    return plain | {name: f"SELECT {columns} FROM ({plain[of]}) x" for name, (of, columns) in learned.SQL_OF.items()}
