"""Queries as named nodes over the tables: run on Spark, or written as one DuckDB statement."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions.sqlkit import DUCK, Operator, shown

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations")


@dataclass
class Node:
    op: Operator
    inputs: tuple[str, ...]
    params: dict = field(default_factory=dict)


NODES: dict[str, Node] = {}
#: Query name -> (node, columns to show).  ``~x`` is rounded to 6 places, ``~2:x`` to 2.
QUERIES: dict[str, tuple[str, str]] = {}


def node(name: str, op: Operator, *inputs: str, **params) -> str:
    for i in inputs:
        if i not in NODES and i not in TABLES:
            raise KeyError(f"{name} reads {i}, which isn't there")
    if name in NODES:
        raise KeyError(f"{name} is there twice")
    NODES[name] = Node(op, inputs, params)
    return name


#: Nodes whose rows Spark makes in another way than by their text: function, inputs.
SPARK: dict[str, Node] = {}


def on_spark(name: str, make, *inputs: str, **params) -> None:
    """Make a node's DataFrame by ``make`` of other nodes' DataFrames, with the same columns and rows; its text stays."""
    SPARK[name] = Node(make, inputs, params)


def query(name: str, columns: str, op: Operator | None = None, *inputs: str, **params) -> None:
    """Register a query: of a node of that name, made here if ``op`` is given, or of ``inputs[0]``."""
    if op is not None:
        node(name, op, *inputs, **params)
        QUERIES[name] = (name, columns)
    else:
        QUERIES[name] = (inputs[0], columns)


def _shown(columns: str) -> list[tuple[str, int | None]]:
    out = []
    for c in columns.split():
        if c.startswith("~"):
            digits, _, name = c[1:].rpartition(":")
            out.append((name, int(digits or 6)))
        else:
            out.append((c, None))
    return out


def frame(spark: SparkSession, sf_dir: str, name: str, made: dict[str, DataFrame] | None = None) -> DataFrame:
    """The node's DataFrame; nodes used twice are planned once."""
    made = {} if made is None else made
    if name not in made:
        if name in TABLES and name not in NODES:
            made[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        else:
            n = SPARK.get(name) or NODES[name]
            made[name] = n.op(*(frame(spark, sf_dir, i, made) for i in n.inputs), **n.params)
    return made[name]


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = QUERIES[name]
    df = frame(spark, sf_dir, source)
    return df.select(*[F.expr(shown(c, d)).alias(c) if d is not None else F.col(c) for c, d in _shown(columns)])


def duckdb_sql(name: str) -> str:
    source, columns = QUERIES[name]
    steps: list[str] = []

    def add(n: str) -> str:
        if n in TABLES and n not in NODES:
            return n
        own = NODES[n]
        names = [add(i) for i in own.inputs]
        text = f"n_{n} AS MATERIALIZED ({own.op.sql(DUCK, *names, **own.params)})"
        if text not in steps:
            steps.append(text)
        return f"n_{n}"

    table = add(source)
    listed = ", ".join(f"{shown(c, d)} AS {c}" if d is not None else c for c, d in _shown(columns))
    return f"WITH {', '.join(steps)} SELECT {listed} FROM {table}" if steps else f"SELECT {listed} FROM {table}"
