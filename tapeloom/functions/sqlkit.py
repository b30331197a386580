"""Expression helpers: SQL text for Spark, and for the DuckDB twins that tests and the driver compare with.

Missing values are NULL throughout: comparisons with them are closed by
``coalesce(.., false)`` where a flag is made, and helpers keep them missing.
"""

from __future__ import annotations

import functools
import inspect

from pyspark.sql import DataFrame

BY = "PARTITION BY symbol ORDER BY trade_date"


class Dialect:
    """The few functions whose names differ."""

    def __init__(self, name: str):
        self.name = name
        self.spark = name == "spark"

    def pick(self, spark: str, duck: str) -> str:
        return spark if self.spark else duck

    # arrays
    def collect(self, x: str) -> str:
        return self.pick(f"collect_list({x})", f"list({x})")

    def map(self, a: str, body: str, v: str = "x") -> str:
        return self.pick(f"transform({a}, {v} -> {body})", f"list_transform({a}, lambda {v}: {body})")

    def filter(self, a: str, cond: str, v: str = "x") -> str:
        return self.pick(f"filter({a}, {v} -> {cond})", f"list_filter({a}, lambda {v}: {cond})")

    def count_of(self, a: str, k) -> str:
        """How often a value is in an array."""
        return self.pick(f"(size({a}) - size(array_remove({a}, {k})))", self.size(self.filter(a, f"x = {k}")))

    def size(self, a: str) -> str:
        return self.pick(f"size({a})", f"CAST(len({a}) AS INTEGER)")

    def total(self, a: str) -> str:
        return self.pick(f"aggregate({a}, CAST(0 AS DOUBLE), (acc, x) -> acc + x)", f"coalesce(list_sum({a}), 0)")

    def at(self, a: str, i: str) -> str:
        return self.pick(f"get({a}, CAST(({i}) - 1 AS INT))", f"list_extract({a}, {i})")

    def span(self, a: str, first: str, n: str) -> str:
        return self.pick(f"slice({a}, {first}, {n})", f"list_slice({a}, {first}, {first} + {n} - 1)")

    def range(self, a: str, z: str) -> str:
        return self.pick(f"sequence({a}, {z})", f"range({a}, ({z}) + 1)")

    def explode(self, a: str) -> str:
        return self.pick(f"explode({a})", f"unnest({a})")

    # dates
    def week_end(self, x: str) -> str:
        """Friday on or after the date."""
        return self.pick(f"next_day(date_sub({x}, 1), 'FRI')", f"CAST({x} + CAST((12 - isodow({x})) % 7 AS INTEGER) AS DATE)")

    def weekday(self, x: str) -> str:
        """Monday is 0."""
        return self.pick(f"weekday({x})", f"(isodow({x}) - 1)")

    def days(self, a: str, b: str) -> str:
        return self.pick(f"datediff({a}, {b})", f"({a} - {b})")

    def seconds(self, a: str, b: str) -> str:
        """Seconds from b to a, as a double."""
        return self.pick(f"((unix_micros(CAST({a} AS TIMESTAMP)) - unix_micros(CAST({b} AS TIMESTAMP))) / 1000000D)", f"((epoch_us({a}) - epoch_us({b})) / 1000000.0::DOUBLE)")

    def bucket(self, ts: str, minutes: int) -> str:
        """Start of the tumbling interval that holds a timestamp."""
        return self.pick(f"window({ts}, '{minutes} minutes').start", f"time_bucket(INTERVAL '{minutes} minutes', {ts}, TIMESTAMP '1970-01-01')")

    def median(self, x: str) -> str:
        return f"median({x})"

    def quantile(self, x: str, p: float) -> str:
        return self.pick(f"percentile({x}, {p})", f"quantile_cont({x}, {p})")

    def join(self, sep: str, x: str, order: str) -> str:
        return self.pick(f"listagg({x}, '{sep}') WITHIN GROUP (ORDER BY {order})", f"string_agg({x}, '{sep}' ORDER BY {order})")


SPARK, DUCK = Dialect("spark"), Dialect("duckdb")


class Operator:
    """A relational operator: called with DataFrames it gives a DataFrame; ``sql`` gives its text."""

    def __init__(self, make):
        self.make = make
        functools.update_wrapper(self, make)
        self.inputs = [p.name for p in list(inspect.signature(make).parameters.values())[1:] if p.default is p.empty]

    def sql(self, dialect: Dialect, *names: str, **params) -> str:
        return self.make(dialect, *names, **params)

    def __call__(self, *frames: DataFrame, **params) -> DataFrame:
        named = dict(zip(self.inputs, frames, strict=True))
        text = self.make(SPARK, *(f"{{{n}}}" for n in named), **params)
        return frames[0].sparkSession.sql(text, **named)


def operator(make) -> Operator:
    return Operator(make)


# windows


def w(n: int, by: str = BY, end: int = 0) -> str:
    """Frame of the last n rows; ``end`` shifts its end back."""
    return f"OVER ({by} ROWS BETWEEN {n - 1 + end} PRECEDING AND {f'{end} PRECEDING' if end else 'CURRENT ROW'})"


def ahead(n: int, by: str = BY, start: int = 1) -> str:
    return f"OVER ({by} ROWS BETWEEN {start} FOLLOWING AND {n} FOLLOWING)"


def so_far(by: str = BY) -> str:
    return f"OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def rolling(agg: str, x: str, n: int, least: int | None = None, by: str = BY, end: int = 0) -> str:
    """An aggregate over the frame, missing below ``least`` values."""
    return f"CASE WHEN count({x}) {w(n, by, end)} >= {n if least is None else least} THEN {agg}({x}) {w(n, by, end)} END"


def lag(x: str, k: int = 1, by: str = BY) -> str:
    return f"lag({x}, {k}) OVER ({by})"


def lead(x: str, k: int = 1, by: str = BY) -> str:
    return f"lead({x}, {k}) OVER ({by})"


# scalars


def clip(x: str, lo, hi) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN least(greatest({x}, {lo}), {hi}) END"


def clip_term(x: str, scale: float) -> str:
    return clip(f"({x}) / {scale}", -1.0, 1.0)


def scaled(x: str, lo: float, hi: float) -> str:
    return clip(f"(({x}) - ({lo})) / {hi - lo}", 0.0, 1.0)


def centered(x: str, scale: float) -> str:
    return clip(f"0.5 + 0.5 * ({x}) / {scale}", 0.0, 1.0)


def triangular(x: str, lo: float, mid: float, hi: float) -> str:
    return f"CASE WHEN ({x}) IS NULL OR ({x}) <= {lo} OR ({x}) >= {hi} THEN 0.0 WHEN ({x}) <= {mid} THEN (({x}) - ({lo})) / {mid - lo} ELSE ({hi} - ({x})) / {hi - mid} END"


def div(a: str, b: str) -> str:
    """Missing where the divisor is 0, to within 1e-12."""
    return f"CASE WHEN abs({b}) > 1e-12 THEN ({a}) / ({b}) END"


def flag(cond: str) -> str:
    return f"coalesce({cond}, false)"


def bit(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1 ELSE 0 END"


def shannon(counts: list[str], n: str, base: float | None = None) -> str:
    """Entropy of counts that sum to n; over ``ln base`` if given."""
    terms = " + ".join(f"CASE WHEN {c} > 0 THEN ({c} / CAST({n} AS DOUBLE)) * ln({c} / CAST({n} AS DOUBLE)) ELSE 0 END" for c in counts)
    return f"-({terms})" + (f" / ln({base})" if base else "")


def shown(x: str, digits: int) -> str:
    """A double to so many places, alike in both engines: the offset keeps exact halves off the edge."""
    scale = f"1e{digits}"
    return f"floor({x} * {scale} + 0.5137e0) / {scale}"
