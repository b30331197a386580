"""Exact top-k by inner product, by distributed histogram selection.

Every candidate is scored against a block of queries.  A round counts scores
into one histogram a query, over the bin that the round before left; each task
sends the tail of its histogram that can matter (bins down to its own k-th
score), sums are taken over tasks, and the bin with the k-th score is the next
range.  When bins are one integer wide the k-th score is known.  A last pass
keeps scores of at least that value; ties are broken by the smaller id, within
tasks first, so that a crowd of equal scores isn't shuffled.

Queries come in blocks of bounded size, which are all that is broadcast;
candidates stream past each block.

Components are turned into ``floor(scale * x)``.  Vectors that are null, or hold
null or non-finite components, take no part.  Vectors score only against those
of their own length.  Of queries that repeat an id the least vector is asked;
repeated candidates all count, except that none with the query's own id does.
Vectors of any length are taken; empty tables give an empty one; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import fresh_path, read_table

#: Queries of a block, candidates scored at a time, bins of a histogram.
QUERY_BLOCK, ROWS, BINS = 4096, 2048, 1024


def _vectors(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = table.select(table[id_col].cast("long").alias("id"), table[vec_col].cast("array<double>").alias("v"))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite)


def _matrix(lists: pa.Array, dim: int, scale: int) -> np.ndarray:
    flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64)
    return np.floor(scale * flat).reshape(len(lists), dim)


class _Block:
    """Queries of one length, and where the search for their k-th scores stands."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, bound: float):
        self.ids, self.k = ids, k
        #: Sums below 2^24 are whole in single precision, below 2^53 in double.
        self.kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else object
        self.vectors = vectors.astype(self.kind) if self.kind is not object else np.vectorize(int, otypes=[object])(vectors)
        self.width = max(1, -(-(2 * int(bound) + 1) // BINS))
        self.low = np.full(len(ids), -int(bound), np.int64)

    def scores(self, lists: pa.Array, scale: int) -> np.ndarray:
        m = _matrix(lists, self.vectors.shape[1], scale)
        m = m.astype(self.kind) if self.kind is not object else np.vectorize(int, otypes=[object])(m)
        return np.dot(m, self.vectors.T).astype(np.int64)

    def others(self, ids: np.ndarray, scores: np.ndarray, least: int) -> np.ndarray:
        """Scores with those of a query's own id put below all."""
        rows, cols = np.nonzero(ids[:, None] == self.ids[None, :])
        scores[rows, cols] = least
        return scores


NONE = np.iinfo(np.int64).min


def _batches(batches):
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            part = b.slice(at, ROWS)
            if part.num_rows:
                yield np.asarray(part.column("id").to_numpy(), np.int64), part.column("v")


def _histograms(candidates: DataFrame, block, scale: int) -> DataFrame:
    """``q, bin, n``; bin BINS holds what lies above the range, which earlier rounds have counted."""
    schema = pa.schema([("q", pa.int32()), ("bin", pa.int32()), ("n", pa.int64())])

    def run(batches):
        q = block.value
        n = len(q.ids)
        counts = np.zeros((n, BINS + 1), np.int64)
        column = np.arange(n)[None, :] * (BINS + 1)
        for ids, lists in _batches(batches):
            s = q.others(ids, q.scores(lists, scale), NONE)
            bins = np.clip((s - q.low[None, :]) // q.width, -1, BINS)
            keep = (bins >= 0) & (s != NONE)
            counts += np.bincount((column + bins)[keep], minlength=n * (BINS + 1)).reshape(n, BINS + 1)
        down = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]  # scores in this bin or above
        above = down - counts
        rows, cols = np.nonzero((counts > 0) & (above < q.k))
        if len(rows):
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(cols, pa.int32()), pa.array(counts[rows, cols], pa.int64())], schema=schema)

    return candidates.mapInArrow(run, "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))


def _narrow(found: DataFrame, q: _Block) -> None:
    """Move each query's range into the bin that holds its k-th score, or its last one where fewer are."""
    w = Window.partitionBy("q").orderBy(F.desc("bin"))
    above = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1))
    bins = found.withColumn("above", F.coalesce(above, F.lit(0))).where(F.col("above") < q.k)
    at = np.full(len(q.ids), 0, np.int64)
    for r in bins.groupBy("q").agg(F.min("bin").alias("bin")).collect():  # one row for each query of the block
        at[r["q"]] = r["bin"]
    q.low = q.low + np.minimum(at, BINS - 1) * q.width


def _winners(candidates: DataFrame, block, scale: int) -> DataFrame:
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def best(parts, k):
        q, ids, s = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.lexsort((ids, -s, q))
        q, ids, s = q[order], ids[order], s[order]
        first = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
        begins = np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
        keep = np.arange(len(q)) - begins < k
        return q[keep], ids[keep], s[keep]

    def run(batches):
        q = block.value
        parts, held = [], 0
        for ids, lists in _batches(batches):
            s = q.others(ids, q.scores(lists, scale), NONE)
            rows, cols = np.nonzero((s >= q.low[None, :]) & (s != NONE))
            parts.append((cols, ids[rows], s[rows, cols]))
            held += len(rows)
            if held > 1 << 20:
                parts = [best(parts, q.k)]
                held = len(parts[0][0])
        if parts:
            cols, ids, s = best(parts, q.k)
            yield pa.RecordBatch.from_arrays([pa.array(q.ids[cols], pa.int64()), pa.array(ids, pa.int64()), pa.array(s, pa.int64())], schema=schema)

    return candidates.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(queries: DataFrame, candidates: DataFrame, k: int, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k highest scores, ties to the smaller id."""
    spark = candidates.sparkSession
    asked, rows = _vectors(queries, id_col, vec_col).groupBy("id").agg(F.min("v").alias("v")), _vectors(candidates, id_col, vec_col)
    path, found = fresh_path(spark, "winners"), False
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + F.pow(F.floor(x * scale).cast("double"), 2)))
    # one row for each length of vectors
    lengths = asked.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(norm).alias("norm")).collect()
    for length in sorted(lengths, key=lambda r: r["dim"]):
        own = rows.where(F.size("v") == length["dim"])
        bound = (own.agg(F.max(norm)).first()[0] or 0.0) * length["norm"] + 1
        blocks = -(-2 * length["n"] // QUERY_BLOCK) if length["n"] > QUERY_BLOCK else 1
        block_of = F.pmod(F.xxhash64("id"), F.lit(blocks))
        for i in range(blocks):
            got = asked.where((F.size("v") == length["dim"]) & (block_of == i)).toArrow()
            if not got.num_rows:
                continue
            got = got.sort_by("id").combine_chunks()
            q = _Block(got.column("id").to_numpy(), _matrix(got.column("v").chunk(0), length["dim"], scale), k, bound)
            while True:
                sent = spark.sparkContext.broadcast(q)
                if q.width == 1 and getattr(q, "done", False):
                    break
                q.done = q.width == 1
                _narrow(_histograms(own, sent, scale), q)
                sent.destroy()
                q.width = max(1, -(-q.width // BINS))
            # written block by block, so that the last plan doesn't grow with the number of blocks
            _winners(own, sent, scale).write.mode("append").parquet(path)
            sent.destroy()
            found = True
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = spark.read.schema("query_id long, vec_id long, score long").parquet(path)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return top_k(vectors.where("vec_id % 50 = 0"), vectors, 5)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
