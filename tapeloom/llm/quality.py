"""Byte-level convolutional quality classifier in numpy.

A text's bytes are embedded; learned filters slide over them; each filter's
response is max-pooled within overlapping chunks that cover the whole document.
The chunks' maxima are combined twice, by their maximum and by their mean, and a
logistic unit makes one probability of them.

As a filter is linear in the embeddings, its response is a sum of table rows,
one table for each place of the filter; training keeps the tables' factors
(embedding and filter weights) and scoring looks bytes up in their products.

The classifier is fitted on a bounded sample: at most ``per_class`` labelled ids
of each class, the lowest by a 64-bit hash of the id, and of each the least of
its texts, if no longer than ``most_bytes``.  Scoring takes whole texts of any
length, in blocks; a text's score depends on its own bytes alone.

Null and empty texts are scored as a text of padding only.  Repeated rows are
scored each time, rows with a null id as well; an empty table gives an empty
one; other columns pass through, whatever their names but for those that begin
with ``__tl_``.  Where a class is missing in the labels, the score is the other
class's share.  Labels, language, source and id are never inputs of a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.common import hash_below, read_table
from tapeloom.llm.language_id import held_out
from tapeloom.llm.tokens import text_slices

#: Labelled documents of each class at most, and bytes of the longest, that the classifier is fitted on.
PER_CLASS, MOST_BYTES = 1200, 24_000
WIDTH, FILTERS, EMBED = 6, 16, 8
#: Bytes of a segment; a chunk is CHUNK segments, of which it shares one with the next.
SEGMENT, CHUNK = 64, 8
#: Passes over the sample, or as many as make STEPS batches.
EPOCHS, STEPS, BATCH, RATE = 14, 1000, 32, 0.01
#: Positions convolved at a time.
BLOCK = 1 << 15
THRESHOLD = 0.7


def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in one array, each text padded with zeros to whole segments and at least a filter's width; segments by text."""
    n = np.array([-(-(len(t) + WIDTH) // SEGMENT) for t in texts], np.int64)
    return np.frombuffer(b"".join(t.ljust(s * SEGMENT, b"\0") for t, s in zip(texts, n.tolist())) + bytes(WIDTH), np.uint8), n


def chunk_bounds(segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-last segment of each chunk over all texts, as pairs for reduceat; chunks by text."""
    step = CHUNK - 1
    chunks = np.maximum(1, -(-(segments - 1) // step))
    first = np.concatenate([[0], np.cumsum(segments)[:-1]])
    k = np.arange(chunks.sum()) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    start = np.repeat(first, chunks) + k * step
    end = np.minimum(start + CHUNK, np.repeat(first + segments, chunks))
    return np.stack([start, end], axis=1).ravel(), chunks


class ByteCnn:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {
            "embed": r.normal(0, 0.3, (256, EMBED)),
            "filters": r.normal(0, 0.3, (WIDTH, EMBED, FILTERS)),
            "bias": np.zeros(FILTERS),
            "out": r.normal(0, 0.1, 2 * FILTERS),
            "last": np.zeros(1),
        }
        self.constant: float | None = None

    def tables(self) -> np.ndarray:
        return np.einsum("be,wef->wbf", self.p["embed"], self.p["filters"]).astype(np.float32)

    def segment_maxima(self, tables: np.ndarray, data: np.ndarray, segments: np.ndarray, places: bool = False):
        """Each filter's largest response in each segment, and where it is.

        Places at a text's end, where a filter would reach into the next text, don't count.
        """
        total = len(data) - WIDTH
        beyond = (np.cumsum(segments)[:, None] * SEGMENT - np.arange(WIDTH - 1, 0, -1)).ravel()
        best = np.empty((total // SEGMENT, FILTERS), np.float32)
        where = np.empty((total // SEGMENT, FILTERS), np.int64) if places else None
        for at in range(0, total, BLOCK):
            n = min(BLOCK, total - at)
            r = tables[0][data[at : at + n]]
            for w in range(1, WIDTH):
                r += tables[w][data[at + w : at + w + n]]
            first, last = np.searchsorted(beyond, (at, at + n))
            r[beyond[first:last] - at] = -np.inf
            r = r.reshape(-1, SEGMENT, FILTERS)
            own = slice(at // SEGMENT, (at + n) // SEGMENT)
            if places:
                arg = r.argmax(axis=1)
                best[own] = np.take_along_axis(r, arg[:, None], axis=1)[:, 0]
                where[own] = arg + (np.arange(own.start, own.stop) * SEGMENT)[:, None]
            else:
                best[own] = r.max(axis=1)
        return best, where

    def features(self, seg: np.ndarray, segments: np.ndarray):
        bounds, chunks = chunk_bounds(segments)
        padded = np.concatenate([seg, np.full((1, FILTERS), -np.inf, np.float32)])
        pooled = np.maximum(np.maximum.reduceat(padded, bounds, axis=0)[::2] + self.p["bias"].astype(np.float32), 0)
        starts = np.cumsum(chunks) - chunks
        top = np.maximum.reduceat(pooled, starts, axis=0)
        mean = np.add.reduceat(pooled, starts, axis=0) / chunks[:, None]
        return pooled, bounds, chunks, starts, np.concatenate([top, mean], axis=1)

    def score(self, texts: list[bytes], tables: np.ndarray | None = None) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        data, segments = layout(texts)
        seg, _ = self.segment_maxima(self.tables() if tables is None else tables, data, segments)
        z = self.features(seg, segments)[-1] @ self.p["out"] + self.p["last"]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def gradients(self, texts: list[bytes], y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss.  Through the maxima a filter learns from one place of each chunk only."""
        data, segments = layout(texts)
        seg, where = self.segment_maxima(self.tables(), data, segments, places=True)
        pooled, bounds, chunks, starts, x = self.features(seg, segments)
        z = x @ self.p["out"] + self.p["last"]
        d = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        g = {"out": x.T @ d, "last": np.array([d.sum()])}
        dx = d[:, None] * self.p["out"]
        doc = np.repeat(np.arange(len(texts)), chunks)
        dp = (dx[:, FILTERS:] / chunks[:, None])[doc]
        is_top = pooled == x[doc, :FILTERS]
        first = np.zeros_like(is_top)  # of equal maxima the first alone
        k, f = np.nonzero(is_top)
        _, once = np.unique(doc[k] * FILTERS + f, return_index=True)
        first[k[once], f[once]] = True
        dp = (dp + np.where(first, dx[:, :FILTERS][doc], 0)) * (pooled > 0)
        g["bias"] = dp.sum(axis=0)
        # the segment of each chunk's maximum
        start, end = bounds[::2], bounds[1::2]
        offsets = start[:, None] + np.arange(CHUNK)
        inside = offsets < end[:, None]
        own = np.where(inside[:, :, None], seg[np.minimum(offsets, len(seg) - 1)], -np.inf)
        place = np.take_along_axis(where[np.minimum(offsets, len(seg) - 1)], own.argmax(axis=1)[:, None], axis=1)[:, 0]
        k, f = np.nonzero(dp)
        v, at = dp[k, f], place[k, f]
        g["embed"], g["filters"] = np.zeros_like(self.p["embed"]), np.zeros_like(self.p["filters"])
        for w in range(WIDTH):
            b = data[at + w]
            table = np.bincount(b.astype(np.int64) * FILTERS + f, weights=v, minlength=256 * FILTERS).reshape(256, FILTERS)
            g["embed"] += table @ self.p["filters"][w].T
            g["filters"][w] = self.p["embed"].T @ table
        return g

    def fit(self, texts: list[bytes], y: np.ndarray, prior: float, seed: int = 7) -> ByteCnn:
        """Adam over shuffled batches with both classes weighing the same; then the logit is moved to the classes' true shares."""
        if len(set(y.tolist())) < 2 or not texts:
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        r = np.random.default_rng(seed)
        m, s = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        step = 0
        epochs = max(EPOCHS, -(-STEPS * BATCH // len(texts)))
        for epoch in range(epochs):
            order = r.permutation(len(texts))
            for at in range(0, len(order), BATCH):
                own = order[at : at + BATCH]
                step += 1
                rate = RATE * (1 if epoch < epochs * 2 // 3 else 0.2)
                for k, g in self.gradients([texts[i] for i in own], y[own]).items():
                    m[k] += 0.1 * (g - m[k])
                    s[k] += 0.01 * (g * g - s[k])
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)
        share = y.mean()
        self.p["last"] += np.log(prior / (1 - prior)) - np.log(share / (1 - share))
        return self


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most_bytes: int = MOST_BYTES) -> ByteCnn:
    """Fit on labelled documents that aren't held out; of repeated labels of an id the lowest counts.

    The sample's ids are chosen among the labels: at most 2 x per_class, which
    are broadcast, so that no text is shuffled but theirs.  What comes to the
    driver is at most 2 x per_class x most_bytes bytes.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("label")).where(~held_out(4))
    counts = {r["label"]: r["n"] for r in own.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return ByteCnn().fit([], np.array(list(counts), float), 0.5)
    hashed = F.xxhash64("doc_id")
    chosen = [
        own.where(F.col("label") == k).where(hash_below(hashed, 2 * per_class, n)).orderBy(hashed, "doc_id").limit(per_class) for k, n in sorted(counts.items())
    ]
    short = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= most_bytes).select("doc_id", "text")
    one = short.join(F.broadcast(chosen[0].union(chosen[1])), "doc_id").groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    got = one.orderBy("doc_id").toArrow()
    texts = [t.encode() for t in got.column("text").to_pylist()]
    return ByteCnn().fit(texts, got.column("label").to_numpy().astype(float), counts[1] / (counts[0] + counts[1]))


def scores(docs: DataFrame, model: ByteCnn) -> DataFrame:
    """``docs``' columns with ``__tl_score``, the probability of label 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        tables = m.tables()
        for b in text_slices(batches, most=2 << 20):
            if not b.num_rows:
                continue
            texts = pc.fill_null(b.column("text"), "").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(m.score(texts, tables), pa.float64())], names=[*b.schema.names, "__tl_score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__tl_score", T.DoubleType())]))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit_quality(docs, read_table(spark, sf_dir, "labels"))
    rows = scores(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return rows.select("doc_id", held_out(4).alias("held_out"), F.col("__tl_score").alias("score"), (F.col("__tl_score") >= THRESHOLD).cast("int").alias("predicted"))
