"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in at most ``2 r`` bits share a variant that
is within ``r`` bits of both.  Every distinct fingerprint emits all its variants
within ``r`` bits; they are shuffled by variant; neighbours in a variant's sorted
list of fingerprints (which geometry bounds: no more than the ball holds) become
edges once each and are verified.  With ``r = 1`` all members of a variant are
within 2 bits of each other, so the chain of neighbours links all of them.

Copies share a fingerprint and are one node; a hot fingerprint costs one row
after partial aggregation.  Components come from alternating stars over the
edges, checkpointed each round.

Null and empty texts have no shingle and fingerprint 0.  A document with a null
id gets its fingerprint and the component of its fingerprint, but is no
component's least id unless it stands alone (then null).  Repeated rows are
returned each time.  Rows that share an id with different texts keep their own
fingerprints, which link as others do.  Texts of any length are read whole, an
empty table gives an empty one, other columns are ignored.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import cut, materialize, read_table
from tapeloom.llm.tokens import text_slices

#: Shingles hashed at a time, so that a very long text needs no more memory than others.
BLOCK = 1 << 18


def shingle_hashes(text: str | None, words: int, seed: int = 42):
    """XXH64 of the word shingles of a text, repeats included, in blocks."""
    w = (text or "").encode().lower().split()  # bytes: lowers A-Z, splits at ASCII white space only
    if not w:
        return
    if len(w) <= words:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(w), seed)], np.uint64)
        return
    n = len(w) - words + 1
    for at in range(0, n, BLOCK):
        own = w[at : at + BLOCK + words - 1]
        grams = own if words == 1 else map(b" ".join, zip(*(own[k:] for k in range(words))))
        yield np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64, len(own) - words + 1)


def fingerprint(blocks) -> int:
    """Bit i is 1 if it is set in over half of the hashes."""
    ones, n = np.zeros(64, np.int64), 0
    for h in blocks:
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        n += len(h)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fp`` of every document; ``fp`` is the fingerprint as a signed long."""
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for b in text_slices(batches):
            fps = [_signed(fingerprint(shingle_hashes(t, words, seed))) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fps, pa.int64())], schema=schema)

    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).mapInArrow(run, "id long, fp long")


def ball(radius: int, bits: int = 64) -> list[int]:
    """All masks of at most ``radius`` of the bits, as signed longs."""
    masks = {0}
    for _ in range(radius):
        masks |= {m ^ (1 << i) for m in masks for i in range(bits)}
    return sorted(_signed(m) for m in masks if m.bit_count() <= radius)


def linked_neighbours(nodes: DataFrame, differing: int = 2, by: list[str] | None = None) -> DataFrame:
    """Edges ``a, b`` between nodes (``node, fp``; one row a fingerprint) that differ in at most ``differing`` bits.

    Every variant's nodes are linked in a chain; the extra columns ``by`` keep
    families of fingerprints apart.
    """
    by = by or []
    half = (differing + 1) // 2
    masks = F.array(*[F.lit(m) for m in ball(half)])
    variants = nodes.select("node", "fp", *by, F.explode(masks).alias("mask")).select("node", "fp", *by, F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    w = Window.partitionBy("variant", *by).orderBy("node")
    pairs = variants.select(F.lag("node").over(w).alias("a"), F.col("node").alias("b"), F.lag("fp").over(w).alias("fa"), "fp").where(F.col("a").isNotNull())
    return pairs.where(F.bit_count(F.col("fa").bitwiseXOR(F.col("fp"))) <= differing).select("a", "b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, component`` for every node with an edge: the least node it is connected with.

    Alternating large and small stars (each node links its neighbours to the
    least of them) until the edges stand still; the number of rounds grows with
    the logarithm of the longest path.
    """

    def stars(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select("b", "a")) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")) if large else both.groupBy("a").agg(F.min("b").alias("m"))
        joined = both.join(least, "a")
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(rounds):
        e = cut(stars(stars(e, True), False))
        new = tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def near_duplicates(docs: DataFrame, words: int = 3, differing: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fp, component`` of every document; fingerprints within ``differing`` (at most 2) bits link."""
    if differing > 2:
        raise ValueError("chains of neighbours are whole for up to 2 bits only")
    prints = materialize(fingerprints(docs, words, 42, id_col, text_col), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("id").alias("node"))
    found = components(linked_neighbours(nodes.where("node is not null"), differing))
    classes = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    return prints.join(classes, "fp")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(read_table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
