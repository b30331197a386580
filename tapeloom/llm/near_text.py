"""Near-duplicate texts: SimHash balls and bands of shingle minima find pairs, word 5-gram shingles confirm them.

Used by the corpus pipeline, where near-duplicates are texts whose sets of word
5-grams have a Jaccard similarity of at least 0.8.  Candidates come first from
the SimHash operator: fingerprints of the 5-word shingles within 2 bits, found
by ball hashing.  As fingerprints of texts at 0.8 may differ in more bits, what
they miss is found by ROWS * BANDS minima of each set under as many hashes; ROWS
of them make the key of a band, and texts with a key in common are candidates.
A pair of similarity J has no key in common with probability
(1 - J ** ROWS) ** BANDS, which is 1.1e-10 at 0.8 and less above, whatever the
length of the texts.  Candidates are verified on the shingles.

Texts of the same words in the same order are one class first, by a digest, and
cost one row each after that.  In a key's bucket a class is first compared with
the least id there, with its neighbour, and with the class that shares the most
keys with others: among edits of one text that is the text itself.  What this
links needs no more comparing.  Where a bucket's classes still aren't linked, so
that a failed check may hide a pair, the rest is found by an exact prefix filter
over those classes: of two sets of a similarity of at least s, the rarest
n - ceil(s n) + 1 shingles of each, rarest first, have one in common, and the
first such stands early enough in both to leave room for what they must share.

Null and empty texts are copies of each other.  A text of one to four words is
one shingle.  Rows with a null id take no part.  Rows that share an id, repeated
ones among them, stay or go together; other than copies they are found by each
of their texts and verified on the least.  Texts of any length are read whole; an
empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import cut, materialize
from tapeloom.llm.simhash import _signed, components, fingerprint, linked_neighbours, shingle_hashes
from tapeloom.llm.tokens import text_slices

SHINGLE, SIMILAR = 5, 0.8
#: Minima in a band's key, and bands.
ROWS, BANDS = 3, 32
#: Shingles whose ROWS * BANDS hashes are made at a time.
BLOCK = 1 << 10

_SALTS = np.random.default_rng(42).integers(0, 1 << 64, ROWS * BANDS, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _distinct(blocks: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(blocks)) if blocks else np.empty(0, np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    return _distinct(list(shingle_hashes(text, SHINGLE)))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One key for each band; none for a text without shingles."""
    if not len(shingles):
        return np.empty(0, np.int64)
    least = np.full(len(_SALTS), ~np.uint64(0))
    for at in range(0, len(shingles), BLOCK):
        least = np.minimum(least, _mixed(shingles[at : at + BLOCK, None] ^ _SALTS).min(axis=0))
    key = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = _mixed(key ^ row) + row
    return key.view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """``id, class_key, n, fp, keys``: digest of the words, number of shingles, SimHash fingerprint, a key for each band."""
    schema = pa.schema([("id", pa.int64()), ("class_key", pa.binary()), ("n", pa.int64()), ("fp", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches):
        for b in text_slices(batches):
            texts = b.column("text").to_pylist()
            digests = [hashlib.sha256(b" ".join((t or "").encode().lower().split())).digest()[:16] for t in texts]
            n, prints, keys = [], [], []
            for t in texts:
                blocks = list(shingle_hashes(t, SHINGLE))
                own = _distinct(blocks)
                n.append(len(own))
                prints.append(_signed(fingerprint(blocks)))
                keys.append(band_keys(own))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(digests, pa.binary()), pa.array(n, pa.int64()), pa.array(prints, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], schema=schema)

    return docs.mapInArrow(run, "id long, class_key binary, n long, fp long, keys array<long>")


def _buckets(classes: DataFrame) -> DataFrame:
    """``key, node, n, prev, head, lead`` of the buckets with more than one class: the neighbour before, the least id, the class with most company."""
    one = classes.select("node", "n", F.explode("keys").alias("key"))
    w = Window.partitionBy("key").orderBy("node")
    sized = one.join(one.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "key")
    sized = materialize(sized, "sized")
    company = sized.groupBy("node").agg(F.sum("size").alias("company"))
    lead = sized.join(company, "node").groupBy("key").agg(F.max_by("node", F.struct("company", "node")).alias("lead"))
    ranked = sized.select("key", "node", "n", F.lag("node").over(w).alias("prev"), F.min("node").over(Window.partitionBy("key")).alias("head"))
    return ranked.join(lead, "key")


def _first_pairs(buckets: DataFrame) -> DataFrame:
    """Pairs ``a < b``: each class with its neighbour, with the least of its bucket and with the leading one."""
    others = F.explode(F.array("prev", "head", "lead")).alias("other")
    pairs = buckets.select("node", others).where("other is not null")
    return pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).where("a < b").distinct()


def _other_pairs(buckets: DataFrame, sets: DataFrame, first: DataFrame, found: DataFrame, similar: float) -> DataFrame:
    """All other pairs ``a < b`` that may be similar, of classes whose buckets aren't linked so far."""
    labelled = buckets.select("key", "node").join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c"))
    apart = labelled.groupBy("key").agg(F.count("*").alias("size"), F.min("c").alias("low"), F.max("c").alias("high")).where("size > 2 and low < high").select("key")
    own = cut(labelled.join(apart, "key").select("node", "c").distinct())
    rows = own.join(sets, "node").select("node", "c", F.explode(_unpacked(F.col("shingles"))).alias("shingle"))
    rows = materialize(rows, "rows")
    common = rows.groupBy("shingle").agg(F.count("*").alias("df"))
    w = Window.partitionBy("node").orderBy("df", "shingle")
    ranked = rows.join(common, "shingle").select("node", "c", "shingle", "df", F.row_number().over(w).alias("rank"), F.count("*").over(Window.partitionBy("node")).alias("n"))
    prefix = materialize(ranked.where(F.col("rank") <= F.col("n") - F.ceil(similar * F.col("n") - 1e-9) + 1).where("df > 1").select("node", "c", "n", "shingle", "rank"), "prefix")
    x = prefix.select("shingle", F.col("node").alias("a"), F.col("n").alias("na"), F.col("c").alias("ca"), F.col("rank").alias("ra"))
    y = prefix.select("shingle", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb"), F.col("rank").alias("rb"))
    # with their first shingle in common at these ranks, two sets can have no more than this in common
    enough = 1 + F.least(F.col("na") - F.col("ra"), F.col("nb") - F.col("rb")) >= similar / (1 + similar) * (F.col("na") + F.col("nb")) - 1e-9
    pairs = x.join(y, "shingle").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & (F.least("na", "nb") >= similar * F.greatest("na", "nb")) & enough)
    return pairs.select("a", "b").distinct().join(first, ["a", "b"], "left_anti")


def _unpacked(packed):
    """The 8-byte numbers of a binary column, as hexadecimal strings."""
    digits = F.hex(packed)
    return F.transform(F.sequence(F.lit(0), F.expr("greatest(octet_length(shingles) div 8 - 1, 0)")), lambda k: F.substring(digits, k * 16 + 1, F.lit(16)))


def _shingles(rows: DataFrame) -> DataFrame:
    """``node, shingles``: sorted distinct hashes of a text's shingles, packed."""
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])

    def run(batches):
        for b in text_slices(batches):
            packed = []
            for t in b.column("text").to_pylist():
                packed.append(shingle_set(t).astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(packed, pa.binary())], schema=schema)

    return rows.mapInArrow(run, "node long, shingles binary")


def _verified(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist()):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                small, large = sorted((len(x), len(y)))
                if small < similar * large:
                    keep.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similar * (len(x) + len(y) - both))
            keep = np.flatnonzero(keep)
            yield pa.RecordBatch.from_arrays([b.column("a").take(pa.array(keep)), b.column("b").take(pa.array(keep))], schema=schema)

    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    joined = joined.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def near_text_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """``id, component`` for every document that isn't the least id of its group of near-duplicates, nulls apart."""
    plain = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).where("id is not null")
    signed = materialize(signatures(plain), "signatures")
    classes = signed.groupBy("class_key").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    classes = cut(classes)
    alike = linked_neighbours(classes.where("n > 0").select("node", "fp"))
    alike = alike.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    alike = cut(alike)
    buckets = materialize(_buckets(classes), "buckets")
    first = cut(_first_pairs(buckets).union(alike).distinct())
    wanted = buckets.select("node").union(alike.select("a")).union(alike.select("b")).distinct()
    texts = plain.withColumnRenamed("id", "node").join(wanted, "node").groupBy("node").agg(F.min("text").alias("text"))
    sets = materialize(_shingles(texts), "shingles")
    edges = cut(_verified(first, sets, similar))
    found = components(edges)
    others = cut(_other_pairs(buckets, sets, first, found, similar))
    if others.count():
        found = components(edges.union(_verified(others, sets, similar)))
    keys = classes.join(found, "node", "left").select("class_key", F.coalesce("component", "node").alias("component"))
    return signed.join(keys, "class_key").groupBy("id").agg(F.min("component").alias("component")).where("id <> component")
