"""Exact line dedup behind two Bloom filters.

Pass 1 hashes every document's distinct line keys into two Bloom filters: bits
seen once, and bits seen again.  Each task sends the bits it has set, by segment
of the filter; segments are merged as a stream, where a bit that two tasks have
seen counts as seen again.  Pass 2 keeps only the lines whose bits are all in
the second filter: suspected repeats, with no false negatives.  Those alone are
shuffled, by a cryptographic digest of the whole key, to confirm that two
documents hold them and to find the first.  Documents then lose the confirmed
lines.

The filter has ``bits_per_line`` bits for each line of the input, up to
``max_bits``; that bounds what is sent to the tasks.  Beyond it more lines are
suspected and shuffled, and results stay the same.

A null or empty text is one empty line.  Documents with a null id are neither
counted nor changed.  Rows that share a ``doc_id`` are one document in the
count; each loses its own lines, by its text.  A line that a document repeats is
lost each time or never.  Texts of any length are worked on whole; an empty
table gives an empty one.  Other columns pass through ``dedup_lines`` unchanged,
whatever their names but for those that begin with ``__tl_``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.common import cut, read_table
from tapeloom.llm.tokens import text_slices

STRIPPED = " \t\n\x0b\x0c\r"
#: Bits of a segment, the unit in which filters are merged.
SEGMENT = 1 << 18
HASHES = 2


def _keys(texts: pa.Array, least: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of all lines of some texts whose key is long enough: the text's place, the line's place in it, the key."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    keys = pc.ascii_lower(pc.ascii_trim(lists.flatten(), characters=STRIPPED))
    long = np.flatnonzero(pc.utf8_length(keys).to_numpy(zero_copy_only=False) >= least)
    text = np.repeat(np.arange(len(n)), n)[long]
    return text, long - (np.cumsum(n) - n)[text], keys.take(pa.array(long)).cast(pa.binary())


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bit numbers of each hash, a row for each hash function; ``bits`` is a power of 2."""
    mask = np.uint64(bits - 1)
    return np.stack([hashes & mask, (hashes >> np.uint64(32)) & mask])


def _digest(key: bytes) -> bytes:
    return hashlib.sha256(key).digest()


def _partial_filters(docs: DataFrame, bits: int, least: int) -> DataFrame:
    """Bits that each task has seen once and again, by segment, as sorted bit numbers within it."""
    schema = pa.schema([("segment", pa.int32()), ("again", pa.bool_()), ("places", pa.binary())])

    def run(batches):
        once, again = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for b in text_slices(batches):
            b = b.filter(pc.is_valid(b.column("id")))
            text, _, keys = _keys(b.column("text"), least)
            if not len(keys):
                continue
            own = _hashes(keys.to_pylist())
            # a key that a document repeats counts once
            order = np.lexsort((own, text))
            own, text = own[order], text[order]
            new = np.append(True, (own[1:] != own[:-1]) | (text[1:] != text[:-1]))
            for row in _places(own[new], bits):
                place, times = np.unique(row, return_counts=True)
                byte, bit = (place >> np.uint64(3)).astype(np.int64), np.left_shift(1, (place & np.uint64(7)).astype(np.int64)).astype(np.uint8)
                seen = (once[byte] & bit) != 0
                np.bitwise_or.at(once, byte, bit)
                both = seen | (times > 1)
                np.bitwise_or.at(again, byte[both], bit[both])
        size = min(SEGMENT, bits) // 8
        for k in range(bits // 8 // size):
            for flag, filt in ((False, once), (True, again)):
                own = filt[k * size : (k + 1) * size]
                if own.any():
                    set_ = np.flatnonzero(np.unpackbits(own, bitorder="little")).astype("<u4")
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([flag]), pa.array([set_.tobytes()], pa.binary())], schema=schema)

    return docs.mapInArrow(run, "segment int, again boolean, places binary")


def _merged(partials: DataFrame, bits: int) -> DataFrame:
    """For each segment the bits seen again, in one task or by two.  A task holds its segments' bits only."""
    schema = pa.schema([("segment", pa.int32()), ("bits", pa.binary())])
    size = min(SEGMENT, bits)

    def run(batches):
        state: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for k, again, places in zip(b.column("segment").to_pylist(), b.column("again").to_pylist(), b.column("places").to_pylist()):
                once, twice = state.setdefault(k, (np.zeros(size, bool), np.zeros(size, bool)))
                place = np.frombuffer(places, "<u4")
                if again:
                    twice[place] = True
                else:
                    twice[place[once[place]]] = True
                    once[place] = True
        for k, (_, twice) in state.items():
            if twice.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())], schema=schema)

    return partials.repartition("segment").mapInArrow(run, "segment int, bits binary")


def repeat_filter(docs: DataFrame, least: int, bits_per_line: int, max_bits: int) -> np.ndarray:
    """The filter of bits seen again, over all lines.  At most ``max_bits``, the bound of what the driver sends on."""
    lines = docs.agg(F.sum(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"))) + 1).alias("n")).first()["n"] or 0
    bits = 1 << 16
    while bits < min(lines * bits_per_line, max_bits):
        bits *= 2
    filt = np.zeros(bits // 8, np.uint8)
    size = min(SEGMENT, bits) // 8
    for r in _merged(_partial_filters(docs, bits, least), bits).toLocalIterator():
        filt[r["segment"] * size : (r["segment"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return filt


def repeated_lines(docs: DataFrame, least: int = 10, bits_per_line: int = 16, max_bits: int = 1 << 29) -> DataFrame:
    """``id, mark, at``: of each document (id and its text's mark) the places of lines whose key a smaller id holds as well.

    ``docs`` has ``id, text, mark``.
    """
    spark = docs.sparkSession
    filt = spark.sparkContext.broadcast(repeat_filter(docs, least, bits_per_line, max_bits))
    schema = pa.schema([("id", pa.int64()), ("mark", pa.int64()), ("digest", pa.binary()), ("at", pa.int32())])

    def suspects(batches):
        f = filt.value
        bits = len(f) * 8
        for b in text_slices(batches):
            b = b.filter(pc.is_valid(b.column("id")))
            text, at, keys = _keys(b.column("text"), least)
            if not len(keys):
                continue
            keys = keys.to_pylist()
            hit = np.ones(len(keys), bool)
            for place in _places(_hashes(keys), bits).astype(np.int64):
                hit &= (f[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
            where = np.flatnonzero(hit)
            text = pa.array(text[where])
            digests = pa.array([_digest(keys[j]) for j in where.tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("id").take(text), b.column("mark").take(text), digests, pa.array(at[where], pa.int32())], schema=schema)

    held = cut(docs.mapInArrow(suspects, "id long, mark long, digest binary, at int"))
    # a table of its own, so that the join below is of two plain shuffles, of which Spark can split a hot digest's
    first = cut(held.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("digest", "first"))
    lost = held.join(first, "digest").where("id > first")
    return lost.groupBy("id", "mark").agg(F.collect_set("at").alias("at"))


def _kept(text: bytes, lost: np.ndarray | None) -> tuple[int, int, bytes]:
    """Lines of a text, lines lost, and what is left of it."""
    if lost is None:
        return text.count(b"\n") + 1, 0, text
    lines = text.split(b"\n")
    gone = set(lost.tolist())
    return len(lines), len(gone), b"\n".join([line for k, line in enumerate(lines) if k not in gone])


def _with_lost(docs: DataFrame, id_col: str, text_col: str, least: int, **size) -> DataFrame:
    """``docs`` with ``__tl_at``, the places of the lines that a document loses."""
    marked = docs.withColumn("__tl_mark", F.xxhash64(text_col))
    plain = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"), F.xxhash64(text_col).alias("mark"))
    lost = repeated_lines(plain, least, **size).withColumnsRenamed({"id": "__tl_id", "mark": "__tl_own", "at": "__tl_at"})
    same = (marked[id_col].cast("long") == F.col("__tl_id")) & (F.col("__tl_mark") == F.col("__tl_own"))
    return marked.join(lost, same, "left").drop("__tl_id", "__tl_own", "__tl_mark")


def _texts_and_lost(b: pa.RecordBatch, text_col: str):
    lists = b.column("__tl_at")
    flat, cuts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    for k, (t, some) in enumerate(zip(pc.fill_null(b.column(text_col).cast(pa.binary()), b"").to_pylist(), lists.is_valid().to_pylist())):
        yield t, flat[cuts[k] : cuts[k + 1]] if some else None


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10, **size) -> DataFrame:
    """The same rows and columns, texts without lines of at least ``least`` code points that a smaller id holds."""

    def run(batches):
        for b in text_slices(batches, text_col):
            new = [None if lost is None else _kept(t, lost)[2].decode() for t, lost in _texts_and_lost(b, text_col)]
            field = b.schema.field(text_col).type
            text = pc.coalesce(pa.array(new, field), b.column(text_col))
            names = [c for c in b.schema.names if c != "__tl_at"]
            yield pa.RecordBatch.from_arrays([text if c == text_col else b.column(c) for c in names], names=names)

    return _with_lost(docs, id_col, text_col, least, **size).mapInArrow(run, docs.schema)


def line_report(docs: DataFrame, least: int = 10, **size) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        for b in text_slices(batches):
            rows = [_kept(t, lost) for t, lost in _texts_and_lost(b, "text")]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").cast(pa.int64()),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows], pa.string()),
                ],
                schema=schema,
            )

    rows = _with_lost(docs.select("doc_id", "text"), "doc_id", "text", least, **size)
    return rows.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(read_table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, list_extract(parts, i) AS line
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), firsts AS (
  SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT keyed.*, coalesce(keyed.doc_id > f.first, false) AS gone FROM keyed LEFT JOIN firsts f ON keyed.k = f.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
