"""Document fingerprints by locally consistent parsing.

A text's code points are symbols of level 0.  On each level equal neighbours
become one symbol; deterministic coin tossing then labels every symbol from its
left neighbour: twice the place of the lowest bit in which their names differ,
plus that bit.  Four tosses bring names down to labels below 6, neighbours' always
unlike.  A local maximum of the labels begins a phrase, so a phrase has 2 to 11
symbols (the last of a text may have one); its name is a hash of its symbols'
names, and names are the symbols of the next level, up to one name.  Whether a
phrase begins somewhere depends on at most ``CONTEXT`` symbols to each side, so
equal substrings are cut alike but near their ends, wherever they stand.

The fingerprint is a MinHash of the names of all phrases, by bins: the least name
in each of 64 bins of those that cover at least ``COARSE`` code points, and for
texts of fewer than ``FINE_BELOW`` code points in each of 32 bins of all phrases.
It is ``l`` (long text), ``c`` (at least ``LEAST`` coarse phrases), ``f`` (fewer)
or ``e`` (empty text), then 16 bits of each least name in hex, 0 for an empty bin.
The likeness of two fingerprints is the share of phrases in common, 2 J / (1 + J)
for J the share of equal bins among those that either text fills: of all phrases
if one text has few coarse ones, else of the coarse ones; 0 for a long text and
one with few coarse phrases.

Arrays hold many texts at once; labels are made a block at a time, with context
on both sides.  Memory is about 40 bytes a code point of a slice, which holds
``SLICE`` bytes or one longer text.

``edited_fingerprints`` sorts texts by range of id, so that the next document is
the next row; only the first and last text of each part are joined afterwards.
Rows with equal ids stand in the order of their text's hash; a null id comes
first; repeated rows are returned each time.  A null text is empty; the edited
text of an empty one is empty.  A lone document is its own next one.  Texts of
any length are read whole; an empty table gives an empty one; other columns
aren't read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.common import materialize, read_table
from tapeloom.llm.tokens import text_slices

CONTEXT, BLOCK = 16, 1 << 16
SLICE = 1 << 20
COARSE, LEAST, FINE_BELOW = 16, 8, 1024
N_COARSE, N_FINE = 64, 32
_U = np.uint64
_MIX = [_U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _MIX[1]
    x = (x ^ (x >> _U(27))) * _MIX[2]
    return x ^ (x >> _U(31))


def joined_name(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Name of a sequence: that of its beginning, and of its next symbol."""
    x = a * _MIX[0] + b
    x = (x ^ (x >> _U(29))) * _MIX[1]
    return x ^ (x >> _U(32))


def _toss_table(width: int) -> np.ndarray:
    """Label of a symbol by its left neighbour's label and its own."""
    left, own = np.divmod(np.arange(width * width), width)
    differ = left ^ own
    place = np.log2(np.maximum(differ & -differ, 1)).astype(np.int64)
    return (2 * place + (own >> place & 1)).astype(np.uint8)


_TOSSES = [(6, _toss_table(64)), (4, _toss_table(16)), (3, _toss_table(8))]


def _block_landmarks(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Local maxima of the labels; ``first`` marks the first symbol of a text."""
    at = np.flatnonzero(first)
    x = x.astype(np.uint32)  # the low half of a name is enough to toss by
    own = x[1:]
    differ = own ^ x[:-1]
    low = differ & (~differ + np.uint32(1))
    place = np.maximum((low.astype(np.float32).view(np.int32) >> 23) - 127, 0).astype(np.uint32)
    label = np.empty(len(x), np.uint8)
    label[1:] = 2 * place + (own >> place & np.uint32(1))
    label[0] = x[0] & np.uint32(1)
    label[at] = x[at] & np.uint32(1)
    for bits, table in _TOSSES:
        ends = label[at] & 1
        head = label[0] & 1
        label[1:] = table[(label[:-1].astype(np.uint16) << bits) | label[1:]]
        label[0] = head
        label[at] = ends
    rise = label[1:] > label[:-1]
    top = np.zeros(len(x), bool)
    top[1:] = rise
    top[:-1] &= ~rise
    last = at[at > 0] - 1
    top[last] = label[last] > label[last - 1]
    top[at] = True
    second = at + 1  # so that a text's first phrase has two symbols
    second = second[second < len(x)]
    top[second[~first[second]]] = False
    return top


def landmarks(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where phrases begin, a block at a time."""
    out = np.empty(len(x), bool)
    for s in range(0, len(x), BLOCK):
        a, z = max(0, s - CONTEXT), min(len(x), s + BLOCK + CONTEXT)
        out[s : s + BLOCK] = _block_landmarks(x[a:z], first[a:z])[s - a :][:BLOCK]
    return out


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...``, ``lengths[i]`` of them, one after another."""
    out = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    out += np.arange(len(out))
    return out


def _glued(x: np.ndarray, starts: np.ndarray, lengths: np.ndarray, tail: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """Of each text the symbols ``starts, lengths`` of ``x``, then its own of ``tail``."""
    n = lengths + tails
    at = np.cumsum(n) - n
    out = np.empty(int(n.sum()), x.dtype)
    out[_ranges(at, lengths)] = x[_ranges(starts, lengths)]
    out[_ranges(at + lengths, tails)] = tail
    return out


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def _counted(at: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many of the sorted places ``at`` are in each text."""
    return np.diff(np.searchsorted(at, _starts(counts)), append=len(at))


def _marks(counts: np.ndarray, n: int) -> np.ndarray:
    first = np.zeros(n, bool)
    first[_starts(counts)] = True
    return first


def _collapsed(x: np.ndarray, end: np.ndarray, counts: np.ndarray):
    """Runs of one symbol as one; also where each run begins (None: all have length 1)."""
    new = _marks(counts, len(x))
    new[1:] |= x[1:] != x[:-1]
    if new.all():
        return x, end, counts, None
    at = np.flatnonzero(new)
    after = np.append(at[1:], len(x))
    n = after - at
    x, run = x[at], np.flatnonzero(n > 1)
    x[run] = joined_name(x[run], n[run].astype(_U))
    return x, end[after - 1], _counted(at, counts), new


def _phrases(x: np.ndarray, end: np.ndarray, counts: np.ndarray, begin: np.ndarray):
    """Names, ends and counts of the next level, and which of them are made of several symbols."""
    at = np.flatnonzero(begin)
    after = np.append(at[1:], len(x))
    n = after - at
    name, made = x[at], n > 1
    more, k = np.flatnonzero(made), 1
    while len(more):
        name[more] = joined_name(name[more], x[at[more] + k])
        k += 1
        more = more[n[more] > k]
    return name, end[after - 1], _counted(at, counts), made


def _spans(end: np.ndarray, counts: np.ndarray, before=0) -> np.ndarray:
    """Code points of each symbol, by where it ends in its text; ``before``: where a text's first one begins."""
    begin = np.empty_like(end)
    begin[1:] = end[:-1]
    begin[_starts(counts)] = before
    return end - begin


def parse(text: np.ndarray, counts: np.ndarray, x: np.ndarray, end: np.ndarray):
    """Phrases of many texts laid end to end, level by level: ``text, name, span`` arrays, texts in order.

    ``counts`` are the symbols of each text, at least 1; ``end`` is where each
    ends in its text.  A text's last name (all of it) comes once it stands alone.
    """
    while len(text):
        x, end, counts, _ = _collapsed(x, end, counts)
        alone = counts == 1
        if alone.any():
            own = np.cumsum(counts)[alone] - 1
            yield text[alone], x[own], end[own]
            keep = np.repeat(~alone, counts)
            text, counts, x, end = text[~alone], counts[~alone], x[keep], end[keep]
            if not len(text):
                return
        x, end, counts, made = _phrases(x, end, counts, landmarks(x, _marks(counts, len(x))))
        yield np.repeat(text, counts)[made], x[made], _spans(end, counts)[made]


class _Sketches:
    """The least name in each bin of many texts' phrases."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        self.coarse, self.fine = (np.full(len(lengths) * n, ~_U(0)) for n in (N_COARSE, N_FINE))
        self.n_coarse = np.zeros(len(lengths), np.int64)

    def add(self, text: np.ndarray, name: np.ndarray, span: np.ndarray, also: np.ndarray | None = None) -> None:
        """Phrases of texts; ``also``: other texts that have them too."""
        wide = span >= COARSE
        short = self.lengths[text] < FINE_BELOW
        for t in [text] if also is None else [text, also]:
            own = t[wide]
            np.minimum.at(self.coarse, own * N_COARSE + (name[wide] % _U(N_COARSE)).astype(np.int64), name[wide])
            self.n_coarse += np.bincount(own, minlength=len(self.lengths))
            if short.any():
                np.minimum.at(self.fine, t[short] * N_FINE + (name[short] % _U(N_FINE)).astype(np.int64), name[short])

    def shown(self) -> list[str]:
        def hexed(least: np.ndarray) -> list[str]:
            bits = np.where(least == ~_U(0), _U(0), _mixed(least) % _U(0xFFFF) + _U(1)).astype(">u2")
            return [row.tobytes().hex() for row in bits.reshape(len(self.lengths), -1)]

        long = self.lengths >= FINE_BELOW
        kinds = np.where(self.lengths == 0, "e", np.where(long, "l", np.where(self.n_coarse >= LEAST, "c", "f"))).tolist()
        return [k + {"e": "", "l": c}.get(k, c + f) for k, c, f in zip(kinds, hexed(self.coarse), hexed(self.fine))]


def _symbols(texts: list[str], lengths: np.ndarray, before=None) -> tuple[np.ndarray, np.ndarray]:
    """Names of code points, and where each ends in its text."""
    x = _mixed(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(_U) + _MIX[0])
    return x, _ranges(np.ones_like(lengths) if before is None else before + 1, lengths)


def _lengths(texts: list[str]) -> np.ndarray:
    return np.fromiter(map(len, texts), np.int64, len(texts))


def _parse_texts(texts: list[str], which: np.ndarray, sketches: _Sketches) -> None:
    """Texts numbered ``which`` by themselves."""
    n = _lengths(texts)
    full = n > 0
    for found in parse(which[full], n[full], *_symbols(texts, n)):
        sketches.add(*found)


def _parse_pairs(texts: list[str], heads: np.ndarray, tails: list[str], own: np.ndarray, other: np.ndarray, sketches: _Sketches) -> None:
    """Texts numbered ``own`` and, numbered ``other``, their first ``heads`` code points with ``tails`` after them.

    On each level the second text shares symbols with the first up to ``CONTEXT``
    before its tail; only what follows is parsed again.
    """
    counts, tcounts, shared = _lengths(texts), _lengths(tails), heads.copy()
    (x, end), (tx, tend) = _symbols(texts, counts), _symbols(tails, tcounts, heads)
    rest: list[tuple] = []
    while len(own):
        # runs: the last shared symbol's run may go on in the tail, so all of it goes there
        raw, raw_end, start = x, end, _starts(counts)
        x, end, counts, new = _collapsed(raw, raw_end, counts)
        stop = start + shared
        begin = np.maximum(stop - 1, start)
        if new is not None:
            shared = (np.cumsum(new) - 1)[begin]
            begin = np.flatnonzero(new)[shared]
            start = _starts(counts)
            shared = shared - start
        else:
            shared = begin - start
        tx, tend = (_glued(a, begin, stop - begin, b, tcounts) for a, b in ((raw, tx), (raw_end, tend)))
        tx, tend, tcounts, _ = _collapsed(tx, tend, tcounts + stop - begin)
        small = (counts <= 2 * CONTEXT) | (shared + tcounts <= 2 * CONTEXT)
        if small.any():
            at, n, keep, tkeep = start[small], shared[small], np.repeat(~small, counts), np.repeat(~small, tcounts)
            rest.append((own[small], counts[small], x[~keep], end[~keep]))
            rest.append((other[small], n + tcounts[small], *(_glued(a, at, n, b[~tkeep], tcounts[small]) for a, b in ((x, tx), (end, tend)))))
            x, end, tx, tend = x[keep], end[keep], tx[tkeep], tend[tkeep]
            own, other, counts, tcounts, shared = (v[~small] for v in (own, other, counts, tcounts, shared))
            if not len(own):
                break
            start = _starts(counts)
        begin = landmarks(x, _marks(counts, len(x)))
        phrase = np.cumsum(begin) - 1
        k = phrase[start + np.maximum(shared - CONTEXT, 0)]
        cut = np.flatnonzero(begin)[k]
        left = np.maximum(cut - CONTEXT, start)
        n = start + shared - left
        tx, tend = (_glued(a, left, n, b, tcounts) for a, b in ((x, tx), (end, tend)))
        tcounts = tcounts + n
        tbegin = landmarks(tx, _marks(tcounts, len(tx)))
        keep = np.ones(len(tx), bool)
        keep[_ranges(_starts(tcounts), cut - left)] = False
        tx, tend, tbegin, tcounts = tx[keep], tend[keep], tbegin[keep], tcounts - (cut - left)
        tbegin[_starts(tcounts)] = True
        shared, before = k - phrase[start], np.where(cut > start, end[cut - 1], 0)
        x, end, counts, made = _phrases(x, end, counts, begin)
        tx, tend, tcounts, tmade = _phrases(tx, tend, tcounts, tbegin)
        both, span = made.copy(), _spans(end, counts)
        both[_ranges(_starts(counts) + shared, counts - shared)] = False
        sketches.add(np.repeat(own, counts)[both], x[both], span[both], np.repeat(other, counts)[both])
        alone = made & ~both
        sketches.add(np.repeat(own, counts)[alone], x[alone], span[alone])
        sketches.add(np.repeat(other, tcounts)[tmade], tx[tmade], _spans(tend, tcounts, before)[tmade])
    for some in rest:
        for found in parse(*some):
            sketches.add(*found)


def fingerprints_of(texts: list[str]) -> list[str]:
    """Fingerprint of each text."""
    sketches = _Sketches(_lengths(texts))
    _parse_texts(texts, np.arange(len(texts)), sketches)
    return sketches.shown()


def pair_fingerprints(texts: list[str], nexts: list[str]) -> tuple[list[str], list[str], list[str]]:
    """Fingerprints of texts; their edited texts; the fingerprints of those."""
    n = len(texts)
    changed = [edited(t, f) for t, f in zip(texts, nexts)]
    lengths = np.append(_lengths(texts), _lengths(changed))
    sketches = _Sketches(lengths)
    long = np.flatnonzero((lengths[:n] >= FINE_BELOW) & (lengths[n:] >= FINE_BELOW))
    rest = np.setdiff1d(np.arange(n), long)
    _parse_texts([texts[k] for k in rest] + [changed[k] for k in rest], np.append(rest, n + rest), sketches)
    if len(long):
        heads = lengths[long] - lengths[long] // 4
        _parse_pairs([texts[k] for k in long], heads, [changed[k][h:] for k, h in zip(long, heads)], long, n + long, sketches)
    shown = sketches.shown()
    return shown[:n], changed, shown[n:]


def likeness(a: str, b: str) -> float:
    """Share of phrases that two texts have in common, from their fingerprints; 0 to 1."""
    kinds = {a[0], b[0]}
    if "e" in kinds:
        return float(a == b)
    if kinds == {"l", "f"}:
        return 0.0
    own = slice(N_COARSE, None) if "f" in kinds else slice(0, N_COARSE)
    x, y = (np.frombuffer(bytes.fromhex(v[1:]), ">u2")[own] for v in (a, b))
    used = (x > 0) | (y > 0)
    j = (x[used] == y[used]).mean() if used.any() else 0.0
    return float(2 * j / (1 + j))


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as much of the beginning of ``following``."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


_ROW = [("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_ROW_SQL = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_EDGE_SQL = f"{_ROW_SQL}, part int, edge string, text string"
_EDGES = [("part", pa.int32()), ("edge", pa.string()), ("text", pa.string())]


def _rows(ids: list, texts: list[str], nexts: list[str], last_print: str | None = None) -> tuple[list[pa.Array], list[str]]:
    """Columns of the rows, and their fingerprints; ``last_print`` is that of the last next text, if it isn't among the texts."""
    prints, changed, new = pair_fingerprints(texts, nexts)
    next_prints = prints[1:] + [last_print or fingerprints_of(nexts[-1:])[0]]
    columns = [
        ids, [len(t) for t in texts], [hashlib.sha256(t.encode()).hexdigest() for t in changed], prints, new,
        [likeness(a, b) for a, b in zip(prints, new)], [likeness(a, b) for a, b in zip(prints, next_prints)],
    ]
    return [pa.array(c, kind) for c, (_, kind) in zip(columns, _ROW)], prints


def _sorted_part(batches):
    """Rows of a sorted part with their next ones; the part's first and last text come as edges."""
    names = [n for n, _ in _ROW + _EDGES]

    def edge(kind: str, i, text: str, fingerprint: str) -> pa.RecordBatch:
        values = [i, len(text), None, fingerprint, None, None, None, TaskContext.get().partitionId(), kind, text]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, (_, k) in zip(values, _ROW + _EDGES)], names=names)

    held = None
    for b in text_slices(batches, most=SLICE):
        ids, texts = b.column("id").to_pylist(), [t or "" for t in b.column("text").to_pylist()]
        if held is None:
            yield edge("first", ids[0], texts[0], fingerprints_of(texts[:1])[0])
        else:
            ids, texts = [held[0], *ids], [held[1], *texts]
        held = ids[-1], texts[-1]
        if len(ids) > 1:
            rows, _ = _rows(ids[:-1], texts[:-1], texts[1:])
            yield pa.RecordBatch.from_arrays(rows + [pa.nulls(len(ids) - 1, k) for _, k in _EDGES], names=names)
    if held is not None:
        yield edge("last", *held, None)


def _last_rows(batches):
    """Last rows of parts, one by one: their next texts are not each other."""
    for b in text_slices(batches, most=SLICE):
        for i, t, n, p in zip(*(b.column(c).to_pylist() for c in ("id", "text", "next_text", "next_print"))):
            yield pa.RecordBatch.from_arrays(_rows([i], [t], [n], p)[0], names=[name for name, _ in _ROW])


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every document."""
    plain = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).withColumn("mark", F.xxhash64("text"))
    ordered = plain.repartitionByRange("id", "mark").sortWithinPartitions("id", "mark").select("id", "text")
    table = materialize(ordered.mapInArrow(_sorted_part, _EDGE_SQL), "parsed")
    first = table.where("edge = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    # part numbers alone meet in one task
    order = table.where("edge = 'last'").select("part").selectExpr("part AS own", "coalesce(lead(part) OVER (ORDER BY part), min(part) OVER ()) AS next_part")
    last = table.where("edge = 'last'").join(order, F.col("part") == F.col("own")).join(first, "next_part")
    rest = last.select("id", "text", "next_text", "next_print").mapInArrow(_last_rows, _ROW_SQL)
    return table.where("edge IS NULL").select([n for n, _ in _ROW]).union(rest)


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
