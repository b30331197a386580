"""Benchmark decontamination: BM25 over test items with block-max WAND.

The index holds the benchmark's items, long ones in parts of at most
``PART_WORDS`` words, and the query is every training passage: windows of
``WINDOW`` words of each whole text, in steps that let any part fit in one
window.  A part's score is BM25 over a passage's distinct words, divided by the
score that the part gives itself, so one threshold serves short and long items:
parts at or above it are all retrieved, none is cut off by rank.

First a batch's passages are held against tables of the largest impact of each
rarer word in each block of parts, all at once; the most frequent words, which
reach no more than half the threshold in any part even together, enter by what
they can add at most.  Passages that can't reach the threshold in any block end
here.  For the others WAND walks the postings: terms in order of their cursors
until their largest impacts reach the threshold give the pivot part; where the
largest impacts of the postings' blocks at the pivot don't reach it, the cursors
jump past the nearest end of those blocks; else the part is scored.

Retrieved items are verified on the retrieved passages and as many words around
them as the item has, neighbouring ones taken together: of the item's word
5-grams in its question (all but its last quarter) and in its answer (that last
quarter, 5 words at least), the shares that stand there must both reach
``OVERLAP``.  An item of under 10 words is question and answer in one; one of
under 5 words has one gram, itself.

The index takes arrays of a few bytes a posting, is broadcast, and is bounded:
benchmarks beyond ``INDEX_BYTES`` are searched in several blocks of items, each
within that bound, with document frequencies and mean length over all items, so
that scores don't depend on the blocks.

Null and empty texts and items, and items with a null id, match nothing;
repeated items are all searched, and those that share an id are one row a
document, as are documents that share an id (null among them), with the number
of passages of all.  Texts of any length are read whole; with an empty table on
either side there is no row; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.common import materialize, read_table
from tapeloom.llm.tokens import text_slices

PART_WORDS, WINDOW, STEP = 64, 128, 64
SCORE, OVERLAP, GRAM = 0.5, 0.8, 5
K1, B = 1.2, 0.75
#: Postings of a block, and parts of a block of the tables that passages are first held against.
POSTING_BLOCK, PART_BLOCK = 16, 4
INDEX_BYTES = 16 << 20
#: Entries of those tables that are summed at a time.
EXPANDED = 1 << 21
_WORD = re.compile(r"\w+")
#: Scores are sums in any order.
_SLACK = 1e-9


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def cuts(n: int, most: int = PART_WORDS) -> list[int]:
    """Bounds of the parts, of nearly equal length, of an item of ``n`` words."""
    parts = -(-n // most)
    return [n * k // parts for k in range(parts + 1)] if parts else []


def gram_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the runs of ``n`` ids; runs with a word that isn't in the index (-1) are left out."""
    runs = len(ids) - n + 1
    if runs < 1:
        return np.zeros(0, np.uint64)
    h, known = np.zeros(runs, np.uint64), np.ones(runs, bool)
    for k in range(n):
        own = ids[k : k + runs]
        h = (h ^ own.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        known &= own >= 0
    return h[known]


class ItemIndex:
    """Inverted index of test items; items are ``(id, text)``.

    ``stats`` are the number of parts, their mean length and each word's number
    of parts where the index is one block of several.
    """

    def __init__(self, items: list[tuple[int, str]], threshold: float = SCORE, stats: tuple[int, float, dict[str, int]] | None = None):
        self.threshold = threshold
        split = [(i, words) for i, text in items if (words := words_of(text))]
        self.item_ids = [i for i, _ in split]
        self.terms = {w: k for k, w in enumerate(dict.fromkeys(chain.from_iterable(w for _, w in split)))}
        bounds = [cuts(len(w)) for _, w in split]
        self.item_of = np.repeat(np.arange(len(split)), [len(b) - 1 for b in bounds])
        self.words = np.array([len(w) for _, w in split], np.int64)
        length = np.array([z - a for b in bounds for a, z in zip(b, b[1:])], np.int64)
        self.n_parts = len(length)
        self.checks = []
        ids = [np.fromiter(map(self.terms.__getitem__, w), np.int64, len(w)) for _, w in split]
        for own in ids:
            n = len(own)
            gram, cut = min(GRAM, n), n - max(GRAM, n // 4) if n >= 2 * GRAM else 0
            question, answer = (own[:cut], own[cut:]) if cut else (own, own)
            self.checks.append((gram, np.unique(gram_hashes(question, gram)), np.unique(gram_hashes(answer, gram))))
        part = np.repeat(np.arange(self.n_parts), length)
        term = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        pairs, tf = np.unique(term * max(1, self.n_parts) + part, return_counts=True)
        term, part = pairs // max(1, self.n_parts), pairs % max(1, self.n_parts)
        n = np.bincount(term, minlength=len(self.terms))
        if stats is None:
            count, mean, df = self.n_parts, length.mean() if self.n_parts else 1.0, n
        else:
            count, mean, df = stats[0], stats[1], np.array([stats[2][w] for w in self.terms], np.int64)
        idf = np.log(1 + (count - df + 0.5) / (df + 0.5))
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[part] / mean))
        share = impact / np.bincount(part, weights=impact, minlength=self.n_parts)[part]
        #: Postings in order of term and part, and where each term's begin.
        self.part, self.share = part.astype(np.int32), share
        self.start = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        self.most = np.maximum.reduceat(share, self.start[:-1]) if len(n) else np.zeros(0)
        self._blocks(n)
        self._tables(term, n)

    def _blocks(self, n: np.ndarray) -> None:
        """Each term's postings in blocks: last part and largest impact of each."""
        per = -(-n // POSTING_BLOCK)
        self.block_start = np.concatenate([[0], np.cumsum(per)]).astype(np.int64)
        k = np.arange(per.sum()) - np.repeat(self.block_start[:-1], per)
        begin = np.repeat(self.start[:-1], per) + k * POSTING_BLOCK
        end = np.minimum(begin + POSTING_BLOCK, np.repeat(self.start[1:], per))
        self.block_last = self.part[end - 1] if len(end) else np.zeros(0, np.int32)
        self.block_most = np.maximum.reduceat(self.share, begin) if len(begin) else np.zeros(0)

    def _tables(self, term: np.ndarray, n: np.ndarray) -> None:
        """Leave out the most frequent terms as long as no part can reach half the threshold by them alone; for the others, largest impacts by block of parts."""
        room = np.full(self.n_parts, self.threshold / 2)
        common = np.zeros(len(n), bool)
        for t in np.argsort(-n, kind="stable").tolist():
            own = slice(self.start[t], self.start[t + 1])
            if (room[self.part[own]] > self.share[own]).all():
                room[self.part[own]] -= self.share[own]
                common[t] = True
        self.n_blocks = max(1, -(-self.n_parts // PART_BLOCK))
        #: What the left-out terms can add in each block.
        self.spare = np.maximum.reduceat(self.threshold / 2 - room, np.arange(0, self.n_parts, PART_BLOCK)) if self.n_parts else np.zeros(1)
        own = np.flatnonzero(~common[term])
        key = term[own] * self.n_blocks + self.part[own] // PART_BLOCK
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        self.table_most = np.maximum.reduceat(self.share[own], first) if len(first) else np.zeros(0)
        self.table_block = (key[first] % self.n_blocks).astype(np.int32)
        self.table_n = np.bincount(key[first] // self.n_blocks, minlength=len(n))
        self.table_start = np.cumsum(self.table_n) - self.table_n

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """Parts that score at least the threshold for a passage's distinct terms, by block-max WAND."""
        need = self.threshold - _SLACK
        part, share, start, block_start, last, block_most = self.part, self.share, self.start, self.block_start, self.block_last, self.block_most
        at = {t: int(start[t]) for t in terms}
        end = {t: int(start[t + 1]) for t in terms}
        here = {t: int(part[at[t]]) for t in terms}
        most = {t: float(self.most[t]) for t in terms}
        found = []

        def move(t: int, to: int) -> None:
            k = at[t] = bisect_left(part, to, at[t], end[t])
            if k < end[t]:
                here[t] = int(part[k])
            else:
                del here[t]

        while here:
            order = sorted(here, key=here.__getitem__)
            bound = 0.0
            for k, t in enumerate(order):
                bound += most[t]
                if bound >= need:
                    break
            else:
                break
            pivot = here[t]
            while k + 1 < len(order) and here[order[k + 1]] == pivot:
                k += 1
            front = order[: k + 1]
            bound, edge = 0.0, here[order[k + 1]] if k + 1 < len(order) else self.n_parts
            for t in front:
                b = bisect_left(last, pivot, block_start[t], block_start[t + 1])
                if b < block_start[t + 1]:
                    bound += block_most[b]
                    edge = min(edge, int(last[b]) + 1)
            if bound < need:
                for t in front:
                    move(t, edge)
            elif here[front[0]] == pivot:
                score = float(sum(share[at[t]] for t in front))
                if score >= need:
                    found.append((pivot, score))
                for t in front:
                    move(t, pivot + 1)
            else:
                for t in front:
                    if here[t] < pivot:
                        move(t, pivot)
        return found

    def passages(self, texts: list[np.ndarray]):
        """``(text, number of the passage)`` of those that may reach the threshold in a block."""
        windows = np.array([max(1, -(-(len(w) - (WINDOW - STEP)) // STEP)) for w in texts], np.int64)
        base = np.cumsum(windows) - windows
        window, term = [], []
        for i, ids in enumerate(texts):
            at = np.flatnonzero(ids >= 0)
            at = at[self.table_n[ids[at]] > 0]
            k = at // STEP
            for shift in (0, 1):  # a word stands in two windows
                ok = (k >= shift) & (k - shift < windows[i])
                window.append(base[i] + k[ok] - shift)
                term.append(ids[at[ok]])
        pairs = np.unique(np.concatenate(window) * len(self.terms) + np.concatenate(term)) if window else np.zeros(0, np.int64)
        window, term = pairs // max(1, len(self.terms)), pairs % max(1, len(self.terms))
        total = np.cumsum(self.table_n[term])
        begin = 0
        while begin < len(window):
            # whole windows, of about EXPANDED entries together
            end = int(np.searchsorted(total, (total[begin - 1] if begin else 0) + EXPANDED, side="right"))
            end = int(np.searchsorted(window, window[max(begin, end - 1)], side="right"))
            t, n = term[begin:end], self.table_n[term[begin:end]]
            where = np.repeat(self.table_start[t] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            keys, place = np.unique(np.repeat(window[begin:end], n) * self.n_blocks + self.table_block[where], return_inverse=True)
            bound = np.bincount(place, weights=self.table_most[where], minlength=len(keys)) + self.spare[keys % self.n_blocks]
            for w in np.unique(keys[bound >= self.threshold - _SLACK] // self.n_blocks).tolist():
                i = int(np.searchsorted(base, w, side="right")) - 1
                yield i, w - int(base[i])
            begin = end

    def leaks(self, texts: list[str | None]):
        """``(text, item id, [passages, score, question overlap, answer overlap])`` of verified pairs."""
        if not self.n_parts:
            return []
        get = self.terms.get
        split = [np.array([get(w, -1) for w in words_of(t)], np.int64) for t in texts]
        hits: dict[tuple[int, int], dict[int, float]] = {}
        for i, k in self.passages(split):
            own = np.unique(split[i][k * STEP : k * STEP + WINDOW])
            for p, score in self.search(own[own >= 0].tolist()):
                have = hits.setdefault((i, int(self.item_of[p])), {})
                have[k] = max(score, have.get(k, 0.0))
        found: dict[tuple[int, int], list] = {}
        for (i, item), scores in sorted(hits.items()):
            around, (gram, question, answer) = int(self.words[item]), self.checks[item]
            groups: list[list[int]] = []
            for k in sorted(scores):
                if groups and k * STEP - around <= groups[-1][-1] * STEP + WINDOW + around:
                    groups[-1].append(k)
                else:
                    groups.append([k])
            for ks in groups:
                near = gram_hashes(split[i][max(0, ks[0] * STEP - around) : ks[-1] * STEP + WINDOW + around], gram)
                q, a = float(np.isin(question, near).mean()), float(np.isin(answer, near).mean())
                if q >= OVERLAP and a >= OVERLAP:
                    have = found.setdefault((i, self.item_ids[item]), [0, 0.0, 0.0, 0.0])
                    have[0] += len(ks)
                    have[1:] = [max(x, y) for x, y in zip(have[1:], (max(scores[k] for k in ks), q, a))]
        return [(i, item, x) for (i, item), x in found.items()]


def _word_parts(rows: DataFrame) -> DataFrame:
    """``k, word, parts, words``: of each block of items its words with their parts; a null word for the parts and words in all."""
    schema = pa.schema([("k", pa.int32()), ("word", pa.string()), ("parts", pa.int64()), ("words", pa.int64())])

    def run(batches):
        for b in text_slices(batches):
            seen: dict[tuple[int, str | None], list[int]] = {}
            for k, t in zip(b.column("k").to_pylist(), b.column("text").to_pylist()):
                words = words_of(t)
                bounds = cuts(len(words))
                for x, z in zip(bounds, bounds[1:]):
                    for w in {None, *words[x:z]}:
                        have = seen.setdefault((k, w), [0, 0])
                        have[0] += 1
                        have[1] += z - x
            if seen:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in seen], pa.int32()), pa.array([w for _, w in seen], pa.string()), *(pa.array([v[j] for v in seen.values()], pa.int64()) for j in (0, 1))], schema=schema
                )

    return rows.mapInArrow(run, "k int, word string, parts long, words long").groupBy("k", "word").agg(F.sum("parts").alias("parts"), F.sum("words").alias("words"))


def index_blocks(items: DataFrame, most: int = INDEX_BYTES):
    """Indexes over blocks of items, each of about ``most`` bytes of text; frequencies are those over all items."""
    rows = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // most))
    rows = rows.withColumn("k", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int"))
    if n > 1:
        by_block = materialize(_word_parts(rows), "item-words")
        overall = by_block.groupBy("word").agg(F.sum("parts").alias("parts"), F.sum("words").alias("words"))
        overall = materialize(overall, "item-words")
        one = overall.where("word is null").first()
    for k in range(n):
        part = sorted((r["item_id"], r["text"]) for r in rows.where(F.col("k") == k).collect())
        if n == 1:
            yield ItemIndex(part)
        elif one and part:
            own = by_block.where((F.col("k") == k) & F.col("word").isNotNull()).select("word").join(overall, "word")
            yield ItemIndex(part, stats=(one["parts"], one["words"] / one["parts"], {r["word"]: r["parts"] for r in own.toLocalIterator()}))


LEAK = "doc_id long, item_id long, n_passages long, score double, question_overlap double, answer_overlap double"


def contaminated(docs: DataFrame, items: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """One row for each document and item that it holds; no shuffle of texts."""
    spark = docs.sparkSession
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_passages", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found, before = None, None
    for index in index_blocks(items, index_bytes):
        if before is not None:  # one index at a time in the executors
            found = materialize(found, "leaks")
            before.destroy()
        sent = spark.sparkContext.broadcast(index)

        def run(batches, sent=sent):
            own = sent.value
            for b in text_slices(batches):
                ids = b.column("doc_id").to_pylist()
                rows = [(ids[i], item, *x) for i, item, x in own.leaks(b.column("text").to_pylist())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        part = plain.mapInArrow(run, LEAK)
        found, before = part if found is None else found.unionByName(part), sent
    if found is None:
        return spark.createDataFrame([], LEAK)
    one = found.groupBy("doc_id", "item_id")
    return one.agg(F.sum("n_passages").alias("n_passages"), *(F.max(c).alias(c) for c in ("score", "question_overlap", "answer_overlap")))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
