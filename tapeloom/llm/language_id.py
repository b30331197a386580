"""Language identification by spans.

A word's letters fall into script ranges; only the languages whose training text
uses the script of most of the word's letters are candidates for it.  A word's
score for a language is the sum of its letter trigrams' log-probabilities there.
Viterbi over a document's words, with a penalty for each switch of language,
labels spans; the language with the most letters is the document's.  The score
is that language's mean probability over the document's letters, each word's
candidates being weighed by the word alone: it is low where spans of other
languages are long, where words fit several languages, and where no language
uses the script.

The model is a table of hashed trigrams by language: its size is fixed, and it
is fitted on a bounded sample, at most about ``per_language`` distinct texts of
each language.

``und`` with score 0 is given for null texts and texts without a letter; where
nothing could be learned every text gets that.  Of equal languages the first by
name is taken.  Repeated rows are labelled each time; very long texts are worked
on whole; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import functools
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.common import read_table
from tapeloom.llm.tokens import split_words, text_slices

#: Hash buckets of trigrams, and documents at most per language that the model is fitted on.
BUCKETS, PER_LANGUAGE = 1 << 15, 1500
SWITCH = 8.0
#: First and last code point of script ranges; Latin and what has none is 1.
SCRIPTS = (
    (0x370, 0x3FF), (0x400, 0x52F), (0x530, 0x58F), (0x590, 0x5FF), (0x600, 0x77F), (0x900, 0x97F), (0x980, 0x9FF),
    (0xA00, 0xA7F), (0xB80, 0xBFF), (0xC00, 0xC7F), (0xE00, 0xE7F), (0x10A0, 0x10FF), (0x1100, 0x11FF), (0x3040, 0x30FF),
    (0x3400, 0x9FFF), (0xAC00, 0xD7AF), (0x20000, 0x323AF),
)


@functools.cache
def script_table() -> np.ndarray:
    """By code point: 0 for what isn't a letter, else 1 plus the script's place in SCRIPTS, 1 for any other."""
    table = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    for i, (a, z) in enumerate(SCRIPTS):
        table[a : z + 1] *= i + 2
    return table


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased words with a space before, between and after; where each word's space stands."""
    points = np.frombuffer((" " + " ".join(words).lower() + "  ").encode("utf-32-le", "replace"), "<u4")
    return points, np.flatnonzero(points == 32)[: len(words) + 1]


def _trigrams(points: np.ndarray) -> np.ndarray:
    """Bucket of the trigram that begins at each place; neighbouring words show as a space only."""
    p = points.astype(np.uint64)
    h = p[:-2] * np.uint64(0x9E3779B97F4A7C15) + p[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + p[2:] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(29)
    return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


class WordModel:
    def __init__(self, langs: list[str], logp: np.ndarray, uses: np.ndarray):
        self.langs = langs
        #: (BUCKETS, languages), less each row's best: 0 is as good as can be.
        self.logp = (logp - logp.max(axis=1, keepdims=True)).astype(np.float32) if len(langs) else logp
        #: (scripts, languages): does the language's training text use the script
        self.uses = uses

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores (words, languages), 0 for all where there is no letter, and each word's letters."""
        points, at = _letters(words)
        script = script_table()[points]
        grams = self.logp[_trigrams(points)]
        starts = at[:-1]
        # word i: trigrams from its space up to the one that ends at the next space
        ends = np.maximum(at[1:] - 1, starts + 1)
        sums = np.zeros((len(grams) + 1, len(self.langs)), np.float64)
        np.cumsum(grams, axis=0, out=sums[1:])
        scores = (sums[np.minimum(ends, len(grams))] - sums[starts]).astype(np.float32)
        letter = np.zeros(len(points) + 1, np.int64)
        np.cumsum(script > 0, out=letter[1:])
        letters = letter[at[1:]] - letter[starts]
        # candidates: languages that use the script of most of the word's letters
        kinds = len(SCRIPTS) + 2
        word = np.searchsorted(starts, np.arange(len(points)), side="right") - 1
        own = np.flatnonzero(script > 0)
        common = np.bincount(script[own], minlength=kinds)
        kind = np.zeros(len(starts), np.int64)
        if np.count_nonzero(common) == 1:
            kind[word[own]] = int(common.argmax())
        elif len(own):
            pairs, times = np.unique(word[own] * kinds + script[own], return_counts=True)
            order = np.lexsort((-pairs, times))  # of equally many letters the lower range
            kind[pairs[order] // kinds] = pairs[order] % kinds
        allowed = self.uses[kind]
        some = allowed.any(axis=1)
        scores[some] = np.where(allowed[some], scores[some], -1e4)
        scores[(letters == 0) | ~some] = 0
        return scores, letters


def viterbi(scores: np.ndarray, offsets: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """Best label of each token; tokens of sequence d are ``offsets[d]:offsets[d + 1]``.  Steps run over all sequences at once."""
    n = np.diff(offsets)
    order = np.argsort(-n, kind="stable")
    order = order[n[order] > 0]
    begin, n = offsets[:-1][order], n[order]
    labels = np.zeros(len(scores), np.int16)
    if not len(order):
        return labels
    switched = np.zeros(scores.shape, bool)
    source = np.zeros(len(scores), np.int16)
    value = scores[begin].copy()
    active = np.searchsorted(-n, -np.arange(1, n[0]), side="left") if n[0] > 1 else np.zeros(0, np.int64)  # sequences longer than t
    for t, k in enumerate(active.tolist(), 1):
        v = value[:k]
        arg = v.argmax(axis=1)
        other = v[np.arange(k), arg][:, None] - penalty
        at = begin[:k] + t
        source[at] = arg
        switched[at] = other > v
        value[:k] = np.maximum(v, other) + scores[at]
    state = value.argmax(axis=1)
    for t in range(int(n[0]) - 1, 0, -1):
        k = int(active[t - 1])
        at = begin[:k] + t
        s = state[:k]
        labels[at] = s
        state[:k] = np.where(switched[at, s], source[at], s)
    labels[begin] = state
    return labels


def label_documents(model: WordModel, texts: pa.Array) -> tuple[list[str], np.ndarray, pa.Array]:
    """Language, score and spans of each text; none may be null."""
    offsets, codes, words = split_words(texts)
    scores, letters = model.words(words)
    labels = viterbi(scores[codes], offsets)
    size, n = len(model.langs), np.diff(offsets)
    doc = np.repeat(np.arange(len(texts)), n)
    own = letters[codes]
    weight = np.bincount(doc * size + labels, weights=own, minlength=len(texts) * size).reshape(len(texts), size)
    total, best = weight.sum(axis=1), weight.argmax(axis=1)
    chance = np.exp(scores - scores.max(axis=1, keepdims=True)) if len(scores) else scores
    chance /= chance.sum(axis=1, keepdims=True)
    sure = np.bincount(doc, weights=own * chance[codes, best[doc]], minlength=len(texts)) / np.maximum(total, 1)
    # a span: words in a row with one label; its place and size in characters, without the space after it
    begins = np.ones(len(codes), bool)
    begins[1:] = (labels[1:] != labels[:-1]) | (doc[1:] != doc[:-1])
    chars = np.fromiter(map(len, words), np.int64, len(words))[codes] + 1
    at = np.cumsum(chars) - chars
    first = np.flatnonzero(begins)
    last = np.append(first[1:], len(codes)) - 1
    base = at[np.minimum(offsets[:-1], max(len(codes) - 1, 0))] if len(codes) else np.zeros(len(texts), np.int64)
    start = at[first] - base[doc[first]]
    length = at[last] + chars[last] - 1 - at[first]
    spans = pa.StructArray.from_arrays(
        [pa.array(start), pa.array(length), pa.DictionaryArray.from_arrays(pa.array(labels[first].astype(np.int32)), pa.array(model.langs, pa.string())).dictionary_decode()], ["start", "length", "lang"]
    )
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(first, offsets).astype(np.int32)), spans)
    return [model.langs[b] if t else "und" for b, t in zip(best.tolist(), total.tolist())], np.where(total > 0, sure, 0.0), lists


def fit_language_model(docs: DataFrame, per_language: int = PER_LANGUAGE) -> WordModel:
    """Count trigrams of at most about ``per_language`` distinct texts of each language, the lowest by a 64-bit hash."""
    hashed = F.xxhash64("text", "doc_id")
    learn = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", "text", hashed.alias("hashed"))
    counts = {r["lang"]: r for r in learn.groupBy("lang").agg(F.approx_count_distinct("hashed").alias("n"), F.min("hashed").alias("least")).collect()}
    langs = sorted(counts)
    if not langs:
        return WordModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(SCRIPTS) + 2, 0), bool))
    place = {x: i for i, x in enumerate(langs)}
    # the highest hash of the sample by language; the least of all is always in it
    upto = {x: (1 << 63) - 1 if r["n"] <= per_language else max(r["least"], (per_language << 64) // r["n"] - (1 << 63)) for x, r in counts.items()}
    share = F.create_map(*[F.lit(y) for x in langs for y in (x, upto[x])])
    sample = learn.where(F.col("hashed") <= share[F.col("lang")]).dropDuplicates(["lang", "hashed"]).select("lang", "text")
    schema = pa.schema([("lang", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches):
        grams = np.zeros((len(langs), BUCKETS), np.int64)
        scripts = np.zeros((len(langs), len(SCRIPTS) + 2), np.int64)
        for b in text_slices(batches):
            for x, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                words = t.replace("\n", " ").split(" ")
                points, _ = _letters(words)
                i = place[x]
                grams[i] += np.bincount(_trigrams(points), minlength=BUCKETS)
                scripts[i] += np.bincount(script_table()[points], minlength=len(SCRIPTS) + 2)
        for table, base in ((grams, 0), (scripts, BUCKETS)):
            i, j = np.nonzero(table)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j + base, pa.int32()), pa.array(table[i, j], pa.int64())], schema=schema)

    got = sample.mapInArrow(run, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((len(langs), BUCKETS + len(SCRIPTS) + 2))
    table[got.column("lang").to_numpy(), got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    grams, scripts = table[:, :BUCKETS] + 0.5, table[:, BUCKETS:]
    logp = np.log(grams / grams.sum(axis=1, keepdims=True)).T
    uses = (scripts >= 0.002 * np.maximum(1, scripts[:, 1:].sum(axis=1, keepdims=True))).T
    uses[0] = False
    return WordModel(langs, np.clip(logp, logp.max(axis=1, keepdims=True) - 6, None), uses)


SPANS = "array<struct<start: bigint, length: bigint, lang: string>>"


def languages(docs: DataFrame, model: WordModel) -> DataFrame:
    """``doc_id, lang_pred, score, spans`` of every document; spans are in characters of the text."""
    span = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("lang", pa.string())])
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("spans", pa.list_(span))])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for b in text_slices(batches):
            if b.num_rows and m.langs:
                lang, score, spans = label_documents(m, pc.fill_null(b.column("text"), ""))
            else:
                lang, score, spans = ["und"] * b.num_rows, [0.0] * b.num_rows, [[]] * b.num_rows
            spans = spans.cast(pa.list_(span)) if isinstance(spans, pa.Array) else pa.array(spans, pa.list_(span))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), spans], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, lang_pred string, score double, spans {SPANS}")


def held_out(divisor: int, remainder: int = 2):
    """Is the crc32 of the id's text of this remainder; a null id isn't."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor == remainder, F.lit(False))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit_language_model(docs.where(~held_out(4)))
    return languages(docs, model).select("doc_id", held_out(4).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
