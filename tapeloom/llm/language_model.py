"""Hidden Markov language model over the whole corpus.

Tokens are words, A-Z lower-cased, and one end for each text.  The most frequent
words of the training texts are classes of their own; rarer ones share a class
with those of the same ending, within which they have their share of its
training count; words unseen in training are one class.  An HMM emits classes:
states are trained by Baum-Welch, expected counts being summed over all
partitions of all training texts, and the scaled forward recursion gives the
exact probability of a whole text.  Probabilities sum to 1 over the V known
tokens and one unknown.

The unknown class has the share of tokens that are seen once in training
(Good-Turing).  States start from the corpus' counts, each varied at random;
every round runs over all training texts, whole, and rounds end when a token's
mean log likelihood gains less than ``SETTLED``, or after ``ROUNDS``.

How the corpus' counts reach the texts: a slice of texts (a block) is coded
against its own distinct words; counts are summed by word over blocks, and go
back to the blocks' words, so that a word is shuffled once a block however often
it occurs.  What is broadcast (frequent words' classes, parameters) is bounded by
the number of classes.

Null and empty texts are their end alone.  Repeated rows count and are scored
each time.  A null id counts as training.  Of words equally frequent the lesser
is a class of its own first.  Texts of any length are one sequence; a task's
memory grows with its longest.  With no training text the score is the base
score; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.common import materialize, read_table
from tapeloom.llm.hmm import expectations, log10_likelihood, maximized, random_model
from tapeloom.llm.language_id import held_out
from tapeloom.llm.tokens import text_slices

FREQUENT, ENDINGS, STATES = 8000, 1024, 8
END, UNKNOWN = FREQUENT + ENDINGS, FREQUENT + ENDINGS + 1
KINDS = UNKNOWN + 1
PACK = 1 << 14
#: Rounds of Baum-Welch at most; gain a token (natural log) below which they end.
ROUNDS, SETTLED = 8, 0.01
#: Tokens of texts that are put in order of length, and of those worked on side by side.
SORTED, SIDE_BY_SIDE = 1 << 22, 1 << 19
BLOCK_BYTES, BLOCKS_A_TASK = 12 << 20, 2

CODED = "block long, doc_id long, held boolean, codes binary, code int, word string, n long"


def _coded(docs: DataFrame) -> DataFrame:
    """Rows of two kinds for each block: documents with their words' codes, and distinct words with training counts."""
    fields = [("block", pa.int64()), ("doc_id", pa.int64()), ("held", pa.bool_()), ("codes", pa.binary()), ("code", pa.int32()), ("word", pa.string()), ("n", pa.int64())]
    schema = pa.schema(fields)

    def run(batches):
        k = 0
        for b in text_slices(batches, most=BLOCK_BYTES):
            if not b.num_rows:
                continue
            block = (b.column("pid")[0].as_py() << 32) + k
            k += 1
            lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(b.column("text"), "")))
            n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = lists.flatten().dictionary_encode()
            codes, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
            doc = np.repeat(np.arange(b.num_rows), n)
            blank = pc.index(words, "").as_py()
            if blank >= 0:
                real = codes != blank
                codes, doc = codes[real], doc[real]
            held = np.asarray(b.column("held").to_pylist(), bool)
            cut = np.searchsorted(doc, np.arange(b.num_rows + 1)).tolist()
            count = np.bincount(codes[~held[doc]], minlength=len(words))
            raw = codes.astype("<u4")
            rows = b.num_rows
            nulls = [pa.nulls(rows, t) for _, t in fields]
            yield pa.RecordBatch.from_arrays(
                [pa.array([block] * rows, pa.int64()), b.column("doc_id"), pa.array(held), pa.array([raw[cut[i] : cut[i + 1]].tobytes() for i in range(rows)], pa.binary()), *nulls[4:]],
                schema=schema,
            )
            at = np.arange(len(words))
            if blank >= 0:
                at = np.delete(at, blank)
            nulls = [pa.nulls(len(at), t) for _, t in fields]
            yield pa.RecordBatch.from_arrays(
                [pa.array([block] * len(at), pa.int64()), *nulls[1:4], pa.array(at, pa.int32()), words.take(pa.array(at)), pa.array(count[at], pa.int64())], schema=schema
            )

            del lists, coded, codes, words, raw, doc
            pa.default_memory_pool().release_unused()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(7).alias("held"), "text", F.spark_partition_id().alias("pid"))
    return rows.mapInArrow(run, CODED)


def _classed(coded: DataFrame):
    """``word, c, kind`` of training words; corpus totals N, V; tokens of each kind; words seen once."""
    words = coded.where("word is not null and n > 0").groupBy("word").agg(F.sum("n").alias("c"))
    words = materialize(words, "word-counts")
    docs = coded.where("codes is not null and not held").count()
    top = words.orderBy(F.desc("c"), "word").limit(FREQUENT).select("word", "c").collect()
    spark = coded.sparkSession
    # at most FREQUENT rows
    frequent = spark.createDataFrame([(r["word"], i) for i, r in enumerate(top)], "word string, own int")
    ending = FREQUENT + F.pmod(F.xxhash64(F.substring("word", -3, 3)), F.lit(ENDINGS)).cast("int")
    classed = words.join(F.broadcast(frequent), "word", "left").select("word", "c", F.coalesce("own", ending).alias("kind"))
    by_kind = classed.groupBy("kind").agg(F.sum("c").alias("c"), F.count("*").alias("words"), F.count_if(F.col("c") == 1).alias("once")).collect()
    size = np.zeros(KINDS)
    for r in by_kind:
        size[r["kind"]] = r["c"]
    size[END] = docs
    known = sum(r["words"] for r in by_kind) + (docs > 0)
    return classed, int(size.sum()), known, size, sum(r["once"] for r in by_kind)


def _with_kinds(coded: DataFrame, classed: DataFrame, total: int, known: int, size: np.ndarray) -> DataFrame:
    """Each document's kinds and those parts of its scores that need no model."""
    base_of = float(np.log10(total + known + 1))
    out = "doc_id long, held boolean, n_tokens long, n_known long, base_score double, within double, kinds binary"
    schema = pa.schema([("doc_id", pa.int64()), ("held", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("within", pa.float64()), ("kinds", pa.binary())])
    words = coded.where("word is not null").select("block", "code", "word").join(classed, "word")
    # one number for code and kind; frequent words' counts are those of their kinds
    words = words.select(F.col("block").alias("of"), (F.col("code").cast("long") * PACK + F.col("kind")).alias("packed"), F.when(F.col("kind") < FREQUENT, 0).otherwise(F.col("c")).alias("c"))

    def block(docs: pa.Table, words: pa.Table) -> pa.Table:
        packed = words.column("packed").to_numpy()
        code, own = packed // PACK, packed % PACK
        codes = np.frombuffer(b"".join(docs.column("codes").to_pylist()), "<u4").astype(np.int64)
        most = max(int(codes.max(initial=0)), int(code.max(initial=0))) + 1
        c, kind = np.zeros(most, np.int64), np.full(most, UNKNOWN, np.int64)
        c[code], kind[code] = np.where(own < FREQUENT, size[own].astype(np.int64), words.column("c").to_numpy()), own
        base = np.log10(c + 1) - base_of
        with np.errstate(divide="ignore", invalid="ignore"):
            inside = np.where(c > 0, np.log10(np.maximum(c, 1)) - np.log10(np.maximum(size[kind], 1)), 0.0)
        n = np.array([x // 4 for x in pc.binary_length(docs.column("codes")).to_pylist()], np.int64)
        at = np.concatenate([[0], np.cumsum(n)])

        def sums(x):
            s = np.concatenate([[0], np.cumsum(x[codes], dtype=np.float64)])
            return s[at[1:]] - s[at[:-1]]

        end = np.log10(size[END] + 1) - base_of
        kinds = kind[codes].astype("<u2")
        ended = [kinds[at[i] : at[i + 1]].tobytes() + np.array([END], "<u2").tobytes() for i in range(len(n))]
        known_ = sums(c > 0).round().astype(np.int64) + (size[END] > 0)
        return pa.Table.from_arrays(
            [docs.column("doc_id"), docs.column("held"), pa.array(n + 1), pa.array(known_), pa.array(sums(base) + end), pa.array(sums(inside)), pa.array(ended, pa.binary())], schema=schema
        )

    docs = coded.where("codes is not null").select("block", "doc_id", "held", "codes")
    # a task has few blocks, however many there are
    blocks = docs.agg(F.approx_count_distinct("block")).first()[0]
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks // BLOCKS_A_TASK)
    docs, words = docs.repartition(parts, "block"), words.repartition(parts, "of")
    return docs.groupBy("block").cogroup(words.groupBy("of")).applyInArrow(block, out)


def _sequences(batches, most: int = 1 << 18):
    """Kinds and offsets of some documents at a time, of about ``most`` tokens or one longer text."""
    for b in text_slices(batches, "kinds", 2 * most):
        if b.num_rows:
            n = pc.binary_length(b.column("kinds")).to_numpy(zero_copy_only=False).astype(np.int64) // 2
            yield b, np.frombuffer(b"".join(b.column("kinds").to_pylist()), "<u2").astype(np.int64), np.concatenate([[0], np.cumsum(n)])


def _by_length(batches):
    """Kinds and offsets of whole texts of about one length, so that few steps are for long ones alone."""

    def groups(texts: list[bytes]):
        texts.sort(key=len)
        own, n = [], 0
        for t in texts:
            if own and n + len(t) > 2 * SIDE_BY_SIDE:
                yield own
                own, n = [], 0
            own.append(t)
            n += len(t)
        yield own

    def held():
        texts, n = [], 0
        for b in batches:
            for t in b.column("kinds").to_pylist():
                texts.append(t)
                n += len(t)
                if n > 2 * SORTED:
                    yield from groups(texts)
                    texts, n = [], 0
        if texts:
            yield from groups(texts)

    for own in held():
        yield np.frombuffer(b"".join(own), "<u2").astype(np.int64), np.concatenate([[0], np.cumsum([len(t) // 2 for t in own])])


#: Numbers in one piece of a table of counts, the unit in which tasks' counts are summed.
PIECE = 1 << 12


def _round(rows: DataFrame, model: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Expected counts over all rows; tasks' tables are summed by piece, as a stream."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("piece", pa.int32()), ("sums", pa.binary())])
    shapes = {k: model[k].shape for k in ("first", "trans", "emit")} | {"loglik": (1,)}

    def expect(batches):
        total = None
        for kinds, offsets in _by_length(batches):
            got = expectations(sent.value, kinds, offsets)
            flat = np.concatenate([got[k].ravel() for k in shapes])
            total = flat if total is None else total + flat
        if total is not None:
            pieces = [total[at : at + PIECE].astype("<f8").tobytes() for at in range(0, len(total), PIECE)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.binary())], schema=schema)

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column("piece").to_pylist(), b.column("sums").to_pylist()):
                x = np.frombuffer(raw, "<f8")
                sums[k] = sums[k] + x if k in sums else x
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], schema=schema)

    parts = rows.select("kinds").mapInArrow(expect, "piece int, sums binary").repartition("piece").mapInArrow(add, "piece int, sums binary").collect()
    sent.destroy()
    flat = np.concatenate([np.frombuffer(r["sums"], "<f8") for r in sorted(parts, key=lambda r: r["piece"])])
    got, at = {}, 0
    for k, shape in shapes.items():
        n = int(np.prod(shape))
        got[k] = flat[at : at + n].reshape(shape)
        at += n
    return got


def train(rows: DataFrame, size: np.ndarray, p_unknown: float, rounds: int = ROUNDS, settled: float = SETTLED) -> dict[str, np.ndarray]:
    """``rows`` has the ``kinds`` of all training texts; ``size`` their counts by kind."""
    prior = size / size.sum()
    model, last = random_model(STATES, prior, UNKNOWN, p_unknown), None
    for _ in range(rounds):
        got = _round(rows, model)
        model = maximized(got, prior, UNKNOWN, p_unknown)
        mean = float(got["loglik"][0]) / size.sum()
        if last is not None and mean - last < settled:
            break
        last = mean
    return model


def score_texts(docs: DataFrame) -> DataFrame:
    """Every document's base score and model score, learned from those that aren't held out."""
    coded = materialize(_coded(docs), "coded")
    classed, total, known, size, once = _classed(coded)
    rows = materialize(_with_kinds(coded, classed, total, known, size), "kinds")
    if not total:
        scored = rows.withColumn("score", F.col("base_score"))
    else:
        model = train(rows.where("not held"), size, float(np.clip(once / total, 1 / (total + known + 1), 0.5)))
        sent = docs.sparkSession.sparkContext.broadcast(model)

        def score(batches):
            for b, kinds, offsets in _sequences(batches):
                own = log10_likelihood(sent.value, kinds, offsets) + b.column("within").to_numpy(zero_copy_only=False)
                names = [c for c in b.schema.names if c not in ("kinds", "within")]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(own)], names=[*names, "score"])

        scored = rows.mapInArrow(score, "doc_id long, held boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(
        "doc_id", F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score"
    )


def op6_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read_table(spark, sf_dir, "documents"))
