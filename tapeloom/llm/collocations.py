"""Phrase collocations by multikey quicksort of suffix pointers.

Routing by leading words goes by levels, each of which abandons what is too
rare.  Words are counted by language.  Pairs of words that are frequent enough
are counted next, as sets of 40-bit hashes in ascending order, which take about
three bytes a pair; sums of pairs that share a hash can only be too high, so no
frequent pair is lost.  Then suffixes, cut to ``DEPTH`` words and ended where a
word or pair is too rare or their piece ends, go to tasks by their leading
words, equal ones of a task as one row with a weight.  There a three-way
quicksort of suffix pointers, one word at a time, down to ``DEPTH``, makes
partitions of equal beginnings: a partition's weight is the count of that
phrase.  A partition below ``least`` is abandoned.

A leading word that makes up more than 1 / ``HOT`` of all words (there are fewer
than ``HOT``) doesn't decide a suffix's task by itself: the next word is taken as
well, and so on.  So no task gets much more than 1 / ``HOT`` of the suffixes for
one key.  Phrases of such words alone are counted in several tasks, none of
them abandoned there; their counts are summed afterwards.

Words travel as 64-bit hashes of language and word.  That no two of the corpus
share a hash is checked over the whole vocabulary; else another seed is taken.
Which words and pairs are frequent is told to tasks by bitmaps of at most
``MOST_BITS``; where one fills, rarer ones pass and their suffixes are abandoned
later: counts stay exact.

Scores, covered phrases and ranks are joins over the counted phrases.  A null
text is empty; a null language is ``und``, as is one of that name.  Repeated rows
count each time.  Texts of any length are read whole (a batch holds one text of
up to 2 GB); an empty table gives an empty one; other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.common import materialize, read_table
from tapeloom.llm.tokens import text_slices

DEPTH, HOT = 5, 512
MOST_BITS, SEGMENT = 1 << 28, 1 << 18
#: Suffixes that a task sorts, about; what a task gathers before it sends it on; bytes of text worked on at a time.
TOGETHER, GATHERED, SLICE = 1 << 21, 1 << 19, 2 << 20
#: Bits of a pair's hash.
PAIR_BITS = 40
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 0 in words, 1 between words, 2 between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 32]] = 1
_KIND[[10, 11, 12, 13, *b".,;:!?"]] = 2
_U = np.uint64


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased words of some texts in order, and for each the number of its piece."""
    begins = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[begins[0] : begins[-1]]
    begins = begins[:-1] - begins[0]
    kind = _KIND[data]
    inside = kind == 0
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    at = begins[begins < len(data)]
    start[at] = inside[at]
    first = np.flatnonzero(start)
    piece = np.cumsum(kind == 2, dtype=np.int32)[first] + np.searchsorted(begins, first, side="right").astype(np.int32)
    offsets = np.append(np.cumsum(inside, dtype=np.int32)[first] - 1, np.count_nonzero(inside)).astype(np.int32)
    return pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[inside]])), piece


def _by_lang(batches):
    """Language and texts of each slice's languages."""
    for b in text_slices(batches, most=SLICE):
        langs = pc.fill_null(b.column("lang"), "und").dictionary_encode()
        own = langs.indices.to_numpy(zero_copy_only=False)
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            yield lang, pc.fill_null(b.column("text").take(pa.array(np.flatnonzero(own == k))), "")


def word_counts(docs: DataFrame) -> DataFrame:
    """``lang, word, n`` of all words; ``docs`` has ``lang, text``."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def run(batches):
        for lang, texts in _by_lang(batches):
            words = words_of(texts)[0].dictionary_encode()
            n = np.bincount(words.indices.to_numpy(zero_copy_only=False), minlength=len(words.dictionary))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), words.dictionary, pa.array(n, pa.int64())], schema=schema)

    return docs.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _coded(vocabulary: DataFrame) -> tuple[DataFrame, str]:
    """``vocabulary`` with ``code``, all distinct, and what the hash begins with."""
    for seed in map(str, range(8)):
        coded = vocabulary.withColumn("code", F.xxhash64(F.concat_ws("\0", F.lit(seed), "lang", "word")))
        if coded.groupBy("code").count().where("count > 1").isEmpty():
            return coded, seed
    raise RuntimeError("no seed gives every word a hash of its own")


def _codes(seed: str, lang: str, words: list[str]) -> np.ndarray:
    prefix = f"{seed}\0{lang}\0"
    return np.fromiter((xxhash.xxh64_intdigest(prefix + w, 42) for w in words), _U, len(words))


def _bitmap(places: DataFrame, bits: int) -> np.ndarray:
    """Bits at ``place``, a column below ``bits``."""
    schema = pa.schema([("segment", pa.int32()), ("bits", pa.binary())])

    def run(batches):
        state: dict[int, np.ndarray] = {}
        for b in batches:
            place = b.column("place").to_numpy()
            for k in np.unique(place // SEGMENT).tolist():
                state.setdefault(k, np.zeros(SEGMENT, bool))[place[place // SEGMENT == k] % SEGMENT] = True
        for k, own in state.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())], schema=schema)

    out = np.zeros(bits // 8, np.uint8)
    for r in places.repartition(F.expr(f"place div {SEGMENT}")).mapInArrow(run, "segment int, bits binary").toLocalIterator():
        out[r["segment"] * SEGMENT // 8 : (r["segment"] + 1) * SEGMENT // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _filter_of(hashes: DataFrame, column: str) -> np.ndarray:
    """A bitmap of some hashes, 64 bits each up to ``MOST_BITS``."""
    count, bits = hashes.count(), SEGMENT
    while bits < min(64 * count, MOST_BITS):
        bits *= 2
    return _bitmap(hashes.select(F.col(column).bitwiseAND(F.lit(bits - 1)).cast("int").alias("place")), bits)


def _has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = (hashes & _U(len(bits) * 8 - 1)).astype(np.int64)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def _sequences(batches, words_filter: np.ndarray, seed: str):
    """Of each slice's languages the codes of all words in order, 0 for rare ones, and whether a word and the next are a pair in a piece."""
    for lang, texts in _by_lang(batches):
        words, piece = words_of(texts)
        words = words.dictionary_encode()
        codes = _codes(seed, lang, words.dictionary.to_pylist())
        codes[~_has(words_filter, codes)] = 0
        own = codes[words.indices.to_numpy(zero_copy_only=False)]
        yield own, (piece[1:] == piece[:-1]) & (own[1:] != 0) & (own[:-1] != 0)


def _pair_hashes(own: np.ndarray, paired: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(paired)
    return _mix(_mix(own[at], _U(1)), own[at + 1]) >> _U(64 - PAIR_BITS)


def _summed(hashes: np.ndarray, n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, ascending, with their counts, up to ``most``."""
    order = np.argsort(hashes)
    hashes, n = hashes[order], n[order]
    at = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
    return hashes[at], np.minimum(np.add.reduceat(n, at), most) if len(at) else n


def _planes(x: np.ndarray) -> bytes:
    """Compressed, the lowest bytes of all values first."""
    return pa.Codec("zstd").compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), asbytes=True)


def _from_planes(data: bytes, kind: str, count: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = pa.Codec("zstd").decompress(data, count * size, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def frequent_pairs(docs: DataFrame, filt, seed: str, least: int, routes: int) -> DataFrame:
    """``pair``, the hashes of word pairs whose occurrences reach ``least``."""
    sent = pa.schema([("route", pa.int32()), ("count", pa.int32()), ("steps", pa.binary()), ("n", pa.binary())])
    bits = max(8, (routes - 1).bit_length())  # at least 256 routes, so that a step fits into 32 bits
    width, most = 1 << (PAIR_BITS - bits), min(least, 1 << 30)

    def gathered(parts):
        hashes, n = _summed(np.concatenate([h for h, _ in parts]), np.concatenate([c for _, c in parts]), most)
        route = (hashes // _U(width)).astype(np.int64)
        cuts = np.append(np.flatnonzero(np.append(True, route[1:] != route[:-1])), len(hashes)) if len(hashes) else [0]
        for a, z in zip(cuts[:-1], cuts[1:]):
            steps = np.diff(hashes[a:z] - _U(int(route[a]) * width), prepend=_U(0)).astype("<u4")
            values = [int(route[a]), int(z - a), _planes(steps), _planes(n[a:z].astype("<u4"))]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, sent)], schema=sent)

    def send(batches):
        parts, size = [], 0
        for own, paired in _sequences(batches, filt.value, seed):
            hashes = _pair_hashes(own, paired)
            found, n = _summed(hashes, np.ones(len(hashes), np.int32), most)
            parts.append((found, n.astype(np.int32)))
            size += len(found)
            if size > 2 * GATHERED:
                yield from gathered(parts)
                parts, size = [], 0
        if parts:
            yield from gathered(parts)

    def merge(batches):
        for route, rows in _grouped(batches, ("count", "steps", "n")):
            hashes = np.concatenate([np.cumsum(_from_planes(s, "<u4", c).astype(_U)) for c, s, _ in rows]) + _U(route * width)
            found, n = _summed(hashes, np.concatenate([_from_planes(x, "<u4", c).astype(np.int64) for c, _, x in rows]), most)
            yield pa.RecordBatch.from_arrays([pa.array(found[n >= least].astype(np.int64))], names=["pair"])

    routed = docs.mapInArrow(send, "route int, count int, steps binary, n binary")
    return routed.repartition("route").sortWithinPartitions("route").mapInArrow(merge, "pair long")


def _grouped(batches, columns: tuple[str, ...]):
    """Rows of each route of a part sorted by it."""
    route, rows = None, []
    for b in batches:
        for r, *row in zip(*(b.column(c).to_pylist() for c in ("route", *columns))):
            if r != route and rows:
                yield route, rows
                rows = []
            route = r
            rows.append(row)
    if rows:
        yield route, rows


def _windows(own: np.ndarray, paired: np.ndarray) -> np.ndarray:
    """For each word that makes a pair with the next its next ``DEPTH`` words, ended by 0 where a pair ends."""
    n = len(own)
    ends = np.flatnonzero(np.append(~paired, True)) + 1  # a run ends before here
    left = ends[np.searchsorted(ends, np.arange(n), side="right")] - np.arange(n)
    at = np.flatnonzero(left > 1)
    out = np.zeros((DEPTH, len(at)), own.dtype)
    for k in range(DEPTH):
        more = left[at] > k
        out[k, more] = own[at[more] + k]
    return out


def _mix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x = (x ^ y) * _U(0x9E3779B97F4A7C15)
    return x ^ (x >> _U(29))


def _whole(w: np.ndarray) -> np.ndarray:
    out = np.zeros(w.shape[1], _U)
    for row in w:
        out = _mix(out, row)
    return out


def _weighted(w: np.ndarray, weight: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal suffixes as one, in the order of ``key``, which equal ones share."""
    order = np.argsort(key)
    w, key = w[:, order], key[order]
    at = np.flatnonzero(np.append(True, (w[:, 1:] != w[:, :-1]).any(axis=0)))
    return w[:, at], np.add.reduceat(weight[order], at), key[at]


def suffixes(docs: DataFrame, words_filter, pairs_filter, hot: frozenset[int], seed: str, routes: int) -> DataFrame:
    """``route, count, codes, windows, weights``: suffixes of a task for each route, distinct ones with their weights, packed."""
    schema = pa.schema([("route", pa.int32()), ("count", pa.int32()), ("codes", pa.binary()), ("windows", pa.binary()), ("weights", pa.binary())])
    hot_codes = np.array(sorted(hot), _U)

    def gathered(parts):
        w, weight = np.concatenate([x for x, _ in parts], axis=1), np.concatenate([n for _, n in parts])
        route, going = np.zeros(w.shape[1], _U), np.ones(w.shape[1], bool)
        for row in w:
            route = np.where(going, _mix(route, row), route)
            going &= np.isin(row, hot_codes)
        w, weight, key = _weighted(w, weight, ((route % _U(routes)) << _U(40)) | (_whole(w) >> _U(24)))
        route = (key >> _U(40)).astype(np.int64)
        cuts = np.append(np.flatnonzero(np.append(True, route[1:] != route[:-1])), len(route))
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            codes, place = np.unique(w[:, a:z], return_inverse=True)
            packed = place.reshape(-1).astype("<u2" if len(codes) <= 1 << 16 else "<u4")
            values = [int(route[a]), z - a, codes.astype("<u8").tobytes(), _planes(packed), _planes(weight[a:z].astype("<u4"))]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

    def run(batches):
        parts, size = [], 0
        for own, paired in _sequences(batches, words_filter.value, seed):
            paired[np.flatnonzero(paired)[~_has(pairs_filter.value, _pair_hashes(own, paired))]] = False
            w = _windows(own, paired)
            if not w.shape[1]:
                continue
            w, weight, _ = _weighted(w, np.ones(w.shape[1], np.int32), _whole(w))
            parts.append((w, weight))
            size += len(weight)
            if size > GATHERED:
                yield from gathered(parts)
                parts, size = [], 0
        if parts:
            yield from gathered(parts)

    return docs.mapInArrow(run, "route int, count int, codes binary, windows binary, weights binary")


def sorted_counts(words: list[np.ndarray], weight: np.ndarray, common: np.ndarray, least: int):
    """Multikey three-way quicksort: ``phrase, count`` of every beginning of 2 words or more.

    ``words[k]`` is the k-th word of each suffix, 0 past its end; ``common`` tells
    hot words.  Phrases of hot words alone come with any count, others with
    ``least`` or more.
    """
    stack: list[tuple] = []

    def descend(own: np.ndarray, prefix: tuple, complete: bool) -> None:
        """A partition's next words; ``complete``: all suffixes that begin with ``prefix`` are here."""
        if complete:
            stack.append((own, prefix, True, True))
            return
        mark = common[words[len(prefix)][own]]
        for part, may_stop in ((own[mark], False), (own[~mark], True)):
            if len(part):
                stack.append((part, prefix, False, may_stop))

    descend(np.arange(len(weight), dtype=np.int32), (), False)
    while stack:
        own, prefix, complete, may_stop = stack.pop()
        key = words[len(prefix)][own]
        sample = key[:: max(1, len(key) // 9)]
        pivot = int(np.partition(sample, len(sample) // 2)[len(sample) // 2])
        below, above = key < pivot, key > pivot
        for side in (below, above):
            part = own[side]
            if len(part) and not (may_stop and weight[part].sum() < least):
                stack.append((part, prefix, complete, may_stop))
        if not pivot:
            continue
        part = own[~(below | above)]
        n = int(weight[part].sum())
        whole = complete or not common[pivot]
        if whole and n < least:
            continue
        phrase = (*prefix, pivot)
        if len(phrase) > 1:
            yield phrase, n
        if len(phrase) < len(words):
            descend(part, phrase, whole)


def phrase_counts(routed: DataFrame, hot: frozenset[int], least: int) -> DataFrame:
    """``codes, n`` of all phrases of 2 to ``DEPTH`` words with at least ``least`` occurrences."""
    schema = pa.schema([("codes", pa.list_(pa.int64())), ("n", pa.int64())])
    hot_codes = np.array(sorted(hot), _U)

    def counted(rows: list) -> pa.RecordBatch:
        books = [np.frombuffer(c, "<u8") for _, c, _, _ in rows]
        all_codes, where = np.unique(np.concatenate([np.zeros(1, _U), *books]), return_inverse=True)  # 0 is the least
        columns, at = [[] for _ in range(DEPTH)], 1
        for book, (count, _, packed, _) in zip(books, rows):
            own = where[at : at + len(book)].astype(np.int32)
            at += len(book)
            w = _from_planes(packed, "<u2" if len(book) <= 1 << 16 else "<u4", count * DEPTH).reshape(DEPTH, -1)
            for k in range(DEPTH):
                columns[k].append(own[w[k]])
        weight = np.concatenate([_from_planes(x, "<u4", count) for count, _, _, x in rows]).astype(np.int64)
        common = np.append(False, np.isin(all_codes[1:], hot_codes))
        found = list(sorted_counts([np.concatenate(c) for c in columns], weight, common, least))
        flat = all_codes[np.fromiter((w for p, _ in found for w in p), np.int64)].view(np.int64) if found else np.zeros(0, np.int64)
        ends = np.cumsum([0, *(len(p) for p, _ in found)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array([n for _, n in found], pa.int64())], schema=schema)

    def run(batches):
        for _, rows in _grouped(batches, ("count", "codes", "windows", "weights")):
            yield counted(rows)

    parts = routed.repartition("route").sortWithinPartitions("route")
    found = parts.mapInArrow(run, "codes array<long>, n long")
    return found.groupBy("codes").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """``codes, lang, phrase, a, l, r, n, score`` of phrases of two words or more, each with its lowest-scoring cut."""
    counts = phrases.select(F.col("codes").alias("own"), F.col("f"))
    cuts = phrases.where("m > 1").select("codes", "lang", "phrase", F.col("f").alias("a"), "m", F.expr("explode(sequence(1, m - 1)) AS k"))
    cuts = cuts.select("*", F.expr("slice(codes, 1, k) AS head"), F.expr("slice(codes, k + 1, m - k) AS rest"))
    cuts = cuts.join(counts.select(F.col("own").alias("head"), F.col("f").alias("l")), "head").join(counts.select(F.col("own").alias("rest"), F.col("f").alias("r")), "rest")
    cuts = cuts.join(totals, "lang")
    wide = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    score = F.expr(f"({wide('1000 * a')} * {wide('n')}) DIV ({wide('l')} * {wide('r')})").alias("score")
    cuts = cuts.select("codes", "lang", "phrase", "a", "n", F.struct(score, F.col("k"), F.col("l"), F.col("r")).alias("cut"))
    best = cuts.groupBy("codes").agg(*[F.first(c).alias(c) for c in ("lang", "phrase", "a", "n")], F.min("cut").alias("cut"))
    return best.select("codes", "lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(docs: DataFrame, least: int = 100, covered_share: int = 100, top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language.

    A phrase goes if one that holds it has at least ``covered_share`` percent of
    its occurrences.  A phrase one word longer decides: any other that holds both
    is no more frequent.
    """
    spark = docs.sparkSession
    plain = docs.select(docs[lang_col].cast("string").alias("lang"), docs[text_col].alias("text"))
    vocabulary, seed = _coded(materialize(word_counts(plain), "words"))
    totals = materialize(vocabulary.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    whole = totals.agg(F.sum("n")).first()[0] or 0
    frequent = materialize(vocabulary.where(F.col("n") >= least), "frequent")
    hot = frozenset(r["code"] % (1 << 64) for r in frequent.where(F.col("n") * HOT > whole).select("code").collect())
    routes = 2 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), whole // TOGETHER)
    words_filter = spark.sparkContext.broadcast(_filter_of(frequent, "code"))
    pairs = materialize(frequent_pairs(plain, words_filter, seed, least, routes), "pairs")
    pairs_filter = spark.sparkContext.broadcast(_filter_of(pairs, "pair"))
    counted = materialize(phrase_counts(suffixes(plain, words_filter, pairs_filter, hot, seed, routes), hot, least), "phrases")
    for b in (words_filter, pairs_filter):
        b.unpersist()
    words = counted.select("codes", "n", F.posexplode("codes").alias("i", "code")).join(frequent.select("code", "lang", "word"), "code")
    named = words.groupBy("codes").agg(F.first("lang").alias("lang"), F.first("n").alias("f"), F.array_sort(F.collect_list(F.struct("i", "word"))).alias("w"))
    named = named.select("codes", "lang", F.expr("array_join(w.word, ' ')").alias("phrase"), "f", F.size("codes").alias("m"))
    single = frequent.select(F.array("code").alias("codes"), "lang", F.col("word").alias("phrase"), F.col("n").alias("f"), F.lit(1).alias("m"))
    phrases = materialize(named.union(single), "named")
    inner = [phrases.where("m > 2").select(F.expr(f"slice(codes, {k}, m - 1)").alias("codes"), "f") for k in (1, 2)]
    longer = inner[0].union(inner[1]).groupBy("codes").agg(F.max("f").alias("longer"))
    kept = _scored(phrases, totals).join(longer, "codes", "left").where(F.expr(f"longer IS NULL OR 100 * longer < {covered_share} * a"))
    order = "ORDER BY score DESC, a DESC, phrase"
    # a language's first ones by part, then of all
    part = kept.withColumn("place", F.expr(f"row_number() OVER (PARTITION BY lang, pmod(hash(codes), 64) {order})")).where(F.col("place") <= top)
    ranked = part.withColumn("rank", F.expr(f"CAST(row_number() OVER (PARTITION BY lang {order}) AS LONG)")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang
), places AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words
), grams AS (
  SELECT lang, w[i : i + m - 1] AS p, m FROM places, (SELECT unnest(range(1, 6)) AS m) WHERE i + m - 1 <= len(w)
), counts AS (
  SELECT lang, p, m, count(*)::BIGINT AS f FROM grams GROUP BY lang, p, m HAVING count(*) >= 100
), cuts AS (
  SELECT lang, p, m, f AS a, unnest(range(1, m)) AS k FROM counts WHERE m > 1
), scored AS (
  SELECT c.lang, c.p, c.a, x.f AS l, y.f AS r, t.n, (1000::HUGEINT * c.a * t.n // (x.f::HUGEINT * y.f))::BIGINT AS score,
         row_number() OVER (PARTITION BY c.lang, c.p ORDER BY 1000::HUGEINT * c.a * t.n // (x.f::HUGEINT * y.f), c.k) AS best
  FROM cuts c JOIN counts x ON c.lang = x.lang AND c.p[1 : c.k] = x.p JOIN counts y ON c.lang = y.lang AND c.p[c.k + 1 : c.m] = y.p
  JOIN totals t ON c.lang = t.lang
), inside AS (
  SELECT lang, p[i : i + k - 1] AS p, max(f) AS longer
  FROM (SELECT lang, p, m, f, k, unnest(range(1, m - k + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS k FROM counts WHERE m > 2)) GROUP BY ALL
), kept AS (
  SELECT s.lang, array_to_string(s.p, ' ') AS phrase, a, l, r, n, score FROM scored s LEFT JOIN inside i ON s.lang = i.lang AND s.p = i.p
  WHERE best = 1 AND NOT coalesce(100 * longer >= 100 * a, false)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
