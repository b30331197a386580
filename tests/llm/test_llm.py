"""Each operator against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tapeloom.llm import contamination, hmm, language_id, language_model, line_dedup, near_text, packing, quality, simhash, token_counts, token_files, tokens, topk_search
from tapeloom.llm.common import fresh_path

WORDS = [a + b + c for a in ("ka", "lo", "mi", "ten", "ra") for b in ("ru", "ne", "sto", "") for c in ("s", "ing", "ta", "lem")]


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    out = [None, "", " ", "\n", "a", "a  b", "Word, word.\nNext line here\n", "É́ Σας İstanbul", "x <|endoftext|> y", "tab\tand\x1codd\x0bspace\r\n", "日本語 テキスト", "no" * 3000, prose(r, 6000)]
    out += [prose(r, r.randint(1, 90)) for _ in range(40)]
    out += [out[20], out[20], "\n".join([out[21], out[22]]), out[21].upper()]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 3, t, "en", -1, "k") for i, t in enumerate(texts)] + [(None, "null id, as long as any line", None, 0, "k"), (3 * 25, texts[25], "en", 7, "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, id int, length string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id < -5")


def ids_of(name, text):
    return tokens.load_tokenizer(tokens.tokenizer_path(name)).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("kind,name", [(tokens.SpacedEncoder, "byte_bpe_50k.json"), (tokens.WordEncoder, "word_bpe_49k.json")])
def test_encoders_equal_the_library(kind, name, texts):
    enc = kind(tokens.tokenizer_path(name))
    r = random.Random(1)
    own = [t or "" for t in texts] + ["".join(r.choice("ab \n\t.,'1É\x01\x1c<|́") for _ in range(30)) for _ in range(400)]
    for t, got in zip(own, enc.encode(pa.array(own))):
        assert got.tolist() == enc.whole(t).tolist(), t


def test_token_counts(docs, empty):
    path = tokens.tokenizer_path("word_bpe_49k.json")
    rows = token_counts.token_counts(docs, path, 50).collect()
    want = collections.Counter((r["doc_id"], len((r["text"] or "").encode()), n := len(ids_of("word_bpe_49k.json", r["text"])), n > 50) for r in docs.collect())
    assert collections.Counter(map(tuple, rows)) == want
    assert token_counts.token_counts(empty, path, 50).count() == 0


def test_packing(docs, empty):
    path, cap = tokens.tokenizer_path("word_bpe_49k.json"), 200
    rows = packing.pack(docs, path, cap).toPandas()
    want = collections.Counter()
    for r in docs.collect():
        ids = np.array([*ids_of("word_bpe_49k.json", r["text"]), 1], "<u4")
        for k, at in enumerate(range(0, len(ids), cap)):
            want[r["doc_id"], k, at, len(ids[at : at + cap]), zlib.crc32(ids[at : at + cap].tobytes())] += 1
    none = lambda v: None if v != v else int(v)
    assert collections.Counter((none(x.doc_id), x.piece, x.start, x.length, x.ids_crc32) for x in rows.itertuples()) == want
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert own.length.sum() <= cap and (own.length.cumsum() - own.length == own.offset).all()
    assert rows.sequence_id.nunique() == -(-rows.length.sum() // cap)
    assert packing.pack(empty, path, cap).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_all_pieces_and_is_near_the_bound(seed):
    r = random.Random(seed)
    counts = collections.Counter(r.choice([r.randint(1, 100), r.randint(40, 60), 100, 34]) for _ in range(r.randint(1, 400)))
    plan = packing.plan_packing(dict(counts), 100)
    used = collections.Counter()
    for pattern, times in plan:
        assert sum(pattern) <= 100
        for s in pattern:
            used[s] += times
    assert used == counts
    bins, total = sum(t for _, t in plan), sum(s * n for s, n in counts.items())
    big = sum(n for s, n in counts.items() if s > 50)
    assert bins <= max(-(-total // 100), big) * 1.12 + 1


def test_line_dedup(docs, empty):
    rows = [r for r in docs.collect()]
    held = collections.defaultdict(set)
    low = {c: c + 32 for c in range(65, 91)}
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(low)
    for r in rows:
        for line in (r["text"] or "").split("\n"):
            if r["doc_id"] is not None and len(key(line)) >= 10:
                held[key(line)].add(r["doc_id"])
    want = {}
    for r in rows:
        lines = (r["text"] or "").split("\n")
        kept = [x for x in lines if r["doc_id"] is None or len(held.get(key(x), ())) < 2 or min(held[key(x)]) == r["doc_id"]]
        want[r["doc_id"]] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    for bits in (16, 1):  # a filter that is too small suspects more and gives the same
        got = line_dedup.line_report(docs, bits_per_line=bits, max_bits=1 << 16).collect()
        assert len(got) == len(rows) and all(want[r["doc_id"]] == tuple(r)[1:] for r in got)
    cleaned = line_dedup.dedup_lines(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == len(rows)
    assert line_dedup.line_report(empty).count() == 0


def test_simhash(spark, docs, empty):
    def fp(text):
        w = (text or "").encode().lower().split()
        s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    rows = docs.collect()
    prints = [fp(r["text"]) for r in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[top(i)] = top(j)
    least = collections.defaultdict(list)
    for i, r in enumerate(rows):
        least[top(i)].append(r["doc_id"])
    want = collections.Counter((r["doc_id"], simhash._signed(prints[i]), min((x for x in least[top(i)] if x is not None), default=None)) for i, r in enumerate(rows))
    got = simhash.near_duplicates(docs).select("id", "fp", "component").collect()
    assert collections.Counter(map(tuple, got)) == want
    assert simhash.near_duplicates(empty).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, x) for x in range(10, 60)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{x: 5 for x in [5, *range(10, 60)]}}


def test_ball_finds_all_links_within_two_bits(spark):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(30)]
    prints = base + [b ^ sum(1 << i for i in r.sample(range(64), 2)) for b in base]
    nodes = spark.createDataFrame([(i, simhash._signed(p)) for i, p in enumerate(dict.fromkeys(prints))], "node long, fp long")
    got = simhash.components(simhash.linked_neighbours(nodes)).collect()
    assert {r["node"]: r["component"] for r in got if r["node"] >= 30} == {30 + i: i for i in range(30)}


def test_token_files(spark, docs, empty):
    path = fresh_path(spark, "files")
    name = "byte_bpe_50k.json"
    token_files.write_token_files(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), path, tokens.tokenizer_path(name), 0)
    got = {r["doc_id"]: tuple(r)[1:] for r in token_files.ids_digest(token_files.read_token_files(spark, path)).collect()}
    at = 0
    for r in sorted({r["doc_id"]: r for r in docs.collect() if r["doc_id"] is not None}.values(), key=lambda r: r["doc_id"]):
        ids = np.array([*ids_of(name, r["text"]), 0], "<u4")
        assert got[r["doc_id"]] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    one = spark.read.parquet(path).where("doc_id = 9").select("n_tokens")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1] and "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,9)]" in plan
    path = fresh_path(spark, "files")
    token_files.write_token_files(empty, path, tokens.tokenizer_path(name), 0)
    assert token_files.read_token_files(spark, path).count() == 0


def test_hmm_forward_equals_enumeration():
    r = np.random.default_rng(3)
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    model = {"first": norm(r.random(3)), "trans": norm(r.random((3, 3))), "emit": norm(r.random((3, 5)))}
    seqs = [[0, 1, 4], [2], [], [3, 3, 1, 0]]
    flat, offsets = np.array([x for s in seqs for x in s]), np.cumsum([0, *map(len, seqs)])
    got = hmm.log10_likelihood(model, flat, offsets)
    for s, g in zip(seqs, got):
        p = model["first"].copy() if s else np.ones(1)
        for t, x in enumerate(s):
            p = (p @ model["trans"] if t else p) * model["emit"][:, x]
        assert abs(math.log10(p.sum()) - g) < 1e-9
    seqs = [[0, 1, 4], [2], [], [3, 3, 1, 0], [1, 4, 4, 0, 2, 3, 1, 1], [0]]
    flat, offsets = np.array([x for s in seqs for x in s]), np.cumsum([0, *map(len, seqs)])
    e = hmm.expectations(model, flat, offsets)
    want = {k: np.zeros_like(v) for k, v in model.items()}
    loglik = 0.0
    for s in filter(None, seqs):  # all paths of each sequence
        paths = {}
        for path in np.ndindex(*[3] * len(s)):
            p = model["first"][path[0]] * model["emit"][path[0], s[0]]
            for t in range(1, len(s)):
                p *= model["trans"][path[t - 1], path[t]] * model["emit"][path[t], s[t]]
            paths[path] = p
        total = sum(paths.values())
        loglik += math.log(total)
        for path, p in paths.items():
            want["first"][path[0]] += p / total
            for t, (k, x) in enumerate(zip(path, s)):
                want["emit"][k, x] += p / total
                if t:
                    want["trans"][path[t - 1], k] += p / total
    assert abs(e["loglik"][0] - loglik) < 1e-4 and all(np.allclose(e[k], want[k], atol=1e-4) for k in want)


def test_language_model_base_score_and_gain(docs, empty):
    got = language_model.score_texts(docs).collect()
    split = {}
    rows = docs.collect()
    count = collections.Counter()
    for r in rows:
        w = [*(r["text"] or "").encode().lower().split(), None]
        split.setdefault(r["doc_id"], w)
        if r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2:
            count.update(w)
    total, known = sum(count.values()), len(count)
    assert len(got) == len(rows)
    for r in got:
        w = split[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(count[x] > 0 for x in w), total)
        assert abs(r["base_score"] - sum(math.log10((count[x] + 1) / (total + known + 1)) for x in w)) < 1e-6
        assert r["score"] <= 1e-9
    assert language_model.score_texts(empty).count() == 0


def test_classifier_gradients_and_fit(spark, docs, empty):
    r = random.Random(0)
    good = [prose(r, 60).encode() for _ in range(60)]
    bad = [b"!! ".join(w.upper() for w in t.split()) for t in good]
    model = quality.ByteCnn().fit(good[:40] + bad[:40], np.array([1.0] * 40 + [0.0] * 40), 0.5)
    assert (model.score(good[40:]) > 0.7).mean() > 0.9 and (model.score(bad[40:]) < 0.7).mean() > 0.9
    alone = model.score([good[41]])[0]
    assert abs(alone - model.score([good[40], good[41], b""])[1]) < 1e-6  # a text's score doesn't hang on its batch
    long = b" ".join(good) * 3
    assert model.score([long])[0] > 0.5 and model.score([long + b" " + bad[50] * 4])[0] < model.score([long])[0]
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    fitted = quality.fit_quality(docs, labels.where("quality = 1"))
    assert quality.scores(docs, fitted).where("__tl_score = 1").count() == docs.count()
    assert quality.scores(empty, model).count() == 0
    small = quality.ByteCnn(seed=1)
    y, t = np.array([1.0, 0.0]), [b"some words here", b"OTHER !! words " * 20]
    g = small.gradients(t, y)
    loss = lambda: -np.mean(y * np.log(small.score(t)) + (1 - y) * np.log(1 - small.score(t)))
    for k, at in (("out", 3), ("bias", 2), ("last", 0)):
        small.p[k][at] += 1e-4
        up = loss()
        small.p[k][at] -= 2e-4
        assert abs((up - loss()) / 2e-4 - g[k][at]) < 1e-3
        small.p[k][at] += 1e-4


def test_classifier_score_is_of_the_text_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    model = quality.fit_quality(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    key = lambda r: (r["doc_id"], r["text"] or "")
    tables = [{key(r): r["__tl_score"] for r in quality.scores(d, model).collect()} for d in (docs, docs.repartition(7), docs.orderBy("text").coalesce(1))]
    weights = model.tables().astype(float)

    def plain(text):  # byte by byte
        n = -(-(len(text) + quality.WIDTH) // quality.SEGMENT) * quality.SEGMENT
        data = np.frombuffer(text.ljust(n, b"\0"), np.uint8)
        r = sum(weights[w][data[w : n - quality.WIDTH + 1 + w]] for w in range(quality.WIDTH))
        step, size = (quality.CHUNK - 1) * quality.SEGMENT, quality.CHUNK * quality.SEGMENT
        chunks = [r[at : at + size] for at in range(0, max(1, n - quality.SEGMENT), step)]
        pooled = np.array([np.maximum(c.max(axis=0) + model.p["bias"], 0) for c in chunks])
        z = np.concatenate([pooled.max(axis=0), pooled.mean(axis=0)]) @ model.p["out"] + model.p["last"][0]
        return 1 / (1 + math.exp(-z))

    for k, x in tables[0].items():
        assert all(abs(t[k] - x) < 1e-9 for t in tables)
    for k in list(tables[0])[::5]:
        assert abs(plain(k[1].encode()) - tables[0][k]) < 1e-4


def test_samples_hold_at_any_count(spark):
    from tapeloom.llm.common import hash_below

    ids = spark.range(200_000).select("id", F.xxhash64("id").alias("h"))
    for wanted, count in ((100, 200_000), (1200, 10**12), (5, 5), (7, 3)):
        got = ids.where(hash_below(F.col("h"), wanted, count)).count()
        want = 200_000 * min(1, wanted / count)
        assert abs(got - want) <= 6 * math.sqrt(want) + 1
    assert spark.range(1).select(hash_below(F.lit(-(1 << 63)), 1200, 10**12)).first()[0]  # never none of all hashes
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(None, 1)] * 50, "doc_id long, quality int")
    texts = spark.createDataFrame([(i % 300, f"text {i}") for i in range(900)] + [(None, "none")] * 50, "doc_id long, text string")
    seen = []
    quality.ByteCnn.fit, kept = (lambda self, t, y, p: seen.append((t, y)) or self), quality.ByteCnn.fit
    try:
        quality.fit_quality(texts, labels, per_class=20)
    finally:
        quality.ByteCnn.fit = kept
    assert len(seen[0][0]) == 40 and seen[0][1].sum() == 20


COLUMNS = {
    "op1_best_fit_packing": "doc_id:bigint piece:int start:bigint length:bigint ids_crc32:bigint sequence_id:bigint offset:bigint",
    "op3_token_counts": "doc_id:bigint n_bytes:bigint n_tokens:bigint over_limit:boolean",
    "op4_line_dedup": "doc_id:bigint n_lines:bigint n_dropped:bigint kept_sha256:string",
    "op5_simhash_near_dedup": "doc_id:bigint fingerprint:string component_id:bigint",
    "op6_hmm_scoring": "doc_id:bigint held_out:boolean n_tokens:bigint n_known:bigint train_tokens:bigint base_score:double score:double",
    "op7_token_files": "doc_id:bigint start:bigint n_tokens:bigint ids_crc32:bigint",
    "op8_quality_classifier": "doc_id:bigint held_out:boolean score:double predicted:int",
    "op9_exact_topk": "query_id:bigint rank:int vec_id:bigint score:bigint",
    "op10_language_id": "doc_id:bigint held_out:boolean lang_pred:string score:double",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_query_columns(spark, name):
    from tapeloom import llm

    sf = "/root/testdata/sf0.001"
    got = llm.queries()[name](spark, sf)
    types = dict(got.dtypes)
    assert all(types[c] == t for c, t in (x.split(":") for x in COLUMNS[name].split()))
    rows = got.toPandas()
    if name != "op9_exact_topk":
        ids = [r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()]
        assert set(rows["doc_id"]) == set(ids) and (name.startswith("op1_") or len(rows) == len(ids))
    for column, modulus in (("op6", 7), ("op8", 4), ("op10", 4)):
        if name.startswith(column + "_"):
            assert all(h == (zlib.crc32(str(i).encode()) % modulus == 2) for i, h in zip(rows["doc_id"], rows["held_out"]))
    if name.startswith("op5"):
        assert rows["fingerprint"].str.fullmatch("[0-9a-f]{16}").all()
    if name.startswith(("op8", "op10")):
        assert rows["score"].between(0, 1).all()
    if name.startswith("op8"):
        assert ((rows["score"] >= 0.7) == (rows["predicted"] == 1)).all()


def test_token_files_are_encoded_as_asked(spark):
    import glob

    import pyarrow.parquet as pq

    path = fresh_path(spark, "files").removeprefix("file:")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id is not null")
    many = docs.unionByName(docs.select(*[(F.col(c) + 100_000).cast(t).alias(c) if c == "doc_id" else c for c, t in docs.dtypes]))
    token_files.write_token_files(many, path, tokens.tokenizer_path("byte_bpe_50k.json"), 0)
    files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{path}/*.parquet")]
    seen = collections.Counter()
    for f in files:
        for g in range(f.num_row_groups):
            assert f.row_group(g).total_byte_size <= 24 << 20
            for c in range(f.num_columns):
                column = f.row_group(g).column(c)
                assert column.has_column_index and column.has_offset_index
                if column.path_in_schema.startswith("ids"):
                    seen.update(column.encodings)
    assert seen["RLE_DICTIONARY"] or seen["DELTA_BINARY_PACKED"]


def test_topk(spark):
    r = np.random.default_rng(1)
    vecs = [(i, r.normal(0, 0.2, 8).tolist()) for i in range(0, 400)] + [(400 + i, [0.5] * 8) for i in range(30)] + [(900, None), (901, [1.0] * 7 + [None]), (902, [1.0] * 7 + [float("nan")]), (903, [1.0, 2.0])]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>").repartition(4)
    got = collections.defaultdict(list)
    for row in topk_search.top_k(df.where("vec_id % 50 = 0"), df, 5).orderBy("query_id", "rank").collect():
        got[row["query_id"]].append((row["vec_id"], row["score"]))
    q = {i: np.floor(256 * np.array(v)).astype(int) for i, v in vecs[:430]}
    want = {i: sorted(((j, int(q[i] @ q[j])) for j in q if j != i), key=lambda x: (-x[1], x[0]))[:5] for i in q if i % 50 == 0}
    assert dict(got) == want
    few = df.where("vec_id < 3")
    assert topk_search.top_k(few.where("vec_id = 0"), few, 5).count() == 2
    assert topk_search.top_k(df.where("vec_id < -1"), df, 5).count() == 0
    assert topk_search.top_k(few, df.where("vec_id < -1"), 5).count() == 0


def test_viterbi_equals_enumeration():
    r = np.random.default_rng(0)
    n = [1, 4, 0, 3]
    offsets = np.cumsum([0, *n])
    scores = r.normal(0, 3, (offsets[-1], 3)).astype(np.float32)
    got = language_id.viterbi(scores, offsets, 1.5)
    for a, z in zip(offsets, offsets[1:]):
        value = lambda path: sum(scores[a + t, s] for t, s in enumerate(path)) - 1.5 * sum(x != y for x, y in zip(path, path[1:]))
        if z > a:
            best = max(value(p) for p in np.ndindex(*[3] * (z - a)))
            assert abs(value(got[a:z].tolist()) - best) < 1e-4


def test_languages(spark, empty):
    r = random.Random(3)
    en, fr, ru = (lambda n: prose(r, n)), (lambda n: " ".join(r.choice(["éau", "quelle", "mentçois", "tréou", "aux"]) for _ in range(n))), (lambda n: " ".join(r.choice(["слово", "мирный", "тоже", "было"]) for _ in range(n)))
    rows = [(i, f(30), x) for i, (x, f) in enumerate([("en", en), ("fr", fr), ("ru", ru)] * 30)] + [(900, None, "en"), (901, "123 !!", None), (902, fr(40) + " " + en(10), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit_language_model(df)
    got = {r["doc_id"]: r for r in language_id.languages(df, model).collect()}
    assert all(got[i]["lang_pred"] == x for i, _, x in rows[:90])
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[900]["score"] == 0
    assert got[902]["lang_pred"] == "fr" and 0.5 < got[902]["score"] < 1
    assert "".join(rows[92][1][x["start"] : x["start"] + x["length"]] + " " for x in got[902]["spans"]).strip() == rows[92][1]
    assert [x["lang"] for x in got[902]["spans"]] == ["fr", "en"]
    other = spark.createDataFrame([(1, "日本語 テキスト です"), (2, en(3000) + "\n\n" + ru(3000))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_id.languages(other, model).collect()}
    assert got[1]["lang_pred"] in ("en", "fr", "ru") and got[1]["score"] < 0.4  # no language uses the script
    assert [x["lang"] for x in got[2]["spans"]] == ["en", "ru"]
    assert set(language_id.fit_language_model(df.where("doc_id < 90").unionByName(df.where("doc_id = 0").select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit("fr").alias("lang"))), 1).langs) == {"en", "fr", "ru"}
    none = language_id.fit_language_model(empty)
    assert {r["lang_pred"] for r in language_id.languages(df, none).collect()} == {"und"}


def test_contamination(spark, docs, empty):
    r = random.Random(8)
    fresh = lambda n, k: " ".join(f"{a}{k}{r.randrange(1000)}" for a in (r.choice(WORDS) for _ in range(n)))
    items = [(i, fresh(n, i)) for i, n in enumerate((20, 45, 150, 64, 30))] + [(9, None), (10, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, "x " * 70 + items[1][1] + " tail" * 90), (2, prose(r, 500)), (3, items[2][1].upper() + "!"), (4, items[0][1] + " " + items[0][1]), (5, " ".join(items[3][1].split()[:40])), (6, None), (7, prose(r, 3000) + " " + items[4][1])]
    got = contamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert {(g["doc_id"], g["item_id"]) for g in got} == {(1, 1), (3, 2), (4, 0), (7, 4)}
    assert contamination.contaminated(empty, bench).count() == 0 and contamination.contaminated(docs, bench.where("item_id < 0")).count() == 0


def leaks_by_brute_force(texts, items):
    """All windows against all parts of all items, on plain words."""
    c, rows = contamination, []
    split = [(i, c.words_of(t)) for i, t in items if t]
    parts = [(k, w[a:z]) for k, (_, w) in enumerate(split) for a, z in zip(c.cuts(len(w)), c.cuts(len(w))[1:])]
    df = collections.Counter(t for _, w in parts for t in set(w))
    mean = sum(len(w) for _, w in parts) / max(1, len(parts))

    def impacts(w):
        tf = collections.Counter(w)
        return {t: math.log(1 + (len(parts) - df[t] + 0.5) / (df[t] + 0.5)) * n * (c.K1 + 1) / (n + c.K1 * (1 - c.B + c.B * len(w) / mean)) for t, n in tf.items()}

    tables = [(k, impacts(w)) for k, w in parts]
    grams = lambda w, n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    for d, text in texts:
        words = c.words_of(text)
        hits = collections.defaultdict(dict)
        for k in range(max(1, -(-(len(words) - c.STEP) // c.STEP))):
            own = set(words[k * c.STEP : k * c.STEP + c.WINDOW])
            for item, table in tables:
                score = sum(x for t, x in table.items() if t in own) / sum(table.values())
                if score >= c.SCORE - 1e-9:
                    hits[item][k] = max(score, hits[item].get(k, 0))
        for item, ks in hits.items():
            i, w = split[item]
            n, cut = min(c.GRAM, len(w)), len(w) - max(c.GRAM, len(w) // 4) if len(w) >= 2 * c.GRAM else 0
            groups = []
            for k in sorted(ks):
                if groups and k * c.STEP - len(w) <= groups[-1][-1] * c.STEP + c.WINDOW + len(w):
                    groups[-1].append(k)
                else:
                    groups.append([k])
            for own in groups:
                near = grams(words[max(0, own[0] * c.STEP - len(w)) : own[-1] * c.STEP + c.WINDOW + len(w)], n)
                q, a = (len(grams(x, n) & near) / len(grams(x, n)) for x in ((w[:cut], w[cut:]) if cut else (w, w)))
                if q >= c.OVERLAP and a >= c.OVERLAP:
                    rows.append((d, i, len(own), max(ks[k] for k in own), q, a))
    found = {}
    for d, i, n, *x in rows:
        have = found.setdefault((d, i), [0, 0, 0, 0])
        found[d, i] = [have[0] + n, *map(max, have[1:], x)]
    return found


def test_contamination_equals_brute_force(spark):
    r = random.Random(5)
    rare = lambda n: [f"{r.choice(WORDS)}{r.randrange(60)}" for _ in range(n)]
    items = [(i, " ".join(rare(n))) for i, n in enumerate([*range(1, 16), 20, 31, 40, 64, 65, 100, 129, 150, 200] * 2)]
    items += [(3, items[10][1]), (500, items[20][1]), (None, "no id at all here"), (501, None), (502, "")]
    texts = [(None, items[12][1]), (0, None), (1, ""), (2, " ".join(rare(5000)))]
    for k, (i, t) in enumerate(items):
        w = (t or "").split()
        texts.append((10 + k, " ".join(rare(r.choice([0, 30, 300])) + w + rare(r.choice([0, 40])))))
        if len(w) >= 15:
            texts.append((200 + k, " ".join(rare(50) + w[: len(w) // 3] + rare(50))))  # a third of it
            texts.append((300 + k, " ".join(rare(9) + ["changed" if j % 23 == 9 else x for j, x in enumerate(w)])))
            texts.append((400 + k, " ".join(w[: -max(5, len(w) // 4)])))  # without the answer
    texts += [texts[20], (700, items[5][1] + " and " + items[5][1] + " " + " ".join(rare(400)) + " " + items[5][1])]
    df = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(texts)], "doc_id long, text string, item_id long").repartition(3)
    bench = spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, doc_id int")
    want = leaks_by_brute_force(texts, [x for x in items if x[0] is not None])
    assert all((10 + k, i) in want for k, (i, t) in enumerate(items) if t and i is not None) and not any(300 > d >= 200 or d >= 400 and d < 500 for d, _ in want if d)
    for size in (contamination.INDEX_BYTES, 3000):  # one block of items, and several
        got = {(x["doc_id"], x["item_id"]): list(x)[2:] for x in contamination.contaminated(df, bench, size).collect()}
        assert got.keys() == want.keys()
        assert all(got[k][0] == want[k][0] and np.allclose(got[k][1:], want[k][1:], atol=1e-9) for k in want)


def test_near_texts(spark, empty):
    r = random.Random(6)
    base = [" ".join(f"{r.choice(WORDS)}{r.randrange(300)}" for _ in range(200)) for _ in range(12)]

    def edited(t):
        w = t.split()
        w[r.randrange(len(w))] = "edited"
        return " ".join(w)

    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, edited(t)) for i, t in enumerate(base)] + [(200, base[3].upper()), (201, None), (202, ""), (None, base[0])]
    got = {x["id"]: x["component"] for x in near_text.near_text_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got.pop(200) == 3 and got.pop(202) == 201
    assert set(got.items()) <= {(100 + i, i) for i in range(12)} and len(got) >= 9
    assert near_text.near_text_groups(empty).count() == 0


def test_near_texts_lose_no_pair_at_any_similarity(spark):
    r = random.Random(9)
    base = [" ".join(f"{r.choice(WORDS)}{r.randrange(300)}" for _ in range(n)) for n in (30, 60, 90, 200, 400) * 24]

    def edited(t):
        w = t.split()
        for k in r.sample(range(len(w)), max(1, round(len(w) * r.uniform(0.002, 0.022)))):
            w[k] = f"{r.choice(WORDS)}{r.randrange(300)}"
        return " ".join(w)

    rows = [(i, t) for i, t in enumerate(base)] + [(1000 + i, edited(t)) for i, t in enumerate(base)]
    grams = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    got = {x["id"]: x["component"] for x in near_text.near_text_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    bands = collections.defaultdict(list)
    for i, t in enumerate(base):
        x, y = grams(t), grams(rows[len(base) + i][1])
        j = len(x & y) / len(x | y)
        bands[min(int(j * 20), 19) if j >= 0.8 else 0].append((1000 + i in got) == (j >= 0.8) and got.get(1000 + i, i) == i)
    assert {16, 17, 18, 19} <= set(bands) and all(all(x) for x in bands.values()), {k: (sum(x), len(x)) for k, x in bands.items()}


def test_near_texts_compare_all_classes_of_a_bucket(spark):
    r = random.Random(3)
    first, second = ([f"{r.choice(WORDS)}{i}{k}" for k in range(300)] for i in "xy")
    other = lambda w, k: " ".join(["of", *w[:k], "in", *w[k + 1 :]])
    shuffled = r.sample(first, len(first))
    rows = [(1, " ".join(first)), (2, " ".join(shuffled)), (3, other(first, 150)), (4, other(shuffled, 150)), (5, " ".join(second))]
    got = {x["id"]: x["component"] for x in near_text.near_text_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {3: 1, 4: 2}

    # one bucket by hand: 1 and 3, 2 and 4 are alike; neighbours, the least id and the leading one alone miss the second pair
    buckets = spark.createDataFrame([(7, 1, 10, None, 1, 1), (7, 2, 10, 1, 1, 1), (7, 3, 10, 2, 1, 1), (7, 4, 10, 3, 1, 1)], "key long, node long, n long, prev long, head long, lead long")
    pairs = near_text._first_pairs(buckets)
    sets = spark.createDataFrame([(i, near_text.shingle_set(t).astype("<u8").tobytes()) for i, t in rows[:4]], "node long, shingles binary")
    found = spark.createDataFrame([(1, 1), (3, 1)], "node long, component long")
    others = near_text._other_pairs(buckets, sets, pairs, found, 0.8)
    assert {tuple(x) for x in pairs.collect()} == {(1, 2), (2, 3), (3, 4), (1, 3), (1, 4)}
    assert {tuple(x) for x in others.collect()} == {(2, 4)}


def test_edits_of_one_text_are_linked_through_it(spark):
    """Edits are under 0.8 with each other, but not with the text; pairs stay in proportion to their number."""
    r = random.Random(12)
    base = [f"{r.choice(WORDS)}{k}" for k in range(150)]
    rows = [(500, " ".join(base))]
    for i in range(200):
        w = list(base)
        w[r.randrange(10, 70)] = f"one{i}"
        w[r.randrange(75, 140)] = f"two{i}"
        rows.append((i if i < 100 else i + 1000, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["id"]: x["component"] for x in near_text.near_text_groups(df).collect()}
    assert got == {i: 0 for i, _ in rows if i}
    signed = near_text.signatures(df.withColumnRenamed("doc_id", "id"))
    assert near_text._first_pairs(near_text._buckets(signed.withColumnRenamed("id", "node"))).count() < 30 * len(rows)


@pytest.mark.parametrize("counts", [{1: 10000}, {1: 9000, 2: 800, 9: 3}, {k: 1000 for k in range(1, 10)}, {3000: 5, 1: 20000, 7: 300}])
def test_plan_fills_sequences_with_many_short_pieces(counts):
    plan = packing.plan_packing(dict(counts), 4096)
    used = collections.Counter()
    for pattern, times in plan:
        assert sum(pattern) <= 4096
        for s in pattern:
            used[s] += times
    assert used == counts
    assert sum(t for _, t in plan) == -(-sum(s * n for s, n in counts.items()) // 4096)


def test_plan_search_does_not_depend_on_the_number_of_pieces():
    counts = {38: 3, 42: 3, 24: 3, 41: 3, 18: 2}  # best fit takes 6 sequences, 5 do
    assert sum(t for _, t in packing.plan_packing(dict(counts), 100)) == 5
    plan = packing.plan_packing({s: 1000 * n for s, n in counts.items()}, 100)  # best fit alone: 5250
    used = collections.Counter()
    for pattern, times in plan:
        assert sum(pattern) <= 100
        for s in pattern:
            used[s] += times
    assert used == {s: 1000 * n for s, n in counts.items()} and sum(t for _, t in plan) <= 5000


def test_dominated_fillings_are_left_out():
    assert packing.dominates((60, 40), (40, 30, 20)) and packing.dominates((50,), (30, 20)) and not packing.dominates((50, 30), (40, 40))
    found = packing.fillings(100, [20, 30, 40, 50, 60], dict.fromkeys([20, 30, 40, 50, 60], 1))
    assert found[0] == (60, 40)
    assert not any(packing.dominates(a, b) for a in found for b in found if a != b)
