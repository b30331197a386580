"""Phrase collocations, Merkle manifest and document fingerprints against brute force on odd tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import collocations, consistent_parse, manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id int, grp string, n string, code string, at int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", None, 2) for r in rows], SCHEMA).repartition(3)


# Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree_of(nodes):
    """Root, and each leaf's siblings by level as (left, right)."""
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k : k + 8] for k in range(0, len(nodes), 8)]
        for leaf, p in enumerate(place):
            run = runs[p // 8]
            paths[leaf].append(("".join(run[: p % 8]), "".join(run[p % 8 + 1 :])))
        nodes, place = [sha("".join(r)) for r in runs], [p // 8 for p in place]
    return nodes[0], paths


def manifest_by_hand(rows):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha("".join(map(part, (r[0], r[3], r[2], r[4], text))))
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))) for x in langs}
    trees = {x: tree_of([leaf(r, r[1]) for r in own]) for x, own in groups.items()}
    root, tops = tree_of([trees[x][0] for x in langs])
    low = {c: c + 32 for c in range(65, 91)}
    out = []
    for k, x in enumerate(langs):
        for r, path in zip(groups[x], trees[x][1]):
            path = path + tops[k]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            h = leaf(r, r[1].translate(low) if hit and r[1] is not None else r[1])
            for a, b in path:
                h = sha(a + h + b)
            out.append((r[0], leaf(r, r[1]), trees[x][0], root, sha("".join(a + b for a, b in path)), h, h == root))
    return out


def proofs(df):
    fields = {c: df[c] for c in ("doc_id", "source", "lang", "n_chars", "text")}
    hit = F.crc32(df["doc_id"].cast("string")) % 3 == 0
    text = F.when(hit, F.translate("text", manifest.UPPER, manifest.LOWER)).otherwise(df["text"])
    return [tuple(r) for r in manifest.manifest(df, fields, changed={"text": text}).collect()]


def test_manifest(spark):
    r = random.Random(3)
    rows = [(k, f"Text {k} É{'x' * (k % 5)}", "en", f"s{k % 3}", k) for k in range(600)]  # two rounds of blocks
    rows += [(k, r.choice(["Abc", "abc", "", None, "A" * 70000]), r.choice([None, "", "de", "ä", "z"]), r.choice([None, "s"]), r.choice([None, 3])) for k in range(600, 680)]
    rows += [(700, "lone", "only", "s", 1), (None, "Null id", "de", None, None), (601, "Same id", "de", "s", 2), rows[5], rows[5]]
    assert collections.Counter(proofs(table(spark, rows))) == collections.Counter(manifest_by_hand(rows))


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 512, 513])
def test_manifest_of_other_sizes(spark, n):
    rows = [(k, f"T{k}", "en", None, k) for k in range(n)]
    assert collections.Counter(proofs(table(spark, rows))) == collections.Counter(manifest_by_hand(rows))


def test_manifest_of_no_rows(spark):
    assert proofs(table(spark, [(1, "a", "b", "c", 1)]).where("doc_id < 0")) == []


# phrase collocations


def phrases_by_hand(rows, least, share, top):
    low = {c: c + 32 for c in range(65, 91)}
    counts, totals = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(low)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            totals[lang] += len(w)
            for m in range(1, 6):
                counts[lang].update(tuple(w[k : k + m]) for k in range(len(w) - m + 1))
    out = []
    for lang, f in counts.items():
        frequent = {p: n for p, n in f.items() if n >= least}
        covered = set()
        for p, n in frequent.items():
            for m in range(2, len(p)):
                covered |= {p[k : k + m] for k in range(len(p) - m + 1) if 100 * n >= share * f[p[k : k + m]]}
        found = []
        for p, a in frequent.items():
            if len(p) > 1 and p not in covered:
                score, _, l, r = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def chatter():
    r = random.Random(6)
    common, rare = ["the", "of", "Is"], [f"w{k}é" for k in range(60)]
    fixed = ["New York city hall", "of the people", "über alles in"]
    word = lambda: r.choice(fixed) if r.random() < 0.15 else r.choice(common) if r.random() < 0.5 else r.choice(rare)
    rows = [(k, "".join(word() + r.choice([" ", " ", " ", "\t ", ", ", ".\n", " | "]) for _ in range(r.randint(0, 120))), r.choice(["en", "en", "de", None, "und"]), "s", 0) for k in range(80)]
    rows += [(90, None, "en", None, 0), (91, "", "fr", None, 0), (92, " ,;\t", "fr", None, 0), (93, "no " * 3000, "en", None, 0), (94, "x" * 50000, "de", None, 0), rows[7], rows[7], (None, rows[8][1], "en", None, 0)]
    return rows


@pytest.mark.parametrize("least,share,top,hot", [(4, 100, 2000, 512), (6, 80, 15, 10), (2, 100, 50, 3)])
def test_collocations(spark, chatter, monkeypatch, least, share, top, hot):
    monkeypatch.setattr(collocations, "HOT", hot)
    got = sorted(tuple(r) for r in collocations.collocations(table(spark, chatter), least, share, top).collect())
    want = phrases_by_hand(chatter, least, share, top)
    assert got == want and len(want) > 20


def test_full_filters_change_nothing(spark, chatter, monkeypatch):
    monkeypatch.setattr(collocations, "_filter_of", lambda *a: np.full(1 << 10, 255, np.uint8))
    got = sorted(tuple(r) for r in collocations.collocations(table(spark, chatter), 5, 100, 2000).collect())
    assert got == phrases_by_hand(chatter, 5, 100, 2000)


def test_collocations_of_no_rows(spark, chatter):
    assert collocations.collocations(table(spark, chatter).where("doc_id < -1"), 2).count() == 0
    assert collocations.collocations(table(spark, [(1, None, None, None, 0)]), 2).count() == 0


def test_hash_is_the_same_on_both_sides(spark):
    words = ["a", "é" * 40, "word", "x" * 1000, ""]
    df = spark.createDataFrame([(w,) for w in words], "word string").selectExpr("word", "xxhash64(concat_ws('\\0', '0', 'en', word)) AS h")
    got = {r["word"]: r["h"] % (1 << 64) for r in df.collect()}
    assert [got[w] for w in words] == collocations._codes("0", "en", words).tolist()


# fingerprints


def phrases_of(text):
    """Names and spans of all phrases of a text, one symbol at a time."""
    mask = (1 << 64) - 1

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    def joined(a, b):
        x = a * 0x9E3779B97F4A7C15 + b & mask
        x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & mask
        return x ^ x >> 32

    def toss(names):
        out = []
        for k, x in enumerate(names):
            differ = x ^ names[k - 1] if k else 1
            place = (differ & -differ).bit_length() - 1
            out.append(2 * place + (x >> place & 1) if k else x & 1)
        return out

    row, found = [(mixed(ord(c) + 0x9E3779B97F4A7C15 & mask), 1) for c in text], []
    while row:
        runs = []
        for name, span in row:
            if runs and runs[-1][0] == name:
                runs[-1] = (name, runs[-1][1] + span, runs[-1][2] + 1)
            else:
                runs.append((name, span, 1))
        row = [(joined(name, n) if n > 1 else name, span) for name, span, n in runs]
        if len(row) == 1:
            return found + row
        label = [x & 0xFFFFFFFF for x, _ in row]
        for _ in range(4):
            label = toss(label)
        assert max(label) < 6 and all(a != b for a, b in zip(label, label[1:]))
        begin = [k == 0 or (k > 1 and label[k] > label[k - 1] and (k + 1 == len(label) or label[k] > label[k + 1])) for k in range(len(label))]
        new = []
        for b, (name, span) in zip(begin, row):
            if b:
                new.append([name, span, 1])
            else:
                new[-1] = [joined(new[-1][0], name), new[-1][1] + span, new[-1][2] + 1]
        assert all(2 <= n <= 11 for _, _, n in new[:-1])
        found += [(name, span) for name, span, n in new if n > 1]
        row = [(name, span) for name, span, _ in new]
    return found


def print_of(text):
    mask = (1 << 64) - 1

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    def bins(names, n):
        least = [min((x for x in names if x % n == k), default=None) for k in range(n)]
        return "".join("0000" if x is None else f"{mixed(x) % 0xFFFF + 1:04x}" for x in least)

    if not text:
        return "e"
    found = phrases_of(text)
    wide = [x for x, span in found if span >= 16]
    coarse = bins(wide, 64)
    return "l" + coarse if len(text) >= 1024 else ("c" if len(wide) >= 8 else "f") + coarse + bins([x for x, _ in found], 32)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(9)
    prose = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(1, 8))) for _ in range(n))
    out = ["", None, "a", "aa", "ab", "aab", "aaaa", "no" * 900, "x" * 5000, "É日本語 テキスト", prose(30), prose(400), prose(3), prose(1500), "z" * 30 + prose(200)]
    return out + [out[11][:-300] + prose(60), prose(250), "ab" * 20 + prose(40), out[10]]


def test_fingerprints_by_hand(texts):
    plain = [t or "" for t in texts]
    assert consistent_parse.fingerprints_of(plain) == [print_of(t) for t in plain]
    nexts = plain[1:] + plain[:1]
    one, changed, other = consistent_parse.pair_fingerprints(plain, nexts)
    assert changed == [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for t, n in zip(plain, nexts)]
    assert one == [print_of(t) for t in plain] and other == [print_of(t) for t in changed]


def test_equal_substrings_share_phrases_at_any_offset():
    r = random.Random(1)
    noise = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    inner = noise(3000)
    own = {x for x, span in phrases_of(inner) if span >= 16}
    for n in (1, 7, 100, 999):
        other = {x for x, span in phrases_of(noise(n) + inner + noise(50)) if span >= 16}
        assert len(own & other) > 0.85 * len(own)
        assert len(own & {x for x, span in phrases_of(noise(3000)) if span >= 16}) == 0


def test_likeness(texts):
    a, b = consistent_parse.fingerprints_of([texts[13], texts[13][:6000] + texts[11][:1500]])
    assert consistent_parse.likeness(a, a) == 1 and 0.4 < consistent_parse.likeness(a, b) < 0.95
    e, f, long = consistent_parse.fingerprints_of(["", "abc", texts[13]])
    assert consistent_parse.likeness(e, e) == 1 and consistent_parse.likeness(e, f) == consistent_parse.likeness(f, e) == consistent_parse.likeness(f, long) == 0


def test_edited_fingerprints(spark, texts):
    rows = [(k * 2, t, "en", None, 0) for k, t in enumerate(texts)]
    extra = [(None, "null id text", "en", None, 0), (4, texts[2], "en", None, 0)]
    got = [tuple(r) for r in consistent_parse.edited_fingerprints(table(spark, rows + extra)).collect()]
    mark = {r["t"]: r["h"] for r in spark.createDataFrame([(t,) for _, t, *_ in rows + extra], "t string").selectExpr("t", "xxhash64(t) AS h").collect()}
    order = sorted(rows + extra, key=lambda r: (r[0] is not None, r[0] or 0, mark[r[1]]))
    plain = [r[1] or "" for r in order]
    one, changed, other = consistent_parse.pair_fingerprints(plain, plain[1:] + plain[:1])
    like = consistent_parse.likeness
    want = [(r[0], len(t), hashlib.sha256(c.encode()).hexdigest(), a, b, like(a, b), like(a, n)) for r, t, c, a, b, n in zip(order, plain, changed, one, other, one[1:] + one[:1])]
    assert collections.Counter(got) == collections.Counter(want)


def test_edited_fingerprints_of_few_rows(spark, texts):
    assert consistent_parse.edited_fingerprints(table(spark, [(1, "a", "b", None, 0)]).where("doc_id < 0")).count() == 0
    lone = consistent_parse.edited_fingerprints(table(spark, [(1, "abcdefgh", "b", None, 0)])).collect()
    assert [(r["n_chars"], r["edited_sha256"], r["near_next"]) for r in lone] == [(8, sha("abcdefab"), 1.0)]
