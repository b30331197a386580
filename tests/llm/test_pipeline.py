"""The pipeline's stages keep the documents' columns and take effect on planted cases."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    from tapeloom.llm.common import materialize

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = materialize(stage(spark, docs, SF), name)
        assert kept.columns == columns and kept.count() <= docs.count()
        docs = kept
        if name == "quality":
            ids = {r["doc_id"] for r in docs.collect()}
            good = [i for i, q in labels.items() if q == 1]
            assert sum(i in ids for i in good) >= 0.9 * len(good)
    texts = [r["text"] or "" for r in docs.collect()]
    assert not any(x in t for x in items.values() for t in texts)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert packed.doc_id.nunique() == docs.count() < before
    assert (packed.groupby("sequence_id").length.sum() <= 4096).all()


def test_stages_on_odd_tables(spark):
    """Nulls in all columns, empty and long texts, ties, repeated rows, extra columns with clashing names, empty tables."""
    long = " ".join(f"w{k % 997}x{k % 89}" for k in range(30_000))
    line = "a line that several documents hold"
    rows = [(None, None, None, 0), (1, None, "x", None), (2, "", "en", 2), (3, long, "en", 3), (4, long, None, 4), (5, line, "en", 5), (5, line, "en", 5)]
    rows += [(6, f"own words first\n{line}\nand last", "en", 6), (None, f"{line}\nwithout an id", "en", 7), (7, "short", "en", 8), (3, "same id, other text", "en", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, id long").selectExpr("*", "1 as node", "'k' as digest", "2L as component", "0 as piece")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for table in (docs, docs.where("id > 100")):
            got = stage(spark, table, SF)
            assert got.columns == docs.columns and got.dtypes == docs.dtypes
            kept[name] = kept.get(name) or [(r["doc_id"], r["text"], r["id"]) for r in got.collect()]
            assert table is docs or got.count() == 0
    assert set(kept["quality"]) <= {(a, b, d) for a, b, _, d in rows}
    lines = {(a, d): b for a, b, d in kept["lines"]}
    assert len(kept["lines"]) == len(rows) and lines[6, 6] == "own words first\nand last" and lines[5, 5] == line and lines[None, 7].startswith(line) and lines[1, None] is None and lines[2, 2] == ""
    assert sorted((a, d) for a, _, d in kept["near_duplicates"] if a is not None and d is not None) == [(3, 3), (3, 9), (5, 5), (5, 5), (6, 6), (7, 8)]
    assert len(kept["decontaminate"]) == len(rows)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert len(packed[packed.piece == 0]) == len(rows) and corpus_pipeline.STAGES[-1][1](spark, docs.where("id > 100"), SF).count() == 0
