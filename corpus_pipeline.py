"""Training-corpus pipeline over the documents table.

Five stages, each on all that the one before kept, each result written as
Parquet and read again:

1. quality: documents that the byte-level classifier rejects go;
2. lines: repeated lines stay in the first document that holds them;
3. near_duplicates: of each group of near-duplicate texts the least id stays;
4. decontaminate: documents that hold a benchmark item go;
5. pack: the rest is packed into sequences; one row for each piece.

All but the last return the columns of documents; ``n_chars`` follows the text.
A document with a null id is scored, kept by the stages that work by id, and
packed.  Rows that share an id share its fate after the first stage, which goes
by text.  Null and empty texts are scored like any other, are one group of
copies, and are packed as their end alone.  Texts of any length are worked on
whole; an empty table gives an empty one; other columns pass through to the last
stage, whatever their names but for those that begin with ``__tl_``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.common import bounded, cut, fresh_path, read_table, remove
from tapeloom.llm.contamination import contaminated
from tapeloom.llm.line_dedup import dedup_lines
from tapeloom.llm.near_text import near_text_groups
from tapeloom.llm.packing import pack
from tapeloom.llm.quality import THRESHOLD, fit_quality, scores
from tapeloom.llm.tokens import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit_quality(docs, read_table(spark, sf_dir, "labels"))
    return scores(docs, model).where(F.col("__tl_score") >= THRESHOLD).drop("__tl_score")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = dedup_lines(docs)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(docs.columns)


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Texts aren't shuffled where the ids that go are few enough to be broadcast."""
    gone = cut(ids.select(F.col(ids.columns[0]).alias("__tl_gone")).where("__tl_gone is not null").distinct())
    return docs.join(bounded(gone), docs["doc_id"].cast("long") == F.col("__tl_gone"), "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, near_text_groups(docs).select("id"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, contaminated(docs, read_table(spark, sf_dir, "benchmark")).select("doc_id"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("pack", packing),
]

#: A trained classifier, fingerprints and token ids have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's files go when the next one's are written."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name)
        done = stage(spark, docs, sf_dir)
        done.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(done.schema).parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
