"""Token ids in Parquet files: ids of a document in one list, documents in order.

File format: Parquet list columns.  Ids are dictionary encoded where a row
group's distinct ids fit the dictionary page, and delta encoded beyond it
(format version 2); row groups and pages are kept short, and every column has a
page index.  Rows are in ascending order of ``doc_id`` over all files, so a
reader that wants a range of documents, or the metadata columns alone, skips
the pages of ids it has no need of.

Columns: ``doc_id``; ``part``, the place of the row's file in that order;
``at``, the ids before the row in its part; ``n_tokens``; ``ids``.

A null text is empty: it holds the end id alone.  A null ``doc_id`` sorts first;
rows that share a ``doc_id`` keep an order by their text's hash.  Texts of any
length are encoded whole, each in one row; an empty table gives files without
rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import fresh_path, read_table
from tapeloom.llm.tokens import SpacedEncoder, encoder, text_slices, tokenizer_path

SCHEMA = "doc_id long, part int, at long, n_tokens int, ids array<int>"

WRITER = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.dictionary.page.size": str(512 << 10),
    "parquet.page.row.count.limit": "512",
    "compression": "zstd",
}


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode every text and write the files.  One shuffle: by range of ``doc_id``."""
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .withColumn("part", F.spark_partition_id())
    )
    item = pa.list_(pa.int32())
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("at", pa.int64()), ("n_tokens", pa.int32()), ("ids", item)])

    def run(batches):
        enc = encoder(SpacedEncoder, tokenizer)
        end = np.array([end_id], np.uint32)
        at = 0
        for b in text_slices(batches):
            if not b.num_rows:
                continue
            lists = enc.encode(pc.fill_null(b.column("text"), ""))
            n = np.array([len(x) + 1 for x in lists], np.int64)
            flat = np.concatenate([y for x in lists for y in (x, end)]).astype(np.int32)
            offsets = np.zeros(len(n) + 1, np.int64)
            np.cumsum(n, out=offsets[1:])
            ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("part"), pa.array(at + offsets[:-1]), pa.array(n.astype(np.int32)), ids], schema=schema
            )
            at += int(offsets[-1])

    ordered.mapInArrow(run, SCHEMA).write.options(**WRITER).parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with ``start``, the ids of all documents before; columns not selected aren't read."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    # one row a part
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    # a row of two numbers for each file: broadcast, so that ids aren't shuffled
    return rows.join(F.broadcast(starts), "part").withColumn("start", F.col("before") + F.col("at")).drop("before")


def ids_digest(rows: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of rows with ``ids``."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for b in batches:
            lists = b.column("ids")
            flat = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<i4")
            cut = lists.offsets.to_numpy().tolist()
            crc = [zlib.crc32(flat[cut[i] : cut[i + 1]]) for i in range(b.num_rows)]
            n = [cut[i + 1] - cut[i] for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], schema=schema)

    return rows.select("doc_id", "start", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    write_token_files(read_table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"), end_id=0)
    return ids_digest(read_token_files(spark, path))
