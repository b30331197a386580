"""Readers and writers: files with different headers, results by scan date."""

import datetime

from tapeloom.sources import files


def put(folder, name, text):
    p = folder / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text, encoding="utf-8")


def test_bars_of_files_with_other_headers(spark, tmp_path):
    put(tmp_path, "AA.csv", "trade_date,open,close,vol\n2024-01-02,1,2,10\n2024/01/03,2,3,\n")
    put(tmp_path, "BB.csv", "trade_date,open,close,vol\n20240102,5,6,7\n")
    put(tmp_path, "x y.csv", "close,trade_date,amount\n9,20240104,oops\n8,no date,1\n")  # other columns, another order, a blank in the name
    put(tmp_path, "sub/many.csv", '﻿"TS","Trade_Date","symbol","Close","Close"\n1,20240105,CC,4,5\n')
    put(tmp_path, "notes.csv", "a,b\n1,2\n")
    got = {(r["symbol"], r["trade_date"].day): (r["open"], r["close"], r["vol"], r["amount"]) for r in files.read_bars(spark, str(tmp_path)).collect()}
    assert got == {("AA", 2): (1, 2, 10, None), ("AA", 3): (2, 3, None, None), ("BB", 2): (5, 6, 7, None), ("x y", 4): (None, 9, None, None), ("CC", 5): (None, 4, None, None)}
    assert files.read_bars(spark, str(tmp_path), ["BB", "CC"]).count() == 2


def test_no_bars_at_all(spark, tmp_path):
    put(tmp_path, "notes.csv", "a,b\n1,2\n")
    assert files.read_bars(spark, str(tmp_path)).count() == 0 and "close" in files.read_bars(spark, str(tmp_path)).columns


def test_minutes_go_by_name(spark, tmp_path):
    put(tmp_path, "AA/20240102.csv", "when,open,close\n2024-01-02 09:30:00,1,2\n")
    put(tmp_path, "AA/20240103.csv", "when,close,open,extra\n2024-01-03 09:30:00,4,3,7\n")
    got = {r["ts"].day: (r["symbol"], r["open"], r["close"], r["extra"]) for r in files.read_minutes(spark, str(tmp_path), {"When": "time"}).collect()}
    assert got == {2: ("AA", 1, 2, None), 3: ("AA", 3, 4, 7)}


def test_results_keep_other_dates(spark, tmp_path):
    path = str(tmp_path / "out")
    frame = lambda d, rows: spark.createDataFrame([(s, d) for s in rows], "symbol string, scan_date string")
    read = lambda: sorted((str(r["scan_date"]), r["symbol"]) for r in spark.read.parquet(f"{path}/picks").collect())
    files.write_results({"picks": frame("2024-01-02", "ab")}, path)
    files.write_results({"picks": frame("2024-01-03", "c"), "counts": spark.range(2)}, path)
    assert read() == [("2024-01-02", "a"), ("2024-01-02", "b"), ("2024-01-03", "c")]
    files.write_results({"picks": frame("2024-01-02", "xyz")}, path)  # a rerun replaces its own
    files.write_results({"picks": frame("2024-01-02", "xyz")}, path)
    assert read() == [("2024-01-02", "x"), ("2024-01-02", "y"), ("2024-01-02", "z"), ("2024-01-03", "c")]
    files.clear_results(spark, ["picks"], path, "2024-01-02")
    assert read() == [("2024-01-03", "c")]


def test_date_spellings(spark):
    rows = spark.createDataFrame([("2024-01-02",), ("2024/01/02",), ("20240102",), ("2 Jan",), (None,)], "d string")
    assert [r[0] for r in rows.select(files.to_date(rows["d"])).collect()] == [datetime.date(2024, 1, 2)] * 3 + [None, None]
