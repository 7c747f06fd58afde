"""The order tables' bars files: one a ticker, written by the tasks that compute the bars, and how they are read."""

import os

from recordvol import queries
from recordvol.plans import orders, screen
from recordvol.sources import bars as files

SF = "/root/testdata/sf0.001"


def test_bars_of_all_files_in_one_job_without_a_folder_a_ticker(spark):
    folder = orders.csv_folder(spark, SF, "daily")
    bars = orders.uneven_bars(spark, SF, "daily")
    tickers = {r[0] for r in bars.select("ticker").distinct().collect()}
    found = [(d, n) for d, _, names in os.walk(folder.removeprefix("file://")) for n in names]
    # Files have their tickers' names, each once; a task has one folder for all of its files, and nothing else is left in it.
    assert sorted(n for _, n in found) == sorted(f"{t}.csv" for t in tickers)
    assert len({d for d, _ in found}) <= orders.partitions(spark, SF) < len(tickers)
    stored = spark.read.parquet(f"{folder}-rows")
    assert {(r["ticker"], r["rows"]) for r in stored.collect()} == {tuple(r) for r in bars.groupBy("ticker").count().collect()}
    read = files.read_csv_bars(spark, folder, "daily")
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, bars.collect()))


def test_files_that_span_batches_are_whole(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(t, f"{i:02}", f"head {t}", f"{i:02},{t}") for t, n in (("^B#1", 7), ("A b", 2), ("Ü", 1)) for i in range(n)]
        orders.write_series(spark.createDataFrame(rows, "ticker string, d string, head string, line string").repartition(1), str(tmp_path / "f"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = {p.name: p.read_text() for p in (tmp_path / "f").glob("*/*")}
    assert found == {f"{t}.csv": "\n".join([f"head {t}", *(line for x, _, _, line in rows if x == t)]) + "\n" for t in ("^B#1", "A b", "Ü")}
    assert {r["ticker"] for r in files.csv_rows(spark, str(tmp_path / "f")).collect()} == {"^B#1", "A b", "Ü"}


def test_the_same_rows_where_tasks_reach_no_local_folder(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("^B#1", "2", "Date,Close", "2020-01-02,2"), ("^B#1", "1", "Date,Close", "2020-01-01,1"), ("A", "1", "Close,Date", "5,2020-01-01")], "ticker string, d string, head string, line string").repartition("ticker")
    monkeypatch.setattr(orders, "LOCAL", ())
    orders.write_series(rows, str(tmp_path / "f"))
    found = {(r["ticker"], r["d"].isoformat(), r["close"]) for r in files.read_csv_bars(spark, str(tmp_path / "f"), "daily").collect()}
    assert found == {("^B#1", "2020-01-01", 1.0), ("^B#1", "2020-01-02", 2.0), ("A", "2020-01-01", 5.0)}


def test_parts_of_files_bars_grow_with_the_lines(spark, monkeypatch):
    monkeypatch.setattr(orders, "LINES", 50)
    many = orders.file_parts(spark, SF)
    plan = queries.queries()["file_verdicts"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert many > 20 and plan.count("Exchange") == plan.count(f"Exchange hashpartitioning(ticker") == plan.count(f", {many}), REPARTITION_BY_NUM") == 2


def test_columns_are_found_once_a_file(spark):
    plan = screen.bars_of(spark, {"daily": orders.csv_folder(spark, SF, "daily")})._jdf.queryExecution().optimizedPlan().toString()
    # Below the lines' own rows, that is, not above the operator that makes a row of each line; lines are split once.
    assert "array_position" not in plan[: plan.index("Generate")] and plan.count(r"\r?\n") == 1


def test_parts_of_csv_bars_grow_with_the_lines(spark, monkeypatch):
    monkeypatch.setattr(orders, "LINES", 50)
    many = orders.file_parts(spark, SF)
    plan = queries.queries()["csv_bars"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert many > 20 and plan.count("Exchange") == plan.count(f", {many}), REPARTITION_BY_NUM") == 1
