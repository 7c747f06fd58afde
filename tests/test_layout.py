"""How bars are laid out: partitions by the number of lines, and screens that add no exchange of their own."""

from recordvol.operators import breakouts, flows, levels, strength
from recordvol.plans import orders
from recordvol.sources import bars as files
from tests.test_averages import bars, walk

SF = "/root/testdata/sf0.001"


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_partitions_grow_with_the_lines(spark, monkeypatch):
    monkeypatch.setattr(orders, "LINES", 100)
    many = -(-orders.table(spark, SF, "lineitem").count() // 100)
    assert many > 50 and orders.partitions(spark, SF) == many
    assert orders.bars(spark, SF).rdd.getNumPartitions() == many


def test_lines_and_bars_of_all_timeframes_move_in_as_many_parts(spark, monkeypatch):
    monkeypatch.setattr(orders, "LINES", 100)
    monkeypatch.setattr(orders, "SENT", 0)  # parts and suppliers count as too many to be sent to every task
    many = orders.partitions(spark, SF)
    bars = orders.bars(spark, SF)
    plan = bars._jdf.queryExecution().executedPlan().toString()
    # Lines and parts by part, lines by supplier and day, bars and suppliers by supplier, bars by ticker: each once for all timeframes.
    assert plan.count("Exchange") == plan.count(f", {many}), REPARTITION_BY_NUM") == 6
    monkeypatch.undo()
    assert sorted(map(tuple, bars.collect())) == sorted(map(tuple, orders.bars(spark, SF).collect()))


def test_windows_over_laid_out_bars_need_no_exchange(spark):
    laid = orders.bars(spark, SF)
    assert exchanges(flows.volume_suite(laid)) == exchanges(laid)
    assert exchanges(flows.monthly_accumulation(laid)) == exchanges(laid)
    daily = orders.bars(spark, SF, "daily")
    assert exchanges(breakouts.contraction(daily)) == exchanges(daily)
    # One for each of both kinds of swing points.
    assert exchanges(flows.divergences(laid)) <= 2 * exchanges(laid)


def test_ratings_move_bars_to_their_dates_once(spark):
    table = bars(spark, walk(150)).repartition(3, "timeframe", "ticker")
    assert exchanges(strength.strength(table)) == 2


def test_pivots_carry_what_is_around_them(spark):
    table = bars(spark, walk(150)).repartition(3, "timeframe", "ticker")
    assert "Join" not in levels.pivots(table, 3, {"line": table["close"]})._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in flows.divergences(table)._jdf.queryExecution().executedPlan().toString()


def test_bars_of_files_are_laid_out_once(spark, tmp_path):
    (tmp_path / "AAA.csv").write_text("Date,Close\n2020-01-01,1\n2020-01-01,2\n2020-01-02,3\n")
    from recordvol.operators.quality import verdicts

    rows = files.with_files(files.csv_rows(spark, str(tmp_path)), "daily")
    assert exchanges(verdicts(rows)) == 1
    assert [r["close"] for r in rows.where("d is not null").orderBy("d").collect()] == [2.0, 3.0]


def test_a_folder_of_files_computes_its_bars_once(spark):
    folder = orders.csv_folder(spark, SF, "weekly")
    stored = spark.read.parquet(f"{folder}-rows")
    tickers = spark.read.text(folder, recursiveFileLookup=True, pathGlobFilter="*.csv").selectExpr("_metadata.file_path as p").distinct().count()
    assert tickers == stored.select("ticker").distinct().count()


def test_breakouts_sort_a_series_once(spark):
    laid = orders.bars(spark, SF)
    sorts = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Sort [timeframe")
    assert sorts(breakouts.price_volume(laid)) == 1
    # No frame of a window is as wide as the breakouts': wider ones are put together.
    assert "-60" not in breakouts.price_volume(laid)._jdf.queryExecution().executedPlan().toString()
