"""Worked examples and quirks of record detection, validation and reports."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from recordvol.operators import exports, quality, records, scoring, universe
from recordvol.operators.records import Screen
from recordvol.plans import screen
from recordvol.schema import BARS, HEAD, TAIL, TRAILING
from recordvol.sources import bars as sources
from recordvol.sources.settings import Settings, choice_files, parse_choice, read_settings


def series(spark, volumes, start="2024-01-01", days=None, ticker="T", timeframe="daily", closes=None):
    first = dt.date.fromisoformat(start)
    dates = days or [first + dt.timedelta(i) for i in range(len(volumes))]
    closes = closes or [10.0] * len(volumes)
    rows = [(timeframe, ticker, d, 9.0, 11.0, 8.0, c, None if v is None else float(v)) for d, v, c in zip(dates, volumes, closes)]
    return spark.createDataFrame(rows, BARS)


def flags(df):
    return [r["is_record"] for r in df.orderBy("d").collect()]


def test_worked_example(spark):
    bars = series(spark, [1000, 5000, 4000, 8000, 7000])
    assert [r["volume"] for r in records.record_events(bars).orderBy("d").collect()] == [1000, 5000, 8000]
    top = exports.hvd_wide_all_days(bars, 3).first()
    assert [top[f"HVD_vol_{i}"] for i in (1, 2, 3)] == [8000, 7000, 5000]


@pytest.mark.parametrize(
    ("first", "resets", "want"),
    [(True, True, "TFTFTF"), (True, False, "TFFFTF"), (False, False, "FFFFTF")],
)
def test_nulls_and_ties(spark, first, resets, want):
    bars = series(spark, [5, None, 5, 3, 9, 9])
    assert flags(records.record_flags(bars, first, resets)) == [c == "T" for c in want]


def test_one_year_scenario(spark):
    latest = dt.date(2024, 6, 28)
    ages = [458, 427, 334, 243, 152, 62, 0]
    bars = series(spark, [1000, 1500, 2000, 2500, 3000, 3500, 3500], days=[latest - dt.timedelta(a) for a in ages])
    row = records.summary(bars).first()
    assert (row["hve_occ_1y"], row["total_hve_count"], row["latest_volume"], row["days_since_hve"]) == (4, 6, 3500.0, 62)
    assert tuple(row.asDict()) == HEAD + TRAILING + TAIL


def test_leap_day_and_window_edges(spark):
    days = [dt.date(2023, 2, 27), dt.date(2023, 2, 28), dt.date(2023, 3, 1), dt.date(2024, 2, 29)]
    row = records.summary(series(spark, [1, 2, 3, 1], days=days)).first()
    assert row["hve_occ_1y"] == 2  # a calendar year back is 28 February
    assert row["total_hv1y_count"] == 1  # 365 days back is 1 March


def test_zero_and_null_volume_and_short_series(spark):
    zero = series(spark, [0, 0], ticker="Z")
    gone = series(spark, [None, None], ticker="N")
    short = series(spark, [5], ticker="S")
    rows = records.summary(zero.unionByName(gone).unionByName(short)).collect()
    assert [(r["ticker"], r["total_hve_count"], r["volume_ratio"]) for r in rows] == [("Z", 0, 0.0)]


def test_window_with_one_bar_is_empty(spark):
    row = records.summary(series(spark, [5, 7], days=[dt.date(2020, 1, 1), dt.date(2024, 1, 1)])).first()
    assert row["hv1y_date"] is None and row["total_hv1y_count"] == 0 and row["all_hv1y_details"] == [] and row["is_hv1y_also_hve"] is False


def test_latest_filters_see_the_whole_history_and_let_nulls_pass(spark):
    cheap = series(spark, [1, 2, 3], ticker="C", closes=[50.0, 50.0, 1.0])
    unknown = series(spark, [1, 2, 3], ticker="U", closes=[50.0, 50.0, None])
    screen = Screen(min_price=2.0, range_mode="fixed", start="2024-01-01", end="2024-01-02")
    assert [r["ticker"] for r in records.summary(cheap.unionByName(unknown), screen).collect()] == ["U"]


def test_one_exchange_feeds_all_windows(spark):
    bars = series(spark, [1, 2, 3])
    plan = records.summary(bars)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_validation_reasons(spark):
    few = series(spark, [1] * 5, ticker="few")
    gaps = series(spark, [1] * 60, ticker="gaps", timeframe="other", closes=[None if i % 5 == 0 else 10.0 for i in range(60)])
    bad = series(spark, [1] * 60, ticker="bad", timeframe="other", closes=[0.0] + [10.0] * 59)
    wild = series(spark, [1] * 60, ticker="wild", timeframe="other", closes=[10.0 if i % 2 else 100.0 for i in range(60)])
    good = series(spark, [1] * 60, ticker="good", timeframe="other")
    all_ = few.unionByName(gaps).unionByName(bad).unionByName(wild).unionByName(good)
    found = {r["ticker"]: r["reason"] for r in quality.verdicts(all_).collect()}
    assert found["few"] == "Insufficient data: 5 < 252 (daily)"
    assert found["gaps"].startswith("Too many missing") and found["bad"].startswith("Invalid price") and found["wild"].startswith("Too many extreme")
    assert found["good"] == "Valid data"
    assert quality.valid_bars(all_).select("ticker").distinct().collect()[0][0] == "good"
    assert quality.data_summary(all_, sample=10).first()["valid"] == 1


def test_cards_and_files(spark, tmp_path):
    bars = series(spark, [1000, 5000, 4000])
    results = records.summary(bars)
    card = exports.cards(results, "2024-01-04 00:00:00").first()["card"].split("\n")
    assert "  1. 2024-01-02  Volume: 5,000  (1 days ago)  [Also HVE]" in card and "  2. 2024-01-01  Volume: 1,000  (2 days ago)" in card
    assert "Total HVE events across all timeframes: 2" in card and "Latest volume activity: Daily (1 days ago)" in card
    exports.write_results(results, str(tmp_path / "csv"))
    exports.write_wide(exports.hve_wide(results), str(tmp_path / "wide"))
    exports.write_cards(results, str(tmp_path / "cards"), "now")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 1


def test_csv_scan(spark, tmp_path):
    (tmp_path / "A.csv").write_text("Date,Open,High,Low,Close,Volume\n2024-01-05 00:00:00-05:00,1,1,1,1,10\n2024-01-06,1,1,1,1,99\n,1,1,1,1,5\nnonsense,1,1,1,1,5\n2024-01-08,1,1,1,nan,x\n")
    (tmp_path / "B.csv").write_text("Date,Open,High,Low,Close,Volume\n2024-01-05,1,1,1,1,10\n")
    rows = sources.read_csv_bars(spark, str(tmp_path), "daily", spark.createDataFrame([("A",), ("C",)], "ticker string")).orderBy("d").collect()
    assert [(r["ticker"], r["d"].isoformat(), r["close"], r["volume"]) for r in rows] == [("A", "2024-01-05", 1.0, 10.0), ("A", "2024-01-08", None, None)]


def test_csv_columns_go_by_their_names(spark, tmp_path):
    (tmp_path / "EXTRA.csv").write_text("\ufeffDate,Open,High,Low,Close,Adj Close,Volume\r\n2024-01-05,1,2,3,4,1.4,1000\r\n")
    (tmp_path / "FEW.csv").write_text("Date,close,VOLUME\n2024-01-05,1.5,1000\n")
    (tmp_path / "MIXED.csv").write_text('Volume,"Date",Close\n7,2024-01-05,5\n"1000","2024-01-05","4"\n')
    (tmp_path / "NOCLOSE.csv").write_text("Date,Volume\n2024-01-05,3\n")
    (tmp_path / "EMPTY.csv").write_text("")
    (tmp_path / "HEADER.csv").write_text("Date,Close,Volume\n\n")
    raw = sources.csv_rows(spark, str(tmp_path))
    found = {r["ticker"]: (r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in sources.tidy(raw, "daily").collect()}
    # Of two rows of a day the last one counts, not the largest.
    assert found == {"EXTRA": (1, 2, 3, 4, 1000), "FEW": (None, None, None, 1.5, 1000), "MIXED": (None, None, None, 4, 1000), "NOCLOSE": (None, None, None, None, 3)}
    reasons = {r["ticker"]: r["reason"] for r in quality.verdicts(sources.with_files(raw, "daily"), 1).collect()}
    assert reasons == {"NOCLOSE": "Missing Close price column", "HEADER": "No data available"} | dict.fromkeys(("EXTRA", "FEW", "MIXED"), "Valid data")


def test_each_timeframe_is_judged_by_its_own_file(spark, tmp_path):
    for timeframe, header in (("daily", "Date,Volume"), ("weekly", "Date,Close,Volume")):
        (tmp_path / timeframe).mkdir()
        for ticker in ("AAA", "BBB"):
            names = "Date,Close,Volume" if ticker == "BBB" else header
            days = [dt.date(2020, 1, 6) + dt.timedelta(7 * i) for i in range(300)]
            (tmp_path / timeframe / f"{ticker}.csv").write_text(names + "\n" + "\n".join(",".join([str(d), *(["5"] * (names.count(",")))]) for d in days))
    bars = screen.bars_of(spark, {t: str(tmp_path / t) for t in ("daily", "weekly")})
    found = {(r["timeframe"], r["ticker"]): r["reason"] for r in quality.verdicts(bars).collect()}
    assert found == {("daily", "AAA"): "Missing Close price column", ("daily", "BBB"): "Valid data", ("weekly", "AAA"): "Valid data", ("weekly", "BBB"): "Valid data"}
    valid = quality.valid_bars(bars)
    assert valid.columns == BARS.fieldNames() and {(r[0], r[1]): r[2] for r in valid.groupBy("timeframe", "ticker").count().collect()} == {k: 300 for k, v in found.items() if v == "Valid data"}
    plan = screen.run(bars, spark.createDataFrame([("AAA",)], "ticker string"), Settings(yf_daily_data=True, yf_weekly_data=True, hve_limit_years=0, hve_date_range_mode="rolling"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 2


def test_full_screen_from_files_to_reports(spark, tmp_path):
    first = dt.date(2020, 1, 1)
    for t, top in (("A", 900), ("B", 500), ("C", 100)):
        lines = [f"{first + dt.timedelta(i)},1,1,1,10,{top if i == 100 else 10 + i % 7}" for i in range(600)]
        (tmp_path / "daily").mkdir(exist_ok=True)
        (tmp_path / "daily" / f"{t}.csv").write_text("Date,Open,High,Low,Close,Volume\n" + "\n".join(lines))
    (tmp_path / "daily" / "SHORT.csv").write_text("Date,Close,Volume\n2020-01-01,1,1\n")
    (tmp_path / "mine.csv").write_text("Symbol\nB\nSHORT\nA\nB\nGONE\n")
    settings = Settings(ticker_choice="6", yf_daily_data=True, hve_limit_years=0, hve_date_range_mode="rolling")
    listed = sources.ticker_list(spark.read.option("header", True).csv(str(tmp_path / "mine.csv"))).withColumn("place", F.monotonically_increasing_id())
    known = spark.createDataFrame([("A", 1, True, "NYSE"), ("A", 2, False, "LSE")], "ticker string, place long, SP500 boolean, exchange string")
    selection = universe.chosen(known, [6], {6: listed}, ["SP500"])
    assert {(r["ticker"], r["SP500"], r["exchange"]) for r in selection.collect()} == {("A", True, "NYSE"), ("B", False, None), ("SHORT", False, None), ("GONE", False, None)}
    bars = screen.bars_of(spark, {"daily": str(tmp_path / "daily")}, selection)
    results = screen.run(bars, selection, settings)
    assert {(r["ticker"], r["hve_volume"]) for r in results.collect()} == {("A", 900.0), ("B", 500.0)}
    screen.write_reports(results, settings, str(tmp_path / "out"), "now", "20240131_180000")
    names = {p.name for p in (tmp_path / "out").iterdir()}
    assert names == {"results", "csv", "ticker_cards", "hve_historical", "hvd_historical", "hve_report_6_20240131_180000"}
    report = spark.read.option("header", True).csv(str(tmp_path / "out" / "hve_report_6_20240131_180000")).collect()
    assert {(r["Ticker"], r["HVE Count"], r["Score"] is not None) for r in report} == {(r["ticker"], str(r["total_hve_count"]), True) for r in results.collect()}
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "hve_historical")).count() == 2
    assert [r["ticker"] for r in exports.most_recent(results, 1).collect()] == ["A"]
    universe.write_selection(selection, str(tmp_path / "sel"), "6")
    assert spark.read.option("header", True).csv(str(tmp_path / "sel" / "combined_tickers_6.csv")).count() == 4


def test_universe_files(spark, tmp_path):
    (tmp_path / "u.csv").write_text('Symbol,Exchange,Analyst Rating,Market capitalization,Index\nBRK.A,NYSE,Strong buy,12.5,"S&P 500, NASDAQ 100"\nX/P,NYSE,Neutral,1,\nN,LSE,Neutral,x,\n')
    table = universe.read_universe(spark, str(tmp_path / "u.csv"))
    assert [(r["ticker"], r["market_cap"]) for r in table.orderBy("place").collect()] == [("BRK-A", 12.5), ("N", None)]
    universe.write_universe(table, str(tmp_path / "flags"))
    flags = spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "flags"))
    assert {(r["ticker"], r["SP500"], r["exchange_LSE"], r["rating_Strong_buy"]) for r in flags.collect()} == {("BRK-A", True, False, True), ("N", False, True, False)}
    assert universe.choice_file_names([6, 5, 6], {5: "a.csv", 6: "b.csv"}) == ["b.csv", "a.csv"]
    with pytest.raises(ValueError, match="no file"):
        universe.choice_file_names([1], {})
    lacking = universe.backfilled(table, spark.createDataFrame([("N",), ("NEW",)], "ticker string"))
    assert {r["ticker"] for r in lacking.collect()} == {"BRK-A", "N", "NEW"}


def test_file_lookups(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "t.csv").write_text("ticker\nA\n")
    assert sources.find_file(spark, "t.csv", [str(tmp_path), str(tmp_path / "in")]) == f"{tmp_path}/in/t.csv"
    assert sources.find_file(spark, "u.csv", [str(tmp_path)]) is None
    paths = sources.ticker_list_paths(str(tmp_path / "in"), "3", "t.csv")
    assert sources.read_first(spark, paths).first()[0] == "A" and len(sources.ticker_info_paths("f", "1")) == 6
    with pytest.raises(FileNotFoundError):
        sources.read_first(spark, [f"{tmp_path}/none.csv"])
    settings = {"yf_daily_data_files_local": "bars/daily", "yf_weekly_data_files_local": "s3://x/w", "yf_monthly_data_files_local": "nan"}
    assert [sources.input_folder(settings, t, "local", "/b") for t in ("daily", "weekly", "monthly")] == ["/b/bars/daily", "s3://x/w", "/b/data/market_data/monthly"]
    with pytest.raises(ValueError, match="unknown timeframe"):
        sources.input_folder({}, "hourly", "local", "/b")
    assert [sources.environment_of(*x) for x in (("colab", {}), ("odd", {}), (None, {"COLAB_GPU": "1"}))] == ["colab", "local", "colab"]


def test_legacy_reports(spark):
    bars = series(spark, [5, 9, 3]).unionByName(series(spark, [9, 5, 3], ticker="NONE"))
    sheet = scoring.summary_sheet(scoring.scored(scoring.legacy_results(bars)))
    assert sheet.columns[:3] == ["Ticker", "Timeframe", "Score"] and [r["Ticker"] for r in scoring.all_combined(sheet, sheet).collect()] == ["T", "T"]
    empty = scoring.legacy_results(bars, empty=True).where("ticker = 'NONE'").first().asDict()
    assert (empty.pop("hve_count"), empty.pop("data_points"), empty.pop("hve_details")) == (0, 0, []) and set(empty.values()) == {"NONE", "daily", None}
    rows = spark.createDataFrame([("A", "2024-01-05"), ("A", "soon"), ("B", "")], "ticker string, Date string")
    assert {(r["ticker"], r["unreadable"]) for r in sources.unreadable_dates(rows).collect()} == {("A", 1), ("B", 0)}
    assert sources.since(bars, F.lit("2024-01-03").cast("date"), 1).count() == 6


def test_ticker_lists(spark):
    listed = spark.createDataFrame([(" A ",), (None,), ("A",), ("B",)], "Symbol string")
    assert sorted(r[0] for r in sources.ticker_list(listed).collect()) == ["A", "B"]
    with pytest.raises(ValueError, match="no ticker column"):
        sources.ticker_list(listed.withColumn("other", F.lit(1)).drop("Symbol").withColumn("more", F.lit(1)))


def test_universe(spark):
    rows = [(1, " BRK.A ", "S&P 500, Mini-Russell 2000"), (2, "X/P", "S&P 500"), (3, "N", None)]
    table = universe.cleaned(spark.createDataFrame(rows, "place int, ticker string, index string"))
    assert [tuple(r) for r in universe.one_hot(table).select("ticker", "MiniRussell2000", "SP500").orderBy("ticker").collect()] == [("BRK-A", True, True), ("N", False, False)]
    assert universe.members(table, 1).count() == 1 and universe.members(table, 0).count() == 2
    with pytest.raises(ValueError, match="unknown choice"):
        universe.members(table, 99)
    assert [r["ticker"] for r in universe.union_selections(table.where("place = 3"), table).collect()] == ["N", "BRK-A"]


def test_score(spark):
    rows = [(10, 2, 50.0), (60, 1, 10.0), (200, 20, 200.0), (500, 0, 0.0), (None, 3, 1.0)]
    df = spark.createDataFrame(rows, "d int, n int, r double")
    got = [r[0] for r in df.select(scoring.score(F.col("d"), F.col("n"), F.col("r"))).collect()]
    want = [66.0, round(50 * (1 - 30 / 60 * 0.5) + 3 + 2, 2), round(25 * (1 - 110 / 275 * 0.8) + 30 + 20, 2), round(5 * (1 - 135 / 365), 2), 0.0]
    assert got == want


def test_settings(tmp_path):
    path = tmp_path / "user.csv"
    path.write_text('# comment,,\n# 5: Index tickers,indexes.csv,16\nticker_choice,1-2,\nHVE_enable,no,\nHVE_min_price,2,\nHVE_limit_years,abc,\nYF_weekly_data,TRUE,\n')
    s = read_settings(str(path))
    assert (s.ticker_choice, s.hve_enable, s.hve_min_price, s.hve_limit_years, s.timeframes()) == ("1-2", False, 2.0, 4, ("weekly",))
    assert choice_files(str(path)) == {5: "indexes.csv"}
    assert read_settings(str(tmp_path / "none.csv")) == Settings()
    assert parse_choice("1-2") == [1, 2] and parse_choice(0) == [0]
    with pytest.raises(ValueError, match="not a choice"):
        parse_choice("1;2")
