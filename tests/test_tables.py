"""Dedupe, rollups, rates, silver and gold tables, incremental loading."""

import datetime

import pytest
from pyspark.sql import functions as F

from pricemill.constants import INDICATOR_COLUMNS, MEASURES
from pricemill.operators import bars, calendar, dedupe, fx, incremental
from pricemill.plans import gold, silver
from pricemill.schemas import DAILY_FACT, EMPTY_DAILY_FACT
from pricemill.session import scratch_path
from pricemill.sources import tables
from pricemill.sources.payloads import empty
from tests.conftest import rows

D, T = datetime.date, datetime.datetime


def test_dedupe_paths_agree(spark):
    data = [("a", i % 7, i if i % 5 else None, float(i)) for i in range(60)]
    df = spark.createDataFrame(data, "k string, g int, load long, v double")
    aggregated = dedupe.dedupe_latest(df, ["k", "g"], "load")
    ranked = dedupe.keep_top(df, ["k", "g"], [F.col("load").desc_nulls_last()], 1)
    assert rows(aggregated) == rows(ranked)
    texts = df.withColumn("t", F.col("v").cast("string"))
    assert rows(dedupe.dedupe_latest(texts, ["k", "g"], "load").drop("t")) == rows(ranked)


def test_an_unknown_load_loses_to_the_smallest_value(spark):
    low = float("-inf")
    df = spark.createDataFrame(
        [("a", None, 1.0), ("a", low, 2.0), ("a", None, 3.0), ("b", 0.0, None), ("b", None, 4.0)],
        "k string, load double, v double",
    ).coalesce(1)
    assert rows(dedupe.dedupe_latest(df, "k", "load")) == [("a", low, 2.0), ("b", 0.0, None)]


def test_ties_between_ticks_are_settled(spark):
    at = T(2020, 1, 1, 12)
    data = [("a", at, i, float(i or 9)) for i in (4, None, -(2**63) + 1, 2**63 - 1, 7)]
    data.append(("a", T(2020, 1, 1, 11, 59, 59, 999999), 2**63 - 1, 1.0))
    df = spark.createDataFrame(data, "series string, ts timestamp, id long, price double")
    for kind in ("timestamp", "timestamp_ntz"):
        typed = df.withColumn("ts", F.col("ts").cast(kind))
        got = bars.from_ticks(typed, "series", "ts", "price", "ts", tie="id").first()
        assert (got["open"], got["close"], got["volume"]) == (1.0, float(2**63 - 1), 6.0)
        same = typed.filter(F.col("ts") == at)
        assert bars.from_ticks(same, "series", "ts", "price", "ts", tie="id").first()["open"] == 9.0


def test_dedupe_keeps_a_row_when_every_load_is_unknown(spark):
    df = spark.createDataFrame([("a", None, 1.0)], "k string, load timestamp, v double")
    assert rows(dedupe.dedupe_latest(df, "k", "load")) == [("a", None, 1.0)]


def test_dedupe_ties_by_breaker(spark):
    df = spark.createDataFrame(
        [("a", 1, 1, 1.0), ("a", 1, 3, 3.0), ("a", 1, 2, 2.0)], "k string, l int, t int, v double"
    )
    assert rows(dedupe.dedupe_latest(df, "k", "l", ["t"]), "v") == [(3.0,)]


def test_duplicates_include_null_keys(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4), ("b", 5)], "k string, v int")
    assert rows(dedupe.find_duplicates(df, "k"), "v", "occurrences") == [(1, 2), (2, 2), (3, 2), (4, 2)]


def daily(spark, data):
    """(date, open, close, low, high) of one series."""
    return spark.createDataFrame(
        [("s", r[0], *[None if v is None else float(v) for v in r[1:]]) for r in data],
        "series string, date date, open double, close double, low double, high double",
    )


OHLC = ("low", "high", "open", "close")


def test_straddling_week_belongs_to_its_first_day(spark):
    # Monday 2019-12-30 to Sunday 2020-01-05 belongs to December 2019 as a whole.
    df = daily(spark, [(D(2019, 12, 30) + datetime.timedelta(days=i), i, i + 1, i, i + 2) for i in range(7)])
    week = bars.rollup(bars.with_period_keys(df, "date"), "week", "series", "date", OHLC)
    year = bars.rollup(week, "year", "series", "iso_week_start_date", OHLC)
    assert rows(year, "year_start_date", *OHLC) == [(D(2019, 1, 1), 0.0, 8.0, 0.0, 7.0)]
    month = bars.rollup(week, "month", "series", "iso_week_start_date", OHLC)
    assert rows(month, "month_start_date") == [(D(2019, 12, 1),)]


def test_quarter_ties_are_settled_by_week(spark):
    df = daily(spark, [(D(2020, 1, 6) + datetime.timedelta(days=7 * i), i, 10 + i, 0, 0) for i in range(4)])
    week = bars.rollup(bars.with_period_keys(df, "date"), "week", "series", "date", OHLC)
    quarter = bars.rollup(week.repartition(4), "quarter", "series", "iso_week_start_date", OHLC)
    assert rows(quarter, "open", "close") == [(0.0, 13.0)]


def test_missing_value_on_last_day_stays_missing(spark):
    df = daily(spark, [(D(2020, 1, 6), 1, 2, 1, 2), (D(2020, 1, 7), 2, None, 1, 2)])
    week = bars.rollup(bars.with_period_keys(df, "date"), "week", "series", "date", OHLC)
    assert rows(week, "open", "close") == [(1.0, None)]


def rates(spark, data):
    return spark.createDataFrame(data, "date date, rate double, ingest_date_time timestamp")


def test_rates_fill_each_column_on_its_own(spark):
    load = T(2020, 2, 1)
    chf = rates(spark, [(D(2020, 1, 2), 0.9, load), (D(2020, 1, 5), 0.8, load)])
    eur = rates(spark, [(D(2020, 1, 3), 0.7, load)])
    days = calendar.calendar(spark, "2020-01-01", "2020-01-06")
    got = silver.usd_to_other(chf, eur, days, "b")
    assert rows(got, "date_rates", "rate_usd_chf", "rate_usd_eur") == [
        (D(2020, 1, 3), 0.9, 0.7), (D(2020, 1, 4), 0.9, 0.7),
        (D(2020, 1, 5), 0.8, 0.7), (D(2020, 1, 6), 0.8, 0.7),
    ]


def test_latest_rate_conversion(spark):
    table = spark.createDataFrame(
        [(D(2020, 1, 1), 0.25, 0.25), (D(2020, 1, 2), 0.875, 0.75)],
        "date_rates date, rate_usd_chf double, rate_usd_eur double",
    )
    df = spark.createDataFrame([(1600.0, 0.0)], "price double, sma double")
    assert rows(fx.convert_latest(df, table, ["price"], "EUR", ["sma"])) == [(1200.0, None)]
    assert rows(fx.convert_latest(df, table, ["price"], "USD", ["sma"])) == [(1600.0, 0.0)]
    with pytest.raises(ValueError):
        fx.convert_latest(df, table, ["price"], "GBP")


def candles(spark, first, count, load, bump=0.0):
    data = []
    for i in range(count):
        close = 100 + (i * 37) % 23 + bump
        day = first + datetime.timedelta(days=i)
        data.append(("s", day, close - 3, close + 4, close - 1, close, 5.0, load))
    return spark.createDataFrame(
        data,
        "series string, date date, low double, high double, open double, close double,"
        " volume double, ingest_date_time timestamp",
    )


@pytest.fixture()
def silver_inputs(spark):
    load = T(2020, 2, 15)
    raw = candles(spark, D(2020, 1, 1), 40, load)
    names = ", ".join(f"{n} double" for n in INDICATOR_COLUMNS)
    supplied = spark.createDataFrame(
        [("s", "2020-01-02", load, *[1.239 + i for i in range(9)])],
        f"series string, d string, ingest_date_time timestamp, {names}",
    )
    chf = rates(spark, [(D(2020, 1, 1), 0.9, load)])
    eur = rates(spark, [(D(2020, 1, 1), 0.8, load)])
    days = calendar.calendar(spark, "2020-01-01", "2020-03-01")
    usd = silver.usd_to_other(chf, eur, days, "b")
    return raw, silver.fact_indicators(supplied, "b"), usd


def test_daily_fact(spark, silver_inputs):
    fact = silver.obt_fact_day(*silver_inputs, "b")
    assert fact.drop("series").columns == [f.name for f in DAILY_FACT.fields]
    got = fact.filter("date_prices = '2020-01-02'").first()
    assert (got.macd_usd, got.sma_7_usd) == (1.24, 4.24)
    assert got.close_chf == round(got.close_usd * 0.9, 2)
    other = fact.filter("date_prices = '2020-01-03'").first()
    assert other.macd_usd is None and other.macd_chf is None


def test_incremental_daily_fact_converges(spark, silver_inputs):
    """A later load that corrects and extends the history ends like one full run."""
    raw, fact, usd = silver_inputs
    later = candles(spark, D(2020, 2, 5), 20, T(2020, 3, 20), bump=2.0)
    both = raw.unionByName(later)
    first = silver.obt_fact_day(raw, fact, usd, "b1", processed_at="2020-03-01 00:00:00")
    second = silver.obt_fact_day(both, fact, usd, "b2", target=first)
    assert 0 < second.count() < both.select("date").distinct().count()
    merged = incremental.upsert(first, second, ["series", "date_prices"])
    full = silver.obt_fact_day(both, fact, usd, "b")
    audit = ("ingest_date_time", "dbt_batch_id")
    assert rows(merged.drop(*audit)) == rows(full.drop(*audit))


def test_gold_chain(spark, silver_inputs):
    fact = silver.obt_fact_day(*silver_inputs, "b")
    units = gold.all_periods(fact, "b")
    assert units["year"].count() == 1 and units["month"].count() == 2
    week = units["week"].orderBy("iso_week_start_date").first()
    assert week.macd_usd is None and week.dbt_batch_id == "b"
    assert f"{MEASURES[-1]}_eur" in units["quarter"].columns
    again = gold.aggregate(fact, "week", "b2", target=units["week"])
    assert again.count() in (0, units["week"].count())


def test_strict_filter_before_dedupe(spark):
    names = ", ".join(f"{n} double" for n in INDICATOR_COLUMNS)
    raw = spark.createDataFrame(
        [("s", "2020-01-01", T(2020, 1, 2), *[1.0] * 9), ("s", "2020-01-01", T(2020, 1, 3), *[2.0] * 9)],
        f"series string, d string, ingest_date_time timestamp, {names}",
    )
    target = silver.fact_indicators(raw, "b", processed_at="2020-01-02 12:00:00")
    assert rows(silver.fact_indicators(raw, "b", target), "macd") == [(2.0,)]
    late = silver.fact_indicators(raw, "b", processed_at="2020-01-03 00:00:00")
    assert silver.fact_indicators(raw, "b", late).count() == 0


def test_filters_with_empty_target(spark):
    df = spark.createDataFrame([(D(2020, 1, 1), 1, 1.0)], "d date, n long, x double")
    for column in ("d", "n", "x"):
        for mode in ("strict", "inclusive"):
            assert incremental.filter_new(df, df.limit(0), column, mode=mode).count() == 1


def test_sync_adds_and_drops_columns(spark):
    target = spark.createDataFrame([(1, "old", 2.0)], "k int, gone string, kept double")
    updates = spark.createDataFrame([(2, 3.0, "new")], "k int, kept double, added string")
    got = incremental.upsert(target, updates, "k")
    assert got.columns == ["k", "kept", "added"]
    assert rows(got) == [(1, 2.0, None), (2, 3.0, "new")]


def test_upsert_is_idempotent_and_touches_only_its_months(spark):
    path = scratch_path(spark, "test-upsert")
    base = candles(spark, D(2020, 1, 1), 60, T(2020, 3, 1))
    assert tables.write_partitioned(base, path) == 60
    untouched = f"{path}/month=2020-01-01"
    before = spark.read.parquet(untouched).inputFiles()
    updates = candles(spark, D(2020, 2, 20), 20, T(2020, 3, 2), 1.0).withColumn(
        "month", F.trunc("date", "month")
    )
    for _ in range(2):
        incremental.upsert_partitions(spark, path, updates, ["series", "date"], "month")
        got = spark.read.parquet(path)
        assert got.count() == 70
        assert got.filter("ingest_date_time = '2020-03-02'").count() == 20
    assert spark.read.parquet(untouched).inputFiles() == before


def test_watermark_of_catalog_table(spark):
    assert incremental.table_watermark(spark, "default.no_such_table") is None
    tables.write_partitioned(candles(spark, D(2020, 1, 1), 3, T(2020, 3, 1)), "default.bars_wm")
    assert incremental.table_watermark(spark, "default.bars_wm") == D(2020, 1, 3)
    assert tables.scan_table(spark, "default.bars_wm").count() == 3
    spark.sql("DROP TABLE default.bars_wm")


def test_empty_frames_keep_their_schema(spark):
    assert empty(spark, EMPTY_DAILY_FACT).schema == EMPTY_DAILY_FACT
