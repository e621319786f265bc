"""Refreshes that begin with the changed rows: what they read, and that nothing is missed."""

import datetime

import pytest
from pyspark.sql import functions as F

from pricemill.operators import indicators
from pricemill.plans import changes, gold, silver
from pricemill.sources import evolving, tables
from tests.conftest import rows

DAY = datetime.date(2020, 1, 1)


def dated(spark, days, series="a"):
    found = [(series, DAY + datetime.timedelta(d)) for d in days]
    frame = spark.createDataFrame(found, "series string, date date")
    return frame.withColumn("month", F.trunc("date", "month"))


def months(found):
    return [(m.year, m.month) for m in found]


def test_a_month_and_its_neighbours(spark):
    table = dated(spark, range(730))
    changed = table.where("date = DATE '2020-06-10'")
    found = changes.partitions_to_read(table, changed, "series", "date", "month", 14, 14)
    assert months(found) == [(2020, 5), (2020, 6), (2020, 7)]


def test_sparse_series_reach_further_back(spark):
    table = dated(spark, range(730)).union(dated(spark, range(0, 730, 20), "b"))
    changed = table.where("series = 'b' AND date BETWEEN DATE '2021-06-01' AND DATE '2021-06-30'")
    found = changes.partitions_to_read(table, changed, "series", "date", "month", 14, 0)
    first = sorted(r[0] for r in table.where("series = 'b'").select("date").collect()
                   if r[0] < datetime.date(2021, 6, 1))[-14]
    assert found[0] <= first.replace(day=1) and (2021, 6) in months(found)
    short = dated(spark, range(0, 730)).union(dated(spark, [500, 510], "c"))
    changed = short.where("series = 'c'")
    found = changes.partitions_to_read(short, changed, "series", "date", "month", 14, 14)
    assert len(found) <= 4  # the series has no more rows anywhere


def test_nothing_changed_reads_nothing(spark):
    table = dated(spark, range(60))
    assert changes.partitions_to_read(table, table.limit(0), "series", "date", "month", 1, 1) == []


def test_rows_behind_a_change_are_reached(spark):
    table = dated(spark, range(10)).withColumn("n", F.datediff("date", F.lit(DAY)))
    found = changes.flag_reached(table, F.col("n") == 3, "series", "date", 2).where("reached")
    assert rows(found, "n") == [(3,), (4,), (5,)]


@pytest.fixture
def bronze(spark, tmp_path):
    path = str(tmp_path / "bronze")
    table = dated(spark, range(900)).union(dated(spark, range(0, 900, 9), "b")).drop("month")
    price = (F.xxhash64("series", "date") % 1000 + 2000).cast("double")
    raw = table.select(
        "series", "date", *[price.alias(c) for c in ("low", "high", "open", "close")],
        F.lit(1.0).alias("volume"), F.to_timestamp(F.lit("2022-06-01")).alias("ingest_date_time"),
    )
    tables.write_partitioned(raw, path)
    return path, raw


def parts(spark):
    fact = spark.createDataFrame([], "series string, date_indicators string").select(
        "*", *[F.lit(None).cast("double").alias(c) for c in silver.INDICATORS]
    )
    rates = spark.createDataFrame(
        [], "date_rates date, rate_usd_chf double, rate_usd_eur double, update_date_time timestamp"
    )
    return fact, rates


def test_daily_changes_read_their_months_and_equal_a_full_run(spark, tmp_path, bronze):
    path, raw = bronze
    fact, rates = parts(spark)
    stamps = {"batch_id": "b", "processed_at": "2023-01-02"}
    first = silver.obt_fact_day(raw, fact, rates, **stamps)
    more = raw.where("date IN (DATE '2020-07-03', DATE '2021-11-20')").withColumn(
        "close", F.col("close") + 500
    ).withColumn("ingest_date_time", F.to_timestamp(F.lit("2023-02-01")))
    tables.append_evolving(more, path)
    now = evolving.read(spark, path)
    found = silver.obt_fact_day_changes(now, fact, rates, target=first, **stamps)
    text = found._jdf.queryExecution().executedPlan().toString()
    filters = [t.split("]")[0] for t in text.split("PartitionFilters: [")[1:]]
    assert filters and all("month" in f for f in filters), filters
    full = silver.obt_fact_day(now.drop("month"), fact, rates, **stamps)
    wanted = ("series", "date_prices", "close_usd", "rsi", "rsi_status")
    both, old = set(rows(found, *wanted)), set(rows(first, *wanted))
    assert both <= set(rows(full, *wanted)) and len(both) < 80
    kept = {r for r in old if r[:2] not in {b[:2] for b in both}}
    assert kept | both == set(rows(full, *wanted))


def test_gold_changes_equal_a_full_run(spark, tmp_path, bronze):
    _, raw = bronze
    fact, rates = parts(spark)
    daily = silver.obt_fact_day(raw, fact, rates, "b", processed_at="2023-01-02")
    changed = (F.col("date_prices") == "2020-07-03") | (F.col("date_prices") == "2021-11-20")
    later = daily.withColumn(
        "close_usd", F.when(changed, F.col("close_usd") + 500).otherwise(F.col("close_usd"))
    ).withColumn(
        "ingest_date_time",
        F.when(changed, F.to_timestamp(F.lit("2023-02-02"))).otherwise(F.col("ingest_date_time")),
    )
    path = str(tmp_path / "daily")
    evolving.overwrite(
        spark, path, later.withColumn("period", F.trunc("date_prices", "year")), "period"
    )
    week = gold.aggregate(daily, "week", "b", processed_at="2023-01-03")
    target = str(tmp_path / "week")
    evolving.overwrite(
        spark, target, week.withColumn("period", F.trunc("iso_week_start_date", "year")), "period"
    )
    found = gold.aggregate_changes(
        evolving.read(spark, path), "week", "b", evolving.read(spark, target)
    )
    full = gold.aggregate(later, "week", "b", processed_at="2023-01-03")
    wanted = ("series", "iso_week_start_date", "open_usd", "close_usd", "high_usd", "rsi")
    both = set(rows(found, *wanted))
    assert both <= set(rows(full, *wanted)) and 4 <= len(both) <= 70
    kept = {r for r in rows(week, *wanted) if r[:2] not in {b[:2] for b in both}}
    assert kept | both == set(rows(full, *wanted))


def test_rsi_needs_fourteen_rows_ahead(spark):
    table = dated(spark, range(40)).withColumn("close", (F.xxhash64("date") % 100).cast("double"))
    whole = indicators.rsi(table, "series", "date", "close").where("date = DATE '2020-02-05'")
    cut = indicators.rsi(
        table.where("date >= DATE '2020-01-22'"), "series", "date", "close"
    ).where("date = DATE '2020-02-05'")
    assert rows(whole, "rsi") == rows(cut, "rsi")
