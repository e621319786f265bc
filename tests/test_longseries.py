"""Chunked windows give the same rows as plain ones, for any keys, gaps and chunk size."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pricemill.operators import indicators, longseries
from tests.conftest import rows

SCHEMA = "series string, tick long, close double"


def ticks(spark, seed, sizes, spread, nulls=0.0):
    rng = random.Random(seed)
    data = []
    for name, size in sizes.items():
        for key in rng.sample(range(-size * spread // 2, size * spread // 2 + 1), size):
            price = None if rng.random() < nulls else round(rng.uniform(1, 500), 2)
            data.append((name, key, price))
    rng.shuffle(data)
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module", params=[(1, 1), (2, 3), (3, 5000)])
def long_ticks(request, spark):
    seed, spread = request.param
    return ticks(spark, seed, {"hot": 900, "warm": 250, "one": 1}, spread).cache()


@pytest.mark.parametrize("chunk_rows", [7, 64])
def test_position(long_ticks, chunk_rows):
    plain = long_ticks.withColumn(
        "_position", F.row_number().over(Window.partitionBy("series").orderBy("tick")) - 1
    )
    got = longseries.with_position(long_ticks, "series", "tick", chunk_rows)
    assert rows(got, "series", "tick", "_position") == rows(plain, "series", "tick", "_position")


def test_no_chunk_is_large(long_ticks):
    chunked = longseries.with_chunks(long_ticks, "series", "tick", 5, 50)
    largest = chunked.groupBy("series", "_chunk").count().agg(F.max("count")).first()[0]
    assert largest <= 55


@pytest.mark.parametrize("chunk_rows", [5, 64])
def test_rsi_and_change(long_ticks, chunk_rows):
    names = ("series", "tick", "close", "rsi", "rsi_status")
    plain = indicators.rsi(long_ticks, "series", "tick", "close")
    chunked = indicators.rsi(long_ticks, "series", "tick", "close", chunk_rows=chunk_rows)
    assert rows(chunked, *names) == rows(plain, *names)
    plain = indicators.price_change(long_ticks, "series", "tick", "close")
    chunked = indicators.price_change(long_ticks, "series", "tick", "close", chunk_rows=chunk_rows)
    assert rows(chunked) == rows(plain)


def test_sma(long_ticks):
    plain = indicators.sma(long_ticks, "series", "tick", "close", (3, 20))
    chunked = indicators.sma(long_ticks, "series", "tick", "close", (3, 20), chunk_rows=30)
    assert rows(chunked) == rows(plain)


def assert_close(got, want, names):
    got, want = rows(got, "series", "tick", *names), rows(want, "series", "tick", *names)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    for a, b in zip(got, want):
        assert a[2:] == pytest.approx(b[2:], rel=1e-11, abs=1e-9)


def test_ema_and_macd(long_ticks):
    plain = indicators.ema(long_ticks, "series", "tick", "close", (2, 7))
    chunked = indicators.ema(long_ticks, "series", "tick", "close", (2, 7), chunk_rows=100)
    assert_close(chunked, plain, ["ema_2", "ema_7"])
    plain = indicators.macd(long_ticks, "series", "tick", "close", 3, 5, 2)
    chunked = indicators.macd(long_ticks, "series", "tick", "close", 3, 5, 2, chunk_rows=100)
    assert_close(chunked, plain, ["macd", "macd_signal", "macd_hist"])


def test_ema_with_missing_prices(spark):
    df = ticks(spark, 9, {"a": 600, "b": 50}, 2, nulls=0.4)
    plain = indicators.ema(df, "series", "tick", "close", (7,))
    chunked = indicators.ema(df, "series", "tick", "close", (7,), chunk_rows=64)
    got, want = rows(chunked, "series", "tick", "ema_7"), rows(plain, "series", "tick", "ema_7")
    assert [r[:2] for r in got] == [r[:2] for r in want]
    for a, b in zip(got, want):
        assert (a[2] is None) == (b[2] is None)
        assert a[2] is None or a[2] == pytest.approx(b[2], rel=1e-11)


@pytest.mark.parametrize("chunk_rows", [40, 146])
def test_ema_keeps_all_history(spark, chunk_rows):
    """Old prices may be larger by many orders of magnitude and must still be felt."""
    prices = [1e9] * 100 + [1e-9] * 300 + [1e12, 1e-12] * 50
    data = [("a", i, p) for i, p in enumerate(prices)] + [("b", 3, 2.0)]
    df = spark.createDataFrame(data, SCHEMA)
    spans = (1, 7, 200)
    got = indicators.ema(df, "series", "tick", "close", spans, chunk_rows=chunk_rows)
    found = rows(got, "series", "tick", *[f"ema_{s}" for s in spans])
    for column, span in enumerate(spans, 2):
        keep, want = (span - 1) / (span + 1), []
        for price in prices:
            want.append(keep * want[-1] + (1 - keep) * price if want else price)
        assert [r[column] for r in found if r[0] == "a"] == pytest.approx(want, rel=1e-10, abs=0)
    assert found[-1] == ("b", 3, 2.0, 2.0, 2.0)


@pytest.mark.parametrize("spread", [1, 400_000])
@pytest.mark.parametrize("nulls", [0.3, 0.995])
def test_forward_fill(spark, spread, nulls):
    df = ticks(spark, 4, {"hot": 800, "b": 30}, spread, nulls)
    window = (
        Window.partitionBy("series").orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    )
    plain = df.withColumn("close", F.last("close", ignorenulls=True).over(window))
    got = longseries.forward_fill(df, "series", "tick", ["close"], chunk_rows=16)
    assert rows(got) == rows(plain)


def test_keys_beyond_double_precision(spark):
    base = 2**60
    data = [("a", base + i, float(i)) for i in range(200)]
    df = spark.createDataFrame(data, SCHEMA)
    got = longseries.with_position(df, "series", "tick", 8)
    assert [r._position for r in got.orderBy("tick").collect()] == list(range(200))


def test_dates_and_times_as_order(spark):
    df = ticks(spark, 5, {"a": 100}, 1)
    dated = df.withColumn("tick", F.date_add(F.lit("1970-01-10").cast("date"), F.col("tick").cast("int")))
    timed = df.withColumn("tick", F.timestamp_seconds("tick"))
    want = [r[2:] for r in rows(indicators.rsi(df, "series", "tick", "close"))]
    for other in (dated, timed, timed.withColumn("tick", F.col("tick").cast("timestamp_ntz"))):
        got = indicators.rsi(other, "series", "tick", "close", chunk_rows=20)
        assert [r[2:] for r in rows(got)] == want


def bucket_rows(df, chunk_rows):
    _, sizes = longseries.buckets(df, ["series"], "tick", chunk_rows)
    return sorted(r["_n"] for r in sizes.collect())


def test_sparse_keys_do_not_make_a_bucket_a_row(spark):
    """Ticks a second apart, counted in microseconds."""
    df = spark.range(20_000).select(
        F.lit("a").alias("series"), F.timestamp_seconds("id").alias("tick"), F.lit(1.0).alias("close")
    )
    sizes = bucket_rows(df, 1000)
    assert len(sizes) <= 25 and sum(sizes) == 20_000 and sizes[-1] <= 2000


def test_dense_spots_are_cut_again(spark):
    keys = [i << 40 for i in range(500)] + [(7 << 40) + i for i in range(1, 3000)]
    keys += [-(1 << 62), (1 << 62) + 5]
    df = spark.createDataFrame([("a", k, 1.0) for k in keys], SCHEMA)
    sizes = bucket_rows(df, 100)
    assert sizes[-1] <= 200 and sum(sizes) == len(keys) and len(sizes) < 150
    got = longseries.with_position(df, "series", "tick", 100)
    assert [r["_position"] for r in got.orderBy("tick").collect()] == list(range(len(keys)))


def test_each_series_has_its_own_width(spark):
    near = spark.range(5000).selectExpr("'near' AS series", "id AS tick", "1.0D AS close")
    far = spark.range(5000).selectExpr("'far' AS series", "id * 1000000007 AS tick", "1.0D AS close")
    sizes = bucket_rows(near.union(far), 500)
    assert len(sizes) <= 26 and sizes[-1] <= 1000


def test_macd_is_one_pass(spark):
    df = ticks(spark, 3, {"a": 300}, 1)
    plan = indicators.macd(df, "series", "tick", "close", chunk_rows=64)._jdf.queryExecution()
    text = plan.optimizedPlan().toString()
    assert text.count("LogicalRDD") <= 2  # besides, two passes count the buckets


def test_macd_with_equal_spans(spark):
    df = ticks(spark, 3, {"a": 300}, 1)
    got = indicators.macd(df, "series", "tick", "close", 3, 5, 5, chunk_rows=64)
    want = indicators.macd(df, "series", "tick", "close", 3, 5, 5)
    assert_close(got, want, ["macd", "macd_signal", "macd_hist"])
    near = indicators.macd(df, "series", "tick", "close", 3, 5, 4)
    line = indicators.ema(df, "series", "tick", "close", (3, 5), ("f", "s"))
    line = line.withColumn("macd", F.col("f") - F.col("s"))
    twice = indicators.ema(line, "series", "tick", "macd", (4,), ("macd_signal",)).withColumn(
        "macd_hist", F.col("macd") - F.col("macd_signal")
    )
    assert_close(near, twice, ["macd", "macd_signal", "macd_hist"])


def test_tasks_follow_the_rows(spark, monkeypatch):
    """Twice the rows are twice the tasks, so a task's windows do not grow with the input."""
    monkeypatch.setattr(longseries, "TASK_ROWS", 100)
    for rows_ in (2000, 4000):
        ticks = spark.range(rows_).selectExpr("'a' AS series", "id AS tick", "1.0D AS price")
        chunked = longseries.with_chunks(ticks, "series", "tick", 0, 50)
        assert chunked.rdd.getNumPartitions() == rows_ // 100
