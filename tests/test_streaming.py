"""Streams over several landings: resumed runs, late rows, replays."""

import datetime

import pytest
from pyspark.sql import functions as F

from pricemill.operators import bars
from pricemill.session import scratch_path
from pricemill.streaming import loads
from tests.conftest import rows

T = datetime.datetime
SCHEMA = "series string, ts timestamp, price double, event_id long"


def landed(spark, first, count, hours=5):
    data = [
        ("ab"[i % 2], T(2024, 1, 1) + datetime.timedelta(hours=hours * i, seconds=i), float((i * 7) % 13), i)
        for i in range(first, first + count)
    ]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture()
def folder(spark):
    return scratch_path(spark, "landing")


def stream(spark, folder, per_batch=None):
    return loads.read_files(spark, folder, SCHEMA, per_batch)


def test_ingest_resumes_where_it_stopped(spark, folder):
    target, checkpoint = scratch_path(spark, "t"), scratch_path(spark, "c")
    for first in (0, 10):
        landed(spark, first, 10).write.mode("append").parquet(folder)
        loads.ingest(stream(spark, folder).withColumnRenamed("ts", "time"), target, checkpoint)
    got = spark.read.parquet(target)
    assert got.count() == 20 and got.select("event_id").distinct().count() == 20


def test_bars_over_batches_equal_one_batch(spark, folder):
    target, checkpoint = scratch_path(spark, "t"), scratch_path(spark, "c")
    for first in (0, 15, 30):
        landed(spark, first, 15).coalesce(1).write.mode("append").parquet(folder)
        daily = loads.daily_bars(stream(spark, folder, 1), "series", "ts", "price")
        loads.upsert(daily, target, checkpoint, ["series", "date"])
    want = bars.from_ticks(landed(spark, 0, 45), "series", "ts", "price", "ts")
    names = ("series", "date", "low", "high", "open", "close", "volume")
    assert rows(spark.read.parquet(target), *names) == rows(want, *names)


def test_upsert_keeps_the_newest_across_batches(spark, folder):
    target, checkpoint = scratch_path(spark, "t"), scratch_path(spark, "c")
    for first in (20, 0):
        landed(spark, first, 20, hours=1).coalesce(1).write.mode("append").parquet(folder)
        days = stream(spark, folder).select("series", F.to_date("ts").alias("date"), "event_id", "price")
        loads.upsert(days, target, checkpoint, ["series", "date"], "event_id", "append")
    every = landed(spark, 0, 40, hours=1).withColumn("date", F.to_date("ts"))
    want = every.groupBy("series", "date").agg(
        F.max("event_id").alias("event_id"), F.max_by("price", "event_id").alias("price")
    )
    names = ("series", "date", "event_id", "price")
    assert rows(spark.read.parquet(target), *names) == rows(want, *names)


def test_repeats_are_dropped(spark, folder):
    target, checkpoint = scratch_path(spark, "t"), scratch_path(spark, "c")
    landed(spark, 0, 10).write.parquet(folder)
    landed(spark, 5, 10).write.mode("append").parquet(folder)
    kept = loads.distinct_rows(stream(spark, folder), ["event_id"], "ts")
    loads.ingest(kept.withColumnRenamed("ts", "time"), target, checkpoint)
    assert spark.read.parquet(target).count() == 15


def build_bars(frame):
    return bars.from_ticks(frame, "series", "ts", "price", "ts")


def test_rows_a_month_late_are_kept_and_repaired(spark, folder):
    target, root = scratch_path(spark, "t"), scratch_path(spark, "late")
    windows, split = scratch_path(spark, "c"), scratch_path(spark, "c")
    from pricemill.sources import evolving
    from pricemill.streaming import late

    def land(frame):
        frame.coalesce(1).write.mode("append").parquet(folder)
        loads.upsert(
            loads.daily_bars(stream(spark, folder, 1), "series", "ts", "price"), target, windows,
            ["series", "date"],
        )
        late.split_late(stream(spark, folder, 1), "series", "ts", root, split)

    def found():
        return rows(evolving.read(spark, target), "series", "date", "low", "high", "open", "close")

    def wanted():
        return rows(build_bars(spark.read.schema(SCHEMA).parquet(folder)),
                    "series", "date", "low", "high", "open", "close")

    land(landed(spark, 0, 100))
    land(landed(spark, 300, 20))
    assert late.repair(
        spark, root, spark.read.schema(SCHEMA).parquet(folder), build_bars, target, "series", "ts"
    ) >= 0
    assert found() == wanted()
    land(landed(spark, 100, 100))  # thirty days late
    assert found() != wanted()
    stored = spark.read.schema(SCHEMA).parquet(folder)
    assert late.repair(spark, root, stored, build_bars, target, "series", "ts") > 0
    assert found() == wanted()
    assert late.repair(spark, root, stored, build_bars, target, "series", "ts") == 0


def test_a_committed_batch_is_passed_over(spark, folder):
    target = scratch_path(spark, "t")
    frame = landed(spark, 0, 4).withColumn("date", F.to_date("ts"))
    from pricemill.sources import evolving

    evolving.overwrite(spark, target, frame.withColumn("month", F.trunc("date", "month")), "month")
    assert not loads.committed(spark, target, "s", 0)
    loads.commit(spark, target, "s", 3)
    loads.commit(spark, target, "other", 9)
    assert loads.committed(spark, target, "s", 3) and loads.committed(spark, target, "s", 0)
    assert not loads.committed(spark, target, "s", 4)
    assert evolving.read(spark, target).count() == 4


def test_stored_rows_without_a_date_are_compared(spark):
    from pricemill.sources import evolving

    target = scratch_path(spark, "t")
    schema = "series string, date date, n long, month date"
    evolving.overwrite(spark, target, spark.createDataFrame([("a", None, 5, None)], schema), "month")
    arriving = spark.createDataFrame([("a", None, 3, None), ("b", None, 1, None)], schema)
    got = loads.newest(spark, target, arriving, ["series", "date"], "n")
    assert rows(got, "series", "n") == [("a", 5), ("b", 1)]
