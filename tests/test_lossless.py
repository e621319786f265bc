"""Upserts and first loads that must not lose or repeat rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from pricemill.functions.scalars import coerce_double
from pricemill.operators.incremental import upsert, upsert_partitions
from pricemill.plans.refresh import read_table, store
from tests.conftest import rows

SCHEMA = "id long, month string, v long"


def test_null_partition_keeps_its_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, None, 1), (2, None, 2), (3, "a", 3)], SCHEMA).write.partitionBy(
        "month"
    ).parquet(path)
    updates = spark.createDataFrame([(4, None, 4), (2, None, 20)], SCHEMA)
    upsert_partitions(spark, path, updates, ["id"], "month")
    found = rows(spark.read.parquet(path), "id", "v")
    assert found == [(1, 1), (2, 20), (3, 3), (4, 4)]


def test_repeated_update_keys_are_refused(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a", 1)], SCHEMA).write.partitionBy("month").parquet(path)
    updates = spark.createDataFrame([(2, "a", 1), (2, "a", 2)], SCHEMA)
    with pytest.raises(ValueError):
        upsert_partitions(spark, path, updates, ["id"], "month")
    assert rows(spark.read.parquet(path), "id") == [(1,)]


def test_null_keys_are_equal_in_upserts(spark):
    target = spark.createDataFrame([(None, "a", 1), (1, "a", 2)], SCHEMA)
    updates = spark.createDataFrame([(None, "a", 9)], SCHEMA)
    assert rows(upsert(target, updates, ["id"]), "id", "v") == [(None, 9), (1, 2)]


def test_empty_first_load_is_followed_by_a_full_one(spark, tmp_path):
    root = str(tmp_path)
    day = datetime.date(2024, 5, 3)
    frame = spark.createDataFrame([(1, day, 7)], "id long, date date, v long")
    assert store(spark, root, "t", frame.limit(0), ["id"], "date", "month").count() == 0
    assert read_table(spark, root, "t") is None
    assert rows(store(spark, root, "t", frame, ["id"], "date", "month"), "id", "v") == [(1, 7)]


def test_only_plain_numbers_are_numbers(spark):
    texts = ["1", " -2.5 ", "1e3", ".5", "5.", "1d", "2f", "NaN", "Infinity", "", " ", "x", None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r[0] for r in frame.select(coerce_double(F.col("t"))).collect()]
    assert found == [1.0, -2.5, 1000.0, 0.5, 5.0] + [None] * 8
