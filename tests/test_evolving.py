"""Tables that declare their schema: columns come, widen and go, and no value is lost."""

import pytest
from pyspark.sql import functions as F

from pricemill.operators.incremental import upsert, upsert_partitions
from pricemill.sources import evolving, tables
from tests.conftest import rows

SCHEMA = "id long, month string, v long, extra long"


@pytest.fixture
def path(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = spark.createDataFrame(
        [(1, "a", 1, 6), (2, "a", 2, 7), (3, "b", 3, 8), (4, None, 4, 9)], SCHEMA
    )
    evolving.overwrite(spark, path, frame, "month")
    return path


def changes(spark, *found):
    return spark.createDataFrame(list(found), "id long, month string, v long")


def test_columns_of_the_table_stay(spark, path):
    upsert_partitions(
        spark, path, changes(spark, (1, "a", 10), (5, "a", 50), (4, None, 40)), ["id"], "month"
    )
    found = rows(evolving.read(spark, path), "id", "v", "extra")
    assert found == [(1, 10, 6), (2, 2, 7), (3, 3, 8), (4, 40, 9), (5, 50, None)]


def test_columns_of_the_updates_are_added(spark, path):
    updates = changes(spark, (1, "a", 10)).withColumn("more", F.lit("x"))
    upsert_partitions(spark, path, updates, ["id"], "month")
    found = rows(evolving.read(spark, path), "id", "extra", "more")
    assert found == [(1, 6, "x"), (2, 7, None), (3, 8, None), (4, 9, None)]


def test_a_dropped_column_is_gone_and_stays_gone(spark, path):
    upsert_partitions(spark, path, changes(spark, (1, "a", 10)), ["id"], "month", sync=True)
    assert set(evolving.read(spark, path).columns) == {"id", "month", "v"}
    again = changes(spark, (1, "a", 11)).withColumn("extra", F.lit(5).cast("long"))
    upsert_partitions(spark, path, again, ["id"], "month")
    found = rows(evolving.read(spark, path), "id", "extra")
    assert found == [(1, 5), (2, None), (3, None), (4, None)]
    upsert_partitions(spark, path, changes(spark, (3, "b", 0)), ["id"], "month", sync=True)
    once_more = changes(spark, (2, "a", 2)).withColumn("extra", F.lit(1).cast("long"))
    upsert_partitions(spark, path, once_more, ["id"], "month")
    assert rows(evolving.read(spark, path), "id", "extra") == [
        (1, None), (2, 1), (3, None), (4, None)
    ]


def test_numbers_widen_and_nothing_else(spark, tmp_path):
    path = str(tmp_path / "w")
    narrow = spark.createDataFrame([(1, "a", 1.5), (2, "b", 2.5)], "id int, month string, v float")
    evolving.overwrite(spark, path, narrow, "month")
    wide = spark.createDataFrame([(1 << 40, "a", 0.1)], "id long, month string, v double")
    upsert_partitions(spark, path, wide, ["id"], "month")
    assert rows(evolving.read(spark, path), "id", "v") == [(1, 1.5), (2, 2.5), (1 << 40, 0.1)]
    text = spark.createDataFrame([("x", "a")], "id string, month string")
    with pytest.raises(ValueError):
        upsert_partitions(spark, path, text, ["id"], "month")
    upsert_partitions(spark, path, narrow.where("id = 2"), ["id"], "month")
    assert evolving.read(spark, path).count() == 3


def test_a_table_without_rows_has_columns(spark, tmp_path):
    path = str(tmp_path / "e")
    assert not evolving.exists(spark, path) and evolving.schema_of(spark, path) is None
    frame = changes(spark, (1, "a", 1))
    evolving.create(spark, path, frame.schema)
    assert evolving.read(spark, path).dtypes == frame.dtypes
    assert evolving.read(spark, path).count() == 0
    assert upsert_partitions(spark, path, frame, ["id"], "month") == 1
    assert rows(evolving.read(spark, path), "id", "v") == [(1, 1)]
    assert upsert_partitions(spark, path, frame.limit(0), ["id"], "month") == 0
    assert evolving.read(spark, path).count() == 1


def test_a_folder_without_declaration_is_taken_as_it_is(spark, tmp_path):
    path = str(tmp_path / "old")
    changes(spark, (1, "a", 1)).write.partitionBy("month").parquet(path)
    upsert_partitions(spark, path, changes(spark, (2, "b", 2)).drop("v"), ["id"], "month")
    assert rows(evolving.read(spark, path), "id", "v") == [(1, 1), (2, None)]


def test_appended_rows_may_lack_columns(spark, tmp_path):
    path = str(tmp_path / "append")
    dated = "id long, date date, v long"
    first = spark.createDataFrame([(1, None, 1)], dated)
    tables.write_partitioned(first, path)
    assert tables.append_evolving(first.drop("v").withColumn("w", F.lit(2)), path) == 1
    assert sorted(rows(evolving.read(spark, path), "v", "w"), key=str) == [(1, None), (None, 2)]


def test_frames_keep_or_sync(spark):
    target = spark.createDataFrame([(1, "a", 1, 6), (2, "a", 2, 7)], SCHEMA)
    updates = changes(spark, (1, "a", 10))
    kept = upsert(target, updates, ["id"], sync=False)
    assert rows(kept, "id", "v", "extra") == [(1, 10, 6), (2, 2, 7)]
    assert upsert(target, updates, ["id"]).columns == ["id", "month", "v"]
