"""Streams that drain what has landed and stop (``availableNow``), then resume next time.

Progress lives in the stream's checkpoint, which must be on shared storage. State is keyed by
series and window (or by row key) and bounded by the watermark.
"""

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from pricemill.constants import LOOKBACK_DAYS
from pricemill.operators.bars import one_key
from pricemill.operators.dedupe import dedupe_latest
from pricemill.operators.incremental import upsert_partitions
from pricemill.sources import evolving
from pricemill.sources.tables import stamp_load

WATERMARK = f"{LOOKBACK_DAYS} days"


def read_files(spark, path, schema, files_per_batch=None):
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def drain(writer, checkpoint):
    """Run a stream over everything available, and wait for it."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def ingest(stream, target, checkpoint, loaded_at=None):
    """Append new rows, stamped, to a bronze table. Rows need a ``time`` column."""
    stamped = stamp_load(stream, loaded_at)
    drain(
        stamped.withColumn("month", F.trunc("date", "month"))
        .writeStream.format("parquet")
        .outputMode("append")
        .partitionBy("month")
        .option("path", target),
        checkpoint,
    )


def daily_bars(stream, series, time, price, watermark=WATERMARK, tie=None):
    """Bars over one-day tumbling windows; rows later than the watermark are for batch repair.

    The event time must be a TIMESTAMP and unique within a series, alone or with the integer
    column ``tie``. Days are UTC days, as
    tumbling windows are, whatever the session's time zone.
    """
    order = time if tie is None else one_key(stream, time, tie)
    utc_day = "date_from_unix_date(CAST(unix_seconds(day.start) div 86400 AS INT))"
    return (
        stream.withWatermark(time, watermark)
        .groupBy(F.col(series).alias("series"), F.window(time, "1 day").alias("day"))
        .agg(
            F.min(price).alias("low"),
            F.max(price).alias("high"),
            F.min_by(price, order).alias("open"),
            F.max_by(price, order).alias("close"),
            F.count(F.lit(1)).cast("double").alias("volume"),
        )
        .select(
            "series", F.expr(utc_day).alias("date"),
            "low", "high", "open", "close", "volume",
        )
    )


def distinct_rows(stream, keys, time, watermark=WATERMARK):
    """First arrival of each key; repeats within the watermark are dropped."""
    return stream.withWatermark(time, watermark).dropDuplicatesWithinWatermark(list(keys))


def upsert(stream, target, checkpoint, keys, latest=None, mode="update"):
    """Merge each micro-batch into a month-partitioned Parquet table by key.

    Each batch leaves a commit record with the name of its stream in the table. A batch that the
    checkpoint replays though it was committed is passed over; one that was not writes the same
    rows again, so the result does not depend on how often a batch runs. With ``latest`` the newest row of a key wins, wherever it is: inside the batch,
    in an earlier batch, or stored before the stream began. NULL keys and NULL dates are equal.
    """
    spark = stream.sparkSession

    def merge(batch, batch_id):
        if committed(spark, target, checkpoint, batch_id):
            return
        rows = batch.withColumn("month", F.trunc("date", "month"))
        if latest is not None:
            rows = dedupe_latest(rows, [*keys, "month"], latest)
        rows = rows.persist()
        try:
            if not evolving.exists(spark, target):
                evolving.overwrite(spark, target, rows, "month")
            else:
                updates = rows if latest is None else newest(spark, target, rows, keys, latest)
                upsert_partitions(spark, target, updates, keys, "month")
            commit(spark, target, checkpoint, batch_id)
        finally:
            rows.unpersist()

    drain(stream.writeStream.outputMode(mode).foreachBatch(merge), checkpoint)


def _commits(target):
    return f"{target.rstrip('/')}/_batches"


def committed(spark, target, name, batch_id):
    """Whether the stream's batch is in the table; only its newest record is kept in mind."""
    try:
        found = spark.read.schema("name string, batch_id long").json(_commits(target))
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    last = found.where(F.col("name") == name).agg(F.max("batch_id")).first()[0]
    return last is not None and batch_id <= last


def commit(spark, target, name, batch_id):
    """Record that all batches of the stream up to this one are in the table."""
    spark.createDataFrame([(name, batch_id)], "name string, batch_id long").coalesce(1).write.mode(
        "append"
    ).json(_commits(target))


def newest(spark, target, rows, keys, latest):
    """The rows, or the stored ones of the same keys where these are newer.

    The equality on the month prunes the read to the months of the batch; rows without a date lie
    in a partition of their own, which is read only if the batch has such rows.
    """
    stored = evolving.read(spark, target)
    near = stored.join(rows.select("month").distinct(), "month", "left_semi").select(*stored.columns)
    if not rows.where(F.col("month").isNull()).isEmpty():
        near = near.unionAll(stored.where(F.col("month").isNull()))
    names = [*keys, "month"]
    wanted = rows.select(*[F.col(k).alias(f"_key_{k}") for k in names])
    same = reduce(
        lambda a, b: a & b, [near[k].eqNullSafe(wanted[f"_key_{k}"]) for k in names]
    )
    both = near.join(wanted, same, "left_semi").unionByName(rows, allowMissingColumns=True)
    return dedupe_latest(both, names, latest)
