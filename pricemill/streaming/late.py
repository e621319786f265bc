"""Rows that come after their window is closed: kept apart, and their days rebuilt.

A windowed stream drops a row whose day ended before the watermark. ``split_late`` runs over the
same landing and keeps such rows in a table of their own, one partition a micro-batch, with the
progress it judged them by. ``repair`` then rebuilds the touched days from the stored rows and
upserts them, and records which batches it has seen, so each is repaired once.

A row is late if its day ended before the newest event time up to and including its batch, less
the delay. Files are read in the order they landed, so a windowed stream over the same landing,
however it cuts its batches, has seen no newer time when it meets the row: what it drops is in the
late table. A replayed batch overwrites its own partition.
"""

from pyspark.sql import functions as F

from pricemill.functions.windows import columns
from pricemill.operators.incremental import upsert_partitions
from pricemill.sources import evolving
from pricemill.streaming.loads import WATERMARK, drain

_LATE, _PROGRESS, _REPAIRED = "late", "progress", "repaired"


def _replace_batch(frame, path, batch_id):
    """Write one batch's partition, in place of what an earlier try left there."""
    (
        frame.withColumn("batch_id", F.lit(batch_id).cast("long"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id").parquet(path)
    )
    evolving.declare(
        frame.sparkSession, path,
        evolving.plain(frame.withColumn("batch_id", F.lit(batch_id).cast("long")).schema),
    )


def _read(spark, root, name):
    path = f"{root}/{name}"
    return evolving.read(spark, path) if evolving.exists(spark, path) else None


def utc_day(time):
    """The UTC day of a timestamp, as tumbling windows have it, in any session time zone."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(time) / 86400).cast("int"))


def split_late(stream, series, time, root, checkpoint, delay=WATERMARK):
    """Keep the late rows of a stream below ``root``, with the newest time of every batch."""
    spark = stream.sparkSession

    def split(batch, batch_id):
        rows = batch.persist()
        try:
            seen = [rows.agg(F.max(time)).first()[0]]
            known = _read(spark, root, _PROGRESS)
            if known is not None:
                earlier = known.where(F.col("batch_id") < batch_id)
                seen.append(earlier.agg(F.max("newest")).first()[0])
            newest = max((t for t in seen if t is not None), default=None)
            progress = spark.createDataFrame([(newest,)], "newest timestamp")
            _replace_batch(progress, f"{root}/{_PROGRESS}", batch_id)
            mark = F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {delay}")
            closes = F.timestamp_seconds((F.floor(F.unix_seconds(time) / 86400) + 1) * 86400)
            late = rows.where(closes <= mark)
            _replace_batch(late, f"{root}/{_LATE}", batch_id)
        finally:
            rows.unpersist()

    drain(stream.writeStream.foreachBatch(split), checkpoint)


def late_days(spark, root, series, time):
    """(batch_id, series, date) of the days that late rows touched and no repair has seen."""
    late = _read(spark, root, _LATE)
    if late is None:
        return None
    days = late.select("batch_id", *columns(series), utc_day(time).alias("date")).distinct()
    done = _read(spark, root, _REPAIRED)
    return days if done is None else days.join(done, "batch_id", "left_anti")


def repair(spark, root, stored, build, target, series, time, out_series="series"):
    """Rebuild the touched days and upsert them into the month-partitioned ``target``.

    ``stored`` holds all rows that arrived, late ones included; ``build`` makes bars (``date`` and
    ``out_series`` are their key) of rows. Returns the number of bars written.
    """
    days = late_days(spark, root, series, time)
    if days is None:
        return 0
    batches = days.select("batch_id").distinct()
    done = f"{root}/{_REPAIRED}"
    seen = [row[0] for row in batches.collect()]  # micro-batches since the last repair
    if not seen:
        return 0
    touched = days.where(F.col("batch_id").isin(seen)).select(*columns(series), "date").distinct()
    dated = stored.withColumn("_day", utc_day(time))
    renamed = touched.withColumnRenamed("date", "_day")
    bars = build(dated.join(renamed, [*columns(series), "_day"], "left_semi").drop("_day"))
    rows = upsert_partitions(
        spark, target, bars.withColumn("month", F.trunc("date", "month")), [out_series, "date"], "month"
    )
    marks = spark.createDataFrame([(b,) for b in seen], "batch_id long")
    marks.write.mode("append").parquet(done)
    evolving.declare(spark, done, evolving.plain(marks.schema))
    return rows
