"""Streams drained over the event table; results are read back from what they wrote."""

from pyspark.sql import functions as F

from pricemill.operators import bars as bar_ops
from pricemill.registry import inputs
from pricemill.registry.entries import query
from pricemill.session import scratch_path
from pricemill.sources import evolving
from pricemill.streaming import late, loads


def _events(spark, sf):
    schema = inputs.table(spark, sf, "events").schema
    # A glob, so that the source takes a single file as well as a folder of files.
    stream = loads.read_files(spark, f"{sf}/{{events}}.parquet", schema)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "stream_ingest_bars",
    "SELECT event_id, ts AS time, event_type, value, CAST(ts AS DATE) AS date,"
    f" TIMESTAMP '{inputs.PROCESSED_AT}' AS ingest_date_time FROM events",
)
def stream_ingest_bars(spark, sf):
    target = scratch_path(spark, "stream-bronze")
    rows = _events(spark, sf).select(
        "event_id", F.col("ts").alias("time"), "event_type", "value"
    )
    loads.ingest(rows, target, scratch_path(spark, "checkpoint"), inputs.PROCESSED_AT)
    return inputs.plain(spark.read.parquet(target).drop("month"))


@query("stream_daily_bars", "SELECT * FROM x_event_bars")
def stream_daily_bars(spark, sf):
    target = scratch_path(spark, "stream-bars")
    utc = F.expr("CAST(concat(CAST(CAST(ts AS TIMESTAMP_NTZ) AS STRING), 'Z') AS TIMESTAMP)")
    events = _events(spark, sf).withColumn("ts", utc)
    bars = loads.daily_bars(events, "event_type", "ts", "value", tie="event_id")
    loads.upsert(bars, target, scratch_path(spark, "checkpoint"), ["series", "date"])
    return evolving.read(spark, target).drop("month")


@query("stream_dedupe", "SELECT event_id, ts, event_type, value FROM events")
def stream_dedupe(spark, sf):
    """Every event arrives twice and is kept once."""
    target = scratch_path(spark, "stream-distinct")
    rows = _events(spark, sf).select("event_id", "ts", "event_type", "value")
    twice = rows.union(rows)
    kept = loads.distinct_rows(twice, ["event_id"], "ts").withColumnRenamed("ts", "time")
    loads.ingest(kept, target, scratch_path(spark, "checkpoint"), inputs.PROCESSED_AT)
    stored = spark.read.parquet(target).withColumnRenamed("time", "ts")
    return inputs.plain(stored.select("event_id", "ts", "event_type", "value"))


@query(
    "stream_upsert",
    "SELECT event_type AS series, CAST(ts AS DATE) AS date, max(event_id) AS event_id,"
    " arg_max(value, event_id) AS value FROM events GROUP BY 1, 2",
)
def stream_upsert(spark, sf):
    """Newest event of each kind and day, kept in a stored table."""
    target = scratch_path(spark, "stream-upsert")
    rows = _events(spark, sf).select(
        F.col("event_type").alias("series"), F.to_date("ts").alias("date"), "event_id", "value"
    )
    loads.upsert(
        rows, target, scratch_path(spark, "checkpoint"), ["series", "date"], "event_id", "append"
    )
    return evolving.read(spark, target).drop("month")


def _landing(spark, sf, deliveries):
    """The event table, landed in several deliveries one after the other; times are UTC."""
    folder = scratch_path(spark, "landing")
    utc = F.expr("CAST(concat(CAST(CAST(ts AS TIMESTAMP_NTZ) AS STRING), 'Z') AS TIMESTAMP)")
    events = inputs.table(spark, sf, "events").select(
        "event_id", utc.alias("ts"), "event_type", "value"
    )
    for condition in deliveries:
        events.where(condition).write.mode("append").parquet(folder)
    return folder, events.schema


@query("stream_late_repair", "SELECT * FROM x_event_bars")
def stream_late_repair(spark, sf):
    """Every twentieth event lands last, up to a month late, and its days are rebuilt."""
    folder, schema = _landing(
        spark, sf, ["event_id % 20 <> 0 AND day(ts) <= 15", "event_id % 20 <> 0 AND day(ts) > 15",
                    "event_id % 20 = 0"]
    )
    target, root = scratch_path(spark, "stream-bars"), scratch_path(spark, "late")

    def landed():
        return loads.read_files(spark, folder, schema, files_per_batch=8)

    loads.upsert(
        loads.daily_bars(landed(), "event_type", "ts", "value", tie="event_id"), target,
        scratch_path(spark, "checkpoint"), ["series", "date"],
    )
    late.split_late(landed(), "event_type", "ts", root, scratch_path(spark, "checkpoint"))

    def build(rows):
        utc_rows = rows.withColumn("date", late.utc_day("ts"))
        return bar_ops.from_ticks(
            utc_rows, "event_type", "date", "value", "ts", tie="event_id"
        ).withColumnRenamed("event_type", "series")

    stored = spark.read.schema(schema).parquet(folder)
    late.repair(spark, root, stored, build, target, "event_type", "ts")
    return evolving.read(spark, target).drop("month")


@query(
    "stream_keep_latest",
    "SELECT series, date, event_id, value FROM (SELECT event_type AS series,"
    " CASE WHEN event_id % 97 <> 0 THEN CAST(ts AS DATE) END AS date, event_id, value,"
    " row_number() OVER (PARTITION BY event_type, CASE WHEN event_id % 97 <> 0 THEN"
    " CAST(ts AS DATE) END ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1",
)
def stream_keep_latest(spark, sf):
    """The newest row of each key over three deliveries, newest first, and a full replay."""
    folder, schema = _landing(
        spark, sf, ["event_id % 3 = 2", "event_id % 3 = 1", "event_id % 3 = 0"]
    )
    target = scratch_path(spark, "stream-latest")
    for _ in range(2):  # the second time with a new checkpoint: everything arrives again
        rows = loads.read_files(spark, folder, schema, files_per_batch=8).select(
            F.col("event_type").alias("series"),
            F.when(F.col("event_id") % 97 != 0, late.utc_day("ts")).alias("date"),
            "event_id", "value",
        )
        loads.upsert(
            rows, target, scratch_path(spark, "checkpoint"), ["series", "date"], "event_id", "append"
        )
    return evolving.read(spark, target).drop("month")
