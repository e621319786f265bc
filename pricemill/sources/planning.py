"""What to fetch: request windows per series and the feed each pair comes from."""

from pyspark.sql import functions as F

from pricemill.constants import (
    CANDLE_HISTORY_DAYS,
    CANDLE_WINDOW_DAYS,
    CONFIGURED_PAIRS,
    FX_HISTORY_START,
    FX_WINDOW_DAYS,
)
from pricemill.functions.scalars import feed_kind, series_table_name


def plan_windows(df, start, end, step_days=CANDLE_WINDOW_DAYS, gap_days=0):
    """Split [start, end) of each row into windows of ``step_days``.

    The next window starts ``gap_days`` after the previous end. Empty windows and starts in
    the future give nothing.
    """
    every = F.make_interval(days=F.lit(step_days + gap_days))
    starts = F.when(
        F.col(start) < F.col(end), F.sequence(F.col(start), F.col(end), every)
    )
    return (
        df.withColumn("window_start", F.explode(starts))
        .filter(F.col("window_start") < F.col(end))
        .withColumn(
            "window_end", F.least(F.date_add("window_start", step_days), F.col(end))
        )
    )


def plan_fx_windows(df, start, end):
    """Inclusive windows: the next one starts the day after."""
    return plan_windows(df, start, end, FX_WINDOW_DAYS, 1)


def configured_pairs(spark, pairs=CONFIGURED_PAIRS):
    """The configured (base, quote) pairs with their feed and table name."""
    pairs = spark.createDataFrame(list(pairs), "base string, quote string")
    return pairs.withColumn("feed", feed_kind("base", "quote")).withColumn(
        "table_name", series_table_name("base", "quote")
    )


def plan_requests(pairs, loaded, as_of):
    """Windows to request for each pair up to ``as_of``.

    ``loaded`` has a ``table_name`` and the latest ``date`` loaded into it. A pair starts
    there, or with its feed's full history when nothing is loaded.
    """
    today = F.lit(as_of).cast("date")
    history = F.when(F.col("feed") == "fx", F.lit(FX_HISTORY_START).cast("date")).otherwise(
        F.date_sub(today, CANDLE_HISTORY_DAYS)
    )
    latest = loaded.groupBy("table_name").agg(F.max("date").alias("_latest"))
    starts = (
        pairs.join(latest, "table_name", "left")
        .withColumn("start", F.coalesce("_latest", history))
        .withColumn("end", today)
        .drop("_latest")
    )
    candles = plan_windows(starts.filter("feed = 'candles'"), "start", "end")
    return candles.unionByName(plan_fx_windows(starts.filter("feed = 'fx'"), "start", "end"))
