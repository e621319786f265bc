"""Payload parsing: landed response text to typed rows, one job over all series.

Numbers are read as text and cast with ``try_cast``: quoted numbers are accepted and anything
else becomes NULL. A payload that is not of the expected shape contributes no rows.
"""

from pyspark.sql import functions as F

from pricemill.constants import INDICATOR_COLUMNS, OHLC
from pricemill.functions.scalars import coerce_double, epoch_to_timestamp, parse_time
from pricemill.functions.windows import columns

# Positions in a candle array.
CANDLE_FIELDS = ("time", "low", "high", "open", "close", "volume")


def parse_candles(df, payload, keep=("series",)):
    """``[[time, low, high, open, close, volume], ...]`` to bars."""
    candles = df.select(
        *columns(keep), F.explode(F.from_json(payload, "array<array<string>>")).alias("c")
    )
    return candles.select(
        *columns(keep),
        epoch_to_timestamp(F.get("c", F.lit(0))).alias("time"),
        *[
            coerce_double(F.get("c", F.lit(CANDLE_FIELDS.index(name)))).alias(name)
            for name in (*OHLC, "volume")
        ],
    )


def parse_fx_rates(df, payload, quote, keep=()):
    """``{"rates": {date: {quote: rate}}}`` to rates; days without the quote are left out."""
    shape = "rates map<string,map<string,string>>"
    days = df.select(
        *columns(keep), F.explode(F.from_json(payload, shape)["rates"]).alias("day", "quotes")
    )
    return (
        days.select(
            *columns(keep),
            parse_time("day").alias("time"),
            F.col("quotes")[quote.upper()].alias("rate"),
        )
        .filter(F.col("rate").isNotNull())
        .withColumn("rate", coerce_double("rate"))
    )


def parse_all_rates(df, payload, keep=()):
    """The rates of every quote in the payload, one row a day and quote."""
    shape = "rates map<string,map<string,string>>"
    days = df.select(
        *columns(keep), F.explode(F.from_json(payload, shape)["rates"]).alias("day", "quotes")
    )
    return days.select(
        *columns(keep), parse_time("day").alias("time"), F.explode("quotes").alias("quote", "rate")
    ).withColumn("rate", coerce_double("rate"))


def is_candles(payload):
    return F.from_json(payload, "array<array<string>>").isNotNull()


def is_rates(payload):
    return F.from_json(payload, "rates map<string,map<string,string>>")["rates"].isNotNull()


def is_indicators(payload):
    return F.from_json(payload, "array<struct<d:string>>").isNotNull()


def parse_indicators(df, payload, keep=()):
    """``[{"d": ..., "unixTs": ..., "rsi": ..., ...}, ...]`` to indicator rows with a time."""
    numbers = ("rsi", *INDICATOR_COLUMNS)
    shape = "array<struct<" + ",".join(f"{n}:string" for n in ("d", "unixTs", *numbers)) + ">>"
    items = df.select(*columns(keep), F.inline(F.from_json(payload, shape)))
    return items.select(
        *columns(keep),
        "d",
        "unixTs",
        *[coerce_double(n).alias(n) for n in numbers],
        F.coalesce(parse_time("d"), epoch_to_timestamp("unixTs")).alias("time"),
    )


def empty(spark, schema):
    """No rows, full schema: what a source without data returns."""
    return spark.createDataFrame([], schema)
