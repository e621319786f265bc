"""Declared schemas of every layer."""

from pyspark.sql import types as T

from pricemill.constants import CONVERTED_CURRENCIES, INDICATOR_COLUMNS, MEASURES, OHLC


def _doubles(names):
    return [T.StructField(name, T.DoubleType()) for name in names]


_LOAD_STAMP = [
    T.StructField("date", T.DateType()),
    T.StructField("ingest_date_time", T.TimestampType()),
]
_BATCH_STAMP = [
    T.StructField("ingest_date_time", T.TimestampType()),
    T.StructField("dbt_batch_id", T.StringType()),
]

BAR = T.StructType([T.StructField("time", T.TimestampType()), *_doubles((*OHLC, "volume"))])
RATE = T.StructType([T.StructField("time", T.TimestampType()), *_doubles(("rate",))])
INDICATOR_PAYLOAD = T.StructType(
    [
        T.StructField("d", T.StringType()),
        T.StructField("unixTs", T.StringType()),
        *_doubles(("rsi", *INDICATOR_COLUMNS)),
    ]
)
INDICATOR = T.StructType([*INDICATOR_PAYLOAD.fields, T.StructField("time", T.TimestampType())])

BRONZE_BAR = T.StructType([*BAR.fields, *_LOAD_STAMP])
BRONZE_RATE = T.StructType([*RATE.fields, *_LOAD_STAMP])
BRONZE_INDICATOR = T.StructType([*INDICATOR.fields, *_LOAD_STAMP])

# Every field read as text: a malformed number becomes NULL instead of failing the file.
CSV_BAR = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("time", *OHLC, "volume")]
)

# Wide daily fact without indicators, as kept for a pair that is not loaded yet.
EMPTY_DAILY_FACT = T.StructType(
    [
        T.StructField("date_prices", T.DateType()),
        *_doubles(f"{m}_usd" for m in OHLC),
        *_doubles(("volume", "rsi")),
        T.StructField("rsi_status", T.StringType()),
        *_doubles(f"rate_usd_{c}" for c in CONVERTED_CURRENCIES),
        *_doubles(f"{m}_{c}" for c in CONVERTED_CURRENCIES for m in OHLC),
        *_BATCH_STAMP,
    ]
)

DAILY_FACT = T.StructType(
    [
        T.StructField("date_prices", T.DateType()),
        *_doubles(f"{m}_usd" for m in MEASURES),
        *_doubles(("volume", "rsi")),
        T.StructField("rsi_status", T.StringType()),
        *_doubles(f"rate_usd_{c}" for c in CONVERTED_CURRENCIES),
        *_doubles(f"{m}_{c}" for c in CONVERTED_CURRENCIES for m in MEASURES),
        *_BATCH_STAMP,
    ]
)

# Payload contracts used by the drift check.
CANDLE_CONTRACT = T.ArrayType(T.ArrayType(T.DoubleType()))
FX_CONTRACT = T.StructType(
    [
        T.StructField("amount", T.DoubleType()),
        T.StructField("base", T.StringType()),
        T.StructField("start_date", T.StringType()),
        T.StructField("end_date", T.StringType()),
        T.StructField(
            "rates",
            T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType())),
        ),
    ]
)
INDICATOR_CONTRACT = T.ArrayType(INDICATOR_PAYLOAD)
