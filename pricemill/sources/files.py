"""CSV and JSON files."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricemill.constants import OHLC
from pricemill.functions.scalars import coerce_double, parse_time
from pricemill.operators.dedupe import union_keep_last
from pricemill.schemas import CSV_BAR


def scan_csv_bars(spark, path, keys=()):
    """OHLCV files whose times are dates or date-times, mixed; text columns ``keys`` come first."""
    schema = T.StructType([T.StructField(key, T.StringType()) for key in keys] + CSV_BAR.fields)
    raw = spark.read.schema(schema).csv(path, header=True)
    return raw.select(
        *keys,
        parse_time("time").alias("time"),
        *[coerce_double(name).alias(name) for name in (*OHLC, "volume")],
    )


def scan_json(spark, path, schema, multi_line=False):
    """JSON rows under a declared schema (no inference pass over the files)."""
    return spark.read.schema(schema).json(path, multiLine=multi_line)


def write_csv(df, path):
    """Times are written in the format the scan reads back."""
    df.write.mode("overwrite").csv(path, header=True, timestampFormat="yyyy-MM-dd HH:mm:ss")


def append_csv(spark, df, existing, target, keys=()):
    """Existing rows plus new ones, the new one winning on equal ``keys`` and ``time``.

    The result goes to ``target``: Spark refuses to overwrite files it is reading. Times are
    compared as parsed, so both text formats of one moment are one key.
    """
    known = scan_csv_bars(spark, existing, keys)
    write_csv(union_keep_last(known, df, [*keys, "time"]), target)
    return scan_csv_bars(spark, target, keys)


def scan_json_column(df, column, schema):
    """Rows whose JSON text sits in a column instead of a file."""
    return df.select("*", F.from_json(column, schema).alias("json")).select("*", "json.*").drop("json")
