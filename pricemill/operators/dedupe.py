"""Keep-latest, keep-first and duplicate detection.

A key may hold a third of all rows. Keep-latest over fixed-width columns is an aggregation
(one partial row per key and map task); otherwise it is a rank filter, which Spark turns into
a group limit before the shuffle. Neither moves a hot key's rows into one task.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricemill.functions.windows import columns
from pricemill.operators.joins import join_groups

_FIXED_WIDTH = (
    T.DoubleType, T.FloatType, T.LongType, T.IntegerType, T.ShortType, T.ByteType,
    T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType,
)


def dedupe_latest(df, keys, latest, tie_breakers=()):
    """One row per key: the one with the largest ``latest``.

    Rows whose ``latest`` is NULL lose to all others. Equal ``latest`` values are settled by
    ``tie_breakers`` (largest first); without them one of the rows is kept.
    """
    keys = columns(keys)
    values = [f for f in df.schema.fields if f.name not in keys]
    if not tie_breakers and all(isinstance(f.dataType, _FIXED_WIDTH) for f in values):
        # max_by leaves out rows without an order key; where a key has no others, one of them stays
        picks = [
            F.expr(
                f"if(max(`{latest}`) IS NULL, first(`{f.name}`), max_by(`{f.name}`, `{latest}`))"
                f" AS `{f.name}`"
            )
            for f in values
        ]
        return df.groupBy(*keys).agg(*picks).select(*df.columns)
    order = [F.col(c).desc_nulls_last() for c in (latest, *tie_breakers)]
    return keep_top(df, keys, order, 1)


def keep_top(df, keys, order, rows):
    """The first ``rows`` rows of each key in the given order."""
    window = Window.partitionBy(*columns(keys)).orderBy(*order)
    return (
        df.withColumn("_rank", F.row_number().over(window))
        .filter(F.col("_rank") <= rows)
        .drop("_rank")
    )


def keep_first(df, keys, order):
    return keep_top(df, keys, [F.col(c).asc() for c in columns(order)], 1)


def find_duplicates(df, keys):
    """Every row whose key occurs more than once, with the number of occurrences.

    Counting first and joining back keeps a hot key splittable (adaptive skew join); a window
    over the key would buffer all its rows in one task.
    """
    keys = columns(keys)
    repeated = (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences")).filter("occurrences > 1")
    )
    return join_groups(df, repeated, keys)


def union_keep_last(older, newer, keys):
    """Append ``newer`` to ``older``; the later occurrence of a key wins."""
    both = older.withColumn("_load", F.lit(0)).unionByName(
        newer.withColumn("_load", F.lit(1)), allowMissingColumns=True
    )
    return dedupe_latest(both, keys, "_load").drop("_load")
