"""Bars from ticks, and rollups of bars to longer periods.

Both are plain aggregations with partial combine: a key holding a third of all rows reaches
the shuffle as one partial row per map task. Order keys are single fixed-width values so the
aggregate stays a ``HashAggregate`` (a struct key would fall back to sorting).
"""

from functools import reduce

from pyspark.sql import functions as F

from pricemill.constants import PERIOD_KEYS
from pricemill.functions.scalars import as_column
from pricemill.functions.windows import columns, ordered
from pricemill.operators.longseries import whole_number

# More than the 64-bit numbers there are, so no tie-breaker reaches the next order key
_TIES = "20000000000000000000BD"


def one_key(df, order_key, tie):
    """An order key (date, time or integer of 18 digits) and an integer tie-breaker as one number.

    A missing tie-breaker comes first. One decimal keeps the aggregate on hashes.
    """
    return F.expr(
        f"CAST({whole_number(df, order_key)} AS DECIMAL(18, 0)) * {_TIES}"
        f" + coalesce(CAST(`{tie}` AS DECIMAL(19, 0)), {-(2**63)}BD)"
    )


def from_ticks(ticks, series, time, price, order_key, unit="day", volume=None, tie=None):
    """One bar per series and ``unit`` (``day``, ``hour``, ``week``, ...).

    ``order_key`` is fixed width; it must be unique per series, alone or with the integer column
    ``tie``, which settles equal keys. ``volume`` is a column to sum; without it the number of
    ticks is the volume.
    """
    order = order_key if tie is None else one_key(ticks, order_key, tie)
    stamp = F.to_date(time) if unit == "day" else F.date_trunc(unit, F.col(time))
    size = F.count(F.lit(1)) if volume is None else F.sum(volume)
    return ticks.groupBy(*columns(series), stamp.alias("date")).agg(
        F.min(price).alias("low"),
        F.max(price).alias("high"),
        F.min_by(price, order).alias("open"),
        F.max_by(price, order).alias("close"),
        size.cast("double").alias("volume"),
    )


def with_period_keys(df, date):
    """First days of the week (Monday), month, quarter and year of a date."""
    return df.withColumns(
        {name: F.trunc(as_column(date), unit) for unit, name in PERIOD_KEYS.items()}
    )


def coarser_keys(unit):
    """Period keys above ``unit``, finest first."""
    names = list(PERIOD_KEYS)
    return [PERIOD_KEYS[u] for u in names[names.index(unit) + 1:]]


def rollup(df, unit, series, order, measures, suffixes=("",), extra=()):
    """Roll finer rows up to one row per series and period.

    ``low`` is the smallest, ``high`` the largest, ``open`` the value of the first row and
    every other measure the value of the last row, NULL included. ``order`` must be unique
    within a series: rolling weeks up to quarters and years orders by the week, which settles
    ties that ordering by month or quarter would leave open. Coarser keys are carried as the
    earliest one seen, so a week that straddles two months belongs to its first day's month.
    """
    key = PERIOD_KEYS[unit]
    special = {"low": "min({0})", "high": "max({0})", "open": "min_by({0}, {1})"}
    aggregates = [f"min({name}) AS {name}" for name in coarser_keys(unit)]
    for suffix in suffixes:
        for measure in measures:
            pick = special.get(measure, "max_by({0}, {1})")
            name = measure + suffix
            aggregates.append(f"{pick.format(name, order)} AS {name}")
    aggregates += [f"max({name}) AS {name}" for name in extra]
    return df.groupBy(*columns(series), key).agg(*map(F.expr, aggregates))


def first_last(df, partition, order, first=(), last=()):
    """First and last value of each group on every row (window form of the rollup)."""
    ascending = ordered(partition, order)
    descending = ordered(partition, [F.col(c).desc() for c in columns(order)])
    return df.select(
        "*",
        *[F.first(c).over(ascending).alias(f"first_{c}") for c in first],
        *[F.first(c).over(descending).alias(f"last_{c}") for c in last],
    )


def union_series(frames):
    """All pairs as one frame: ``frames`` maps a series name to its rows."""
    tagged = [df.withColumn("series", F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
