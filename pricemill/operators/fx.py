"""Exchange rates: merging, filling, as-of lookup and conversion.

A rate table has one row per calendar day. Spark checks its size before it broadcasts one.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from pricemill.constants import CONVERTED_CURRENCIES, CURRENCIES, MEASURES
from pricemill.functions.scalars import converted
from pricemill.functions.windows import forward_filled, ordered


def full_outer_rates(chf, eur, date="date", ingest="ingest_date_time"):
    """Both rate series by date. The load time is the older one of the two."""
    left = chf.select(date, F.col("rate").alias("rate_usd_chf"), F.col(ingest).alias("_chf_load"))
    right = eur.select(date, F.col("rate").alias("rate_usd_eur"), F.col(ingest).alias("_eur_load"))
    return left.join(right, date, "full").select(
        F.col(date).alias("date_rates"),
        "rate_usd_chf",
        "rate_usd_eur",
        F.least("_chf_load", "_eur_load").alias(ingest),
    )


def on_spine(rates, days, date="date_rates"):
    """Every calendar day, with the rates known for it."""
    return days.select(F.col("date").alias(date)).distinct().join(rates, date, "left")


def spine_fill(rates, days, values, date="date_rates"):
    """Every calendar day with each column filled forward on its own.

    The columns become rows, each with its name as the key and valid from its day to the next day
    that has a value. Validity is cut at the months: inside a month a window by (name, month)
    fills, and what a month begins with is the last value of an earlier month, a running value by
    name over one row a month. No window goes without a key, and only the second has a whole
    column's months, 120 000 at most, in one task.
    """
    spine = on_spine(rates, days, date)
    nulls = ["NULL"] * len(values)
    rows = ", ".join(
        f"'{v}', " + ", ".join(f"`{v}`" if v == w else n for w, n in zip(values, nulls))
        for v in values
    )
    names = ", ".join(f"`{v}`" for v in values)
    month = F.trunc(date, "month").alias("_month")
    held = spine.selectExpr(f"`{date}`", f"stack({len(values)}, {rows}) AS (_name, {names})").select(
        "*", month
    )
    last = held.groupBy("_name", "_month").agg(
        *[F.max_by(v, F.when(F.col(v).isNotNull(), F.col(date))).alias(f"_last_{v}") for v in values]
    )
    earlier = ordered("_name", "_month").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(
        "_name", "_month",
        *[forward_filled(f"_last_{v}", earlier).alias(f"_carried_{v}") for v in values],
    )
    inside = ordered(["_name", "_month"], date)
    filled = held.select(
        date, "_name", "_month", *[forward_filled(v, inside).alias(v) for v in values]
    ).join(carried, ["_name", "_month"])
    return filled.groupBy(date).agg(
        *[F.max(F.coalesce(v, f"_carried_{v}")).alias(v) for v in values]
    )


def asof_rates(df, rates, days, date, values=("rate_usd_chf", "rate_usd_eur")):
    """The rate valid on a row's day: that of the last day on or before it that has one.

    Rates change by day, so filling the calendar and joining on equality answers the as-of
    question without sorting or shuffling ``df``.
    """
    filled = spine_fill(rates, days, values).withColumnRenamed("date_rates", "_rate_date")
    return df.join(filled, F.col(date) == F.col("_rate_date"), "left").drop(
        "_rate_date"
    )


def join_rates(bars, rates, date):
    """Add the rates of the day by a left join; Spark broadcasts them while they are small."""
    daily = rates.select(F.col("date_rates").alias(date), "rate_usd_chf", "rate_usd_eur")
    return bars.join(daily, date, "left")


def latest_rates(rates):
    """The newest row of the rate table."""
    return rates.orderBy(F.col("date_rates").desc()).limit(1).select("rate_usd_chf", "rate_usd_eur")


def expand_currencies(df, measures=MEASURES, currencies=CONVERTED_CURRENCIES):
    """``<measure>_usd`` as it is, and ``<measure>_<currency>`` at the rate of the day."""
    return df.selectExpr(
        *[c for c in df.columns if c not in measures],
        *currency_columns(measures, currencies),
    )


def currency_columns(measures=MEASURES, currencies=CONVERTED_CURRENCIES):
    """SQL text of the wide columns, the base currency first."""
    wide = [f"{m} AS {m}_usd" for m in measures]
    for c in currencies:
        wide += [f"{converted(m, f'rate_usd_{c}')} AS {m}_{c}" for m in measures]
    return wide


def unpivot_currencies(df, ids, measures=MEASURES, currencies=CURRENCIES):
    """Wide measure-by-currency columns to one row per currency."""
    names = ", ".join(("currency", *measures))
    rows = ", ".join(
        f"'{c}', " + ", ".join(f"{m}_{c}" for m in measures) for c in currencies
    )
    return df.selectExpr(*ids, f"stack({len(currencies)}, {rows}) AS ({names})")


def convert_daily(bars, rates, date, measures, currencies=CONVERTED_CURRENCIES):
    return expand_currencies(join_rates(bars, rates, date), measures, currencies)


def convert_latest(df, rates, measures, currency, optional=()):
    """Convert at the newest rate, not rounded; USD passes through.

    ``optional`` measures become NULL when zero, as serving leaves them out.
    """
    currency = currency.upper()
    if currency not in (c.upper() for c in CURRENCIES):
        raise ValueError(f"unknown currency {currency}")
    if currency == "USD":
        return df
    rate = latest_rates(rates).select(f"rate_usd_{currency.lower()}").scalar()
    changed = {m: F.expr(f"{m} * _rate") for m in measures}
    changed |= {m: F.expr(f"nullif({m}, 0D) * _rate") for m in optional}
    return df.withColumn("_rate", rate).withColumns(changed).drop("_rate")
