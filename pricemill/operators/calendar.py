"""Calendar dimension, period presets and range handling."""

from pyspark.sql import functions as F

from pricemill.constants import CALENDAR_START, DAYS_PER_FILTER, DEFAULT_FILTER_DAYS
from pricemill.functions.scalars import as_column, parse_time
from pricemill.operators.bars import with_period_keys


def calendar(spark, start, end):
    """One row per day of a literal range, with the first day of its week/month/quarter/year.

    Its size is fixed by the two literals, which is what makes it safe to broadcast.
    """
    days = spark.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date")
    )
    return with_period_keys(days, "date")


def calendar_between(df, date):
    """The calendar from the first to the last date of a frame: one row per day between."""
    bounds = df.agg(F.min(date).alias("lo"), F.max(date).alias("hi"))
    days = bounds.select(F.explode(F.sequence("lo", "hi")).alias("date"))
    return with_period_keys(days, "date")


def bounded(days, as_of=None, start=CALENDAR_START, date="date"):
    """The days from ``start`` to ``as_of`` (default: today), both included."""
    last = F.current_date() if as_of is None else F.lit(as_of).cast("date")
    return days.where((as_column(date) >= F.lit(start).cast("date")) & (as_column(date) <= last))


def join_calendar(df, days, date):
    """Add period keys by a left join with the calendar ; Spark broadcasts it while it is small."""
    return df.join(days.withColumnRenamed("date", date), date, "left")


# Preset name -> (start, end) as a function of "today".
PRESETS = {
    "today": lambda d: (d, d),
    "yesterday": lambda d: (F.date_sub(d, 1), F.date_sub(d, 1)),
    "last7": lambda d: (F.date_sub(d, 6), d),
    "last30": lambda d: (F.date_sub(d, 29), d),
    "thisMonth": lambda d: (F.trunc(d, "month"), F.last_day(d)),
    "lastMonth": lambda d: (
        F.trunc(F.add_months(d, -1), "month"),
        F.last_day(F.add_months(d, -1)),
    ),
    "last2Year": lambda d: (F.add_months(d, -24), d),
    "last3Year": lambda d: (F.add_months(d, -36), d),
    "last5Year": lambda d: (F.add_months(d, -60), d),
    "last10Year": lambda d: (F.add_months(d, -120), d),
    "last12Year": lambda d: (F.add_months(d, -144), d),
}


def preset_range(name, as_of):
    """(start, end) columns of a preset; ``as_of`` is a date column or an ISO string."""
    day = F.lit(as_of).cast("date") if isinstance(as_of, str) else as_column(as_of)
    return PRESETS[name](day)


def in_preset(df, date, name, as_of):
    """Rows in a preset range. Both bounds fold to literals, so the filter reaches the scan."""
    start, end = preset_range(name, as_of)
    return df.filter(as_column(date).between(start, end))


def time_filter_days(name, as_of):
    """Days looked back by a time filter; ``ytd`` counts from the first of January."""
    name, day = as_column(name), as_column(as_of)
    days = F.when(name == "ytd", F.datediff(day, F.trunc(day, "year")))
    for key, value in DAYS_PER_FILTER.items():
        days = days.when(name == key, value)
    return days.otherwise(DEFAULT_FILTER_DAYS)


def normalized_range(text):
    """``a ~ b`` to a struct of ordered dates; NULL when either side is not a date."""
    dates = F.transform(
        F.split(as_column(text), "~"), lambda side: parse_time(F.trim(side)).cast("date")
    )

    def ordered(pair):
        first, second = F.get(pair, F.lit(0)), F.get(pair, F.lit(1))
        return F.when(
            (F.size(pair) == 2) & first.isNotNull() & second.isNotNull(),
            F.struct(F.least(first, second).alias("start"), F.greatest(first, second).alias("end")),
        )

    # the pair is bound once, as every use of the expression would parse the text again
    return F.get(F.transform(F.array(dates), ordered), F.lit(0))
