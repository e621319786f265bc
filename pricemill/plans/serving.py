"""Serving queries: lazy frames over the silver and gold tables, for all series at once."""

from pyspark.sql import functions as F

from pricemill.constants import (
    AGGREGATED_PERIODS,
    DAYS_PER_FILTER,
    DEFAULT_SLICE_ROWS,
    FORECAST_DATES,
    INDICATOR_GROUPS,
    INDICATORS,
    MONTHLY_HISTORY_DAYS,
    OHLC,
    PERIOD_KEYS,
    PERIOD_UNITS,
    SLICE_ROWS,
)
from pricemill.functions.scalars import (
    as_column,
    direction,
    repaired_low,
    rsi_label,
    rsi_or_default,
    strictly_positive,
)
from pricemill.functions.windows import columns
from pricemill.operators import fx, indicators
from pricemill.operators.dedupe import dedupe_latest, keep_first, keep_top
from pricemill.operators.quality import parsed_request


def _day(as_of):
    return F.lit(as_of).cast("date") if isinstance(as_of, str) else as_column(as_of)


def latest_rates(rates):
    return fx.latest_rates(rates)


def latest_two(fact, series="series", date="date_prices"):
    """The two newest bars of each series (a group limit before the shuffle)."""
    return keep_top(fact, series, [F.col(date).desc()], 2)


def current_metrics(fact, rates, currency="USD", series="series"):
    """Newest bar of each series and its change to the one before.

    Series with fewer than two bars have no change and are left out.
    """
    bars = latest_two(
        fact.select(series, "date_prices", "close_usd", "high_usd", "low_usd", "volume", "rsi"),
        series,
    )
    pair = (
        bars.groupBy(series)
        .agg(
            F.max_by("close_usd", "date_prices").alias("current_price"),
            F.min_by("close_usd", "date_prices").alias("previous_price"),
            F.max_by("volume", "date_prices").alias("volume_24h"),
            F.max_by("high_usd", "date_prices").alias("high_24h"),
            F.max_by("low_usd", "date_prices").alias("low_24h"),
            F.max_by("rsi", "date_prices").alias("rsi"),
            F.count(F.lit(1)).alias("_bars"),
        )
        .filter("_bars = 2")
        .drop("_bars")
    )
    prices = ("current_price", "previous_price", "high_24h", "low_24h")
    change = F.col("current_price") - F.col("previous_price")
    return fx.convert_latest(pair, rates, prices, currency).select(
        series,
        "current_price",
        change.alias("change_24h"),
        (change / F.nullif(F.col("previous_price"), F.lit(0.0)) * 100).alias("change_percent_24h"),
        "volume_24h",
        "high_24h",
        "low_24h",
        rsi_or_default("rsi").alias("rsi"),
        direction(change).alias("trend"),
        strictly_positive(change).alias("is_positive"),
    )


def in_range(df, date, days, start, end, as_of):
    """Between two dates when both are given, else the last ``days`` days.

    The bounds fold to date literals, so the filter reaches the scan.
    """
    if start and end:
        return df.filter(F.col(date).between(_day(start), _day(end)))
    return df.filter(F.col(date) >= F.date_sub(_day(as_of), days))


def _history_rows(df, date, volume, status, series):
    return df.withColumn("_status", status).selectExpr(
        series,
        f"{date} AS date",
        *[f"{m}_usd AS {m}" for m in ("open", "high", "low", "close")],
        f"CAST({volume} AS DOUBLE) AS volume",
        "rsi",
        "_status AS rsi_status",
        *[f"{m}_usd AS {m}" for m in INDICATORS],
    )


def history_daily(fact, rates, days=30, start=None, end=None, currency="USD", as_of=None,
                  series="series"):
    rows = in_range(fact, "date_prices", days, start, end, as_of)
    shaped = _history_rows(rows, "date_prices", "volume", F.col("rsi_status"), series)
    return _served(shaped, rates, currency, series)


def history_monthly(month, rates, days, start=None, end=None, currency="USD", as_of=None,
                    series="series"):
    """From the month table: no volume, status recomputed from the RSI value."""
    key = PERIOD_KEYS["month"]
    rows = in_range(month, key, days, start, end, as_of)
    shaped = _history_rows(rows, key, "0", rsi_label("rsi"), series)
    return _served(shaped, rates, currency, series)


def _served(df, rates, currency, series):
    """Convert, turn NULL into zero where the row contract coerces, and order by date."""
    shaped = fx.convert_latest(df, rates, OHLC, currency, optional=INDICATORS)
    return shaped.fillna(0.0, [*OHLC, "volume", "rsi"]).orderBy(series, "date")


def history_grain(days):
    """The grain that answers so many days: long ranges come from the month table."""
    return "month" if days >= MONTHLY_HISTORY_DAYS else "day"


def history(fact, month, rates, days=30, start=None, end=None, currency="USD", as_of=None,
            series="series", grain=None):
    """History by ``grain``, ``month`` or ``day``; None takes what ``history_grain`` says."""
    if (grain or history_grain(days)) == "month":
        return history_monthly(month, rates, days, start, end, currency, as_of, series)
    return history_daily(fact, rates, days, start, end, currency, as_of, series)


def aggregated(gold, period="weekly", series="series", periods=AGGREGATED_PERIODS):
    """The last ``periods`` (None: all) of each series, newest first. The average is the close."""
    key = PERIOD_KEYS[PERIOD_UNITS.get(period, "week")]
    rows = gold[PERIOD_UNITS.get(period, "week")].select(
        series,
        F.col(key).alias("period"),
        F.col("close_usd").alias("avg_price"),
        F.col("high_usd").alias("max_price"),
        F.col("low_usd").alias("min_price"),
        F.lit(0.0).alias("total_volume"),
    )
    newest = F.col("period").desc()
    kept = rows if periods is None else keep_top(rows, series, [newest], periods)
    return kept.fillna(0.0, ["avg_price", "max_price", "min_price"]).orderBy(
        series, newest
    )


FORECAST_PRICES = (
    "predicted_close_usd", "predicted_close_usd_lower", "predicted_close_usd_upper",
)


def forecast(predictions, rates, currency="USD", series="series", dates=FORECAST_DATES):
    """The newest prediction of each date, for the earliest ``dates`` (None: all) of each series."""
    newest = dedupe_latest(predictions, [series, "date_prices"], "predicted_at")
    earliest = newest
    if dates is not None:
        earliest = keep_top(newest, series, [F.col("date_prices").asc()], dates)
    return fx.convert_latest(earliest, rates, FORECAST_PRICES, currency).orderBy(
        series, "date_prices"
    )


def forecast_slice(predictions, time_filter, series="series"):
    """First of each month for ``all``, else the first rows the filter asks for."""
    if time_filter == "all":
        month = F.trunc("date_prices", "month")
        return keep_first(
            predictions.withColumn("_month", month), [series, "_month"], "date_prices"
        ).drop("_month")
    rows = SLICE_ROWS.get(time_filter, DEFAULT_SLICE_ROWS)
    return keep_top(predictions, series, [F.col("date_prices").asc()], rows)


def forecast_applies(end, as_of):
    """A forecast is shown unless a custom range ends before today."""
    end = _day(end)
    return end.isNull() | (end >= _day(as_of))


def period_stats(bars, series="series", date="date"):
    """First open, last close, extremes and variation over the rows given."""
    stats = bars.groupBy(*columns(series)).agg(
        F.min(date).alias("start_date"),
        F.max(date).alias("end_date"),
        F.min_by("open", date).alias("start_open"),
        F.max_by("close", date).alias("end_close"),
        F.max("high").alias("period_high"),
        F.min("low").alias("period_low"),
    )
    first = F.col("start_open")
    return stats.withColumn(
        "variation", (F.col("end_close") - first) / F.nullif(first, F.lit(0.0)) * 100
    )


def indicator_points(rows, group, series="series", date="date"):
    """A group of indicators as (date, indicator, value) points; NULL points are removed."""
    names = INDICATOR_GROUPS[group]
    return _points(rows, names, series, date).filter(F.col("value").isNotNull())


def _points(rows, names, series, date):
    cells = ", ".join(f"'{n}', {n}" for n in names)
    return rows.selectExpr(series, date, f"stack({len(names)}, {cells}) AS (indicator, value)")


def repair_lows(bars, date="date"):
    return bars.withColumn("low", repaired_low("low", "open", "high", "close", date))


def chart_series(rows, groups=("rsi", "macd", "sma", "ema"), series="series", date="date",
                 smooth=None):
    """Repaired prices and the chosen indicators as points; ``smooth`` as in ``rsi_points``.

    One pass over the rows: the monthly mean of RSI is put on the first row of its month, and all
    points come from one stack. Prices are points also where they are NULL.
    """
    names = [*OHLC, *[name for group in groups for name in INDICATOR_GROUPS[group]]]
    points = repair_lows(rows, date)
    when = as_column(date)
    if "rsi" in groups:
        points = indicators.with_charted_rsi(points, series, date, smooth)
        when = F.when(F.col("indicator") == "rsi", F.col("_rsi_date")).otherwise(when)
        cells = ", ".join(f"'{n}', {'_rsi' if n == 'rsi' else n}" for n in names)
        kept = [series, date, "_rsi_date"]
    else:
        cells = ", ".join(f"'{n}', {n}" for n in names)
        kept = [series, date]
    stacked = points.selectExpr(*kept, f"stack({len(names)}, {cells}) AS (indicator, value)")
    return stacked.where(F.col("indicator").isin(*OHLC) | F.col("value").isNotNull()).select(
        series, when.alias(date), "indicator", "value"
    )


def volatility_series(bars, series="series"):
    return indicators.volatility_intensity(bars, series)


def newest_rows(df, order, rows):
    """The newest rows of a table (top-k, no full sort)."""
    return df.orderBy(*[F.col(c).desc() for c in columns(order)]).limit(rows)


def capped(df, order, rows):
    """The first ``rows`` rows, where a caller asks for a cap."""
    return df.orderBy(*columns(order)).limit(rows)


def days_for(time_filter, as_of):
    """Days of a time filter as a number, for routing."""
    if time_filter == "ytd":
        return as_of.timetuple().tm_yday - 1
    return DAYS_PER_FILTER.get(time_filter, 180)


def serve(request, tables, as_of):
    """Answer a request by its type, in USD. ``tables`` maps layer names to frames.

    The request is held against its contract first; one that does not fit raises ValueError.
    """
    request = parsed_request(request)
    kind = request["type"]
    rates = tables["usd_to_other"]
    if kind == "metrics":
        return current_metrics(tables["fact"], rates)
    if kind == "history":
        return history(
            tables["fact"], tables["gold"]["month"], rates, request["days"],
            request["startDate"], request["endDate"], "USD", as_of,
        )
    if kind == "aggregated":
        return aggregated(tables["gold"], request["period"])
    return forecast(tables["forecasts"], rates)
