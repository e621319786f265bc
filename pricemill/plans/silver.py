"""Silver tables: indicators, exchange rates and the wide daily fact."""

from pyspark.sql import functions as F

from pricemill.constants import (
    INDICATOR_COLUMNS, INDICATORS, LOOKBACK_DAYS, MEASURES, RSI_PERIOD,
)
from pricemill.operators import fx, indicators
from pricemill.operators.calendar import bounded
from pricemill.operators.dedupe import dedupe_latest
from pricemill.operators.incremental import filter_new
from pricemill.plans import changes
from pricemill.sources.tables import stamp_batch


def fact_indicators(raw, batch_id, target=None, processed_at=None, series="series"):
    """Indicator rows of a day, latest load first, renamed and kept to two decimals.

    The incremental filter runs before the dedupe: only newly loaded rows compete.
    """
    if target is not None:
        raw = filter_new(raw, target, "ingest_date_time")
    fields = [series, "d", "ingest_date_time", *INDICATOR_COLUMNS]
    latest = dedupe_latest(raw.select(*fields), [series, "d"], "ingest_date_time")
    shaped = latest.selectExpr(
        series,
        "d AS date_indicators",
        *[f"round({src}, 2) AS {dst}" for src, dst in INDICATOR_COLUMNS.items()],
    )
    return stamp_batch(shaped, batch_id, processed_at)


def usd_to_other(raw_chf, raw_eur, days, batch_id, target=None, processed_at=None, start=None,
                 as_of=None):
    """Both rates for every calendar day, filled forward; days before the first are left out.

    With ``start``, the days are those from it to ``as_of`` (default: today).
    """
    if start is not None:
        days = bounded(days, as_of, start)
    fields = ["date", "rate", "ingest_date_time"]
    chf, eur = (
        dedupe_latest(raw.select(*fields), "date", "ingest_date_time")
        for raw in (raw_chf, raw_eur)
    )
    rates = ["rate_usd_chf", "rate_usd_eur"]
    filled = fx.spine_fill(
        fx.full_outer_rates(chf, eur), days, [*rates, "ingest_date_time"]
    ).dropna(subset=rates)
    if target is not None:
        filled = filter_new(filled, target, "ingest_date_time", "update_date_time")
    return stamp_batch(
        filled.select("date_rates", *[F.col(r).cast("double").alias(r) for r in rates]),
        batch_id, processed_at,
    ).withColumnRenamed("ingest_date_time", "update_date_time")


def daily_rsi(raw, series="series"):
    """Latest load of each day with its RSI over the whole history."""
    latest = dedupe_latest(raw, [series, "date"], "ingest_date_time")
    return indicators.rsi(latest, series, "date", "close")


def obt_fact_day(raw, fact, rates, batch_id, target=None, processed_at=None, series="series"):
    """The wide daily fact: every measure in every currency, RSI, rates and audit columns.

    RSI is computed before the incremental filter, so its frames are never cut. The day's
    indicator carries its date as text and is cast for the join.
    """
    bars = daily_rsi(raw, series)
    if target is not None:
        bars = filter_new(bars, target, "ingest_date_time", mode="lookback")
    return wide_fact(bars, fact, rates, batch_id, processed_at, series)


def obt_fact_day_changes(raw, fact, rates, batch_id, target, processed_at=None, series="series",
                         partition="month"):
    """The rows of the daily fact that newly loaded candles change, from the months they reach.

    ``raw`` is a stored table partitioned by ``partition``. Changed are the candles loaded after
    the newest row of the target (less the lookback); what comes out are their days and the
    days behind them whose RSI has one of them in its frame, so that an upsert of these rows
    gives the table a full run would give. An empty target lets everything through.
    """
    mark = target.agg(
        F.max("ingest_date_time") - F.make_dt_interval(days=F.lit(LOOKBACK_DAYS))
    ).first()[0]
    if mark is None:
        return obt_fact_day(raw, fact, rates, batch_id, None, processed_at, series)
    newer = F.col("ingest_date_time") > F.lit(mark)
    changed = raw.where(newer).select(series, "date", partition)
    months = changes.partitions_to_read(
        raw.select(series, "date", partition), changed, series, "date", partition,
        before=RSI_PERIOD, after=RSI_PERIOD,
    )
    near = F.col(partition).isin(months) | (F.col(partition).isNull() & newer)
    rated = daily_rsi(raw.where(near).drop(partition), series)
    bars = changes.flag_reached(rated, newer, series, "date", RSI_PERIOD).where("reached").drop(
        "reached"
    )
    return wide_fact(bars, fact, rates, batch_id, processed_at, series)


def wide_fact(bars, fact, rates, batch_id, processed_at=None, series="series"):
    """Rated bars with the day's indicators and rates, every measure in every currency."""
    daily = fact.select(series, F.to_date("date_indicators").alias("date"), *INDICATORS)
    stamped = stamp_batch(bars.join(daily, [series, "date"], "left"), batch_id, processed_at)
    wide = fx.currency_columns()
    base, converted = wide[:len(MEASURES)], wide[len(MEASURES):]
    return fx.join_rates(stamped, rates, "date").selectExpr(
        series,
        "date AS date_prices",
        *base,
        "volume",
        "rsi",
        "rsi_status",
        "rate_usd_chf",
        "rate_usd_eur",
        *converted,
        "ingest_date_time",
        "dbt_batch_id",
    )
