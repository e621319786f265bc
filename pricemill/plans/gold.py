"""Gold tables: the daily fact rolled up to weeks, and weeks to months, quarters and years."""

from pyspark.sql import functions as F

from pricemill.constants import CURRENCIES, MEASURES, PERIOD_KEYS, RSI_PERIOD
from pricemill.operators import indicators
from pricemill.operators.bars import rollup, with_period_keys
from pricemill.operators.incremental import filter_new
from pricemill.plans import changes
from pricemill.sources.tables import stamp_batch


def aggregate(source, unit, batch_id, target=None, processed_at=None, series="series"):
    """One row per series and period in all currencies, with RSI on the period closes.

    ``source`` is the daily fact for weeks and the week table for everything longer. RSI is
    computed before the incremental filter.
    """
    order = "date_prices" if unit == "week" else PERIOD_KEYS["week"]
    keyed = with_period_keys(source, order) if unit == "week" else source
    periods = rollup(
        keyed, unit, series, order, MEASURES,
        suffixes=[f"_{c}" for c in CURRENCIES], extra=("ingest_date_time",),
    )
    rated = indicators.rsi(periods, series, PERIOD_KEYS[unit], "close_usd")
    if target is not None:
        rated = filter_new(rated, target, "ingest_date_time", mode="inclusive")
    return stamp_batch(rated, batch_id, processed_at)


def aggregate_changes(source, unit, batch_id, target, processed_at=None, series="series",
                      source_unit="year", partition="period"):
    """The rows of a gold table that changed rows of its source change.

    ``source`` (the daily fact for weeks, else the week table) and ``target`` are stored tables
    with their partition, which is the ``source_unit`` of the source's date and the year of the
    target's. Changed are the rows of the source stamped at the target's newest stamp or later.
    Only the periods they fall in are rolled up again, from the partitions where these have rows.
    The closes ahead of them, and the periods behind them whose RSI they reach, come from the
    target; so an upsert of these rows gives the table a full run would give.
    """
    mark = target.agg(F.max("ingest_date_time")).first()[0]
    if mark is None:
        return aggregate(source.drop(partition), unit, batch_id, None, processed_at, series)
    order = "date_prices" if unit == "week" else PERIOD_KEYS["week"]
    key = PERIOD_KEYS[unit]
    changed = source.where(F.col("ingest_date_time") >= F.lit(mark))
    if unit == "week":
        changed = with_period_keys(changed, order)
    touched = changed.select(series, key).distinct()
    # a week's days begin with it; a longer period's first week may begin six days before it
    edge = F.date_add(key, 6 if unit == "week" else -6)
    parts = touched.select(F.explode(F.array(F.col(key), edge)).alias("day")).select(
        F.trunc("day", source_unit).alias("part")
    )
    near = source.where(F.col(partition).isin(changes.values(parts, "part")))
    keyed = with_period_keys(near, order) if unit == "week" else near
    rolled = rollup(
        keyed.join(touched, [series, key], "left_semi"), unit, series, order, MEASURES,
        suffixes=[f"_{c}" for c in CURRENCIES], extra=("ingest_date_time",),
    )
    years = changes.partitions_to_read(
        target.select(series, key, partition),
        touched.withColumn(partition, F.trunc(key, "year")),
        series, key, partition, before=RSI_PERIOD, after=RSI_PERIOD,
    )
    kept = target.where(F.col(partition).isin(years)).join(touched, [series, key], "left_anti")
    both = rolled.withColumn("_touched", F.lit(True)).unionByName(
        kept.select(*rolled.columns).withColumn("_touched", F.lit(False))
    )
    rated = indicators.rsi(both, series, key, "close_usd")
    reached = changes.flag_reached(rated, F.col("_touched"), series, key, RSI_PERIOD)
    return stamp_batch(reached.where("reached").drop("reached", "_touched"), batch_id, processed_at)


def all_periods(fact, batch_id, processed_at=None, series="series"):
    """The four gold tables by unit. Longer periods all come from the week table."""
    week = aggregate(fact, "week", batch_id, None, processed_at, series)
    return {"week": week} | {
        unit: aggregate(week, unit, batch_id, None, processed_at, series)
        for unit in ("month", "quarter", "year")
    }
