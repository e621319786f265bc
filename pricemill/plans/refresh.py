"""One refresh of all silver and gold tables from bronze, full or incremental.

Tables are Parquet folders below a root. A table that exists is the target of the incremental
filter and is upserted by key; otherwise it is built in full. The rate table is always
rebuilt: it has one row per day, and a filled day carries an old load time that an incremental
filter would miss.
"""

from pyspark.sql import functions as F

from pricemill.constants import PERIOD_KEYS
from pricemill.operators.incremental import upsert_partitions
from pricemill.plans import gold, silver
from pricemill.sources import evolving

_PERIOD = "period"


def table_path(root, name):
    return f"{root.rstrip('/')}/{name}"


def read_table(spark, root, name):
    """A stored table, or None before its first refresh."""
    path = table_path(root, name)
    return evolving.read(spark, path).drop(_PERIOD) if evolving.exists(spark, path) else None


def store(spark, root, name, rows, keys, date, unit):
    """Write or upsert a table partitioned by a period of its date.

    A first load of no rows leaves no table; the typed empty rows stand for it until one comes.
    Columns that a later load brings are added.
    """
    path = table_path(root, name)
    dated = rows.withColumn(_PERIOD, F.trunc(F.col(date).cast("date"), unit))
    if evolving.exists(spark, path):
        upsert_partitions(spark, path, dated, keys, _PERIOD)
    else:
        evolving.overwrite(spark, path, dated, _PERIOD, declare_empty=False)
    found = read_table(spark, root, name)
    return rows.limit(0) if found is None else found


def refresh(spark, root, candles, indicators, chf, eur, days, batch_id, processed_at=None,
            daily_partition="month", candle_partition="month"):
    """Bring every table up to date; returns the stored tables by name.

    ``daily_partition`` is the partition of the daily tables: a month for many series, a year
    for few. Where ``candles`` is a stored table with ``candle_partition`` as its partition, a
    refresh of tables that exist begins with what was loaded since: it reads the partitions that
    the changed rows reach and rolls up the periods they fall in, nothing else.
    """
    stamps = {"batch_id": batch_id, "processed_at": processed_at}

    def stored(name, partition=False):
        found = read_table(spark, root, name)
        return evolving.read(spark, table_path(root, name)) if partition and found else found

    fact = store(
        spark, root, "indicators",
        silver.fact_indicators(indicators, target=stored("indicators"), **stamps),
        ["series", "date_indicators"], "date_indicators", daily_partition,
    )
    rates = silver.usd_to_other(chf, eur, days, **stamps)
    evolving.overwrite(
        spark, table_path(root, "rates"),
        rates.withColumn(_PERIOD, F.trunc("date_rates", "year")), _PERIOD,
    )
    rates = read_table(spark, root, "rates")
    known = stored("daily")
    if known is not None and candle_partition in candles.columns:
        changed = silver.obt_fact_day_changes(
            candles, fact, rates, target=known, partition=candle_partition, **stamps
        )
    else:
        changed = silver.obt_fact_day(
            candles.drop(candle_partition), fact, rates, target=known, **stamps
        )
    daily = store(
        spark, root, "daily", changed, ["series", "date_prices"], "date_prices", daily_partition
    )
    tables = {"indicators": fact, "rates": rates, "daily": daily}
    source, source_unit = "daily", daily_partition
    for unit, key in PERIOD_KEYS.items():
        known = stored(unit, partition=True)
        if known is None:
            rows = gold.aggregate(tables[source], unit, **stamps)
        else:
            rows = gold.aggregate_changes(
                stored(source, partition=True), unit, target=known, source_unit=source_unit,
                **stamps,
            )
        tables[unit] = store(spark, root, unit, rows, ["series", key], key, "year")
        source, source_unit = "week", "year"
    return tables
