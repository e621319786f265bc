"""Bronze loads: landed payloads to stamped tables, in one job over all series."""

from pricemill.sources import evolving, payloads
from pricemill.sources.tables import append_evolving, stamp_load, write_partitioned


def load(spark, rows, target, loaded_at=None):
    """Create or extend a bronze table; returns the rows written.

    Payloads are parsed once: the write itself counts. A first load without rows leaves an empty
    table with its columns.
    """
    stamped = stamp_load(rows, loaded_at)
    if "/" in target:
        known = evolving.exists(spark, target)
    else:
        known = spark.catalog.tableExists(target)
    return append_evolving(stamped, target) if known else write_partitioned(stamped, target)


def load_candles(spark, responses, target, loaded_at=None):
    return load(spark, payloads.parse_candles(responses, "payload"), target, loaded_at)


def load_rates(spark, responses, quote, target, loaded_at=None):
    return load(spark, payloads.parse_fx_rates(responses, "payload", quote), target, loaded_at)


def load_indicators(spark, responses, target, loaded_at=None):
    rows = payloads.parse_indicators(responses, "payload", ["series"])
    return load(spark, rows, target, loaded_at)
