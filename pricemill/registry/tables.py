"""Silver and gold tables, incremental loading and writing."""

import functools

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pricemill.constants import INDICATOR_COLUMNS, PERIOD_KEYS
from pricemill.functions import scalars
from pricemill.operators import incremental
from pricemill.operators.dedupe import dedupe_latest
from pricemill.plans import bronze, gold, landing, refresh, silver
from pricemill.registry import inputs
from pricemill.registry.entries import query, rounded
from pricemill.registry.parsing import candle_payloads, fx_payloads, indicator_payloads
from pricemill.session import scratch_path
from pricemill.sources import evolving, planning, tables
from pricemill.sources.payloads import empty

_STAMPS = f"TIMESTAMP '{inputs.PROCESSED_AT}' AS ingest_date_time, '{inputs.BATCH}' AS dbt_batch_id"


@query("fact_indicators", f"SELECT *, {_STAMPS} FROM x_fact")
def fact_indicators(spark, sf):
    return inputs.plain(inputs.fact_indicators(spark, sf))


@query("obt_fact_day", "SELECT * FROM x_obt")
def obt_fact_day(spark, sf):
    return inputs.plain(inputs.obt(spark, sf))


def _gold_sql(unit):
    return (
        "SELECT * EXCLUDE (change, avg_gain, avg_loss, raw), "
        f"{_STAMPS} FROM x_{unit}_rsi"
    )


@query("gold_week", _gold_sql("week"))
def gold_week(spark, sf):
    return inputs.plain(inputs.gold_table(spark, sf, "week"))


@query("gold_month", _gold_sql("month"))
def gold_month(spark, sf):
    return inputs.plain(inputs.gold_table(spark, sf, "month"))


@query("gold_quarter", _gold_sql("quarter"))
def gold_quarter(spark, sf):
    return inputs.plain(inputs.gold_table(spark, sf, "quarter"))


@query("gold_year", _gold_sql("year"))
def gold_year(spark, sf):
    return inputs.plain(inputs.gold_table(spark, sf, "year"))


@query(
    "join_bars_indicators",
    "SELECT b.series, b.date, close, macd, sma_7 FROM x_latest b LEFT JOIN x_fact f"
    " ON f.series = b.series AND CAST(date_indicators AS DATE) = b.date",
)
def join_bars_indicators(spark, sf):
    bars = dedupe_latest(inputs.raw_candles(spark, sf), ["series", "date"], "ingest_date_time")
    daily = inputs.fact_indicators(spark, sf).select(
        "series", F.to_date("date_indicators").alias("date"), "macd", "sma_7"
    )
    return bars.join(daily, ["series", "date"], "left").select(
        "series", "date", "close", "macd", "sma_7"
    )


@query(
    "round_rename",
    "SELECT series, d, "
    + ", ".join(f"{rounded(s)} AS {n}" for s, n in INDICATOR_COLUMNS.items())
    + " FROM x_raw_ind",
)
def round_rename(spark, sf):
    return inputs.raw_indicators(spark, sf).select(
        "series", "d", *[F.round(s, 2).alias(n) for s, n in INDICATOR_COLUMNS.items()]
    )


@query("star_except", "SELECT * EXCLUDE (ingest_date_time, volume) FROM x_raw")
def star_except(spark, sf):
    return inputs.raw_candles(spark, sf).drop("ingest_date_time", "volume")


# The target was loaded up to this day; everything later (and a re-fetched overlap) is new.
_CUT = "2000-01-01"
_TARGET = f"(SELECT * FROM x_bars WHERE date < DATE '{_CUT}')"


def _target(spark, sf):
    return inputs.bars(spark, sf).filter(F.col("date") < F.lit(_CUT).cast("date"))


@query("high_watermark", f"SELECT max(date) AS high_watermark FROM {_TARGET}")
def high_watermark(spark, sf):
    return incremental.high_watermark(_target(spark, sf), "date")


@query("incr_filter_strict", f"SELECT * FROM x_bars WHERE date > (SELECT max(date) FROM {_TARGET})")
def incr_filter_strict(spark, sf):
    return incremental.filter_new(inputs.bars(spark, sf), _target(spark, sf), "date")


@query(
    "incr_filter_inclusive",
    f"SELECT * FROM x_bars WHERE date >= (SELECT max(date) FROM {_TARGET})",
)
def incr_filter_inclusive(spark, sf):
    return incremental.filter_new(
        inputs.bars(spark, sf), _target(spark, sf), "date", mode="inclusive"
    )


@query(
    "incr_filter_lookback",
    f"SELECT * FROM x_bars WHERE date > (SELECT max(date) - INTERVAL 10 DAY FROM {_TARGET})",
)
def incr_filter_lookback(spark, sf):
    return incremental.filter_new(
        inputs.bars(spark, sf), _target(spark, sf), "date", mode="lookback"
    )


# Updates: everything from 30 days before the cut, with corrected closes.
_UPDATES = (
    "(SELECT series, date, low, high, open, close + 1 AS close, volume FROM x_bars"
    f" WHERE date >= DATE '{_CUT}' - 30)"
)


def _updates(spark, sf):
    bars = inputs.bars(spark, sf)
    recent = bars.filter(F.col("date") >= F.date_sub(F.lit(_CUT).cast("date"), 30))
    return recent.withColumn("close", F.col("close") + 1)


_UPSERTED = (
    "SELECT * FROM (SELECT t.series, t.date, t.low, t.high, t.open, t.close, t.volume"
    f" FROM {_TARGET} t ANTI JOIN {_UPDATES} u ON t.series = u.series AND t.date = u.date)"
    f" UNION ALL SELECT * FROM {_UPDATES}"
)


@query("upsert_by_key", _UPSERTED)
def upsert_by_key(spark, sf):
    return incremental.upsert(_target(spark, sf), _updates(spark, sf), ["series", "date"])


@query("upsert_table", _UPSERTED)
def upsert_table(spark, sf):
    """The same merge into a stored table: only months touched by the updates are rewritten."""
    path = scratch_path(spark, "upsert")
    tables.write_partitioned(_target(spark, sf), path)
    updates = _updates(spark, sf).withColumn("month", F.trunc("date", "month"))
    incremental.upsert_partitions(spark, path, updates, ["series", "date"], "month")
    return evolving.read(spark, path).drop("month")


# The table has a column more than the updates; they have another one.
_WITH_SPREAD = f"(SELECT *, high - low AS spread FROM {_TARGET})"


def _evolved(spark, sf, sync):
    """A stored table with ``spread``, then updates with ``middle`` in its place."""
    path = scratch_path(spark, "evolving")
    target = _target(spark, sf).withColumn("spread", F.col("high") - F.col("low"))
    tables.write_partitioned(target, path)
    updates = _updates(spark, sf).withColumn("middle", (F.col("high") + F.col("low")) / 2)
    incremental.upsert_partitions(
        spark, path, updates.withColumn("month", F.trunc("date", "month")),
        ["series", "date"], "month", sync=sync,
    )
    return path


@query(
    "upsert_keeps_columns",
    "SELECT t.series, t.date, t.low, t.high, t.open, t.close, t.volume, t.spread,"
    f" CAST(NULL AS DOUBLE) AS middle FROM {_WITH_SPREAD} t ANTI JOIN {_UPDATES} u"
    " ON t.series = u.series AND t.date = u.date UNION ALL"
    " SELECT u.series, u.date, u.low, u.high, u.open, u.close, u.volume, t.spread,"
    f" (u.high + u.low) / 2 AS middle FROM {_UPDATES} u LEFT JOIN {_WITH_SPREAD} t"
    " ON t.series = u.series AND t.date = u.date",
)
def upsert_keeps_columns(spark, sf):
    """A column that the updates lack keeps its values, in touched and untouched months alike."""
    return evolving.read(spark, _evolved(spark, sf, sync=False)).drop("month")


@query(
    "upsert_drops_column",
    "SELECT t.series, t.date, t.low, t.high, t.open, t.close, t.volume,"
    f" CAST(NULL AS DOUBLE) AS middle, CAST(NULL AS DOUBLE) AS spread FROM {_TARGET} t"
    f" ANTI JOIN {_UPDATES} u ON t.series = u.series AND t.date = u.date UNION ALL"
    " SELECT *, (high + low) / 2 AS middle, CASE WHEN date >= DATE"
    f" '{_CUT}' + 365 THEN 0.0 END AS spread FROM {_UPDATES}",
)
def upsert_drops_column(spark, sf):
    """A synchronised column is gone from all months, and stays gone when its name comes back."""
    path = _evolved(spark, sf, sync=True)
    bars = evolving.read(spark, path)
    later = bars.where(F.col("date") >= F.date_add(F.lit(_CUT).cast("date"), 365))
    incremental.upsert_partitions(
        spark, path, later.withColumn("spread", F.lit(0.0)), ["series", "date"], "month"
    )
    return evolving.read(spark, path).drop("month")


@query(
    "sync_columns",
    "SELECT series, date, close, CAST(NULL AS DOUBLE) AS rsi FROM x_bars",
)
def sync_columns(spark, sf):
    bars = inputs.bars(spark, sf)
    shape = bars.select("series", "date", "close", F.lit(1.0).alias("rsi")).limit(0)
    return incremental.sync_columns(bars, shape)


@query(
    "append_merge_schema",
    f"SELECT *, CAST(NULL AS DOUBLE) AS spread FROM {_TARGET} UNION ALL"
    f" SELECT *, high - low AS spread FROM x_bars WHERE date >= DATE '{_CUT}'",
)
def append_merge_schema(spark, sf):
    """A second batch with one more column is appended to a stored table."""
    path = scratch_path(spark, "append")
    tables.write_partitioned(_target(spark, sf), path)
    later = inputs.bars(spark, sf).filter(F.col("date") >= F.lit(_CUT).cast("date"))
    tables.append_evolving(later.withColumn("spread", F.col("high") - F.col("low")), path)
    return tables.scan_evolving(spark, path).drop("month")


@query(
    "write_bronze_new",
    f"SELECT *, TIMESTAMP '{inputs.PROCESSED_AT}' AS ingest_date_time FROM x_bars",
)
def write_bronze_new(spark, sf):
    path = scratch_path(spark, "bronze")
    bars = inputs.bars(spark, sf).withColumn("time", F.col("date").cast("timestamp")).drop("date")
    tables.write_partitioned(tables.stamp_load(bars, inputs.PROCESSED_AT), path)
    return inputs.plain(tables.scan_table(spark, path).drop("month", "time"))


@query("observe_rows", "SELECT count(*) AS row_count FROM x_bars")
def observe_rows(spark, sf):
    """Rows reported by the write itself next to rows found in the table."""
    path = scratch_path(spark, "observe")
    written = tables.write_partitioned(inputs.bars(spark, sf), path)
    found = tables.scan_table(spark, path).agg(F.count(F.lit(1)).alias("row_count"))
    return found.filter(F.col("row_count") == written)


@query(
    "stamp_load",
    "SELECT event_id, CAST(ts AS DATE) AS date,"
    f" TIMESTAMP '{inputs.PROCESSED_AT}' AS ingest_date_time FROM events",
)
def stamp_load(spark, sf):
    events = inputs.table(spark, sf, "events").withColumnRenamed("ts", "time")
    stamped = tables.stamp_load(events, inputs.PROCESSED_AT)
    return inputs.plain(stamped.select("event_id", "date", "ingest_date_time"))


@query("stamp_batch", f"SELECT series, date, close, {_STAMPS} FROM x_raw")
def stamp_batch(spark, sf):
    raw = inputs.raw_candles(spark, sf).select("series", "date", "close", "ingest_date_time")
    return inputs.plain(tables.stamp_batch(raw, inputs.BATCH, inputs.PROCESSED_AT))


@query(
    "scan_table",
    "SELECT o_orderpriority, count(*) AS row_count FROM orders GROUP BY o_orderpriority",
)
def scan_table(spark, sf):
    orders = tables.scan_table(spark, f"{sf}/orders.parquet")
    return orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("row_count"))


@query(
    "table_inventory",
    "SELECT 'orders' AS table_name, count(*) AS row_count, 'o_orderkey,o_custkey,o_orderstatus,"
    "o_totalprice,o_orderdate,o_orderpriority' AS column_names FROM orders UNION ALL"
    " SELECT 'events', count(*), 'event_id,ts,user_id,event_type,value,props' FROM events",
)
def table_inventory(spark, sf):
    return tables.inventory({n: inputs.table(spark, sf, n) for n in ("orders", "events")})


_SPANS = "(SELECT series, min(date) AS lo, max(date) AS hi FROM x_bars GROUP BY series)"


@query(
    "plan_fetch_windows",
    "SELECT series, CAST(s AS DATE) AS window_start,"
    " least(CAST(s + INTERVAL 200 DAY AS DATE), hi) AS window_end FROM"
    f" (SELECT *, unnest(generate_series(lo, hi, INTERVAL 200 DAY)) AS s FROM {_SPANS})"
    " WHERE s < hi",
)
def plan_fetch_windows(spark, sf):
    spans = inputs.bars(spark, sf).groupBy("series").agg(
        F.min("date").alias("lo"), F.max("date").alias("hi")
    )
    return planning.plan_windows(spans, "lo", "hi").drop("lo", "hi")


@query(
    "plan_fx_windows",
    "SELECT series, CAST(s AS DATE) AS window_start,"
    " least(CAST(s + INTERVAL 365 DAY AS DATE), hi) AS window_end FROM"
    f" (SELECT *, unnest(generate_series(lo, hi, INTERVAL 366 DAY)) AS s FROM {_SPANS})"
    " WHERE s < hi",
)
def plan_fx_windows(spark, sf):
    spans = inputs.bars(spark, sf).groupBy("series").agg(
        F.min("date").alias("lo"), F.max("date").alias("hi")
    )
    return planning.plan_fx_windows(spans, "lo", "hi").drop("lo", "hi")


_PAIRS = (
    "(SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'USD' WHEN 'O' THEN 'BTC' ELSE 'ETH'"
    " END AS base, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'EUR' WHEN '2' THEN 'CHF'"
    " ELSE 'USD' END AS quote FROM orders)"
)


def _pairs(spark, sf):
    status, priority = F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)
    return inputs.table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(status == "F", "USD").when(status == "O", "BTC").otherwise("ETH").alias("base"),
        F.when(priority == "1", "EUR").when(priority == "2", "CHF").otherwise("USD")
        .alias("quote"),
    )


@query(
    "route_series",
    "SELECT *, CASE WHEN base = 'USD' AND quote IN ('EUR', 'CHF') THEN 'fx' ELSE 'candles' END"
    f" AS feed FROM {_PAIRS}",
)
def route_series(spark, sf):
    return _pairs(spark, sf).withColumn("feed", scalars.feed_kind("base", "quote"))


@query(
    "series_table_name",
    "SELECT DISTINCT base, quote, lower(base || '_' || quote || '_' || CASE WHEN base = 'USD'"
    " AND quote IN ('EUR', 'CHF') THEN 'rates' ELSE 'ohlcv' END) AS table_name"
    f" FROM {_PAIRS}",
)
def series_table_name(spark, sf):
    pairs = _pairs(spark, sf).select("base", "quote").distinct()
    return pairs.withColumn("table_name", scalars.series_table_name("base", "quote"))


@query("empty_typed", "SELECT * FROM x_bars")
def empty_typed(spark, sf):
    """A source without data keeps its schema, so it joins the others and adds nothing."""
    bars = inputs.bars(spark, sf)
    return empty(spark, bars.schema).unionByName(bars)


@query("obt_incremental", "SELECT * EXCLUDE (ingest_date_time, dbt_batch_id) FROM x_obt")
def obt_incremental(spark, sf):
    """Two loads of the daily fact end in the same table as one.

    The first load sees candles up to the cut, the second everything; its rows newer than the
    first load's (less ten days) replace or extend the table.
    """
    raw = inputs.raw_candles(spark, sf)
    fact, rates = inputs.fact_indicators(spark, sf), inputs.usd_rates(spark, sf)
    first = silver.obt_fact_day(
        raw.filter(F.col("ingest_date_time") < "2001-09-02"), fact, rates,
        "batch-0", processed_at="2001-09-02 00:00:00",
    )
    second = silver.obt_fact_day(
        raw, fact, rates, inputs.BATCH, target=first, processed_at=inputs.PROCESSED_AT
    )
    merged = incremental.upsert(first, second, ["series", "date_prices"])
    return merged.drop("ingest_date_time", "dbt_batch_id")


@query(
    "gold_incremental",
    "SELECT * EXCLUDE (change, avg_gain, avg_loss, raw) FROM x_week_rsi",
)
def gold_incremental(spark, sf):
    """A second load corrects days of two months; the weeks they touch, and those behind them
    whose RSI they reach, are replaced."""
    root = scratch_path(spark, "gold")
    corrected = F.month("date_prices").isin(3) & F.year("date_prices").isin(1994, 1997)
    later = "2030-01-01 00:00:00"
    fact = inputs.obt(spark, sf)
    wrong = fact.withColumn(
        "close_usd", F.when(corrected, F.col("close_usd") * 2).otherwise(F.col("close_usd"))
    )
    refresh.store(
        spark, root, "week",
        gold.aggregate(wrong, "week", "batch-0", processed_at=inputs.PROCESSED_AT),
        ["series", PERIOD_KEYS["week"]], PERIOD_KEYS["week"], "year",
    )
    stamped = fact.withColumn(
        "ingest_date_time",
        F.when(corrected, F.lit(later).cast("timestamp")).otherwise(
            F.lit("2000-01-01 00:00:00").cast("timestamp")
        ),
    )
    refresh.store(
        spark, root, "daily", stamped, ["series", "date_prices"], "date_prices", "year"
    )
    week = refresh.table_path(root, "week")
    changed = gold.aggregate_changes(
        evolving.read(spark, refresh.table_path(root, "daily")), "week", inputs.BATCH,
        evolving.read(spark, week), processed_at=later,
    )
    merged = refresh.store(
        spark, root, "week", changed, ["series", PERIOD_KEYS["week"]], PERIOD_KEYS["week"], "year"
    )
    return merged.drop("ingest_date_time", "dbt_batch_id")


@functools.cache
def _refreshed(sf):
    """Two refreshes: one that sees two of the three loads, one that sees all.

    Returns the folder of the stored tables; made once per process and data folder.
    """
    spark = SparkSession.active()
    root = scratch_path(spark, "tables")
    raw, supplied, *rates, days = inputs.bronze(spark, sf)
    early = F.col("ingest_date_time") < "2001-09-03"
    refresh.refresh(
        spark, root, raw.filter(early), supplied.filter(early), *rates, days,
        "batch-0", "2001-09-02 12:00:00", daily_partition="year",
    )
    refresh.refresh(
        spark, root, raw, supplied, *rates, days, inputs.BATCH, inputs.PROCESSED_AT,
        daily_partition="year",
    )
    return root


@query("refresh_daily", "SELECT * EXCLUDE (ingest_date_time, dbt_batch_id) FROM x_obt")
def refresh_daily(spark, sf):
    daily = refresh.read_table(spark, _refreshed(sf), "daily")
    return daily.drop("ingest_date_time", "dbt_batch_id")


@query(
    "refresh_quarter",
    "SELECT * EXCLUDE (change, avg_gain, avg_loss, raw) FROM x_quarter_rsi",
)
def refresh_quarter(spark, sf):
    quarter = refresh.read_table(spark, _refreshed(sf), "quarter")
    return quarter.drop("ingest_date_time", "dbt_batch_id")


# Late corrections: some days of two separate years come again, a year later, with other closes.
_CORRECTED = (
    "(month(date) = 3 AND year(date) IN (1994, 1997) AND day(date) <= 5 AND close > 0)"
)
_CORRECTIONS = (
    "(SELECT series, date, low, high, open, close * 1.5 AS close, volume,"
    f" TIMESTAMP '2002-01-01 00:00:00' AS ingest_date_time FROM x_latest WHERE {_CORRECTED})"
)


@functools.cache
def _corrected(sf):
    """A stored bronze table, one full refresh, corrections of old days, and a second refresh."""
    spark = SparkSession.active()
    root, bronze_path = scratch_path(spark, "tables"), scratch_path(spark, "bronze")
    raw, supplied, *rates, days = inputs.bronze(spark, sf)
    tables.write_partitioned(raw, bronze_path)

    def run(batch, at):
        refresh.refresh(
            spark, root, evolving.read(spark, bronze_path), supplied, *rates, days, batch, at,
            daily_partition="year",
        )

    run("batch-0", "2001-12-01 00:00:00")
    latest = dedupe_latest(raw, ["series", "date"], "ingest_date_time")
    corrections = latest.where(_CORRECTED).withColumn("close", F.col("close") * 1.5).withColumn(
        "ingest_date_time", F.lit("2002-01-01 00:00:00").cast("timestamp")
    )
    tables.append_evolving(corrections.select(*raw.columns), bronze_path)
    run(inputs.BATCH, "2002-01-02 00:00:00")
    return root


@query(
    "refresh_changes",
    "SELECT series, date AS date_prices, close AS close_usd,"
    " CASE WHEN loss > 0 THEN round(100 - 100 / (1 + gain / loss), 2) END AS rsi FROM ("
    " SELECT *, avg(greatest(coalesce(change, 0), 0)) OVER w AS gain,"
    " avg(greatest(-coalesce(change, 0), 0)) OVER w AS loss FROM ("
    " SELECT *, close - lag(close) OVER (PARTITION BY series ORDER BY date) AS change FROM ("
    f" SELECT series, date, close FROM x_latest ANTI JOIN {_CORRECTIONS} AS c USING (series, date)"
    f" UNION ALL SELECT series, date, close FROM {_CORRECTIONS}))"
    " WINDOW w AS (PARTITION BY series ORDER BY date ROWS 13 PRECEDING))",
)
def refresh_changes(spark, sf):
    """A second refresh that reads only what late corrections reach gives the full run's rows."""
    daily = refresh.read_table(spark, _corrected(sf), "daily")
    return daily.select("series", "date_prices", "close_usd", "rsi")


@query(
    "load_candles",
    "SELECT series, CAST(date AS TIMESTAMP) AS time, low, high, open, close, volume, date,"
    f" TIMESTAMP '{inputs.PROCESSED_AT}' AS ingest_date_time FROM x_bars",
)
def load_candles(spark, sf):
    """Responses landed in two deliveries, loaded into one bronze table."""
    target = scratch_path(spark, "bronze")
    responses = candle_payloads(spark, sf)
    for delivery in ("month < '1998-01-01'", "month >= '1998-01-01'"):
        bronze.load_candles(spark, responses.filter(delivery), target, inputs.PROCESSED_AT)
    return inputs.plain(tables.scan_table(spark, target).drop("month"))


def _landed(spark, sf):
    """Candle, rate and indicator responses of every pair, and two that no parser takes."""
    candles = candle_payloads(spark, sf).select(
        F.lit("prices").alias("kind"), F.col("series").alias("base"), F.lit("USD").alias("quote"),
        "payload",
    )
    rates = fx_payloads(spark, sf).select(
        F.lit("prices").alias("kind"), F.lit("USD").alias("base"), F.lit("CHF").alias("quote"), "payload"
    )
    supplied = indicator_payloads(spark, sf).where(
        F.col("ingest_date_time") == "2001-09-01 00:00:00"
    ).select(
        F.lit("indicators").alias("kind"), F.col("series").alias("base"), F.lit("USD").alias("quote"),
        "payload",
    )
    broken = candles.select("kind", "base", "quote").distinct().withColumn(
        "payload", F.lit('{"message": "limit"}')
    )
    return candles.unionAll(rates).unionAll(supplied).unionAll(broken)


@query(
    "load_all_pairs",
    "SELECT 'candles' AS feed, lower(series) AS series, date, close AS value FROM x_bars"
    " UNION ALL SELECT 'fx', 'usd', date, rate FROM x_rate_days WHERE flag = 'R'"
    " UNION ALL SELECT 'indicators', lower(series), CAST(d AS DATE), macd FROM x_raw_ind"
    " WHERE ingest_date_time = TIMESTAMP '2001-09-01 00:00:00'"
    " UNION ALL SELECT 'rejected', lower(series), NULL, NULL FROM x_bars GROUP BY series",
)
def load_all_pairs(spark, sf):
    """All pairs in one load, in two deliveries that overlap; refused responses are kept."""
    root = scratch_path(spark, "landing")
    rows = _landed(spark, sf)
    half = F.pmod(F.xxhash64("payload"), F.lit(3))
    landing.load_all(spark, rows.where(half < 2), root, inputs.PROCESSED_AT)
    landing.load_all(spark, rows.where(half > 0), root, inputs.PROCESSED_AT)

    def loaded(feed, value):
        return evolving.read(spark, f"{root}/{feed}").select(
            F.lit(feed).alias("feed"), "series", "date", F.col(value).alias("value")
        )

    refused = evolving.read(spark, f"{root}/rejected").select(
        F.lit("rejected"), F.lower("base"), F.lit(None).cast("date"), F.lit(None).cast("double")
    )
    return loaded("candles", "close").unionAll(loaded("fx", "rate")).unionAll(
        loaded("indicators", "macd")
    ).unionAll(refused)


@query(
    "plan_loaded_pairs",
    "SELECT table_name, CAST(s AS DATE) AS window_start, least(CAST(s + INTERVAL 1 DAY * step AS"
    " DATE), DATE '2002-01-01') AS window_end FROM (SELECT table_name, step,"
    " unnest(generate_series(lo, DATE '2002-01-01', INTERVAL 1 DAY * gap)) AS s FROM ("
    " SELECT lower(series) || '_usd_ohlcv' AS table_name, CAST(max(date) AS TIMESTAMP) AS lo,"
    " 200 AS step, 200 AS gap FROM x_bars GROUP BY series UNION ALL"
    " SELECT 'usd_chf_rates', CAST(max(date) AS TIMESTAMP), 365, 366 FROM x_rate_days"
    " WHERE flag = 'R')) WHERE s < DATE '2002-01-01'",
)
def plan_loaded_pairs(spark, sf):
    """Requests follow from the manifest and the bronze tables of a load of all pairs."""
    root = scratch_path(spark, "landing")
    landing.load_all(spark, _landed(spark, sf), root, inputs.PROCESSED_AT)
    return landing.next_requests(spark, root, "2002-01-01").select(
        "table_name", "window_start", "window_end"
    )


@query("refresh_from_empty", "SELECT * FROM x_bars")
def refresh_from_empty(spark, sf):
    """A catalog table a pair, declared before any row: some pairs load nothing at first."""
    bars = inputs.bars(spark, sf)
    place = scratch_path(spark, "catalog")
    database = scalars.schema_for(f"models/bronze/{place.rpartition('-')[2]}/pair.sql")
    names = {
        row["series"]: f"{database}.{row['table_name']}"
        for row in bars.select("series").distinct().select(
            "series",
            F.regexp_replace(
                scalars.series_table_name("series", F.lit("USD")), "[^a-z0-9_]", "_"
            ).alias("table_name"),
        ).collect()
    }
    for name in names.values():
        tables.declare_table(spark, name, bars.schema, f"{place}/{name}")
    first, *rest = sorted(names)
    for series in names:  # the first delivery has rows of one pair only
        rows = bars.where((F.col("series") == series) & (F.lit(series) == first))
        tables.load_table(rows, names[series])
    for series in rest:
        found = tables.scan_table(spark, tables.quoted(names[series]))
        if found.columns != bars.columns or not found.isEmpty():
            raise ValueError(f"{names[series]} is not an empty table of bars")
        tables.load_table(bars.where(F.col("series") == series), names[series])
    return functools.reduce(
        lambda a, b: a.unionByName(b),
        [tables.scan_table(spark, tables.quoted(name)) for name in names.values()],
    )


@query(
    "plan_requests",
    "SELECT table_name, CAST(s AS DATE) AS window_start, least(CAST(s + INTERVAL 200 DAY AS"
    " DATE), DATE '2002-01-01') AS window_end FROM (SELECT table_name,"
    " unnest(generate_series(lo, DATE '2002-01-01', INTERVAL 200 DAY)) AS s FROM (SELECT"
    " lower(series) || '_usd_ohlcv' AS table_name, max(date) AS lo FROM x_bars"
    " GROUP BY series)) WHERE s < DATE '2002-01-01'",
)
def plan_requests(spark, sf):
    """What to ask for next, from what is loaded."""
    bars = inputs.bars(spark, sf)
    pairs = bars.select(F.col("series").alias("base"), F.lit("USD").alias("quote")).distinct()
    pairs = pairs.withColumn("feed", scalars.feed_kind("base", "quote")).withColumn(
        "table_name", scalars.series_table_name("base", "quote")
    )
    loaded = bars.select(
        scalars.series_table_name("series", F.lit("USD")).alias("table_name"), "date"
    )
    return planning.plan_requests(pairs, loaded, "2002-01-01").select(
        "table_name", "window_start", "window_end"
    )
