"""Logical inputs (ticks, candles, rates, indicators, forecasts) made from the given tables.

Each function has a twin among the named SQL parts below it.
"""

import functools

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricemill.operators import bars as bar_ops
from pricemill.operators.calendar import calendar_between
from pricemill.operators.dedupe import dedupe_latest
from pricemill.plans import gold, silver
from pricemill.registry.entries import part, rounded, rsi_parts
from pricemill.session import scratch_path

AS_OF = "2001-08-01"
PROCESSED_AT = "2001-12-31 00:00:00"
BATCH = "batch-1"


@functools.cache
def _schema(sf, name):
    return SparkSession.active().read.parquet(f"{sf}/{name}.parquet").schema


def table(spark, sf, name):
    """A given table; its schema is read from the files once per process."""
    return spark.read.schema(_schema(sf, name)).parquet(f"{sf}/{name}.parquet")


def plain(df):
    """Timestamps without zone, as the tables hold them."""
    return df.select(
        *[
            F.col(f.name).cast("timestamp_ntz").alias(f.name)
            if isinstance(f.dataType, T.TimestampType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def order_ticks(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("series"),
        F.to_date("o_orderdate").alias("date"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderkey").alias("tick"),
    )


part(
    "x_ticks",
    "SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS date,"
    " o_totalprice AS price, o_orderkey AS tick FROM orders",
)


def bars(spark, sf):
    return bar_ops.from_ticks(order_ticks(spark, sf), "series", "date", "price", "tick")


part(
    "x_bars",
    "SELECT series, date, min(price) AS low, max(price) AS high,"
    " arg_min(price, tick) AS open, arg_max(price, tick) AS close,"
    " CAST(count(*) AS DOUBLE) AS volume FROM x_ticks GROUP BY series, date",
)


def line_ticks(spark, sf):
    """Tick-length series: three flags, a third of all rows each."""
    return (
        table(spark, sf, "lineitem")
        .groupBy(
            F.col("l_returnflag").alias("series"),
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("tick"),
        )
        .agg(F.max("l_extendedprice").alias("close"))
    )


part(
    "x_line",
    "SELECT l_returnflag AS series, l_orderkey * 8 + l_linenumber AS tick,"
    " max(l_extendedprice) AS close FROM lineitem GROUP BY 1, 2",
)


def event_ticks(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_type").alias("series"), "ts", F.col("value").alias("price"), "event_id"
    )


def event_bars(spark, sf):
    """Daily bars of the events; events of one time go by their id."""
    ticks = event_ticks(spark, sf)
    return bar_ops.from_ticks(ticks, "series", "ts", "price", "ts", tie="event_id")


# Overlapping loads of the same day: one candle per order status, the status telling the load.
_LOADS = {"F": "2001-09-01 00:00:00", "O": "2001-09-02 00:00:00", "P": "2001-09-03 00:00:00"}


def raw_candles(spark, sf):
    loaded = F.create_map(*[F.lit(v) for pair in _LOADS.items() for v in pair])
    ticks = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("series"),
        F.to_date("o_orderdate").alias("date"),
        F.col("o_orderstatus").alias("load"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderkey").alias("tick"),
    )
    candles = bar_ops.from_ticks(ticks, ["series", "load"], "date", "price", "tick")
    return candles.withColumn("ingest_date_time", loaded[F.col("load")].cast("timestamp")).drop(
        "load"
    )


part(
    "x_raw",
    "SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS date,"
    " min(o_totalprice) AS low, max(o_totalprice) AS high,"
    " arg_min(o_totalprice, o_orderkey) AS open, arg_max(o_totalprice, o_orderkey) AS close,"
    " CAST(count(*) AS DOUBLE) AS volume,"
    " CASE o_orderstatus"
    + "".join(f" WHEN '{k}' THEN TIMESTAMP '{v}'" for k, v in _LOADS.items())
    + " END AS ingest_date_time FROM orders GROUP BY o_orderpriority, 2, o_orderstatus",
)
part(
    "x_latest",
    "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY series, date"
    " ORDER BY ingest_date_time DESC) AS rn FROM x_raw) WHERE rn = 1",
)


def all_rates(spark, sf):
    """Weekday rates of both currencies in two overlapping loads (by line status).

    Flag R is one currency, every other flag the second. A weekend's lines belong to Friday.
    """
    cents = F.round(F.col("l_discount") * 100).cast("long")
    day = F.to_date("l_shipdate")
    weekday = F.date_sub(day, F.greatest(F.weekday(day) - 4, F.lit(0)))
    return (
        table(spark, sf, "lineitem")
        .groupBy(
            (F.col("l_returnflag") == "R").alias("mine"), weekday.alias("date"), "l_linestatus"
        )
        .agg(F.sum(cents * 100).alias("total"), F.count(F.lit(1)).alias("lines"))
        .select(
            "mine",
            "date",
            ((F.lit(8000) + F.expr("total div lines")).cast("double") / 10000).alias("rate"),
            F.when(F.col("l_linestatus") == "O", "2001-12-01 06:00:00")
            .otherwise("2001-12-02 06:00:00").cast("timestamp").alias("ingest_date_time"),
        )
    )


def rates_of(rates, flag):
    """The rows of one currency."""
    return rates.where(F.col("mine") if flag == "R" else ~F.col("mine")).drop("mine")


def raw_rates(spark, sf, flag):
    return rates_of(all_rates(spark, sf), flag)


part(
    "x_raw_rates",
    "SELECT CASE WHEN l_returnflag = 'R' THEN 'R' ELSE 'A' END AS flag,"
    " CAST(l_shipdate AS DATE) - CAST(greatest(isodow(l_shipdate) - 5, 0) AS INTEGER) AS date,"
    " CAST(8000 + sum(CAST(round(l_discount * 100) AS BIGINT) * 100) // count(*) AS DOUBLE)"
    " / CAST(10000 AS DOUBLE) AS rate,"
    " CASE l_linestatus WHEN 'O' THEN TIMESTAMP '2001-12-01 06:00:00'"
    " ELSE TIMESTAMP '2001-12-02 06:00:00' END AS ingest_date_time"
    " FROM lineitem GROUP BY 1, 2, l_linestatus",
)
part(
    "x_rate_days",
    "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY flag, date"
    " ORDER BY ingest_date_time DESC) AS rn FROM x_raw_rates) WHERE rn = 1",
)


def day_rates(spark, sf, flag):
    return dedupe_latest(raw_rates(spark, sf, flag), "date", "ingest_date_time")


def days(spark, sf):
    """The calendar from the first to the last order."""
    return calendar_between(order_ticks(spark, sf), "date")


part(
    "x_days",
    "SELECT d AS date, CAST(date_trunc('week', d) AS DATE) AS iso_week_start_date,"
    " CAST(date_trunc('month', d) AS DATE) AS month_start_date,"
    " CAST(date_trunc('quarter', d) AS DATE) AS quarter_start_date,"
    " CAST(date_trunc('year', d) AS DATE) AS year_start_date FROM ("
    "SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d FROM ("
    "SELECT min(date) AS lo, max(date) AS hi FROM x_ticks))",
)


def usd_rates(spark, sf):
    return silver.usd_to_other(
        raw_rates(spark, sf, "R"), raw_rates(spark, sf, "A"), days(spark, sf),
        BATCH, processed_at=PROCESSED_AT,
    )


part(
    "x_full",
    "SELECT coalesce(c.date, e.date) AS date_rates, c.rate AS rate_usd_chf,"
    " e.rate AS rate_usd_eur,"
    " least(c.ingest_date_time, e.ingest_date_time) AS ingest_date_time"
    " FROM (SELECT * FROM x_rate_days WHERE flag = 'R') c"
    " FULL JOIN (SELECT * FROM x_rate_days WHERE flag = 'A') e ON c.date = e.date",
)
part(
    "x_filled",
    "SELECT d.date AS date_rates,"
    + ", ".join(
        f" last_value({c} IGNORE NULLS) OVER (ORDER BY d.date) AS {c}"
        for c in ("rate_usd_chf", "rate_usd_eur", "ingest_date_time")
    )
    + " FROM x_days d LEFT JOIN x_full f ON d.date = f.date_rates",
)
part(
    "x_usd",
    "SELECT date_rates, rate_usd_chf, rate_usd_eur FROM x_filled"
    " WHERE rate_usd_chf IS NOT NULL AND rate_usd_eur IS NOT NULL",
)

# Supplied indicators: simple functions of the candle, so both sides agree to the last bit.
_SUPPLIED = {
    "rsi": "volume",
    "macd": "close - open",
    "macdsignal": "(high - low) / 8",
    "macdhist": "(close - open) - (high - low) / 8",
    "sma7": "(open + close) / 2",
    "sma50": "(high + low) / 2",
    "sma200": "(open + close) / 4",
    "ema7": "(high + low) / 4",
    "ema50": "close * 0.5",
    "ema200": "open * 0.5",
}


def raw_indicators(spark, sf):
    return indicators_of(raw_candles(spark, sf))


def indicators_of(candles):
    """Indicator rows, in the same overlapping loads as the candles."""
    return candles.select(
        "series",
        F.date_format("date", "yyyy-MM-dd").alias("d"),
        (F.unix_date("date").cast("long") * 86400).cast("string").alias("unixTs"),
        *[F.expr(e).alias(n) for n, e in _SUPPLIED.items()],
        "ingest_date_time",
    )


@functools.cache
def _bronze_paths(sf):
    """Folders of the stored candles and rates of a data folder, made once per process."""
    spark = SparkSession.active()
    found = {"candles": raw_candles(spark, sf), "rates": all_rates(spark, sf)}
    paths = {name: scratch_path(spark, name) for name in found}
    for name, rows in found.items():
        rows.write.parquet(paths[name])
    return paths


def bronze(spark, sf):
    """What a refresh reads: (candles, indicators, rates R, rates A, days).

    Candles and rates are stored first, so that every step of every refresh reads bars and days,
    and the given tables are read once whatever the number of refreshes and steps.
    """
    paths = _bronze_paths(sf)
    candles, rates = (spark.read.parquet(paths[name]) for name in ("candles", "rates"))
    days = calendar_between(candles, "date")
    return (
        candles, indicators_of(candles), rates_of(rates, "R"), rates_of(rates, "A"), days
    )


part(
    "x_raw_ind",
    "SELECT series, strftime(date, '%Y-%m-%d') AS d,"
    " CAST(CAST(epoch(CAST(date AS TIMESTAMP)) AS BIGINT) AS VARCHAR) AS unix_ts, "
    + ", ".join(f"{e} AS {n}" for n, e in _SUPPLIED.items())
    + ", ingest_date_time FROM x_raw",
)

_RENAMED = {
    "macd": "macd", "macdsignal": "macd_signal", "macdhist": "macd_hist",
    "sma7": "sma_7", "sma50": "sma_50", "sma200": "sma_200",
    "ema7": "ema_7", "ema50": "ema_50", "ema200": "ema_200",
}
part(
    "x_fact",
    "SELECT series, d AS date_indicators, "
    + ", ".join(f"{rounded(s)} AS {n}" for s, n in _RENAMED.items())
    + " FROM (SELECT *, row_number() OVER (PARTITION BY series, d"
    " ORDER BY ingest_date_time DESC) AS rn FROM x_raw_ind) WHERE rn = 1",
)


def fact_indicators(spark, sf):
    return silver.fact_indicators(
        raw_indicators(spark, sf), BATCH, processed_at=PROCESSED_AT
    )


def obt(spark, sf):
    return silver.obt_fact_day(
        raw_candles(spark, sf), fact_indicators(spark, sf), usd_rates(spark, sf),
        BATCH, processed_at=PROCESSED_AT,
    )


rsi_parts("x_daily", "x_latest", "date", "close")

MEASURES = ("low", "high", "open", "close", *_RENAMED.values())
CURRENCIES = ("usd", "chf", "eur")
part(
    "x_obt",
    "SELECT b.series, b.date AS date_prices, "
    + ", ".join(f"{m} AS {m}_usd" for m in MEASURES)
    + ", volume, rsi, rsi_status, rate_usd_chf, rate_usd_eur, "
    + ", ".join(
        f"{rounded(f'{m} * rate_usd_{c}')} AS {m}_{c}"
        for c in ("chf", "eur") for m in MEASURES
    )
    + f", TIMESTAMP '{PROCESSED_AT}' AS ingest_date_time, '{BATCH}' AS dbt_batch_id"
    " FROM x_daily_rsi b"
    " LEFT JOIN x_fact f ON f.series = b.series AND CAST(f.date_indicators AS DATE) = b.date"
    " LEFT JOIN x_usd r ON r.date_rates = b.date",
)

_KEYS = {
    "week": "iso_week_start_date", "month": "month_start_date",
    "quarter": "quarter_start_date", "year": "year_start_date",
}


def rollup_sql(source, unit, order, columns):
    """Rollup SQL: first/last by window functions, so NULLs on the last day are kept."""
    key = _KEYS[unit]
    coarser = list(_KEYS.values())[list(_KEYS).index(unit) + 1:]
    picks, results = [], [f"min({c}) AS {c}" for c in coarser]
    for column in columns:
        measure = column
        for c in CURRENCIES:
            measure = measure.removesuffix(f"_{c}")
        if measure in ("low", "high"):
            picks.append(column)
            results.append(f"{'min' if measure == 'low' else 'max'}({column}) AS {column}")
        else:
            way = "ASC" if measure == "open" else "DESC"
            picks.append(
                f"first_value({column}) OVER (PARTITION BY series, {key} ORDER BY {order} {way})"
                f" AS {column}"
            )
            results.append(f"max({column}) AS {column}")
    return (
        f"SELECT series, {key}, {', '.join(results)} FROM (SELECT series, {key}, "
        + "".join(f"{c}, " for c in coarser)
        + f"{', '.join(picks)} FROM {source}) GROUP BY series, {key}"
    )


WIDE = tuple(f"{m}_{c}" for c in CURRENCIES for m in MEASURES)
part(
    "x_obt_days",
    "SELECT o.*, d.* EXCLUDE (date) FROM x_obt o LEFT JOIN x_days d ON o.date_prices = d.date",
)
part("x_week", rollup_sql("x_obt_days", "week", "date_prices", WIDE))
for _unit in ("month", "quarter", "year"):
    part(f"x_{_unit}", rollup_sql("x_week", _unit, "iso_week_start_date", WIDE))
for _unit, _key in _KEYS.items():
    rsi_parts(f"x_{_unit}", f"x_{_unit}", _key, "close_usd")


def gold_table(spark, sf, unit):
    week = gold.aggregate(obt(spark, sf), "week", BATCH, processed_at=PROCESSED_AT)
    if unit == "week":
        return week
    return gold.aggregate(week, unit, BATCH, processed_at=PROCESSED_AT)


def forecasts(spark, sf):
    price = F.col("o_totalprice")
    return table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("series"),
        F.to_date("o_orderdate").alias("date_prices"),
        price.alias("predicted_close_usd"),
        (price * 0.9).alias("predicted_close_usd_lower"),
        (price * 1.1).alias("predicted_close_usd_upper"),
        F.col("o_orderkey").alias("predicted_at"),
    )


part(
    "x_forecasts",
    "SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS date_prices,"
    " o_totalprice AS predicted_close_usd,"
    " o_totalprice * CAST(0.9 AS DOUBLE) AS predicted_close_usd_lower,"
    " o_totalprice * CAST(1.1 AS DOUBLE) AS predicted_close_usd_upper,"
    " o_orderkey AS predicted_at FROM orders",
)
part(
    "x_newest",
    "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY series,"
    " date_prices ORDER BY predicted_at DESC) AS rn FROM x_forecasts) WHERE rn = 1",
)
part(
    "x_earliest",
    "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY series"
    " ORDER BY date_prices) AS rn FROM x_newest) WHERE rn <= 365",
)
part(
    "x_rate_now",
    "SELECT rate_usd_chf, rate_usd_eur FROM x_usd ORDER BY date_rates DESC LIMIT 1",
)
rsi_parts("x_bars", "x_bars", "date", "close")
