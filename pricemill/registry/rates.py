"""Exchange rates and conversion."""

from pyspark.sql import functions as F

from pricemill.constants import CALENDAR_START, OHLC
from pricemill.operators import calendar, fx, longseries
from pricemill.plans import silver
from pricemill.registry import inputs
from pricemill.registry.entries import query, rounded

_RATES = ["rate_usd_chf", "rate_usd_eur"]


def _full(spark, sf):
    return fx.full_outer_rates(
        inputs.day_rates(spark, sf, "R"), inputs.day_rates(spark, sf, "A")
    )


@query("fx_full_outer", "SELECT * FROM x_full")
def fx_full_outer(spark, sf):
    return inputs.plain(_full(spark, sf))


@query("fx_spine_ffill", "SELECT * FROM x_usd")
def fx_spine_ffill(spark, sf):
    filled = fx.spine_fill(_full(spark, sf), inputs.days(spark, sf), _RATES)
    return filled.dropna(subset=_RATES)


@query("usd_to_other", "SELECT date_rates, rate_usd_chf, rate_usd_eur, TIMESTAMP"
       f" '{inputs.PROCESSED_AT}' AS update_date_time, '{inputs.BATCH}' AS dbt_batch_id FROM x_usd")
def usd_to_other(spark, sf):
    return inputs.plain(inputs.usd_rates(spark, sf))


_ALL_DAYS = (
    "(SELECT CAST(unnest(generate_series(CAST(min(d) AS TIMESTAMP), CAST(max(d) AS TIMESTAMP),"
    " INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders"
    " UNION ALL SELECT CAST(ts AS DATE) FROM events))"
)


def _order_and_event_days(spark, sf):
    """Every day from the first order to the last event, far before and behind the bound."""
    both = inputs.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")).unionAll(
        inputs.table(spark, sf, "events").select(F.to_date("ts"))
    )
    return calendar.calendar_between(both, "d")


@query(
    "calendar_bound",
    f"SELECT date FROM {_ALL_DAYS} WHERE date BETWEEN DATE '2009-12-31' AND DATE '2024-01-15'",
)
def calendar_bound(spark, sf):
    """The calendar of the rates begins with a fixed day and ends with today."""
    return calendar.bounded(_order_and_event_days(spark, sf), "2024-01-15").select("date")


@query(
    "usd_to_other_bounded",
    "SELECT date_rates, rate_usd_chf, rate_usd_eur FROM (SELECT d.date AS date_rates,"
    + ",".join(
        f" last_value({c} IGNORE NULLS) OVER (ORDER BY d.date) AS {c}" for c in _RATES
    )
    + f" FROM {_ALL_DAYS} d LEFT JOIN (SELECT * REPLACE (CAST(date_rates + INTERVAL 5000 DAY AS"
    " DATE) AS date_rates) FROM x_full) f ON d.date = f.date_rates"
    " WHERE d.date BETWEEN DATE '2009-12-31' AND DATE '2012-01-31')"
    " WHERE rate_usd_chf IS NOT NULL AND rate_usd_eur IS NOT NULL",
)
def usd_to_other_bounded(spark, sf):
    """Rates moved by 5000 days, so that they reach over both bounds of the calendar."""
    chf, eur = (
        inputs.raw_rates(spark, sf, flag).withColumn("date", F.date_add("date", 5000))
        for flag in "RA"
    )
    rates = silver.usd_to_other(
        chf, eur, _order_and_event_days(spark, sf), inputs.BATCH, start=CALENDAR_START,
        as_of="2012-01-31", processed_at=inputs.PROCESSED_AT,
    )
    return rates.select("date_rates", *_RATES)


@query(
    "ffill",
    "SELECT series, tick, last_value(CASE WHEN close > 40000 THEN close END IGNORE NULLS)"
    " OVER (PARTITION BY series ORDER BY tick) AS close FROM x_line",
)
def ffill(spark, sf):
    """Forward fill over tick-length series (small prices count as missing)."""
    ticks = inputs.line_ticks(spark, sf)
    gaps = ticks.withColumn("close", F.when(F.col("close") > 40000, F.col("close")))
    return longseries.forward_fill(gaps, "series", "tick", ["close"])


@query(
    "asof_rate",
    "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, o_totalprice, rate_usd_chf,"
    " rate_usd_eur FROM orders LEFT JOIN x_filled ON CAST(o_orderdate AS DATE) = date_rates",
)
def asof_rate(spark, sf):
    orders = inputs.table(spark, sf, "orders").select(
        "o_orderkey", F.to_date("o_orderdate").alias("date"), "o_totalprice"
    )
    return fx.asof_rates(orders, _full(spark, sf), inputs.days(spark, sf), "date")


@query("latest_rates", "SELECT * FROM x_rate_now")
def latest_rates(spark, sf):
    return fx.latest_rates(inputs.usd_rates(spark, sf))


@query(
    "join_bars_rates",
    "SELECT b.*, rate_usd_chf, rate_usd_eur FROM x_bars b LEFT JOIN x_usd ON date = date_rates",
)
def join_bars_rates(spark, sf):
    return fx.join_rates(inputs.bars(spark, sf), inputs.usd_rates(spark, sf), "date")


_CONVERTED = (
    "SELECT date, series, volume, rate_usd_chf, rate_usd_eur, "
    + ", ".join(f"{m} AS {m}_usd" for m in OHLC) + ", "
    + ", ".join(
        f"{rounded(f'{m} * rate_usd_{c}')} AS {m}_{c}" for c in ("chf", "eur") for m in OHLC
    )
    + " FROM x_bars LEFT JOIN x_usd ON date = date_rates"
)


@query("convert_daily", _CONVERTED)
def convert_daily(spark, sf):
    return fx.convert_daily(
        inputs.bars(spark, sf), inputs.usd_rates(spark, sf), "date", OHLC
    )


@query("expand_currencies", _CONVERTED)
def expand_currencies(spark, sf):
    rated = fx.join_rates(inputs.bars(spark, sf), inputs.usd_rates(spark, sf), "date")
    return fx.expand_currencies(rated, OHLC)


@query(
    "unpivot_currencies",
    " UNION ALL ".join(
        f"SELECT series, date_prices, '{c}' AS currency, "
        + ", ".join(f"{m}_{c} AS {m}" for m in inputs.MEASURES)
        + " FROM x_obt"
        for c in inputs.CURRENCIES
    ),
)
def unpivot_currencies(spark, sf):
    return fx.unpivot_currencies(inputs.obt(spark, sf), ["series", "date_prices"])


@query(
    "convert_latest",
    "SELECT series, date, volume, "
    + ", ".join(f"{m} * rate_usd_eur AS {m}" for m in OHLC)
    + " FROM x_bars CROSS JOIN x_rate_now",
)
def convert_latest(spark, sf):
    return fx.convert_latest(
        inputs.bars(spark, sf), inputs.usd_rates(spark, sf), OHLC, "EUR"
    )
