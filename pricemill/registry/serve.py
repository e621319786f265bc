"""Serving queries over the silver and gold tables."""

from pyspark.sql import functions as F

from pricemill.constants import INDICATORS, MONTHLY_HISTORY_DAYS, OHLC, RESULT_ROW_CAP
from pricemill.functions import scalars
from pricemill.plans import serving
from pricemill.registry import inputs
from pricemill.registry.entries import part, query

_EUR = "CROSS JOIN x_rate_now"
part(
    "x_two",
    "SELECT * FROM x_obt QUALIFY row_number() OVER"
    " (PARTITION BY series ORDER BY date_prices DESC) <= 2",
)
_ORDERED = "(PARTITION BY series ORDER BY date_prices DESC)"


@query("latest_two_bars", "SELECT series, date_prices, close_usd FROM x_two")
def latest_two_bars(spark, sf):
    fact = inputs.obt(spark, sf).select("series", "date_prices", "close_usd")
    return serving.latest_two(fact)


def _metrics_sql(factor, join):
    return (
        "SELECT series, cur AS current_price, cur - prev AS change_24h,"
        " (cur - prev) / prev * 100 AS change_percent_24h, volume AS volume_24h,"
        " hi AS high_24h, lo AS low_24h, coalesce(nullif(rsi, 0), 50) AS rsi,"
        " CASE WHEN cur - prev >= 0 THEN 'up' ELSE 'down' END AS trend,"
        " cur - prev > 0 AS is_positive FROM (SELECT series,"
        f" close_usd{factor} AS cur, lead(close_usd) OVER {_ORDERED}{factor} AS prev,"
        f" high_usd{factor} AS hi, low_usd{factor} AS lo, volume, rsi,"
        f" row_number() OVER {_ORDERED} AS rn FROM x_two {join}) WHERE rn = 1"
    )


@query("current_metrics", _metrics_sql("", ""))
def current_metrics(spark, sf):
    return serving.current_metrics(inputs.obt(spark, sf), inputs.usd_rates(spark, sf))


@query("current_metrics_eur", _metrics_sql(" * x_rate_now.rate_usd_eur", _EUR))
def current_metrics_eur(spark, sf):
    return serving.current_metrics(inputs.obt(spark, sf), inputs.usd_rates(spark, sf), "EUR")


def _history_sql(source, date, volume, status, where, currency=None):
    rate = f" * r.rate_usd_{currency}" if currency else ""
    cells = [f"coalesce({m}_usd{rate}, 0) AS {m}" for m in OHLC]
    cells += [
        f"nullif({m}_usd, 0){rate} AS {m}" if currency else f"{m}_usd AS {m}" for m in INDICATORS
    ]
    join = "CROSS JOIN x_rate_now r" if currency else ""
    return (
        f"SELECT series, {date} AS date, {', '.join(cells)}, {volume} AS volume,"
        f" coalesce(rsi, 0) AS rsi, {status} AS rsi_status FROM {source} {join} WHERE {where}"
    )


_RECENT = "date_prices >= DATE '2001-08-01' - 180"
_LABEL = (
    "CASE WHEN rsi > 70 THEN 'Overbought' WHEN rsi < 30 THEN 'Oversold' ELSE 'Neutral' END"
)


def _history(spark, sf, **how):
    monthly = how.get("days", 0) >= MONTHLY_HISTORY_DAYS
    return serving.history(
        None if monthly else inputs.obt(spark, sf),
        inputs.gold_table(spark, sf, "month") if monthly else None,
        inputs.usd_rates(spark, sf), as_of=inputs.AS_OF, **how,
    )


@query("hist_daily", _history_sql("x_obt", "date_prices", "volume", "rsi_status", _RECENT))
def hist_daily(spark, sf):
    return _history(spark, sf, days=180)


@query(
    "hist_last_n_days",
    _history_sql("x_obt", "date_prices", "volume", "rsi_status", _RECENT, "eur"),
)
def hist_last_n_days(spark, sf):
    return _history(spark, sf, days=180, currency="EUR")


@query(
    "hist_between",
    _history_sql(
        "x_obt", "date_prices", "volume", "rsi_status",
        "date_prices BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'", "chf",
    ),
)
def hist_between(spark, sf):
    return _history(spark, sf, start="1997-01-01", end="1998-12-31", currency="CHF")


@query(
    "hist_monthly",
    _history_sql(
        "x_month_rsi", "month_start_date", "CAST(0 AS DOUBLE)", _LABEL,
        "month_start_date >= DATE '2001-08-01' - 3650",
    ),
)
def hist_monthly(spark, sf):
    return _history(spark, sf, days=3650)


def _last12_sql(unit, key):
    return (
        f"SELECT series, {key} AS period, close_usd AS avg_price, high_usd AS max_price,"
        f" low_usd AS min_price, CAST(0 AS DOUBLE) AS total_volume FROM x_{unit}"
        f" QUALIFY row_number() OVER (PARTITION BY series ORDER BY {key} DESC) <= 12"
    )


@query("agg_last12_week", _last12_sql("week", "iso_week_start_date"))
def agg_last12_week(spark, sf):
    return serving.aggregated({"week": inputs.gold_table(spark, sf, "week")}, "weekly")


@query("agg_last12_month", _last12_sql("month", "month_start_date"))
def agg_last12_month(spark, sf):
    return serving.aggregated({"month": inputs.gold_table(spark, sf, "month")}, "monthly")


@query("agg_last12_quarter", _last12_sql("quarter", "quarter_start_date"))
def agg_last12_quarter(spark, sf):
    return serving.aggregated({"quarter": inputs.gold_table(spark, sf, "quarter")}, "quarterly")


def _forecast(spark, sf, currency="USD"):
    return serving.forecast(inputs.forecasts(spark, sf), inputs.usd_rates(spark, sf), currency)


@query("forecast_latest", "SELECT * FROM x_earliest")
def forecast_latest(spark, sf):
    return _forecast(spark, sf)


def _serve(spark, sf, **request):
    """Answers come from all layers; Spark runs only what the request needs."""
    tables = {
        "fact": inputs.obt(spark, sf), "usd_to_other": inputs.usd_rates(spark, sf),
        "forecasts": inputs.forecasts(spark, sf),
        "gold": {u: inputs.gold_table(spark, sf, u) for u in ("week", "month", "quarter")},
    }
    return serving.serve(request, tables, inputs.AS_OF)


@query("serve_metrics", _metrics_sql("", ""))
def serve_metrics(spark, sf):
    return _serve(spark, sf, type="metrics")


@query(
    "serve_history",
    _history_sql(
        "x_obt", "date_prices", "volume", "rsi_status",
        "date_prices BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'",
    ),
)
def serve_history(spark, sf):
    return _serve(spark, sf, type="history", startDate="1997-01-01", endDate="1998-12-31")


@query("serve_aggregated", _last12_sql("quarter", "quarter_start_date"))
def serve_aggregated(spark, sf):
    return _serve(spark, sf, type="aggregated", period="quarterly")


@query("serve_forecast", "SELECT * FROM x_earliest")
def serve_forecast(spark, sf):
    return _serve(spark, sf, type="forecast")


@query(
    "forecast_eur",
    "SELECT series, date_prices, predicted_at, "
    + ", ".join(f"{p} * rate_usd_eur AS {p}" for p in serving.FORECAST_PRICES)
    + f" FROM x_earliest {_EUR}",
)
def forecast_eur(spark, sf):
    return _forecast(spark, sf, "EUR")


@query(
    "forecast_slice",
    "SELECT *, 'yes' AS shown FROM x_earliest QUALIFY row_number() OVER"
    " (PARTITION BY series ORDER BY date_prices) <= 30",
)
def forecast_slice(spark, sf):
    """One month, shown because the range asked for ends on or after today."""
    rows = serving.forecast_slice(_forecast(spark, sf), "1m")
    applies = serving.forecast_applies("2001-08-02", inputs.AS_OF)
    return rows.filter(applies).withColumn("shown", F.lit("yes"))


@query(
    "forecast_monthly_first",
    "SELECT * FROM x_earliest QUALIFY row_number() OVER (PARTITION BY series,"
    " date_trunc('month', date_prices) ORDER BY date_prices) = 1",
)
def forecast_monthly_first(spark, sf):
    return serving.forecast_slice(_forecast(spark, sf), "all")


@query(
    "period_stats",
    "SELECT series, min(date) AS start_date, max(date) AS end_date, arg_min(open, date) AS"
    " start_open, arg_max(close, date) AS end_close, max(high) AS period_high, min(low) AS"
    " period_low, (arg_max(close, date) - arg_min(open, date)) / arg_min(open, date) * 100"
    " AS variation FROM x_bars GROUP BY series",
)
def period_stats(spark, sf):
    return serving.period_stats(inputs.bars(spark, sf))


# Bars in which some lows are not positive.
part(
    "x_bad_lows",
    "SELECT * REPLACE (CASE WHEN volume >= 2 THEN -low ELSE low END AS low) FROM x_bars",
)
_REPAIRED = "CASE WHEN low <= 0 THEN list_sort([open, high, close])[2] ELSE low END"


def _bad_lows(df):
    return df.withColumn(
        "low", F.when(F.col("volume") >= 2, -F.col("low")).otherwise(F.col("low"))
    )


@query("repair_low", f"SELECT * REPLACE ({_REPAIRED} AS low) FROM x_bad_lows")
def repair_low(spark, sf):
    return serving.repair_lows(_bad_lows(inputs.bars(spark, sf)))


def _points_sql(names):
    return " UNION ALL ".join(
        f"SELECT series, date_prices AS date, '{n}' AS indicator, {n}_usd AS value FROM x_obt"
        f" WHERE {n}_usd IS NOT NULL" for n in names
    )


def _chart_rows(spark, sf):
    return inputs.obt(spark, sf).selectExpr(
        "series", "date_prices AS date", "volume", "rsi",
        *[f"{m}_usd AS {m}" for m in (*OHLC, *INDICATORS)],
    )


@query("indicator_points", _points_sql(["macd", "macd_signal", "macd_hist"]))
def indicator_points(spark, sf):
    return serving.indicator_points(_chart_rows(spark, sf), "macd")


@query(
    "chart_series",
    " UNION ALL ".join(
        f"SELECT series, date, '{m}' AS indicator, "
        + (_REPAIRED if m == "low" else m) + " AS value FROM (SELECT series, date_prices AS"
        " date, CASE WHEN volume >= 2 THEN -low_usd ELSE low_usd END AS low, high_usd AS high,"
        " open_usd AS open, close_usd AS close FROM x_obt)"
        for m in OHLC
    )
    + " UNION ALL SELECT series, CAST(date_trunc('month', date_prices) AS DATE) + 14, 'rsi',"
    " round(avg(coalesce(nullif(rsi, 0), 50)), 6) FROM x_obt GROUP BY 1, 2"
    " UNION ALL " + _points_sql(INDICATORS),
)
def chart_series(spark, sf):
    points = serving.chart_series(_bad_lows(_chart_rows(spark, sf)))
    rounded = F.when(F.col("indicator") == "rsi", F.round("value", 6)).otherwise(F.col("value"))
    return points.withColumn("value", rounded)


@query(
    "top_n_latest",
    "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders"
    " ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1000",
)
def top_n_latest(spark, sf):
    orders = inputs.table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return serving.newest_rows(orders, ["o_orderdate", "o_orderkey"], 1000)


@query(
    "serve_cap",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem"
    " ORDER BY ALL LIMIT 10000",
)
def serve_cap(spark, sf):
    names = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = inputs.table(spark, sf, "lineitem").select(*names)
    return serving.capped(rows, names, RESULT_ROW_CAP)


@query(
    "param_query",
    "SELECT o_orderpriority, count(*) AS row_count, max(o_totalprice) AS top_price FROM orders"
    " WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'"
    " GROUP BY o_orderpriority",
)
def param_query(spark, sf):
    """SQL text with bound parameters; values are never pasted into the text."""
    return spark.sql(
        "SELECT o_orderpriority, count(*) AS row_count, max(o_totalprice) AS top_price"
        " FROM {orders} WHERE o_orderdate >= CAST(:start AS TIMESTAMP_NTZ)"
        " AND o_orderdate < CAST(:end AS TIMESTAMP_NTZ) + INTERVAL 1 DAY"
        " GROUP BY o_orderpriority",
        args={"start": "1997-01-01", "end": "1998-12-31"},
        orders=inputs.table(spark, sf, "orders"),
    )


@query(
    "defaults_fill",
    "SELECT event_id, coalesce(nullif(k, 0), 50) AS value FROM (SELECT event_id,"
    " CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)",
)
def defaults_fill(spark, sf):
    k = F.get_json_object("props", "$.k").try_cast("double")
    return inputs.table(spark, sf, "events").select(
        "event_id", scalars.truthy_or(k, 50).alias("value")
    )
