"""Data quality checks."""

from pyspark.sql import functions as F

from pricemill.operators import quality
from pricemill.plans import declared
from pricemill.registry import inputs
from pricemill.registry.entries import query

_SERIES_COLUMNS = ("date_prices", "close_usd", "volume", "rsi", "macd_usd", "rate_usd_chf")


def _count_sql(name, rows):
    return " UNION ALL ".join(
        f"SELECT '{name}' AS \"check\", '{label}' AS \"column\","
        f" count(*) FILTER (WHERE {condition}) AS failing FROM {source}"
        for label, condition, source in rows
    )


_NOT_NULL = _count_sql("not_null", [(c, f"{c} IS NULL", "x_obt") for c in _SERIES_COLUMNS])
_POSITIVE_COLUMNS = ("low_usd", "high_usd", "close_usd", "volume", "rate_usd_chf", "macd_usd")
_POSITIVE = _count_sql(
    "positive_value", [(c, f"{c} <= 0", "x_obt") for c in _POSITIVE_COLUMNS]
)
_PERCENT = _count_sql("percentage_range", [("rsi", "rsi < 0 OR rsi > 100", "x_obt")])
_UNIQUE = (
    "SELECT 'unique' AS \"check\", 'series,date' AS \"column\", count(*) AS failing FROM"
    " (SELECT series, date FROM x_ticks GROUP BY ALL HAVING count(*) > 1)"
)
_OHLC = _count_sql(
    "ohlc",
    [("ohlc", "high < open OR high < close OR low > open OR low > close", "x_bars")],
)


@query("dq_not_null", _NOT_NULL)
def dq_not_null(spark, sf):
    return quality.run_checks(
        inputs.obt(spark, sf), [quality.not_null(c) for c in _SERIES_COLUMNS]
    )


@query("dq_unique", _UNIQUE)
def dq_unique(spark, sf):
    return quality.unique(inputs.order_ticks(spark, sf), ["series", "date"])


@query("dq_positive", _POSITIVE)
def dq_positive(spark, sf):
    return quality.run_checks(
        inputs.obt(spark, sf), [quality.positive(c) for c in _POSITIVE_COLUMNS]
    )


@query("dq_percentage", _PERCENT)
def dq_percentage(spark, sf):
    return quality.run_checks(inputs.obt(spark, sf), [quality.percentage("rsi")])


@query("dq_ohlc", _OHLC)
def dq_ohlc(spark, sf):
    return quality.run_checks(inputs.bars(spark, sf), [quality.ohlc()])


@query(
    "dq_ohlc_nulls",
    _count_sql(
        "ohlc_nulls",
        [("ohlc", "low_eur IS NULL OR close_eur IS NULL OR high_eur IS NULL"
          " OR open_eur IS NULL", "x_obt")],
    ),
)
def dq_ohlc_nulls(spark, sf):
    check = quality.ohlc_nulls(("open_eur", "high_eur", "low_eur", "close_eur"))
    return quality.run_checks(inputs.obt(spark, sf), [check])


@query(
    "dq_date_format",
    _count_sql(
        "date_format",
        [("d", r"NOT regexp_matches(d, '^\d{4}-\d{2}-\d{2}')", "x_raw_ind"),
         ("unixTs", r"NOT regexp_matches(unix_ts, '^\d{4}-\d{2}-\d{2}')", "x_raw_ind")],
    ),
)
def dq_date_format(spark, sf):
    checks = [quality.date_text("d"), quality.date_text("unixTs")]
    return quality.run_checks(inputs.raw_indicators(spark, sf), checks)


@query(
    "dq_min_rows",
    "SELECT user_id, count(*) AS rows, count(*) >= 2 AS enough FROM events GROUP BY user_id",
)
def dq_min_rows(spark, sf):
    return quality.min_rows(inputs.table(spark, sf, "events"), "user_id")


@query(
    "dq_failing_rows",
    "SELECT series, date_prices, macd_usd FROM x_obt WHERE macd_usd <= 0",
)
def dq_failing_rows(spark, sf):
    rows = inputs.obt(spark, sf).select("series", "date_prices", "macd_usd")
    return quality.failing_rows(rows, quality.positive("macd_usd"))


@query(
    "dq_report",
    f"{_NOT_NULL} UNION ALL {_POSITIVE} UNION ALL {_PERCENT} UNION ALL SELECT 'unique',"
    " 'series,date_prices', count(*) FROM (SELECT series, date_prices FROM x_obt GROUP BY ALL"
    " HAVING count(*) > 1)",
)
def dq_report(spark, sf):
    checks = [
        *[quality.not_null(c) for c in _SERIES_COLUMNS],
        *[quality.positive(c) for c in _POSITIVE_COLUMNS],
        quality.percentage("rsi"),
    ]
    return quality.report(inputs.obt(spark, sf), checks, [["series", "date_prices"]])


_PERIOD_KEYS = {
    "week": "iso_week_start_date", "month": "month_start_date",
    "quarter": "quarter_start_date", "year": "year_start_date",
}
_PRICES = [f"{m}_{c}" for c in ("usd", "chf", "eur") for m in ("low", "high", "open", "close")]


def _declared_sql():
    def table(name, source, nulls, positives, keys, percent=True):
        rows = [("not_null", c, f"{c} IS NULL") for c in nulls]
        rows += [("positive_value", c, f"{c} <= 0") for c in positives]
        rows += [("percentage_range", "rsi", "rsi < 0 OR rsi > 100")] * percent
        parts = [
            f"SELECT '{name}' AS table_name, '{check}' AS \"check\", '{column}' AS \"column\","
            f" count(*) FILTER (WHERE {condition}) AS failing FROM {source}"
            for check, column, condition in rows
        ]
        parts.append(
            f"SELECT '{name}', 'unique', '{','.join(keys)}', count(*) FROM (SELECT 1 FROM {source}"
            f" GROUP BY {', '.join(keys)} HAVING count(*) > 1)"
        )
        return parts

    rates = ["rate_usd_chf", "rate_usd_eur"]
    parts = table("daily", "x_obt", ["date_prices", "close_usd", "volume"],
                  [*_PRICES, "volume", *rates], ["series", "date_prices"])
    parts += table("rates", "x_usd", ["date_rates", *rates], rates, ["date_rates"], False)
    for unit, key in _PERIOD_KEYS.items():
        source = f"(SELECT *, 'b' AS dbt_batch_id FROM x_{unit}_rsi)"
        parts += table(unit, source, [key, "close_usd", "dbt_batch_id"], _PRICES[:4], ["series", key])
    return " UNION ALL ".join(parts)


@query("dq_tables", _declared_sql())
def dq_tables(spark, sf):
    """The declared checks of the fact, the rates and the four gold tables."""
    tables = {"daily": inputs.obt(spark, sf), "rates": inputs.usd_rates(spark, sf)}
    tables |= {unit: inputs.gold_table(spark, sf, unit) for unit in _PERIOD_KEYS}
    return declared.report(tables)


def _texts(spark, sf):
    """Rows as they arrive: prices as text, some not numbers, some missing."""
    return inputs.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("date"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))
        .otherwise(F.col("o_totalprice").cast("string")).alias("open"),
        F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice").cast("string")).alias("rsi"),
        F.col("o_totalprice").alias("macd"),
    )


@query(
    "validate_rows",
    "SELECT CAST(o_orderkey AS VARCHAR) AS date, o_totalprice AS open,"
    " CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END AS rsi,"
    " 'Neutral' AS rsi_status, CAST(0 AS DOUBLE) AS volume, o_totalprice AS macd"
    " FROM orders WHERE o_orderstatus <> 'F'",
)
def validate_rows(spark, sf):
    """Text prices are coerced, missing ones are zero, absent columns take their default."""
    valid, _ = quality.validate(_texts(spark, sf), quality.HISTORY_CONTRACT)
    return valid.select("date", "open", "rsi", "rsi_status", "volume", "macd")


@query(
    "validate_rejected",
    "SELECT CAST(o_orderkey AS VARCHAR) AS date, 'open' AS fault FROM orders"
    " WHERE o_orderstatus = 'F'",
)
def validate_rejected(spark, sf):
    _, rejected = quality.validate(_texts(spark, sf), quality.HISTORY_CONTRACT)
    return rejected.select("date", F.array_join("faults", ",").alias("fault"))


def _counted(spark, sf, *columns):
    """Orders as rows of numbers in text, by status: fine, blank (P) or no number (F)."""
    price = F.col("o_totalprice").cast("string")
    text = (
        F.when(F.col("o_orderstatus") == "P", " ")
        .when(F.col("o_orderstatus") == "F", F.concat(price, F.lit("d"))).otherwise(price)
    )
    return inputs.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("key"), text.alias("text"),
        F.col("o_totalprice").alias("price"),
    ).select(*columns)


_NUMBERED = "SELECT CAST(o_orderkey AS VARCHAR) AS {0}, {1} FROM orders WHERE {2}"
_OR_ZERO = "CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_totalprice END"


@query(
    "validate_metrics",
    "SELECT o_totalprice AS current_price, -o_totalprice AS change_24h, o_totalprice AS rsi,"
    " CAST(o_orderkey AS DOUBLE) AS volume_24h FROM orders WHERE o_orderstatus = 'O'",
)
def validate_metrics(spark, sf):
    """Every metric must be a number; blanks are none."""
    rows = _counted(
        spark, sf, F.col("text").alias("current_price"), (-F.col("price")).alias("change_24h"),
        F.lit(0.5).alias("change_percent_24h"), F.col("key").alias("volume_24h"),
        F.col("price").alias("high_24h"), F.col("price").alias("low_24h"),
        F.col("text").alias("rsi"),
    )
    valid, _ = quality.validate(rows, quality.METRICS_CONTRACT)
    return valid.select("current_price", "change_24h", "rsi", "volume_24h")


@query(
    "validate_aggregated",
    _NUMBERED.format(
        "period",
        f"{_OR_ZERO} AS avg_price, o_totalprice AS max_price, CAST(0 AS DOUBLE) AS min_price,"
        " CAST(0 AS DOUBLE) AS total_volume",
        "o_orderstatus <> 'F'",
    ),
)
def validate_aggregated(spark, sf):
    """Blank numbers are zero, and so are columns that are not there."""
    rows = _counted(
        spark, sf, F.col("key").alias("period"), F.col("text").alias("avg_price"),
        F.col("price").alias("max_price"),
    )
    valid, _ = quality.validate(rows, quality.AGGREGATED_CONTRACT)
    return valid


@query(
    "validate_forecasts",
    _NUMBERED.format(
        "date_prices",
        "'predicted_close_usd_upper' || CASE WHEN o_orderstatus = 'F'"
        " THEN ',predicted_close_usd' ELSE '' END AS faults",
        "true",
    ),
)
def validate_forecasts(spark, sf):
    """A missing column of predictions is a fault of every row."""
    rows = _counted(
        spark, sf, F.col("key").alias("date_prices"), F.col("key").alias("predicted_at"),
        F.col("text").alias("predicted_close_usd"),
        F.col("price").alias("predicted_close_usd_lower"),
    )
    _, rejected = quality.validate(rows, quality.FORECAST_CONTRACT)
    named = F.array_join(F.sort_array("faults", asc=False), ",")
    return rejected.select("date_prices", named.alias("faults"))


@query(
    "serve_rejected",
    "SELECT event_id, 'type' AS faults FROM events WHERE event_type NOT IN ('view', 'click')",
)
def serve_rejected(spark, sf):
    """Requests of unknown types, with the fields at fault."""
    kind = F.col("event_type")
    requests = inputs.table(spark, sf, "events").select(
        "event_id", F.when(kind.isin("view", "click"), "history").otherwise(kind).alias("type"),
        F.col("ts").cast("string").alias("startDate"),
    )
    _, rejected = quality.validate(requests, quality.REQUEST_CONTRACT)
    return rejected.select("event_id", F.array_join("faults", ",").alias("faults"))


@query(
    "validate_requests",
    "SELECT 'metrics' AS request_type,"
    " CAST(json_extract_string(props, '$.k') AS INTEGER) AS days,"
    " CASE WHEN event_type = 'view' THEN 'monthly' ELSE 'weekly' END AS period"
    " FROM events WHERE event_type IN ('view', 'click')",
)
def validate_requests(spark, sf):
    """Views and clicks ask for metrics; other kinds are unknown and rejected."""
    kind = F.col("event_type")
    requests = inputs.table(spark, sf, "events").select(
        F.when(kind.isin("view", "click"), "metrics").otherwise(kind).alias("type"),
        F.get_json_object("props", "$.k").alias("days"),
        F.when(kind == "view", "monthly").alias("period"),
    )
    valid, _ = quality.validate(requests, quality.REQUEST_CONTRACT)
    return valid.select(F.col("type").alias("request_type"), "days", "period")
