"""Bars, dedupe, calendar and rollups."""

from pyspark.sql import functions as F

from pricemill.constants import MEASURES, OHLC
from pricemill.operators import bars as bar_ops
from pricemill.operators import calendar as cal
from pricemill.operators import dedupe
from pricemill.registry import inputs
from pricemill.registry.entries import part, query, rounded
from pricemill.sources.tables import profile


@query("bars_from_orders", "SELECT * FROM x_bars")
def bars_from_orders(spark, sf):
    return inputs.bars(spark, sf)


part(
    "x_event_bars",
    "SELECT event_type AS series, CAST(ts AS DATE) AS date, min(value) AS low,"
    " max(value) AS high, arg_min(value, (ts, event_id)) AS open,"
    " arg_max(value, (ts, event_id)) AS close,"
    " CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2",
)


@query("bars_from_events", "SELECT * FROM x_event_bars")
def bars_from_events(spark, sf):
    return inputs.event_bars(spark, sf)


@query(
    "bars_tied",
    "SELECT o_orderpriority AS series, date_trunc('month', o_orderdate) AS date,"
    " min(o_totalprice) AS low, max(o_totalprice) AS high,"
    " arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS open,"
    " arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS close,"
    " CAST(count(*) AS DOUBLE) AS volume FROM orders GROUP BY 1, 2",
)
def bars_tied(spark, sf):
    """Many ticks of one time: the tie-breaker decides which opens and which closes the month."""
    ticks = inputs.table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "series")
    bars = bar_ops.from_ticks(
        ticks, "series", "o_orderdate", "o_totalprice", "o_orderdate", unit="month",
        tie="o_orderkey",
    )
    return inputs.plain(bars)


@query(
    "bars_hourly",
    "SELECT event_type AS series, date_trunc('hour', ts) AS date, min(value) AS low,"
    " max(value) AS high, arg_min(value, ts) AS open, arg_max(value, ts) AS close,"
    " CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2",
)
def bars_hourly(spark, sf):
    ticks = inputs.event_ticks(spark, sf)
    return inputs.plain(bar_ops.from_ticks(ticks, "series", "ts", "price", "ts", unit="hour"))


@query("dedupe_latest", "SELECT * FROM x_latest")
def dedupe_latest(spark, sf):
    raw = inputs.raw_candles(spark, sf)
    return inputs.plain(dedupe.dedupe_latest(raw, ["series", "date"], "ingest_date_time"))


@query(
    "dedupe_latest_text",
    "SELECT o_orderpriority, o_orderdate, o_orderkey, o_orderstatus, o_totalprice FROM orders"
    " QUALIFY row_number() OVER (PARTITION BY o_orderpriority, o_orderdate"
    " ORDER BY o_orderkey DESC) = 1",
)
def dedupe_latest_text(spark, sf):
    orders = inputs.table(spark, sf, "orders").drop("o_custkey")
    return dedupe.dedupe_latest(orders, ["o_orderpriority", "o_orderdate"], "o_orderkey")


@query(
    "find_duplicates",
    "SELECT *, count(*) OVER (PARTITION BY series, date) AS occurrences FROM x_ticks"
    " QUALIFY occurrences > 1",
)
def find_duplicates(spark, sf):
    return dedupe.find_duplicates(inputs.order_ticks(spark, sf), ["series", "date"])


# Two fetched pages that overlap by 60 days.
_PAGES = "(SELECT * FROM x_ticks WHERE date < DATE '1998-06-30'" \
    " UNION ALL SELECT * FROM x_ticks WHERE date >= DATE '1998-05-01')"


def _pages(spark, sf):
    ticks = inputs.order_ticks(spark, sf)
    return ticks.filter("date < '1998-06-30'"), ticks.filter("date >= '1998-05-01'")


@query("union_pages", f"SELECT * FROM {_PAGES}")
def union_pages(spark, sf):
    first, second = _pages(spark, sf)
    return first.unionByName(second)


@query("union_keep_last", f"SELECT DISTINCT * FROM {_PAGES}")
def union_keep_last(spark, sf):
    first, second = _pages(spark, sf)
    return dedupe.union_keep_last(first, second, ["series", "date", "tick"])


@query("union_series", "SELECT * FROM x_bars")
def union_series(spark, sf):
    """One frame per pair, as landed, unioned under a series column; the pairs are the data's."""
    every = inputs.bars(spark, sf)
    names = sorted(row[0] for row in every.select("series").distinct().collect())
    return bar_ops.union_series(
        {n: every.filter(F.col("series") == n).drop("series") for n in names}
    )


@query("calendar_dim", "SELECT * FROM x_days")
def calendar_dim(spark, sf):
    return inputs.days(spark, sf)


@query("calendar_distinct", "SELECT DISTINCT date FROM x_ticks")
def calendar_distinct(spark, sf):
    return inputs.order_ticks(spark, sf).select("date").distinct()


@query("join_calendar", "SELECT b.*, d.* EXCLUDE (date) FROM x_bars b LEFT JOIN x_days d"
       " ON b.date = d.date")
def join_calendar(spark, sf):
    return cal.join_calendar(inputs.bars(spark, sf), inputs.days(spark, sf), "date")


# The SQL twin of each preset, as a function of the day d.
_PRESETS = {
    "today": ("d", "d"),
    "yesterday": ("d - 1", "d - 1"),
    "last7": ("d - 6", "d"),
    "last30": ("d - 29", "d"),
    "thisMonth": ("date_trunc('month', d)", "last_day(d)"),
    "lastMonth": (
        "date_trunc('month', d - INTERVAL 1 MONTH)", "last_day(d - INTERVAL 1 MONTH)"
    ),
    "last2Year": ("d - INTERVAL 2 YEAR", "d"),
    "last3Year": ("d - INTERVAL 3 YEAR", "d"),
    "last5Year": ("d - INTERVAL 5 YEAR", "d"),
    "last10Year": ("d - INTERVAL 10 YEAR", "d"),
    "last12Year": ("d - INTERVAL 12 YEAR", "d"),
}


@query(
    "preset_windows",
    " UNION ALL ".join(
        f"SELECT d AS as_of, '{n}' AS preset, CAST({s} AS DATE) AS start_date,"
        f" CAST({e} AS DATE) AS end_date FROM (SELECT DISTINCT date AS d FROM x_ticks)"
        for n, (s, e) in _PRESETS.items()
    ),
)
def preset_windows(spark, sf):
    dates = inputs.order_ticks(spark, sf).select(F.col("date").alias("as_of")).distinct()
    ranges = []
    for name in cal.PRESETS:
        start, end = cal.preset_range(name, F.col("as_of"))
        ranges.append(
            F.struct(
                F.lit(name).alias("preset"), start.alias("start_date"), end.alias("end_date")
            )
        )
    return dates.select("as_of", F.inline(F.array(*ranges)))


@query(
    "in_preset",
    "SELECT * FROM x_bars WHERE date BETWEEN DATE '2001-07-01' AND DATE '2001-07-31'",
)
def in_preset(spark, sf):
    return cal.in_preset(inputs.bars(spark, sf), "date", "lastMonth", inputs.AS_OF)


@query(
    "time_filter_days",
    "SELECT date AS as_of, f AS time_filter, CASE f WHEN '1w' THEN 7 WHEN '1m' THEN 30"
    " WHEN '6m' THEN 180 WHEN '1y' THEN 365 WHEN 'all' THEN 3650"
    " WHEN 'ytd' THEN CAST(date_diff('day', date_trunc('year', date), date) AS INTEGER)"
    " ELSE 180 END AS days FROM (SELECT DISTINCT date FROM x_ticks),"
    " unnest(['1w', '1m', '6m', '1y', 'ytd', 'all', 'custom']) u(f)",
)
def time_filter_days(spark, sf):
    filters = F.array(*[F.lit(f) for f in ("1w", "1m", "6m", "1y", "ytd", "all", "custom")])
    dates = inputs.order_ticks(spark, sf).select(F.col("date").alias("as_of")).distinct()
    return dates.withColumn("time_filter", F.explode(filters)).withColumn(
        "days", cal.time_filter_days("time_filter", "as_of")
    )


@query(
    "normalize_range",
    "SELECT l_orderkey, l_linenumber, l_partkey,"
    " least(CAST(l_shipdate AS DATE), o) AS start_date,"
    " greatest(CAST(l_shipdate AS DATE), o) AS end_date FROM lineitem"
    " JOIN (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o FROM orders)"
    " ON l_orderkey = o_orderkey",
)
def normalize_range(spark, sf):
    """Typed ranges ``ship ~ order``, put in order."""
    lines = inputs.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate"
    )
    orders = inputs.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    text = F.concat_ws(
        " ~ ", F.date_format("l_shipdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "yyyy-MM-dd")
    )
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            "l_orderkey", "l_linenumber", "l_partkey", cal.normalized_range(text).alias("r")
        )
        .select(
            "l_orderkey", "l_linenumber", "l_partkey",
            F.col("r.start").alias("start_date"), F.col("r.end").alias("end_date"),
        )
    )


# Rollups of plain bars: the week table first, everything longer from it.
part(
    "x_bar_days",
    "SELECT b.*, d.* EXCLUDE (date) FROM x_bars b LEFT JOIN x_days d ON b.date = d.date",
)
part("x_bar_week", inputs.rollup_sql("x_bar_days", "week", "date", OHLC))
for _unit in ("month", "quarter", "year"):
    part(f"x_bar_{_unit}", inputs.rollup_sql("x_bar_week", _unit, "iso_week_start_date", OHLC))


def week_bars(spark, sf):
    keyed = bar_ops.with_period_keys(inputs.bars(spark, sf), "date")
    return bar_ops.rollup(keyed, "week", "series", "date", OHLC)


@query("rollup_week", "SELECT * FROM x_bar_week")
def rollup_week(spark, sf):
    return week_bars(spark, sf)


@query("rollup_month", "SELECT * FROM x_bar_month")
def rollup_month(spark, sf):
    weeks = week_bars(spark, sf)
    return bar_ops.rollup(weeks, "month", "series", "iso_week_start_date", OHLC)


@query("rollup_quarter", "SELECT * FROM x_bar_quarter")
def rollup_quarter(spark, sf):
    weeks = week_bars(spark, sf)
    return bar_ops.rollup(weeks, "quarter", "series", "iso_week_start_date", OHLC)


@query("rollup_year", "SELECT * FROM x_bar_year")
def rollup_year(spark, sf):
    weeks = week_bars(spark, sf)
    return bar_ops.rollup(weeks, "year", "series", "iso_week_start_date", OHLC)


@query("rollup_indicators", "SELECT * FROM x_month")
def rollup_indicators(spark, sf):
    keyed = bar_ops.with_period_keys(inputs.obt(spark, sf), "date_prices")
    suffixes = [f"_{c}" for c in inputs.CURRENCIES]
    weeks = bar_ops.rollup(keyed, "week", "series", "date_prices", MEASURES, suffixes)
    return bar_ops.rollup(weeks, "month", "series", "iso_week_start_date", MEASURES, suffixes)


@query(
    "first_last_window",
    "SELECT *, first_value(open) OVER (PARTITION BY series, iso_week_start_date ORDER BY date)"
    " AS first_open, first_value(close) OVER (PARTITION BY series, iso_week_start_date"
    " ORDER BY date DESC) AS last_close FROM x_bar_days",
)
def first_last_window(spark, sf):
    keyed = bar_ops.with_period_keys(inputs.bars(spark, sf), "date")
    return bar_ops.first_last(
        keyed, ["series", "iso_week_start_date"], "date", ["open"], ["close"]
    )


@query(
    "batch_profile",
    "SELECT series, count(*) AS row_count, min(date) AS min_time, max(date) AS max_time,"
    " min(close) AS min_value, max(close) AS max_value FROM x_bars GROUP BY series",
)
def batch_profile(spark, sf):
    return profile(inputs.bars(spark, sf), "date", "close", ["series"])


@query(
    "scalar_math",
    "SELECT series, date, " + rounded("close * 1.005") + " AS rounded,"
    " 100 / (1 + high / low) AS share, -close AS negated, abs(close - open) AS distance,"
    " greatest(open, close) AS larger, least(open, close) AS smaller FROM x_bars",
)
def scalar_math(spark, sf):
    return inputs.bars(spark, sf).select(
        "series", "date",
        F.round(F.col("close") * 1.005, 2).alias("rounded"),
        (100 / (1 + F.col("high") / F.col("low"))).alias("share"),
        (-F.col("close")).alias("negated"),
        F.abs(F.col("close") - F.col("open")).alias("distance"),
        F.greatest("open", "close").alias("larger"),
        F.least("open", "close").alias("smaller"),
    )


@query(
    "scalar_conditional",
    "SELECT event_id, nullif(event_type, 'error') AS kind,"
    " coalesce(nullif(event_type, 'error'), 'none') AS kind_or_none,"
    " least(CASE WHEN value > 10 THEN value END, 50.0) AS capped,"
    " CASE WHEN value < 1 THEN 'low' WHEN value > 20 THEN 'high' ELSE 'mid' END AS band"
    " FROM events",
)
def scalar_conditional(spark, sf):
    value = F.col("value")
    kind = F.nullif(F.col("event_type"), F.lit("error"))
    return inputs.table(spark, sf, "events").select(
        "event_id",
        kind.alias("kind"),
        F.coalesce(kind, F.lit("none")).alias("kind_or_none"),
        F.least(F.when(value > 10, value), F.lit(50.0)).alias("capped"),
        F.when(value < 1, "low").when(value > 20, "high").otherwise("mid").alias("band"),
    )


@query(
    "scalar_date",
    "SELECT date, strftime(date, '%Y-%m-%d') AS text, CAST(strftime(date, '%Y-%m-%d') AS DATE)"
    " AS parsed, CAST(date_trunc('month', date) AS DATE) AS month_start,"
    " last_day(date) AS month_end, CAST(date - INTERVAL 1 MONTH AS DATE) AS month_before,"
    " CAST(date - INTERVAL 2 YEAR AS DATE) AS two_years_before, date - 10 AS ten_days_before,"
    " CAST(year(date) AS INTEGER) AS y, CAST(month(date) AS INTEGER) AS m,"
    " CAST(day(date) AS INTEGER) AS d, date <= DATE '2001-08-01' AS past"
    " FROM (SELECT DISTINCT date FROM x_ticks)",
)
def scalar_date(spark, sf):
    date = F.col("date")
    return inputs.order_ticks(spark, sf).select("date").distinct().select(
        date,
        F.date_format(date, "yyyy-MM-dd").alias("text"),
        F.to_date(F.date_format(date, "yyyy-MM-dd")).alias("parsed"),
        F.trunc(date, "month").alias("month_start"),
        F.last_day(date).alias("month_end"),
        F.add_months(date, -1).alias("month_before"),
        F.add_months(date, -24).alias("two_years_before"),
        F.date_sub(date, 10).alias("ten_days_before"),
        F.year(date).alias("y"),
        F.month(date).alias("m"),
        F.day(date).alias("d"),
        (date <= F.lit(inputs.AS_OF).cast("date")).alias("past"),
    )


@query(
    "scalar_string",
    "SELECT o_orderkey, upper(o_orderpriority) AS upper_text, lower(o_orderpriority) AS"
    " lower_text, concat_ws('_', lower(o_orderstatus), o_orderpriority) AS joined,"
    " split_part(o_orderpriority, '-', 2) AS after_dash,"
    " replace(o_orderpriority, '-', '/') AS replaced FROM orders",
)
def scalar_string(spark, sf):
    priority = F.col("o_orderpriority")
    return inputs.table(spark, sf, "orders").select(
        "o_orderkey",
        F.upper(priority).alias("upper_text"),
        F.lower(priority).alias("lower_text"),
        F.concat_ws("_", F.lower("o_orderstatus"), priority).alias("joined"),
        F.split_part(priority, F.lit("-"), F.lit(2)).alias("after_dash"),
        F.replace(priority, F.lit("-"), F.lit("/")).alias("replaced"),
    )


@query(
    "scalar_array",
    "SELECT series, date, list_sort([open, high, close])[2] AS median, 3 AS size,"
    " [low, open][1] AS head, list_sum(list_transform([open, high, close],"
    " lambda x: x * 2)) AS doubled, len(list_filter([open, high, close],"
    " lambda x: x > 250000)) AS large, [open, high, close][1:2][2] AS sliced FROM x_bars",
)
def scalar_array(spark, sf):
    prices = F.array("open", "high", "close")
    return inputs.bars(spark, sf).select(
        "series", "date",
        F.element_at(F.array_sort(prices), 2).alias("median"),
        F.size(prices).alias("size"),
        F.get(F.array("low", "open"), F.lit(0)).alias("head"),
        F.aggregate(
            F.transform(prices, lambda x: x * 2), F.lit(0.0), lambda a, x: a + x
        ).alias("doubled"),
        F.size(F.filter(prices, lambda x: x > 250000)).alias("large"),
        F.element_at(F.slice(prices, 1, 2), 2).alias("sliced"),
    )


@query(
    "scalar_map",
    "SELECT series, date, 'USD' AS quote, close AS price FROM x_bars"
    " UNION ALL SELECT series, date, 'EUR', close * CAST(0.5 AS DOUBLE) FROM x_bars",
)
def scalar_map(spark, sf):
    quotes = F.create_map(F.lit("USD"), F.col("close"), F.lit("EUR"), F.col("close") * 0.5)
    return inputs.bars(spark, sf).select(
        "series", "date", F.explode(quotes).alias("quote", "price")
    )
