"""Indicators over bars (short series) and ticks (long series)."""

from pyspark.sql import functions as F

from pricemill.functions import scalars
from pricemill.operators import bars as bar_ops
from pricemill.operators import indicators
from pricemill.plans import serving
from pricemill.registry import inputs
from pricemill.registry.entries import part, query, rounded, rsi_parts
from pricemill.registry.market import week_bars

# Rows per chunk of a tick series.
CHUNK_ROWS = 1 << 14

rsi_parts("x_line", "x_line", "tick", "close")
rsi_parts("x_bar_week", "x_bar_week", "iso_week_start_date", "close")
rsi_parts("x_bar_month", "x_bar_month", "month_start_date", "close")
rsi_parts("x_event", "x_event_bars", "date", "close")

_PLAIN_RSI = "EXCLUDE (change, avg_gain, avg_loss, raw)"


@query("price_change", "SELECT * FROM x_bars_change")
def price_change(spark, sf):
    return indicators.price_change(inputs.bars(spark, sf), "series", "date", "close")


@query("rsi14", f"SELECT * {_PLAIN_RSI} FROM x_bars_rsi")
def rsi14(spark, sf):
    return indicators.rsi(inputs.bars(spark, sf), "series", "date", "close")


@query("rsi14_events", f"SELECT * {_PLAIN_RSI} FROM x_event_rsi")
def rsi14_events(spark, sf):
    return indicators.rsi(inputs.event_bars(spark, sf), "series", "date", "close")


@query("rsi14_week", f"SELECT * {_PLAIN_RSI} FROM x_bar_week_rsi")
def rsi14_week(spark, sf):
    return indicators.rsi(week_bars(spark, sf), "series", "iso_week_start_date", "close")


@query("rsi14_month", f"SELECT * {_PLAIN_RSI} FROM x_bar_month_rsi")
def rsi14_month(spark, sf):
    months = bar_ops.rollup(
        week_bars(spark, sf), "month", "series", "iso_week_start_date",
        ("low", "high", "open", "close"),
    )
    return indicators.rsi(months, "series", "month_start_date", "close")


@query("rsi14_ticks", f"SELECT * {_PLAIN_RSI} FROM x_line_rsi")
def rsi14_ticks(spark, sf):
    ticks = inputs.line_ticks(spark, sf)
    return indicators.rsi(ticks, "series", "tick", "close", chunk_rows=CHUNK_ROWS)


@query("price_change_ticks", "SELECT * FROM x_line_change")
def price_change_ticks(spark, sf):
    ticks = inputs.line_ticks(spark, sf)
    return indicators.price_change(ticks, "series", "tick", "close", chunk_rows=CHUNK_ROWS)


@query(
    "rsi_status",
    "SELECT series, date, rsi, CASE WHEN rsi < 30 THEN 'oversold' WHEN rsi > 70 THEN"
    " 'overbought' ELSE 'neutral' END AS status, CASE WHEN rsi < 30 THEN 'Oversold'"
    " WHEN rsi > 70 THEN 'Overbought' ELSE 'Neutral' END AS label FROM x_bars_rsi",
)
def rsi_status(spark, sf):
    return rsi14(spark, sf).select(
        "series", "date", "rsi",
        scalars.rsi_status("rsi").alias("status"), scalars.rsi_label("rsi").alias("label"),
    )


def _settled(column, digits):
    """Rounded twice, so that a last-bit difference does not decide a tie."""
    return F.round(F.round(column, 8), digits)


def _settled_sql(expression, digits):
    return rounded(f"round({expression}, 8)", digits)


def _sma_sql(source, order, spans, digits=5):
    return f"SELECT series, {order}, " + ", ".join(
        _settled_sql(f"CASE WHEN count(*) OVER w{s} = {s} THEN avg(close) OVER w{s} END", digits)
        + f" AS sma_{s}" for s in spans
    ) + f" FROM {source} WINDOW " + ", ".join(
        f"w{s} AS (PARTITION BY series ORDER BY {order}"
        f" ROWS BETWEEN {s - 1} PRECEDING AND CURRENT ROW)" for s in spans
    )


def _rounded(df, keys, names, digits=5):
    return df.select(*keys, *[_settled(n, digits).alias(n) for n in names])


@query("sma", _sma_sql("x_bars", "date", (7, 50, 200)))
def sma(spark, sf):
    averaged = indicators.sma(inputs.bars(spark, sf), "series", "date", "close")
    return _rounded(averaged, ["series", "date"], ["sma_7", "sma_50", "sma_200"])


@query("sma_ticks", _sma_sql("x_line", "tick", (7, 50, 200)))
def sma_ticks(spark, sf):
    averaged = indicators.sma(
        inputs.line_ticks(spark, sf), "series", "tick", "close", (7, 50, 200), CHUNK_ROWS
    )
    return _rounded(averaged, ["series", "tick"], ["sma_7", "sma_50", "sma_200"])


# Steps of the fold: enough for two million rows a series.
_FOLD_STEPS = 21


def _ema_part(name, source, order, price, span):
    """An exponential average over the whole history, as a fold of y = keep * y + rest.

    A row is a step (keep, rest). Two spells of 2^k steps are joined to one of 2^(k+1), so after
    the last round each row holds the spell from the first row to it.
    """
    keep = f"(CAST({span - 1} AS DOUBLE) / {span + 1})"
    part(f"{name}_i", f"SELECT *, row_number() OVER (PARTITION BY series ORDER BY {order}) - 1"
         f" AS i FROM {source}")
    steps = (
        f"SELECT series, i, CASE WHEN i = 0 THEN 0 ELSE {keep} END AS keep,"
        f" {price} * CASE WHEN i = 0 THEN 1 ELSE 1 - {keep} END AS rest FROM {name}_i"
    )
    for k in range(_FOLD_STEPS):
        steps = (
            f"SELECT series, i, keep * lag(keep, {1 << k}, 0) OVER w AS keep,"
            f" rest + keep * lag(rest, {1 << k}, 0) OVER w AS rest"
            f" FROM ({steps}) WINDOW w AS (PARTITION BY series ORDER BY i)"
        )
    part(name, f"SELECT series, i, rest AS y FROM ({steps})")


for _source, _order, _tag in (("x_bars", "date", "bar"), ("x_line", "tick", "line")):
    for _span in (7, 12, 26, 50, 200):
        _ema_part(f"x_{_tag}_ema_{_span}", _source, _order, "close", _span)
    part(
        f"x_{_tag}_macd",
        f"SELECT b.series, b.{_order}, f.y - s.y AS macd FROM x_{_tag}_ema_12_i b"
        f" JOIN x_{_tag}_ema_12 f ON f.series = b.series AND f.i = b.i"
        f" JOIN x_{_tag}_ema_26 s ON s.series = b.series AND s.i = b.i",
    )
    _ema_part(f"x_{_tag}_signal", f"x_{_tag}_macd", _order, "macd", 9)


def _ema_sql(tag, order, spans):
    columns = ", ".join(_settled_sql(f"e{s}.y", 4) + f" AS ema_{s}" for s in spans)
    joins = " ".join(
        f"JOIN x_{tag}_ema_{s} e{s} ON e{s}.series = b.series AND e{s}.i = b.i" for s in spans
    )
    return f"SELECT b.series, b.{order}, {columns} FROM x_{tag}_ema_{spans[0]}_i b {joins}"


def _macd_sql(tag, order):
    return (
        f"SELECT b.series, b.{order}, {_settled_sql('macd', 4)} AS macd,"
        f" {_settled_sql('y', 4)} AS macd_signal, {_settled_sql('macd - y', 4)} AS macd_hist,"
        " macd >= y AS positive"
        f" FROM x_{tag}_signal_i b JOIN x_{tag}_signal s ON s.series = b.series AND s.i = b.i"
    )


@query("ema", _ema_sql("bar", "date", (7, 50, 200)))
def ema(spark, sf):
    averaged = indicators.ema(inputs.bars(spark, sf), "series", "date", "close")
    return _rounded(averaged, ["series", "date"], ["ema_7", "ema_50", "ema_200"], 4)


@query("ema_ticks", _ema_sql("line", "tick", (7, 50, 200)))
def ema_ticks(spark, sf):
    averaged = indicators.ema(
        inputs.line_ticks(spark, sf), "series", "tick", "close", (7, 50, 200),
        chunk_rows=CHUNK_ROWS,
    )
    return _rounded(averaged, ["series", "tick"], ["ema_7", "ema_50", "ema_200"], 4)


def _macd_rows(df, order):
    return df.select(
        "series", order,
        *[_settled(n, 4).alias(n) for n in ("macd", "macd_signal", "macd_hist")],
        (F.col("macd_hist") >= 0).alias("positive"),
    )


@query("macd", _macd_sql("bar", "date"))
def macd(spark, sf):
    return _macd_rows(indicators.macd(inputs.bars(spark, sf), "series", "date", "close"), "date")


@query("macd_ticks", _macd_sql("line", "tick"))
def macd_ticks(spark, sf):
    ticks = inputs.line_ticks(spark, sf)
    lines = indicators.macd(ticks, "series", "tick", "close", chunk_rows=CHUNK_ROWS)
    return _macd_rows(lines, "tick")


@query(
    "macd_hist_identity",
    "SELECT series, count(*) AS row_count, count(*) AS equal_rows FROM x_bars GROUP BY series",
)
def macd_hist_identity(spark, sf):
    """One pass over three averages gives the histogram that two passes give, on every row."""
    bars = inputs.bars(spark, sf)
    lines = indicators.macd(bars, "series", "date", "close")
    twice = indicators.ema(bars, "series", "date", "close", (12, 26), ("fast", "slow"))
    twice = twice.withColumn("line", F.col("fast") - F.col("slow"))
    twice = indicators.ema(twice, "series", "date", "line", (9,), ("signal",)).select(
        "series", "date", (F.col("line") - F.col("signal")).alias("hist")
    )
    gap = F.abs(F.col("macd_hist") - F.col("hist"))
    return lines.join(twice, ["series", "date"]).groupBy("series").agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(gap < 1e-7).alias("equal_rows")
    )


@query("volatility", "SELECT *, high - low AS volatility FROM x_bars")
def volatility(spark, sf):
    return indicators.volatility(inputs.bars(spark, sf))


@query(
    "volatility_intensity",
    "SELECT *, high - low AS volatility, max(high - low) OVER (PARTITION BY series) AS"
    " max_volatility, (high - low) / max(high - low) OVER (PARTITION BY series) AS intensity"
    " FROM x_bars",
)
def volatility_intensity(spark, sf):
    return serving.volatility_series(inputs.bars(spark, sf))


part(
    "x_smooth",
    "SELECT r.series, CAST(date_trunc('month', date) AS DATE) + 14 AS date,"
    " avg(coalesce(nullif(rsi, 0), 50)) AS value FROM x_bars_rsi r"
    " JOIN (SELECT series FROM x_bars GROUP BY series"
    " HAVING max(date) - min(date) >= 730) s ON s.series = r.series GROUP BY r.series, 2"
    " UNION ALL SELECT r.series, date, rsi FROM x_bars_rsi r"
    " JOIN (SELECT series FROM x_bars GROUP BY series"
    " HAVING max(date) - min(date) < 730) s ON s.series = r.series WHERE rsi IS NOT NULL",
)


@query("rsi_monthly_smooth", "SELECT series, date, round(value, 6) AS value FROM x_smooth")
def rsi_monthly_smooth(spark, sf):
    points = indicators.rsi_points(rsi14(spark, sf), "series")
    return points.withColumn("value", F.round("value", 6))


@query(
    "rsi_smooth_short",
    "SELECT series, date, rsi AS value FROM x_event_rsi WHERE rsi IS NOT NULL",
)
def rsi_smooth_short(spark, sf):
    """Series of under two years keep their daily points."""
    return indicators.rsi_points(rsi14_events(spark, sf), "series")


@query(
    "display_grain",
    "SELECT series, min(date) AS first_date, max(date) AS last_date, CASE WHEN max(date) -"
    " min(date) >= 730 THEN 'month' ELSE 'day' END AS grain"
    " FROM (SELECT * FROM x_bars UNION ALL SELECT * FROM x_event_bars) GROUP BY series",
)
def display_grain(spark, sf):
    both = inputs.bars(spark, sf).unionByName(inputs.event_bars(spark, sf))
    return indicators.display_grain(both, "series")
