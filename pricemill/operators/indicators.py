"""Price indicators per series.

Every function takes ``chunk_rows``. Left out, the window is partitioned by series: right for
bars, of which a series has one per period. Given, the series is cut into chunks (see
``longseries``): right for ticks. Both forms give the same rows.
"""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from pricemill.constants import (
    AVERAGE_SPANS,
    MACD_FAST,
    MACD_SIGNAL,
    MACD_SLOW,
    RSI_PERIOD,
    SMOOTHING_DAY_OF_MONTH,
    SMOOTHING_SPAN_DAYS,
)
from pricemill.functions.scalars import as_column, rsi_or_default, rsi_status
from pricemill.functions.windows import change_from_previous, columns, ordered, trailing
from pricemill.operators.joins import join_groups
from pricemill.operators.longseries import CHUNK, HALO, POSITION, over_chunks, with_chunks

# Below the smallest double a weight is zero, however the average is written.
_LEAST_WEIGHT = 1e-308
# Largest factor a block of the moving-average scan may scale by.
_BLOCK_SCALE = 1e100
# Shorter sums that make up the next longer one.
_SUM_STEP = 4


def _per_series(df, series, order, halo, chunk_rows, build):
    if chunk_rows is None:
        return build(df, columns(series))
    return over_chunks(df, series, order, halo, chunk_rows, build)


def price_change(df, series, order, price, name="change", chunk_rows=None):
    """Difference to the previous row's price; NULL on the first row."""

    def build(frame, partition):
        return frame.withColumn(name, change_from_previous(price, ordered(partition, order)))

    return _per_series(df, series, order, 1, chunk_rows, build)


def rsi(df, series, order, price, period=RSI_PERIOD, keep_parts=False, chunk_rows=None):
    """Simple-average RSI over ``period`` rows, with its status.

    The first rows use shorter frames. The missing change of the very first row counts as
    zero gain and zero loss. Without any loss in the frame the value is NULL and the status
    neutral.
    """

    def build(frame, partition):
        changed = frame.withColumn(
            "change", change_from_previous(price, ordered(partition, order))
        )
        frame_rows = trailing(partition, order, period)
        change = F.col("change")
        averaged = changed.select(
            "*",
            F.avg(F.when(change > 0, change).otherwise(0.0)).over(frame_rows).alias("avg_gain"),
            F.avg(F.when(change < 0, -change).otherwise(0.0)).over(frame_rows).alias("avg_loss"),
        )
        ratio = F.col("avg_gain") / F.nullif(F.col("avg_loss"), F.lit(0.0))
        raw = F.round(100 - 100 / (1 + ratio), 2)
        return averaged.withColumn("rsi_calculated", raw).select(
            "*",
            F.when(F.col("rsi_calculated").between(0, 100), F.col("rsi_calculated")).alias("rsi"),
            rsi_status("rsi_calculated").alias("rsi_status"),
        )

    built = _per_series(df, series, order, period, chunk_rows, build)
    return built if keep_parts else built.drop("change", "avg_gain", "avg_loss", "rsi_calculated")


def sma(df, series, order, price, spans=AVERAGE_SPANS, chunk_rows=None):
    """Simple moving averages; NULL until a full span of rows exists.

    A sliding frame is added up again on every row, which takes ``span`` steps a row. Here sums of
    4, 16, 64, ... rows are each made of four shorter ones by ``lag``, and a span of a few of
    them: steps by the logarithm of the span. Nothing is subtracted but counts of rows, so a large
    or infinite price leaves no trace behind its span. A NULL price does not count.
    """

    def build(frame, partition):
        rows = ordered(partition, order)
        running = rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        known, row, sums = "_known", "_row", ["_sum_1"]
        frame = frame.withColumns({
            known: F.count(price).over(running), row: F.count(F.lit(1)).over(running),
            sums[0]: F.coalesce(F.col(price).cast("double"), F.lit(0.0)),
        })
        while _SUM_STEP ** len(sums) <= max(spans):
            width = _SUM_STEP ** (len(sums) - 1)
            parts = [F.lag(sums[-1], width * i).over(rows) for i in range(1, _SUM_STEP)]
            sums.append(f"_sum_{width * _SUM_STEP}")
            frame = frame.withColumn(sums[-1], sum(parts, F.col(sums[-2])))
        averages = []
        for span in spans:
            parts, at = [], 0
            for level in reversed(range(len(sums))):
                while at + _SUM_STEP ** level <= span:
                    parts.append(F.lag(sums[level], at).over(rows) if at else F.col(sums[level]))
                    at += _SUM_STEP ** level
            number = F.col(known) - F.lag(known, span, 0).over(rows)
            average = sum(parts[1:], parts[0]) / F.nullif(number, F.lit(0))
            averages.append(F.when(F.col(row) >= span, average).alias(f"sma_{span}"))
        return frame.select("*", *averages).drop(known, row, *sums)

    return _per_series(df, series, order, max(spans), chunk_rows, build)


def ema(df, series, order, price, spans=AVERAGE_SPANS, names=None, chunk_rows=None):
    """Exponential moving averages with smoothing 2/(span+1), starting at the first price.

    ``y[t] = q*y[t-1] + a*x[t]`` is written as running sums: inside a block of rows
    ``sum(a*x*q^-j) * q^j``, plus the previous block's end faded by ``q^(j+1)``. Blocks are
    long enough that what lies two blocks back weighs less than 1e-100, and short enough that
    ``q^-j`` stays far from overflow. A row without price has no average and does not move it.
    Chunks carry their ends on in the same way, over all chunks that have a weight at all.
    """
    names = names or [f"ema_{span}" for span in spans]
    if chunk_rows is None:
        counted = _with_price_position(df, columns(series), order, price)
        return _ema_columns(counted, columns(series), order, price, spans, names).drop(POSITION)
    chunked = with_chunks(df, series, order, 0, chunk_rows, price)
    averaged = _carried_ema(chunked, columns(series), order, price, spans, names, chunk_rows)
    return averaged.drop(CHUNK, HALO, POSITION)


def macd(df, series, order, price, fast=MACD_FAST, slow=MACD_SLOW, signal=MACD_SIGNAL,
         chunk_rows=None):
    """Line (fast minus slow average), its own average as signal, and their difference.

    All three are one linear recurrence with the state (fast, slow, signal). Its transfer matrix
    has the fading factors of the three averages as eigenvalues, so in the basis of its
    eigenvectors the state is three plain averages of the price: the signal is a fixed combination
    of the averages over its own, the fast and the slow span. One pass over one chunking gives
    all. Equal spans have no such basis; there the line is averaged in a second pass.
    """
    if signal in (fast, slow):
        lines = ema(df, series, order, price, (fast, slow), ("_fast", "_slow"), chunk_rows)
        line = lines.withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
        averaged = ema(line, series, order, "macd", (signal,), ("macd_signal",), chunk_rows)
    else:
        names = ("_fast", "_slow", "_short")
        averaged = ema(df, series, order, price, (fast, slow, signal), names, chunk_rows)
        smooth = _smoothed("_fast", fast, "_short", signal) - _smoothed(
            "_slow", slow, "_short", signal
        )
        averaged = averaged.withColumns(
            {"macd": F.col("_fast") - F.col("_slow"), "macd_signal": smooth}
        ).drop(*names)
    return averaged.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def _smoothed(average, span, short, signal):
    """The ``signal`` average of an average, less what it is for the average of any other span.

    Both weights multiply to a geometric series, whose sum is a combination of the average and of
    the short one, the signal's own average of the price; its two factors differ by one.
    """
    keep, fade = _keep(span), _keep(signal)
    return F.lit((1 - fade) * keep / (keep - fade)) * (F.col(average) - F.col(short))


def _carried_ema(chunked, series, order, price, spans, names, chunk_rows):
    """Averages inside chunks, plus the average at the end of the chunk before, faded.

    A chunk's own share of its end is a plain sum over its rows, so the ends are one small
    aggregate. They are folded over as many chunks as have a weight at all: nothing is cut.
    """
    keys = [*series, CHUNK]
    own = [f"_own_{name}" for name in names]
    carries = _chunk_carries(chunked, series, price, spans, names, chunk_rows)
    local = _ema_columns(chunked, [CHUNK, *series], order, price, spans, own)
    joined = join_groups(local, carries, keys, "left")
    since = F.col(POSITION) - F.col(CHUNK) * F.lit(chunk_rows) + F.lit(1)
    results = [
        (
            F.col(part)
            + F.coalesce(F.col(f"_carry_{name}"), F.lit(0.0)) * F.pow(F.lit(_keep(span)), since)
        ).alias(name)
        for span, name, part in zip(spans, names, own)
    ]
    return joined.select(*chunked.columns, *results)


def _chunk_carries(chunked, series, price, spans, names, chunk_rows):
    """What each chunk starts from; all chunks but the last have ``chunk_rows`` priced rows."""
    left = F.lit(chunk_rows - 1) - (F.col(POSITION) - F.col(CHUNK) * F.lit(chunk_rows))
    ends, carries = [], []
    for span, name in zip(spans, names):
        keep = _keep(span)
        weight = F.when(F.col(POSITION) == 0, 1.0).otherwise(1 - keep)
        ends.append(F.sum(weight * F.col(price) * F.pow(F.lit(keep), left)).alias(f"_end_{name}"))
        faded = keep**chunk_rows
        reach = 1 if faded == 0 else math.ceil(math.log(_LEAST_WEIGHT) / math.log(faded))
        before = ordered(series, CHUNK).rowsBetween(-reach, -1)
        earlier = F.collect_list(f"_end_{name}").over(before)
        carries.append(_folded(earlier, faded).alias(f"_carry_{name}"))
    priced = chunked.filter(F.col(price).isNotNull())
    return priced.groupBy(*series, CHUNK).agg(*ends).select(*series, CHUNK, *carries)


def _folded(ends, faded):
    return F.aggregate(ends, F.lit(0.0), lambda total, end: total * F.lit(faded) + end)


def _with_price_position(df, partition, order, price):
    running = ordered(partition, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(POSITION, F.count(price).over(running) - F.lit(1))


def _keep(span):
    return (span - 1) / (span + 1)


def _block_rows(span):
    keep = _keep(span)
    return 1 if keep == 0 else math.floor(math.log(_BLOCK_SCALE) / -math.log(keep))


def _ema_columns(frame, partition, order, price, spans, names):
    """Add one average per span; rows carry their position among the priced rows."""
    value = F.col(price)
    running = (Window.unboundedPreceding, Window.currentRow)
    local_columns, carries, results = [], [], []
    for span, name in zip(spans, names):
        keep = _keep(span)
        if keep == 0:
            results.append(value.alias(name))
            continue
        rows = _block_rows(span)
        block, offset = f"_block_{name}", f"_offset_{name}"
        local, carry = f"_local_{name}", f"_carry_{name}"
        frame = frame.withColumns(
            {
                block: F.floor(F.col(POSITION) / F.lit(rows)),
                offset: F.pmod(F.col(POSITION), F.lit(rows)).cast("double"),
            }
        )
        weight = F.when(F.col(POSITION) == 0, 1.0).otherwise(1 - keep)
        in_block = ordered([block, *partition], order).rowsBetween(*running)
        scaled = weight * value * F.pow(F.lit(keep), -F.col(offset))
        frame = frame.withColumn(
            local, F.sum(scaled).over(in_block) * F.pow(F.lit(keep), F.col(offset))
        )
        before = ordered(partition, order).rowsBetween(Window.unboundedPreceding, -1)
        block_end = F.when(F.col(offset) == rows - 1, F.col(local))
        carries.append(F.last(block_end, ignorenulls=True).over(before).alias(carry))
        faded = F.coalesce(F.col(carry), F.lit(0.0)) * F.pow(F.lit(keep), F.col(offset) + 1)
        results.append(F.when(value.isNotNull(), F.col(local) + faded).alias(name))
        local_columns += [block, offset, local, carry]
    kept = [c for c in frame.columns if c not in local_columns]
    return frame.select("*", *carries).select(*kept, *results)


def volatility(df, name="volatility"):
    return df.withColumn(name, F.col("high") - F.col("low"))


def volatility_intensity(df, series):
    """High minus low, and its share of the series' largest.

    The maximum is aggregated and joined back instead of taken over a window, so a long
    series stays split over many tasks.
    """
    measured = volatility(df)
    largest = measured.groupBy(*columns(series)).agg(F.max("volatility").alias("max_volatility"))
    return join_groups(measured, largest, series).withColumn(
        "intensity", F.col("volatility") / F.nullif(F.col("max_volatility"), F.lit(0.0))
    )


def rsi_points(df, series, date="date", smooth=None):
    """RSI as charted: monthly means (``smooth``) or the raw points.

    With ``smooth`` None a series of two years or more has means. Months are aggregated first;
    the span and the choice are made on the monthly rows. A mean counts a missing or zero RSI as
    neutral and is dated the 15th.
    """
    series = columns(series)
    month = F.trunc(date, "month")
    monthly = df.groupBy(*series, month.alias("month")).agg(
        F.avg(rsi_or_default("rsi")).alias("value"),
        F.min(date).alias("first"),
        F.max(date).alias("last"),
    )
    middle = F.date_add("month", SMOOTHING_DAY_OF_MONTH - 1).alias(date)
    known = df.filter(as_column("rsi").isNotNull())
    point = [*series, date, F.col("rsi").alias("value")]
    if smooth is not None:
        return monthly.select(*series, middle, "value") if smooth else known.select(*point)
    spans = (
        monthly.groupBy(*series)
        .agg(F.min("first").alias("first"), F.max("last").alias("last"))
        .select(*series, (F.datediff("last", "first") >= SMOOTHING_SPAN_DAYS).alias("smooth"))
    )
    smoothed = (
        join_groups(monthly, spans.filter("smooth"), series, "left_semi")
        .select(*series, middle, "value")
    )
    raw = join_groups(known, spans.filter(~F.col("smooth")), series, "left_semi")
    return smoothed.unionByName(raw.select(*point))


def with_charted_rsi(df, series, date="date", smooth=None):
    """Add the points of ``rsi_points`` to the rows: ``_rsi`` and its day ``_rsi_date``.

    A month's mean is on the first row of the month, the other rows have none. All windows are
    of one series, so the rows are shuffled once.
    """
    series = columns(series)
    month = F.trunc(date, "month")
    whole, in_month = Window.partitionBy(*series), Window.partitionBy(*series, month)
    if smooth is None:
        span = F.datediff(F.max(date).over(whole), F.min(date).over(whole))
        means = span >= SMOOTHING_SPAN_DAYS
    else:
        means = F.lit(smooth)
    first = F.row_number().over(in_month.orderBy(date)) == 1
    mean = F.when(first, F.avg(rsi_or_default("rsi")).over(in_month))
    middle = F.date_add(month, SMOOTHING_DAY_OF_MONTH - 1)
    return df.withColumn("_means", means).withColumns(
        {
            "_rsi": F.when(F.col("_means"), mean).otherwise(F.col("rsi")),
            "_rsi_date": F.when(F.col("_means"), middle).otherwise(F.col(date)),
        }
    ).drop("_means")


def display_grain(df, series, date="date"):
    """``month`` for series of two years or more, else ``day``."""
    return (
        df.groupBy(*columns(series))
        .agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"))
        .withColumn(
            "grain",
            F.when(
                F.datediff("last_date", "first_date") >= SMOOTHING_SPAN_DAYS, "month"
            ).otherwise("day"),
        )
    )
