"""Scalar column functions. All are built-in expressions, so they stay inside codegen."""

from functools import reduce
from pathlib import PurePosixPath

from pyspark.sql import functions as F

from pricemill.constants import (
    BAD_LOW_DATE,
    BAD_LOW_LIMIT,
    FX_BASE,
    FX_QUOTES,
    RSI_DEFAULT,
    RSI_OVERBOUGHT,
    RSI_OVERSOLD,
    SCHEMA_PREFIX,
)


def as_column(column):
    return F.col(column) if isinstance(column, str) else column


# What counts as a number in text: no type suffixes, no names
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def coerce_double(column):
    """A number, or NULL where the value is not one (``1d``, ``NaN`` and empty text are not)."""
    value = as_column(column)
    return F.when(value.cast("string").rlike(NUMBER), value.try_cast("double"))


def epoch_to_timestamp(column):
    """Epoch seconds (number or text) to a timestamp; NULL where not a number."""
    return F.timestamp_seconds(coerce_double(column))


def parse_time(column):
    """Text in ``yyyy-MM-dd`` or ``yyyy-MM-dd HH:mm:ss`` to a timestamp, else NULL.

    Only the form that the text can have is tried: a failed try costs an exception a row.
    """
    text = as_column(column)
    return F.when(
        text.contains(":"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))
    ).otherwise(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))


def rsi_status(rsi):
    """Status as stored in tables; NULL counts as neutral."""
    rsi = as_column(rsi)
    return (
        F.when(rsi < RSI_OVERSOLD, "oversold")
        .when(rsi > RSI_OVERBOUGHT, "overbought")
        .otherwise("neutral")
    )


def rsi_label(rsi):
    """Status as recomputed by the monthly history query."""
    return F.initcap(rsi_status(rsi))


def truthy_or(column, default):
    """The default replaces both NULL and zero."""
    return F.coalesce(F.nullif(as_column(column), F.lit(0)), F.lit(default).cast("double"))


def rsi_or_default(rsi):
    return truthy_or(rsi, RSI_DEFAULT)


def direction(change):
    """``up`` from zero on, else ``down``."""
    return F.when(as_column(change) >= 0, "up").otherwise("down")


def strictly_positive(change):
    """The stricter trend flag: zero is not positive."""
    return as_column(change) > 0


def median_of_three(a, b, c):
    return F.array_sort(F.array(as_column(a), as_column(b), as_column(c)))[1]


def bad_low(low, date):
    """Lows that cannot be real: not positive, or the one known bad day."""
    low = as_column(low)
    return (low <= 0) | ((as_column(date) == F.lit(BAD_LOW_DATE).cast("date")) & (low < BAD_LOW_LIMIT))


def repaired_low(low, open_, high, close, date):
    return F.when(bad_low(low, date), median_of_three(open_, high, close)).otherwise(as_column(low))


def converted(price, rate):
    """A price in another currency at the rate of its day, kept to cents (SQL text)."""
    return f"round({price} * {rate}, 2)"


def feed_kind(base, quote):
    """Which payload shape a pair is loaded from."""
    is_fx = (F.upper(as_column(base)) == FX_BASE) & F.upper(as_column(quote)).isin(*FX_QUOTES)
    return F.when(is_fx, "fx").otherwise("candles")


def series_table_name(base, quote):
    """``btc_usd_ohlcv`` for candles, ``usd_chf_rates`` for exchange rates."""
    suffix = F.when(feed_kind(base, quote) == "fx", "rates").otherwise("ohlcv")
    return F.lower(F.concat_ws("_", as_column(base), as_column(quote), suffix))


def schema_for(model_path, custom=None, prefix=SCHEMA_PREFIX):
    """The schema (database) of a table: the prefix, the folders between root and file, a suffix.

    ``silver/crypto/x.sql`` -> ``dlh_silver__crypto``; a leading ``models`` folder is the root.
    """
    folders = PurePosixPath(model_path.replace("\\", "/")).parent.parts
    placed = [folder for i, folder in enumerate(folders) if (i, folder) != (0, "models")]
    return "_".join(filter(None, (prefix + "__".join(placed), custom))).lower()


def any_null(columns):
    return reduce(lambda a, b: a | b, [as_column(c).isNull() for c in columns])


def ohlc_broken(low="low", high="high", open_="open", close="close"):
    """High below, or low above, open or close."""
    low, high, open_, close = (as_column(c) for c in (low, high, open_, close))
    return (high < open_) | (high < close) | (low > open_) | (low > close)
