"""Data quality: checks as conditions, counted together in one pass per table."""

import re
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricemill.constants import PERIOD_UNITS, REQUEST_TYPES
from pricemill.functions.scalars import any_null, coerce_double, ohlc_broken
from pricemill.functions.windows import columns

DATE_TEXT = r"^\d{4}-\d{2}-\d{2}"


@dataclass(frozen=True)
class Check:
    """A named condition that is true for failing rows. NULL passes."""

    name: str
    column: str
    failing: Column


def not_null(column):
    return Check("not_null", column, F.col(column).isNull())


def positive(column):
    return Check("positive_value", column, F.col(column) <= 0)


def percentage(column):
    return Check("percentage_range", column, (F.col(column) < 0) | (F.col(column) > 100))


def ohlc(low="low", high="high", open_="open", close="close"):
    return Check("ohlc", "ohlc", ohlc_broken(low, high, open_, close))


def ohlc_nulls(names=("open", "high", "low", "close")):
    return Check("ohlc_nulls", "ohlc", any_null(names))


def date_text(column):
    return Check("date_format", column, ~F.col(column).rlike(DATE_TEXT))


def failing_rows(df, check):
    """The rows a check rejects."""
    return df.filter(check.failing)


def run_checks(df, checks):
    """Failing rows per check: a single aggregate, then one output row per check."""
    counts = df.agg(*[F.count_if(c.failing).alias(f"c{i}") for i, c in enumerate(checks)])
    rows = [
        F.struct(
            F.lit(c.name).alias("check"),
            F.lit(c.column).alias("column"),
            F.col(f"c{i}").alias("failing"),
        )
        for i, c in enumerate(checks)
    ]
    return counts.select(F.inline(F.array(*rows)))


def unique(df, keys):
    """Number of keys that occur more than once, as a check row."""
    keys = columns(keys)
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return repeated.agg(F.count(F.lit(1)).alias("failing")).select(
        F.lit("unique").alias("check"), F.lit(",".join(keys)).alias("column"), "failing"
    )


def report(df, checks, unique_keys=()):
    """All checks of a table, uniqueness included."""
    parts = [run_checks(df, checks), *[unique(df, keys) for keys in unique_keys]]
    return reduce(lambda a, b: a.unionByName(b), parts)


def report_once(df, checks, keys):
    """All checks of a table and the uniqueness of its keys, in one pass.

    Failures are counted per key first, so the count of repeated keys and the sums of failures
    come from the same aggregate; a key with many rows is added up before it is shuffled.
    """
    keys = columns(keys)
    per_key = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(c.failing).alias(f"_c{i}") for i, c in enumerate(checks)],
    )
    names = [(c.name, c.column) for c in checks] + [("unique", ",".join(keys))]
    counts = per_key.agg(
        *[F.coalesce(F.sum(f"_c{i}"), F.lit(0)).alias(f"c{i}") for i in range(len(checks))],
        F.count_if(F.col("_n") > 1).alias(f"c{len(checks)}"),
    )
    rows = [
        F.struct(F.lit(a).alias("check"), F.lit(b).alias("column"), F.col(f"c{i}").alias("failing"))
        for i, (a, b) in enumerate(names)
    ]
    return counts.select(F.inline(F.array(*rows)))


def report_tables(tables):
    """The reports of several tables as one: ``tables`` maps a name to (rows, checks, keys)."""
    parts = [
        report_once(df, checks, keys).select(F.lit(name).alias("table_name"), "*")
        for name, (df, checks, keys) in tables.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def min_rows(df, series, at_least=2):
    """Rows per series, and whether there are enough to compute a change."""
    return df.groupBy(*columns(series)).agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "enough", F.col("rows") >= at_least
    )


@dataclass(frozen=True)
class Field:
    """One field of a row contract.

    ``number`` is coerced from text, NULL becoming 0; ``strict_number`` must already be a
    number but may be NULL; ``text`` must not be NULL; ``integer`` is optional; ``choice``
    must be one of ``allowed``. ``default`` is used where the column is absent, and for
    ``integer`` and ``choice`` also where the value is.
    """

    name: str
    kind: str
    default: Any = None
    allowed: tuple = ()


def validate(df, contract):
    """(valid, rejected): contract rows, and original rows with the fields at fault."""
    values, faults = [], []
    for field in contract:
        value, fault = _checked(df, field)
        values.append(value.alias(field.name))
        if fault is not None:
            faults.append(F.when(fault, F.lit(field.name)))
    marked = df.withColumn("_faults", F.array_compact(F.array(*faults)))
    valid = marked.filter(F.size("_faults") == 0).select(*values)
    rejected = marked.filter(F.size("_faults") > 0).withColumnRenamed("_faults", "faults")
    return valid, rejected


def _checked(df, field):
    present = field.name in df.columns
    column = F.col(field.name)
    if field.kind == "number":
        if not present:
            return F.lit(field.default).cast("double"), F.lit(field.default is None)
        blank = column.isNull() | (F.trim(column.cast("string")) == "")
        number = coerce_double(column)
        return F.when(blank, 0.0).otherwise(number), ~blank & number.isNull()
    if field.kind == "required_number":
        number = coerce_double(column) if present else F.lit(None).cast("double")
        return number, number.isNull()
    if field.kind == "strict_number":
        if not present:
            return F.lit(None).cast("double"), None
        number = column.try_cast("double")
        return number, column.isNotNull() & number.isNull()
    if field.kind == "integer":
        if not present:
            return F.lit(field.default), None
        number = F.regexp_extract(column, r"^\s*([+-]?\d+)", 1).try_cast("int")
        empty = column.isNull() | (column == "")
        return F.when(empty, field.default).otherwise(number), ~empty & number.isNull()
    if field.kind == "choice":
        if not present:
            return F.lit(field.default), F.lit(field.default is None)
        value = column if field.default is None else F.coalesce(column, F.lit(field.default))
        return value, value.isNull() | ~value.isin(*field.allowed)
    if field.kind == "optional_text":
        return (column if present else F.lit(None)).cast("string"), None
    if not present:
        return F.lit(field.default), F.lit(field.default is None)
    return column.cast("string"), column.isNull()


def parsed_request(request, contract=None):
    """One request (a mapping of texts) by its contract, as a dict; ValueError names its faults."""
    values, faults = {}, []
    for field in contract or REQUEST_CONTRACT:
        given = request.get(field.name)
        value = field.default if given is None else given
        if field.kind == "integer":
            whole = re.match(r"\s*([+-]?\d+)", str(field.default if given in (None, "") else given))
            value = int(whole[1]) if whole else None
        required = field.kind != "optional_text"
        if required and (value is None or field.allowed and value not in field.allowed):
            faults.append(field.name)
        values[field.name] = value
    if faults:
        raise ValueError(f"request rejected for {', '.join(faults)}")
    return values


# Contract of a history row.
HISTORY_CONTRACT = (
    Field("date", "text"),
    *(Field(name, "number", 0.0) for name in ("open", "high", "low", "close", "volume")),
    Field("rsi", "number", 50.0),
    Field("rsi_status", "text", "Neutral"),
    *(
        Field(name, "strict_number")
        for name in (
            "macd", "macd_signal", "macd_hist",
            "sma_7", "sma_50", "sma_200",
            "ema_7", "ema_50", "ema_200",
        )
    ),
)

# Contract of current metrics.
METRICS_CONTRACT = tuple(
    Field(name, "required_number")
    for name in (
        "current_price", "change_24h", "change_percent_24h", "volume_24h",
        "high_24h", "low_24h", "rsi",
    )
)

# Contract of a period.
AGGREGATED_CONTRACT = (
    Field("period", "text"),
    *(Field(n, "number", 0.0) for n in ("avg_price", "max_price", "min_price", "total_volume")),
)

# Contract of a forecast.
FORECAST_CONTRACT = (
    Field("date_prices", "text"),
    *(
        Field(name, "number")
        for name in (
            "predicted_close_usd", "predicted_close_usd_lower", "predicted_close_usd_upper",
        )
    ),
    Field("predicted_at", "text"),
)

# Contract of a request.
REQUEST_CONTRACT = (
    Field("type", "choice", None, REQUEST_TYPES),
    Field("days", "integer", 30),
    Field("startDate", "optional_text"),
    Field("endDate", "optional_text"),
    Field("period", "choice", "weekly", tuple(PERIOD_UNITS)),
)
