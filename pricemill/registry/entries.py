"""The two registries and the SQL building blocks the entries share."""

import re

QUERIES = {}
ORACLES = {}

# Named sub-queries, in an order in which each uses only earlier ones.
PARTS = {}


def query(name, sql=None):
    """Register a query under a name, with the SQL that must give the same rows."""

    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = with_parts(sql)
        return function

    return register


def part(name, sql):
    PARTS[name] = sql


def with_parts(sql):
    """Prefix a statement with the named sub-queries it refers to."""
    needed, texts = set(), [sql]
    while texts:
        text = texts.pop()
        for name, body in PARTS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                texts.append(body)
    if not needed:
        return sql
    parts = ",\n".join(f"{n} AS ({PARTS[n]})" for n in PARTS if n in needed)
    return f"WITH {parts}\n{sql}"


def rounded(expression, digits=2):
    """Half-up rounding of a double by its decimal text, as Spark rounds."""
    return (
        f"CAST(round(CAST(CAST({expression} AS VARCHAR) AS DECIMAL(38,20)), {digits}) AS DOUBLE)"
    )


def rsi_parts(prefix, source, order, price):
    """Sub-queries for RSI over ``source``: change, averages, value and status."""
    part(
        f"{prefix}_change",
        f"SELECT *, {price} - lag({price}) OVER (PARTITION BY series ORDER BY {order})"
        f" AS change FROM {source}",
    )
    frame = f"(PARTITION BY series ORDER BY {order} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)"
    part(
        f"{prefix}_avg",
        f"SELECT *, avg(CASE WHEN change > 0 THEN change ELSE 0 END) OVER {frame} AS avg_gain,"
        f" avg(CASE WHEN change < 0 THEN -change ELSE 0 END) OVER {frame} AS avg_loss"
        f" FROM {prefix}_change",
    )
    value = rounded("100 - 100 / (1 + avg_gain / nullif(avg_loss, 0))")
    part(f"{prefix}_raw", f"SELECT *, {value} AS raw FROM {prefix}_avg")
    part(
        f"{prefix}_rsi",
        "SELECT *, CASE WHEN raw BETWEEN 0 AND 100 THEN raw END AS rsi,"
        " CASE WHEN raw < 30 THEN 'oversold' WHEN raw > 70 THEN 'overbought'"
        f" ELSE 'neutral' END AS rsi_status FROM {prefix}_raw",
    )
