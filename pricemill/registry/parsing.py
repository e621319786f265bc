"""Payloads and files: written from the tables, parsed back, equal to what went in."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricemill.constants import INDICATOR_COLUMNS, OHLC
from pricemill.functions import scalars
from pricemill.operators import drift
from pricemill.registry import inputs
from pricemill.registry.entries import query
from pricemill.schemas import FX_CONTRACT
from pricemill.session import scratch_path
from pricemill.sources import files, payloads


def _epoch(date="date"):
    return F.unix_timestamp(F.col(date).cast("timestamp"))


def candle_payloads(spark, sf):
    """One response per series and month: ``[[time, low, high, open, close, volume], ...]``.

    Entries of all responses are in order: a response that is made again has the same text.
    """
    candle = F.array(
        _epoch().cast("string"), *[F.col(c).cast("string") for c in (*OHLC, "volume")]
    )
    return (
        inputs.bars(spark, sf)
        .groupBy("series", F.trunc("date", "month").alias("month"))
        .agg(F.to_json(F.array_sort(F.collect_list(candle))).alias("payload"))
    )


def fx_payloads(spark, sf):
    """One response per month: ``{"rates": {date: {"CHF": rate}}, ...}``."""
    day = F.struct(F.date_format("date", "yyyy-MM-dd").alias("key"), "rate")
    rates = F.transform(
        F.array_sort(F.collect_list(day)),
        lambda d: F.struct(d["key"], F.create_map(F.lit("CHF"), d["rate"]).alias("value")),
    )
    return (
        inputs.day_rates(spark, sf, "R")
        .groupBy(F.trunc("date", "month").alias("month"))
        .agg(
            F.to_json(
                F.struct(
                    F.lit(1.0).alias("amount"),
                    F.lit("USD").alias("base"),
                    F.date_format(F.min("date"), "yyyy-MM-dd").alias("start_date"),
                    F.date_format(F.max("date"), "yyyy-MM-dd").alias("end_date"),
                    F.map_from_entries(rates).alias("rates"),
                )
            ).alias("payload")
        )
    )


def indicator_payloads(spark, sf):
    names = ["d", "unixTs", "rsi", *INDICATOR_COLUMNS]
    raw = inputs.raw_indicators(spark, sf)
    return raw.groupBy(
        "series", "ingest_date_time", F.substring("d", 1, 7).alias("month")
    ).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*names)))).alias("payload"))


@query(
    "parse_candles",
    "SELECT series, CAST(date AS TIMESTAMP) AS time, low, high, open, close, volume FROM x_bars",
)
def parse_candles(spark, sf):
    return inputs.plain(payloads.parse_candles(candle_payloads(spark, sf), "payload"))


@query(
    "parse_fx_rates",
    "SELECT CAST(date AS TIMESTAMP) AS time, rate FROM x_rate_days WHERE flag = 'R'",
)
def parse_fx_rates(spark, sf):
    return inputs.plain(payloads.parse_fx_rates(fx_payloads(spark, sf), "payload", "chf"))


@query(
    "parse_indicators",
    "SELECT series, ingest_date_time, d, unix_ts, rsi, "
    + ", ".join(INDICATOR_COLUMNS)
    + ", CAST(d AS TIMESTAMP) AS time FROM x_raw_ind",
)
def parse_indicators(spark, sf):
    parsed = payloads.parse_indicators(
        indicator_payloads(spark, sf), "payload", ["series", "ingest_date_time"]
    )
    return inputs.plain(parsed).withColumnRenamed("unixTs", "unix_ts")


def _csv_bars(spark, sf):
    """Bars of every series as text, in the two time formats."""
    bars = inputs.bars(spark, sf)
    early = F.col("date") < F.lit("1998-01-01").cast("date")
    time = F.when(early, F.date_format("date", "yyyy-MM-dd")).otherwise(
        F.date_format(F.col("date").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    )
    return bars.select("series", time.alias("time"), *[F.col(c) for c in (*OHLC, "volume")])


_CSV = "SELECT series, CAST(date AS TIMESTAMP) AS time, low, high, open, close, volume FROM x_bars"


@query("scan_csv_bars", _CSV)
def scan_csv_bars(spark, sf):
    path = scratch_path(spark, "csv")
    files.write_csv(_csv_bars(spark, sf), path)
    return inputs.plain(files.scan_csv_bars(spark, path, ["series"]))


@query("csv_append_keep_last", _CSV.replace("volume FROM", "CASE WHEN date >= DATE '2000-01-01'"
       " THEN -volume ELSE volume END AS volume FROM"))
def csv_append_keep_last(spark, sf):
    """A re-fetched tail of every series is appended; its rows win over those already there."""
    path, target = scratch_path(spark, "csv"), scratch_path(spark, "csv")
    files.write_csv(_csv_bars(spark, sf), path)
    fresh = files.scan_csv_bars(spark, path, ["series"]).filter(F.col("time") >= "2000-01-01")
    fresh = fresh.withColumn("volume", -F.col("volume"))
    return inputs.plain(files.append_csv(spark, fresh, path, target, ["series"]))


_PROPS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("k", T.LongType())])


@query(
    "scan_json_rows",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
)
def scan_json_rows(spark, sf):
    path = scratch_path(spark, "json")
    events = inputs.table(spark, sf, "events")
    events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k")).write.json(path)
    return files.scan_json(spark, path, _PROPS)


@query(
    "scalar_json",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,"
    " json_extract_string(props, '$.k') AS k_text FROM events",
)
def scalar_json(spark, sf):
    events = inputs.table(spark, sf, "events")
    return files.scan_json_column(events, "props", "k bigint").select(
        "event_id", "k", F.get_json_object("props", "$.k").alias("k_text")
    )


@query(
    "coerce_numeric",
    "SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS price,"
    " TRY_CAST(o_orderpriority AS DOUBLE) AS bad FROM orders",
)
def coerce_numeric(spark, sf):
    return inputs.table(spark, sf, "orders").select(
        "o_orderkey",
        scalars.coerce_double(F.col("o_totalprice").cast("string")).alias("price"),
        scalars.coerce_double("o_orderpriority").alias("bad"),
    )


@query(
    "epoch_to_ts",
    "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS time FROM orders",
)
def epoch_to_ts(spark, sf):
    seconds = F.unix_timestamp(F.to_date("o_orderdate").cast("timestamp")).cast("string")
    return inputs.plain(
        inputs.table(spark, sf, "orders").select(
            "o_orderkey", scalars.epoch_to_timestamp(seconds).alias("time")
        )
    )


@query(
    "infer_payload_schema",
    "SELECT DISTINCT '$' AS path, 'object' AS type FROM events"
    " UNION ALL SELECT DISTINCT '$.k', 'number' FROM events WHERE props LIKE '%\"k\"%'",
)
def infer_payload_schema(spark, sf):
    events = inputs.table(spark, sf, "events")
    return drift.field_table(spark, drift.infer_schema(events, "props"))


@query(
    "dynamic_keys_to_map",
    "SELECT unnest(['$', '$.amount', '$.base', '$.end_date', '$.rates', '$.rates{}',"
    " '$.rates{}.CHF', '$.start_date']) AS path, unnest(['object', 'number', 'string',"
    " 'string', 'map', 'object', 'number', 'string']) AS type FROM"
    " (SELECT DISTINCT 1 FROM lineitem)",
)
def dynamic_keys_to_map(spark, sf):
    """The response type with its date keys taken as data."""
    responses = fx_payloads(spark, sf)
    return drift.field_table(spark, drift.infer_with_map(responses, "payload", "rates"))


@query(
    "schema_drift",
    "SELECT '$.rates{}.CHF' AS path, 'added' AS kind, CAST(NULL AS VARCHAR) AS expected,"
    " 'number' AS actual FROM (SELECT DISTINCT 1 FROM lineitem)"
    " UNION ALL SELECT '$.rates{}.EUR', 'removed', 'number', NULL"
    " FROM (SELECT DISTINCT 1 FROM lineitem)",
)
def schema_drift(spark, sf):
    """The contract asks for EUR; the responses carry CHF."""
    inferred = drift.infer_with_map(fx_payloads(spark, sf), "payload", "rates")
    expected = T.StructType(
        [
            *FX_CONTRACT.fields[:-1],
            T.StructField(
                "rates",
                T.MapType(
                    T.StringType(), T.StructType([T.StructField("EUR", T.DoubleType())])
                ),
            ),
        ]
    )
    return drift.diff(spark, expected, inferred)


# Each event as a payload whose ``rates`` are keyed by the day, with a field that comes and goes.
_EVENT_JSON = (
    "'{{\"id\": ' || {id} || ', \"kind\": \"' || event_type || '\", \"rates\": {{\"' || {day}"
    " || '\": {{\"CHF\": ' || {id} || ', \"note\": null}}}}, \"tags\": [\"a\", ' || {id} || ']'"
    " || CASE WHEN event_id % 2 = 0 THEN ', \"even\": true' ELSE '' END || '}}'"
)


def _event_payloads(spark, sf):
    text = _EVENT_JSON.format(id="CAST(event_id AS STRING)", day="date_format(ts, 'yyyy-MM-dd')")
    return inputs.table(spark, sf, "events").selectExpr(f"{text} AS payload")


_TREE = (
    "(SELECT regexp_replace(regexp_replace(fullkey, '\\.rates\\.\"?[0-9-]+\"?', '.rates{{}}', 'g'),"
    " '\\[[0-9]+\\]', '[]', 'g') AS path, j.type AS type, j.atom AS atom"
    " FROM (SELECT CAST({json} AS JSON) AS payload FROM events) AS e, json_tree(e.payload) AS j)"
)
_TREE_KIND = (
    "CASE WHEN path = '$.rates' THEN 'map' WHEN type IN ('OBJECT', 'ARRAY', 'BOOLEAN', 'NULL')"
    " THEN lower(type) WHEN type = 'VARCHAR' THEN 'string' ELSE 'number' END"
)
_EVENT_TREE = _TREE.format(
    json=_EVENT_JSON.format(id="CAST(event_id AS VARCHAR)", day="strftime(ts, '%Y-%m-%d')")
)


@query(
    "infer_paths",
    f"SELECT path, {_TREE_KIND} AS kind, count(*) AS seen FROM {_EVENT_TREE} GROUP BY ALL",
)
def infer_paths(spark, sf):
    """Every path of the payloads with its kinds; the days are found to be keys of a map."""
    return drift.infer_paths(_event_payloads(spark, sf), "payload")


@query(
    "infer_contract",
    "SELECT path, CASE count(DISTINCT kind) FILTER (kind <> 'null') WHEN 0 THEN 'null'"
    " WHEN 1 THEN max(kind) FILTER (kind <> 'null') ELSE 'mixed' END AS kind, count(*) AS seen"
    f" FROM (SELECT path, {_TREE_KIND} AS kind FROM {_EVENT_TREE}) GROUP BY path",
)
def infer_contract(spark, sf):
    return drift.merged_kinds(drift.infer_paths(_event_payloads(spark, sf), "payload"))


@query(
    "drift_paths",
    f"SELECT path, 'added' AS kind, CAST(NULL AS VARCHAR) AS expected, max({_TREE_KIND}) AS actual"
    f" FROM {_EVENT_TREE} WHERE path = '$.even' GROUP BY path",
)
def drift_paths(spark, sf):
    """What the odd events did not promise: a field of the even ones."""
    payloads_ = _event_payloads(spark, sf)
    is_even = F.col("payload").contains("even")
    odd = drift.merged_kinds(drift.infer_paths(payloads_.where(~is_even), "payload"))
    every = drift.merged_kinds(drift.infer_paths(payloads_, "payload"))
    return drift.diff_paths(odd, every)
