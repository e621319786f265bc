"""Checks, row contracts and schema drift."""

from pyspark.sql import types as T

from pricemill.operators import drift, quality
from pricemill.schemas import INDICATOR_CONTRACT
from tests.conftest import rows


def test_checks_in_one_pass(spark):
    df = spark.createDataFrame(
        [(1, 1.0, 101.0, "2020-01-01"), (1, 0.0, -1.0, "01/02/2020"), (2, None, None, None)],
        "k int, price double, rsi double, d string",
    )
    checks = [
        quality.not_null("price"), quality.positive("price"), quality.percentage("rsi"),
        quality.date_text("d"),
    ]
    got = {(r.check, r.column): r.failing for r in quality.report(df, checks, ["k"]).collect()}
    assert got == {
        ("not_null", "price"): 1, ("positive_value", "price"): 1, ("percentage_range", "rsi"): 2,
        ("date_format", "d"): 1, ("unique", "k"): 1,
    }


def test_empty_table_fails_nothing(spark):
    df = spark.createDataFrame([], "price double")
    assert quality.run_checks(df, [quality.positive("price")]).first().failing == 0


def test_ohlc_integrity(spark):
    df = spark.createDataFrame(
        [(1.0, 4.0, 2.0, 3.0), (2.5, 4.0, 2.0, 3.0), (1.0, 2.5, 2.0, 3.0), (None, 4.0, 2.0, 3.0)],
        "low double, high double, open double, close double",
    )
    assert quality.run_checks(df, [quality.ohlc()]).first().failing == 2
    assert quality.run_checks(df, [quality.ohlc_nulls()]).first().failing == 1


def test_row_contract(spark):
    df = spark.createDataFrame(
        [("2020-01-01", "1.5", None, "Neutral"), (None, "1", "50", "Neutral"), ("d", "x", "50", None)],
        "date string, open string, rsi string, rsi_status string",
    )
    valid, rejected = quality.validate(df, quality.HISTORY_CONTRACT)
    assert rows(valid, "date", "open", "rsi", "close", "macd") == [("2020-01-01", 1.5, 0.0, 0.0, None)]
    assert sorted(r.faults for r in rejected.collect()) == [["date"], ["open", "rsi_status"]]


def test_absent_rsi_is_neutral(spark):
    df = spark.createDataFrame([("2020-01-01",)], "date string")
    valid, _ = quality.validate(df, quality.HISTORY_CONTRACT)
    assert rows(valid, "rsi", "rsi_status") == [(50.0, "Neutral")]


def test_request_contract(spark):
    df = spark.createDataFrame(
        [("history", "90", None), ("metrics", None, "monthly"), ("other", "1", None),
         ("history", "7days", "daily"), ("history", "abc", None)],
        "type string, days string, period string",
    )
    valid, rejected = quality.validate(df, quality.REQUEST_CONTRACT)
    assert rows(valid, "type", "days", "period") == [("history", 90, "weekly"), ("metrics", 30, "monthly")]
    assert sorted(r.faults for r in rejected.collect()) == [["days"], ["period"], ["type"]]


def test_inferred_types_are_merged(spark):
    df = spark.createDataFrame(
        [('[{"d":"2020-01-01","rsi":1}]',), ('[{"d":"2020-01-02","rsi":1.5,"extra":true}]',)],
        "payload string",
    )
    got = drift.fields(drift.infer_schema(df, "payload"))
    assert got == {
        "$": "array", "$[]": "object", "$[].d": "string", "$[].rsi": "number", "$[].extra": "boolean"
    }


def test_drift_kinds(spark):
    df = spark.createDataFrame([('[{"d":5,"unixTs":"1","rsi":1.0,"new":1}]',)], "payload string")
    got = {(r.path, r.kind) for r in drift.diff(spark, INDICATOR_CONTRACT, drift.infer_schema(df, "payload")).collect()}
    assert ("$[].d", "retyped") in got and ("$[].new", "added") in got and ("$[].macd", "removed") in got
    assert drift.diff(spark, INDICATOR_CONTRACT, INDICATOR_CONTRACT).count() == 0


def test_data_keys_become_a_map(spark):
    df = spark.createDataFrame(
        [('{"base":"USD","rates":{"2020-01-01":{"EUR":0.9},"2020-01-02":{"EUR":1}}}',)], "payload string"
    )
    inferred = drift.infer_with_map(df, "payload", "rates")
    assert isinstance(inferred["rates"].dataType, T.MapType)
    assert drift.fields(inferred)["$.rates{}.EUR"] == "number"


def test_a_report_in_one_pass(spark):
    df = spark.createDataFrame(
        [("a", 1, -1.0), ("a", 1, None), ("a", 2, 3.0), (None, 2, 0.0), (None, 2, 1.0)],
        "series string, day int, price double",
    )
    checks = [quality.not_null("price"), quality.positive("price"), quality.not_null("series")]
    keys = ["series", "day"]
    once = rows(quality.report_once(df, checks, keys))
    assert once == rows(quality.report(df, checks, [keys]))
    assert [r[2] for r in rows(quality.report_once(df.limit(0), checks, keys))] == [0, 0, 0, 0]
    both = quality.report_tables({"x": (df, checks, keys), "y": (df.limit(0), checks[:1], ["day"])})
    assert both.count() == 6
