"""Payloads, files, windows to fetch, routing and naming."""

import datetime

import pytest
from pyspark.sql import functions as F

from pricemill.functions import scalars
from pricemill.plans import bronze
from pricemill.schemas import BAR
from pricemill.session import scratch_path
from pricemill.sources import files, payloads, planning
from tests.conftest import rows

D, T = datetime.date, datetime.datetime


def payload(spark, text):
    return spark.createDataFrame([("s", text)], "series string, payload string")


def test_candles_quoted_missing_and_bad(spark):
    text = (
        '[["1583020800","8520.25","8790","8555","8610","77.75"],'
        '[1583107200, null, 8911.5, 8600, "x", 3]]'
    )
    got = rows(payloads.parse_candles(payload(spark, text), "payload"))
    assert got == [
        ("s", T(2020, 3, 1), 8520.25, 8790.0, 8555.0, 8610.0, 77.75),
        ("s", T(2020, 3, 2), None, 8911.5, 8600.0, None, 3.0),
    ]


@pytest.mark.parametrize("text", ["[]", "", None, '{"message": "failed"}', "not json"])
def test_candles_nothing_to_parse(spark, text):
    got = payloads.parse_candles(payload(spark, text), "payload")
    assert got.count() == 0 and got.columns[1:] == [f.name for f in BAR.fields]


def test_rates_skip_missing_quotes(spark):
    text = (
        '{"amount":1.0,"base":"USD","rates":{"2020-01-02":{"EUR":0.9},'
        '"2020-01-03":{"CHF":0.97},"2020-01-06":{"EUR":"0.91","CHF":1}}}'
    )
    got = rows(payloads.parse_fx_rates(payload(spark, text), "payload", "eur"))
    assert got == [(T(2020, 1, 2), 0.9), (T(2020, 1, 6), 0.91)]


def test_indicator_time_from_date_or_epoch(spark):
    text = (
        '[{"d":"2020-03-01","unixTs":"1583020800","rsi":61.25,"macd":12.5},'
        '{"unixTs":"1583107200","rsi":"58.75"}]'
    )
    got = payloads.parse_indicators(payload(spark, text), "payload")
    assert rows(got, "time", "rsi", "macd") == [
        (T(2020, 3, 1), 61.25, 12.5), (T(2020, 3, 2), 58.75, None)
    ]
    assert payloads.parse_indicators(payload(spark, "[]"), "payload").count() == 0


def test_csv_mixed_times_and_keep_last(spark):
    old, new = scratch_path(spark, "csv"), scratch_path(spark, "csv")
    lines = [
        "time,low,high,open,close,volume",
        "2026-01-09,1,2,1.5,1.75,10",
        "2026-01-08 00:00:00,1,2,bad,1.75,11",
    ]
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(old)
    got = files.scan_csv_bars(spark, old)
    assert rows(got, "time", "open", "volume") == [
        (T(2026, 1, 8), None, 11.0), (T(2026, 1, 9), 1.5, 10.0)
    ]
    fresh = got.filter("volume = 10").withColumn("volume", F.lit(99.0))
    assert rows(files.append_csv(spark, fresh, old, new), "time", "volume") == [
        (T(2026, 1, 8), 11.0), (T(2026, 1, 9), 99.0)
    ]


def spans(spark, *pairs):
    return spark.createDataFrame([("s", *p) for p in pairs], "series string, lo date, hi date")


def test_candle_windows(spark):
    got = planning.plan_windows(spans(spark, (D(2020, 1, 1), D(2021, 2, 4))), "lo", "hi")
    assert rows(got, "window_start", "window_end") == [
        (D(2020, 1, 1), D(2020, 7, 19)), (D(2020, 7, 19), D(2021, 2, 4))
    ]


def test_fx_windows_skip_degenerate_and_future(spark):
    end = D(2020, 1, 1) + datetime.timedelta(days=366)
    got = planning.plan_fx_windows(
        spans(spark, (D(2020, 1, 1), end), (D(2030, 1, 1), end)), "lo", "hi"
    )
    assert rows(got, "window_start", "window_end") == [(D(2020, 1, 1), D(2020, 12, 31))]


def test_configured_pairs(spark):
    got = {(r.base, r.quote): (r.feed, r.table_name) for r in planning.configured_pairs(spark).collect()}
    assert len(got) == 6
    assert got["BTC", "USD"] == ("candles", "btc_usd_ohlcv")
    assert got["ETH", "BTC"] == ("candles", "eth_btc_ohlcv")
    assert got["USD", "CHF"] == ("fx", "usd_chf_rates")


@pytest.mark.parametrize(
    ("path", "custom", "schema"),
    [
        ("silver/crypto_prices/x.sql", None, "dlh_silver__crypto_prices"),
        ("models/Gold/Prices/x.sql", None, "dlh_gold__prices"),
        ("silver\\rates\\x.sql", "Dev", "dlh_silver__rates_dev"),
    ],
)
def test_schema_names(path, custom, schema):
    assert scalars.schema_for(path, custom) == schema


def test_requests_start_at_the_watermark_or_full_history(spark):
    pairs = planning.configured_pairs(spark)
    loaded = spark.createDataFrame(
        [("btc_usd_ohlcv", D(2020, 1, 1)), ("btc_usd_ohlcv", D(2020, 1, 5))],
        "table_name string, date date",
    )
    got = planning.plan_requests(pairs, loaded, "2020-01-10")
    first = {r.table_name: r.s for r in got.groupBy("table_name").agg(F.min("window_start").alias("s")).collect()}
    assert first["btc_usd_ohlcv"] == D(2020, 1, 5)
    assert first["usd_chf_rates"] == D(2010, 1, 1)
    assert first["eth_usd_ohlcv"] == D(2020, 1, 10) - datetime.timedelta(days=365 * 13)
    assert got.filter("table_name = 'btc_usd_ohlcv'").count() == 1


def test_bronze_loads_create_then_append(spark):
    target = scratch_path(spark, "bronze")
    one = payload(spark, '[[1640995200,1,4,2,3,10]]')
    assert bronze.load_candles(spark, payload(spark, "[]"), target) == 0
    assert bronze.load_candles(spark, one, target) == 1
    assert bronze.load_candles(spark, one, target) == 1
    assert spark.read.parquet(target).count() == 2
