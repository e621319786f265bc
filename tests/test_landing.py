"""One load for all pairs: routing, refusals, repeats, and what to ask for next."""

import json

from pyspark.sql import functions as F

from pricemill.plans import landing
from pricemill.schemas import CSV_BAR
from pricemill.sources import evolving, tables
from tests.conftest import rows

SCHEMA = "kind string, base string, quote string, payload string"
CANDLE = json.dumps([[86400, 1, 4, 2, 3, 9], [172800, "2", "5", "3", "4", "8"]])
RATES = json.dumps({"base": "USD", "rates": {"2024-01-02": {"CHF": 0.9, "EUR": 0.8}, "2024-01-03": {"CHF": 0.91}}})
POINTS = json.dumps([{"d": "2024-01-02", "unixTs": "1704153600", "rsi": "51", "macd": 1.5}])


def landed(spark, *found):
    return spark.createDataFrame(list(found), SCHEMA)


def test_every_feed_has_its_parser(spark, tmp_path):
    root = str(tmp_path / "r")
    written = landing.load_all(spark, landed(
        spark, ("prices", "BTC", "USD", CANDLE), ("prices", "ETH", "BTC", CANDLE),
        ("prices", "usd", "chf", RATES), ("prices", "USD", "EUR", RATES),
        ("indicators", "BTC", "USD", POINTS), ("prices", "BTC", "USD", RATES),
        ("prices", "USD", "EUR", None), ("indicators", "BTC", "USD", "not json"),
        ("prices", "BTC", "USD", "[]"),
    ), root, "2024-02-01")
    assert written == {"candles": 4, "fx": 3, "indicators": 1, "rejected": 3}
    found = evolving.read(spark, f"{root}/fx")
    assert rows(found, "table_name", "rate") == [
        ("usd_chf_rates", 0.9), ("usd_chf_rates", 0.91), ("usd_eur_rates", 0.8)
    ]
    assert rows(evolving.read(spark, f"{root}/candles"), "table_name", "close")[0] == (
        "btc_usd_ohlcv", 3.0
    )
    refused = evolving.read(spark, f"{root}/rejected")
    assert rows(refused, "feed") == [("candles",), ("fx",), ("indicators",)]


def test_a_delivery_may_be_repeated(spark, tmp_path):
    root = str(tmp_path / "r")
    first = landed(spark, ("prices", "BTC", "USD", CANDLE), ("prices", "BTC", "USD", "x"))
    assert landing.load_all(spark, first, root)["candles"] == 2
    more = first.unionAll(landed(spark, ("prices", "AAVE", "USD", CANDLE)))
    assert landing.load_all(spark, more, root) == {
        "candles": 2, "fx": 0, "indicators": 0, "rejected": 0
    }
    assert evolving.read(spark, f"{root}/candles").count() == 4


def test_requests_follow_from_the_tables(spark, tmp_path):
    root = str(tmp_path / "r")
    landing.load_all(spark, landed(
        spark, ("prices", "BTC", "USD", CANDLE), ("prices", "USD", "CHF", RATES)
    ), root)
    found = landing.next_requests(spark, root, "2024-01-05")
    chf = [r for r in rows(found, "table_name", "window_start", "window_end") if "chf" in r[0]]
    assert [(str(a), str(b)) for _, a, b in chf] == [("2024-01-03", "2024-01-05")]


def test_an_empty_landing_leaves_typed_tables(spark, tmp_path):
    root = str(tmp_path / "r")
    written = landing.load_all(spark, landed(spark, ("prices", "A", "B", "[]")).limit(0), root)
    assert set(written.values()) == {0}
    assert {"series", "time", "close", "date"} <= set(evolving.read(spark, f"{root}/candles").columns)


def test_catalog_tables_before_rows(spark, tmp_path):
    name = "declared_here.bars"
    tables.declare_table(spark, name, CSV_BAR, str(tmp_path / "t"), ("time",))
    assert tables.scan_table(spark, name).count() == 0
    part = spark.createDataFrame([("t", "1")], "time string, close string")
    assert tables.load_table(part, name) == 1
    assert tables.load_table(part.withColumn("low", F.lit("0")), name) == 1
    assert sorted(rows(tables.scan_table(spark, name), "low", "close"), key=str) == [
        ("0", "1"), (None, "1")
    ]
    assert set(tables.scan_table(spark, name).columns) == set(CSV_BAR.names)
