"""Indicator semantics on hand-made rows."""

import datetime
import itertools

import pytest
from pyspark.sql import functions as F

from pricemill.operators import indicators
from pricemill.plans import serving
from tests.conftest import rows

D = datetime.date


def priced(spark, closes, series="a", start=D(2020, 1, 1)):
    data = [
        (series, start + datetime.timedelta(days=i), None if c is None else float(c))
        for i, c in enumerate(closes)
    ]
    return spark.createDataFrame(data, "series string, date date, close double")


def test_first_change_is_null_and_counts_as_zero(spark):
    out = indicators.rsi(priced(spark, [10, 12, 11]), "series", "date", "close", keep_parts=True)
    got = rows(out, "date", "change", "avg_gain", "avg_loss")
    assert got[0][1:] == (None, 0.0, 0.0)
    assert got[1][1:] == (2.0, 1.0, 0.0)
    assert got[2][2] == pytest.approx(2 / 3)
    assert got[2][3] == pytest.approx(1 / 3)


def test_all_gains_give_no_value_but_neutral(spark):
    out = indicators.rsi(priced(spark, range(1, 20)), "series", "date", "close")
    assert {(r.rsi, r.rsi_status) for r in out.collect()} == {(None, "neutral")}


def test_all_losses_are_oversold(spark):
    out = indicators.rsi(priced(spark, range(20, 1, -1)), "series", "date", "close")
    assert rows(out, "date", "rsi", "rsi_status")[-1][1:] == (0.0, "oversold")


def test_window_counts_rows_not_days(spark):
    closes = [10 + (-1) ** i * i * 0.5 for i in range(30)]
    dense = priced(spark, closes)
    gaps = dense.withColumn("date", F.expr("date_add(date, CAST(date_diff(date, '2020-01-01') * 3 AS INT))"))
    one = [r[1:] for r in rows(indicators.rsi(dense, "series", "date", "close"), "date", "rsi")]
    two = [r[1:] for r in rows(indicators.rsi(gaps, "series", "date", "close"), "date", "rsi")]
    assert one == two


def test_status_is_strict(spark):
    from pricemill.functions.scalars import rsi_label, rsi_status

    df = spark.createDataFrame([(29.99,), (30.0,), (70.0,), (70.01,), (None,)], "v double")
    got = {r.v: (r.s, r.l) for r in df.select("v", rsi_status("v").alias("s"), rsi_label("v").alias("l")).collect()}
    assert got == {
        29.99: ("oversold", "Oversold"), 30.0: ("neutral", "Neutral"), 70.0: ("neutral", "Neutral"),
        70.01: ("overbought", "Overbought"), None: ("neutral", "Neutral"),
    }


def sequential_ema(values, span):
    keep, out, state = (span - 1) / (span + 1), [], None
    for v in values:
        if v is None:
            out.append(None)
            continue
        state = v if state is None else keep * state + (1 - keep) * v
        out.append(state)
    return out


@pytest.mark.parametrize("span", [1, 2, 7, 50])
def test_ema_matches_recurrence(spark, span):
    values = [None, 5.0, 7.5, None, 1.0] + [float((i * 37) % 101) for i in range(2000)] + [None]
    out = indicators.ema(priced(spark, values), "series", "date", "close", (span,))
    got = [r[1] for r in rows(out, "date", f"ema_{span}")]
    for a, b in zip(got, sequential_ema(values, span), strict=True):
        assert a == pytest.approx(b, rel=1e-12) if b is not None else a is None


def test_macd_identity_and_sign(spark):
    values = [100 + (i * 37) % 11 for i in range(300)]
    out = indicators.macd(priced(spark, values), "series", "date", "close").collect()
    fast, slow = sequential_ema(values, 12), sequential_ema(values, 26)
    line = [a - b for a, b in zip(fast, slow)]
    signal = sequential_ema(line, 9)
    for r, a, b in zip(sorted(out, key=lambda r: r.date), line, signal, strict=True):
        assert r.macd == pytest.approx(a, abs=1e-9)
        assert r.macd_signal == pytest.approx(b, abs=1e-9)
        assert r.macd_hist == r.macd - r.macd_signal


def test_sma_needs_a_full_span(spark):
    out = indicators.sma(priced(spark, [1, 2, 3, 4]), "series", "date", "close", (3,))
    assert [r[1] for r in rows(out, "date", "sma_3")] == [None, None, 2.0, 3.0]


def test_rsi_points_as_asked(spark):
    data = [("a", datetime.date(2020, 1, i), float(i)) for i in range(1, 11)]
    df = spark.createDataFrame(data, "series string, date date, rsi double")
    assert indicators.rsi_points(df, "series", smooth=False).count() == 10
    got = indicators.rsi_points(df, "series", smooth=True).collect()
    assert [tuple(r) for r in got] == [("a", datetime.date(2020, 1, 15), 5.5)]


def test_rsi_points_smooth_only_long_spans(spark):
    start = D(2020, 1, 1)
    long = [("l", start + datetime.timedelta(days=i), None if i == 0 else 0.0) for i in range(731)]
    short = [("s", start + datetime.timedelta(days=i), None if i == 0 else 40.0) for i in range(730)]
    df = spark.createDataFrame(long + short, "series string, date date, rsi double")
    got = indicators.rsi_points(df, "series")
    long_points = rows(got.filter("series = 'l'"), "date", "value")
    assert len(long_points) == 24 or len(long_points) == 25
    assert long_points[0] == (D(2020, 1, 15), 50.0)
    assert got.filter("series = 's'").count() == 729


def test_low_repair(spark):
    data = [
        (D(2017, 4, 1), 10.0, 3.0, 2.0, 1.0),
        (D(2017, 4, 1), 300.0, 200.0, 250.0, 100.0),
        (D(2017, 4, 2), 10.0, 3.0, 2.0, 1.0),
        (D(2020, 1, 1), 9.0, 3.0, 5.0, 0.0),
        (D(2020, 1, 2), 9.0, 3.0, 5.0, -4.0),
    ]
    df = spark.createDataFrame(data, "date date, high double, open double, close double, low double")
    got = [r.low for r in serving.repair_lows(df).collect()]
    assert got == [3.0, 100.0, 1.0, 5.0, 5.0]


def test_volatility_intensity_handles_flat_series(spark):
    df = spark.createDataFrame(
        [("a", 2.0, 1.0), ("a", 5.0, 1.0), ("b", 1.0, 1.0), (None, 3.0, 1.0)],
        "series string, high double, low double",
    )
    got = rows(indicators.volatility_intensity(df, "series"), "series", "volatility", "intensity")
    assert got == [(None, 2.0, 1.0), ("a", 1.0, 0.25), ("a", 4.0, 1.0), ("b", 0.0, None)]


@pytest.mark.parametrize("chunk_rows", [None, 64])
def test_sma_of_awkward_prices(spark, chunk_rows):
    """Missing, infinite and huge prices count in their own spans only."""
    prices = [float(i * i % 97) for i in range(700)]
    for i in (3, 4, 5, 6, 7, 8, 9, 10, 300):
        prices[i] = None
    prices[100], prices[200], prices[400] = float("inf"), 1e300, float("nan")
    frame = spark.createDataFrame(
        [("a", i, p) for i, p in enumerate(prices)] + [("b", 1, 2.0)], "series string, i long, p double"
    )
    spans = (1, 7, 64, 200)
    found = {
        r["i"]: r for r in indicators.sma(frame, "series", "i", "p", spans, chunk_rows).collect()
        if r["series"] == "a"
    }
    assert len(found) == len(prices)
    for i, span in itertools.product(range(len(prices)), spans):
        seen = [p for p in prices[max(0, i + 1 - span):i + 1] if p is not None]
        got = found[i][f"sma_{span}"]
        if i + 1 < span or not seen:
            assert got is None
        else:
            assert got == pytest.approx(sum(seen) / len(seen), rel=1e-12, nan_ok=True)


def test_sma_has_no_sliding_frame(spark):
    """A frame that slides is added up anew on every row: ``span`` steps a row."""
    frame = spark.createDataFrame([("a", 1, 1.0)], "series string, i long, p double")
    plan = indicators.sma(frame, "series", "i", "p", (7, 200))._jdf.queryExecution().toString()
    assert "lag(" in plan and "avg(" not in plan
