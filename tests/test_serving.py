"""Serving queries on hand-made tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from pricemill.operators import calendar, quality
from pricemill.plans import serving
from tests.conftest import rows

D = datetime.date


@pytest.fixture()
def rates(spark):
    return spark.createDataFrame(
        [(D(2020, 1, 1), 0.875, 0.75)], "date_rates date, rate_usd_chf double, rate_usd_eur double"
    )


def fact(spark, data):
    wide = spark.createDataFrame(
        data,
        "series string, date_prices date, close_usd double, high_usd double, low_usd double,"
        " volume double, rsi double",
    )
    extra = ("macd", "macd_signal", "macd_hist", "sma_7", "sma_50", "sma_200", "ema_7", "ema_50", "ema_200")
    return wide.withColumn("open_usd", F.col("close_usd")).withColumn(
        "rsi_status", F.lit("neutral")
    ).withColumns({f"{n}_usd": F.lit(0.0) if n == "macd" else F.lit(60100.0) for n in extra})


def test_metrics(spark, rates):
    df = fact(spark, [
        ("a", D(2020, 1, 1), 1.0, 1.0, 1.0, 1.0, 1.0),
        ("a", D(2020, 1, 2), 42000.0, 43000.0, 41000.0, 9.0, 40.0),
        ("a", D(2020, 1, 3), 43500.0, 44000.0, 42500.0, 10.0, 0.0),
        ("single", D(2020, 1, 3), 1.0, 1.0, 1.0, 1.0, 1.0),
    ])
    got = serving.current_metrics(df, rates).collect()
    assert len(got) == 1
    assert (got[0].change_24h, round(got[0].change_percent_24h, 2)) == (1500.0, 3.57)
    assert (got[0].rsi, got[0].trend, got[0].is_positive) == (50.0, "up", True)
    eur = serving.current_metrics(df, rates, "EUR").first()
    assert eur.change_24h == pytest.approx(1125.0) and eur.volume_24h == 10.0


def test_history_routing_and_defaults(spark, rates):
    daily = fact(spark, [("a", D(2020, 1, 2), 42000.0, 43000.0, None, None, None)])
    month = daily.withColumnRenamed("date_prices", "month_start_date").withColumn("rsi", F.lit(71.0))
    got = serving.history(daily, month, rates, days=30, as_of="2020-01-20").first()
    assert (got.low, got.volume, got.rsi, got.rsi_status) == (0.0, 0.0, 0.0, "neutral")
    got = serving.history(daily, month, rates, days=3650, as_of="2020-01-20").first()
    assert (got.volume, got.rsi_status) == (0.0, "Overbought")
    chf = serving.history(daily, month, rates, days=30, currency="CHF", as_of="2020-01-20").first()
    assert chf.sma_7 == pytest.approx(60100 * 0.875) and chf.macd is None
    assert serving.history(daily, month, rates, days=3, as_of="2020-01-20").count() == 0
    between = serving.history(daily, month, rates, start="2020-01-01", end="2020-01-02", as_of="2020-01-20")
    assert between.count() == 1


def predictions(spark, days=400):
    start = D(2020, 1, 1)
    data = []
    for i in range(days):
        for at in (2, 1, 3):
            data.append(("a", start + datetime.timedelta(days=i), 820.0 + at, 790.0, 850.0, at))
    return spark.createDataFrame(
        data,
        "series string, date_prices date, predicted_close_usd double,"
        " predicted_close_usd_lower double, predicted_close_usd_upper double, predicted_at long",
    )


def test_forecast_newest_prediction_of_earliest_dates(spark, rates):
    got = serving.forecast(predictions(spark), rates, "EUR")
    assert got.count() == 365
    assert got.agg(F.max("date_prices")).first()[0] == D(2020, 12, 30)
    assert got.first().predicted_close_usd == pytest.approx(823 * 0.75)


@pytest.mark.parametrize(
    ("name", "count"),
    [("1w", 7), ("1m", 30), ("6m", 180), ("1y", 365), ("ytd", 365), ("custom", 180), ("all", 12)],
)
def test_forecast_slices(spark, rates, name, count):
    rows_ = serving.forecast(predictions(spark), rates)
    assert serving.forecast_slice(rows_, name).count() == count
    assert serving.forecast_slice(rows_.limit(0), name).count() == 0


def test_forecast_applies(spark):
    df = spark.createDataFrame([(D(2020, 1, 1),), (D(2020, 1, 2),), (None,)], "end date")
    got = rows(df.select("end", serving.forecast_applies(F.col("end"), "2020-01-02").alias("yes")))
    assert [r[1] for r in got] == [True, False, True]


def test_aggregated_routes_by_period(spark):
    weeks = fact(spark, [
        ("a", D(2020, 1, 6) + datetime.timedelta(days=7 * i), float(i), 2.0, 1.0, 5.0, 50.0) for i in range(20)
    ]).withColumnRenamed("date_prices", "iso_week_start_date")
    got = serving.aggregated({"week": weeks}, "weekly").collect()
    assert len(got) == 12 and got[0].avg_price == 19.0 and got[0].total_volume == 0.0
    assert serving.aggregated({"week": weeks}, "unknown").count() == 12


def test_limits_and_grain_are_arguments(spark, rates):
    daily = fact(spark, [("a", D(2020, 1, i), float(i), 2.0, 1.0, 5.0, 50.0) for i in range(1, 21)])
    weeks = daily.withColumnRenamed("date_prices", "iso_week_start_date")
    assert serving.aggregated({"week": weeks}, "weekly", periods=None).count() == 20
    assert serving.forecast(predictions(spark, 400), rates, dates=None).count() == 400
    got = serving.history(daily, None, rates, days=3650, as_of="2020-01-20", grain="day")
    assert got.count() == 20


def test_request_contract():
    got = quality.parsed_request({"type": "history", "days": "12x", "startDate": "2020-01-01"})
    assert got == {
        "type": "history", "days": 12, "period": "weekly",
        "startDate": "2020-01-01", "endDate": None,
    }
    assert quality.parsed_request({"type": "metrics", "days": ""})["days"] == 30
    with pytest.raises(ValueError, match="type, days, period"):
        quality.parsed_request({"days": "soon", "period": "daily"})


def test_dispatch(spark, rates):
    daily = fact(spark, [("a", D(2020, 1, i), float(i), 2.0, 1.0, 5.0, 50.0) for i in (1, 2, 3)])
    tables = {
        "fact": daily, "usd_to_other": rates, "forecasts": predictions(spark, 3),
        "gold": {
            "week": daily.withColumnRenamed("date_prices", "iso_week_start_date"),
            "month": daily.withColumnRenamed("date_prices", "month_start_date"),
        },
    }
    assert serving.serve({"type": "metrics"}, tables, "2020-01-03").count() == 1
    assert serving.serve({"type": "history"}, tables, "2020-01-03").count() == 3
    assert serving.serve({"type": "aggregated"}, tables, "2020-01-03").count() == 3
    assert serving.serve({"type": "forecast"}, tables, "2020-01-03").count() == 3
    with pytest.raises(ValueError):
        serving.serve({"type": "other"}, tables, "2020-01-03")


def test_days_for_filters():
    assert serving.days_for("1y", D(2020, 3, 1)) == 365
    assert serving.days_for("ytd", D(2020, 3, 1)) == 60
    assert serving.days_for("custom", D(2020, 3, 1)) == 180


def test_period_stats(spark):
    df = spark.createDataFrame(
        [("a", D(2020, 1, 2), 12.0, 15.0, 9.0, 11.0), ("a", D(2020, 1, 1), 10.0, 11.0, 8.0, 10.5)],
        "series string, date date, open double, high double, low double, close double",
    )
    got = serving.period_stats(df).first()
    assert (got.start_open, got.end_close, got.period_high, got.period_low) == (10.0, 11.0, 15.0, 8.0)
    assert got.variation == pytest.approx(10.0)


def test_ranges_are_put_in_order(spark):
    df = spark.createDataFrame(
        [("2020-02-01 ~ 2020-01-01",), ("2020-01-01~2020-02-01",), ("2020-01-01",), ("x ~ 2020-01-01",)],
        "t string",
    )
    got = [r.r for r in df.select(calendar.normalized_range("t").alias("r")).collect()]
    assert [(r.start, r.end) for r in got[:2]] == [(D(2020, 1, 1), D(2020, 2, 1))] * 2
    assert got[2:] == [None, None]
