"""Typed ranges and times: every text is parsed once, in the one form it can have."""

import datetime

from pricemill.functions.scalars import parse_time
from pricemill.operators.calendar import normalized_range
from pricemill.registry import QUERIES
from tests.conftest import rows


def test_each_side_is_parsed_once(spark, sf_dir):
    plan = QUERIES["normalize_range"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("gettimestamp(") == 2  # one for each form


def test_texts(spark):
    texts = [("2020-01-02",), ("2020-01-02 03:04:05",), ("2020-01-02 3:04",), ("2020-1-2",), ("x",),
             ("",), ("10:11",), ("2020-01-02 ~ 2019-12-31 23:59:59",), ("2020-01-02~",),
             ("2020-01-02 ~ 2020-01-03 ~ 2020-01-04",), ("2020-01-02 ~ no",), (None,)]
    frame = spark.createDataFrame(texts, "t string")
    times = {r[0]: r[1] for r in frame.select("t", parse_time("t")).collect() if r[1] is not None}
    assert times == {
        "2020-01-02": datetime.datetime(2020, 1, 2),
        "2020-01-02 03:04:05": datetime.datetime(2020, 1, 2, 3, 4, 5),
    }
    ranges = frame.select(normalized_range("t").alias("r")).where("r IS NOT NULL").select("r.*")
    assert rows(ranges) == [(datetime.date(2019, 12, 31), datetime.date(2020, 1, 2))]
