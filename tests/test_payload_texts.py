"""Responses that are made twice have the same text, whatever order their rows come in."""

import pytest
from pyspark.sql import functions as F

from pricemill.registry import parsing
from pricemill.session import scratch_path
from tests.conftest import rows


@pytest.fixture(scope="module")
def turned(spark, sf_dir):
    """The tables in another order of rows and in several files."""
    place = scratch_path(spark, "turned")
    for name, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        table.repartition(5, F.xxhash64(key)).sortWithinPartitions(F.desc(key)).write.parquet(
            f"{place}/{name}.parquet"
        )
    return place


@pytest.mark.parametrize("made", ["candle_payloads", "fx_payloads", "indicator_payloads"])
def test_order_of_rows_does_not_show(spark, sf_dir, turned, made):
    texts = getattr(parsing, made)
    found = rows(texts(spark, turned), "payload")
    assert found == rows(texts(spark, sf_dir), "payload")
