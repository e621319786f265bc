"""Plan shapes that the scale of the data depends on."""

import pytest
from pyspark.sql import DataFrame

from pricemill.registry import QUERIES, tables


WRITING = (
    "stream_", "refresh_", "upsert_table", "append_", "write_", "observe_", "load_",
    "scan_csv", "scan_json", "csv_", "infer_", "dynamic_", "schema_drift",
)


def plan(spark, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    ["bars_from_orders", "bars_from_events", "bars_tied", "dedupe_latest", "rollup_month", "gold_month",
     "forecast_latest", "period_stats"],
)
def test_aggregates_hash(spark, sf_dir, name):
    text = plan(spark, sf_dir, name)
    assert "HashAggregate" in text and "SortAggregate" not in text


@pytest.mark.parametrize(
    "name",
    ["rsi14", "rsi14_ticks", "ema", "ema_ticks", "macd_ticks", "sma_ticks", "ffill",
     "rollup_year", "volatility_intensity", "find_duplicates", "upsert_by_key",
     "rsi_monthly_smooth", "dedupe_latest_text", "forecast_monthly_first"],
)
def test_no_single_partition(spark, sf_dir, name):
    assert "SinglePartition" not in plan(spark, sf_dir, name)


def windows(plan):
    """Every window of a logical plan, subqueries left out."""
    if plan.nodeName() == "Window":
        yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from windows(children.apply(i))


@pytest.mark.parametrize(
    "name",
    ["fx_spine_ffill", "usd_to_other", "asof_rate", "convert_daily", "obt_fact_day", "gold_week",
     "hist_daily", "agg_last12_month", "chart_series", "forecast_latest", "rsi14", "rsi14_ticks",
     "sma_ticks", "ema_ticks", "macd_ticks", "ffill", "volatility_intensity", "period_stats"],
)
def test_every_window_has_a_key(spark, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    plan = frame._jdf.queryExecution().optimizedPlan()
    assert all(not w.partitionSpec().isEmpty() for w in windows(plan))


@pytest.mark.parametrize(
    "name", ["dedupe_latest_text", "forecast_latest", "latest_two_bars", "agg_last12_week"]
)
def test_rank_filters_limit_groups(spark, sf_dir, name):
    assert "WindowGroupLimit" in plan(spark, sf_dir, name)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_and_no_cross_join(spark, sf_dir, name):
    if name.startswith(WRITING):
        pytest.skip("reads back what it wrote")
    text = plan(spark, sf_dir, name)
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas"):
        assert word not in text


def test_scans_read_only_needed_columns(spark, sf_dir):
    text = plan(spark, sf_dir, "bars_from_orders")
    assert "o_custkey" not in text and "o_orderstatus" not in text


def test_date_filter_reaches_the_scan(spark, sf_dir):
    text = plan(spark, sf_dir, "in_preset")
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in text


@pytest.mark.parametrize("made", [tables._refreshed, tables._corrected])
def test_refreshes_read_the_given_tables_once(spark, sf_dir, monkeypatch, made):
    """No step of a refresh aggregates the ticks and lines again: its inputs are stored tables."""
    read = []
    monkeypatch.setattr(
        tables.refresh, "refresh",
        lambda spark, root, *frames, **more: read.extend(
            path for f in frames if isinstance(f, DataFrame) for path in f.inputFiles()
        ),
    )
    made.__wrapped__(sf_dir)
    assert read and not any(path.startswith(f"file://{sf_dir}/") for path in read)
