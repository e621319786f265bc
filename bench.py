"""Run the headline queries and print one JSON line.

``BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``) and ``BENCH_CPUS`` (default 8) choose data
and cores. Each query is built and run to completion twice into a no-op sink, after one
warm-up of the session; the better time counts.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pricemill.registry import QUERIES  # noqa: E402
from pricemill.session import local_session  # noqa: E402

HEADLINE = (
    "bars_from_orders", "bars_from_events", "dedupe_latest", "find_duplicates",
    "rollup_week", "rollup_month", "rsi14", "sma", "ema", "macd",
    "rsi14_ticks", "sma_ticks", "ema_ticks", "macd_ticks", "ffill",
    "usd_to_other", "asof_rate", "convert_daily",
    "fact_indicators", "obt_fact_day", "gold_week", "gold_month",
    "current_metrics", "hist_daily", "hist_monthly", "agg_last12_week",
    "forecast_latest", "chart_series", "period_stats",
    "parse_candles", "upsert_by_key", "upsert_table", "dq_report", "stream_daily_bars",
    "obt_incremental", "gold_incremental", "load_candles",
)


def timed(spark, name, sf_dir):
    begun = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begun


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    timed(spark, "bars_from_orders", sf_dir)
    seconds = {
        name: round(min(timed(spark, name, sf_dir) for _ in range(2)), 3) for name in HEADLINE
    }
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
