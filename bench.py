"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

usage: python bench.py [name ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

from marketloom.plans import catalog
from marketloom.session import build_session

HEADLINE = (
    "sql01_customer_360", "sql02_product_360", "sql03_order_line_fact", "sql04_daily_sales", "sql07_rfm_segments", "sql08_executive_snapshot", "sql15_cohort_retention",
    "sql18_demand_forecast_train", "sql19_inventory_analytics", "sql22_supplier_performance", "c3_pareto", "c7_behavioral_features", "dq1_deduplicate", "dq12_validate_all", "dq8_profile_numeric",
    "m4_funnel", "m7_time_in_stage", "pr3_batch_prices", "i3_inventory_policies", "a1_statistical_anomalies", "d3_statistical_drift", "d4_ks_drift", "f2_moving_average", "f5_calendar_lag_features",
    "t4_kruskal", "t11_nearest_matches", "u8_auuc", "v2_kaplan_meier", "l6_predict_value", "n5_optimal_threshold", "r5_content_based", "g6_co_purchases", "e2_trade_areas", "x2_aspect_aggregates", "s3_point_in_time",
)


def run(spark, name: str, path: str) -> float:
    start = time.perf_counter()
    catalog.QUERIES[name](spark, path).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", int(cpus))
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in catalog.QUERIES]
    spark.read.parquet(f"{path}/orders.parquet").groupBy("o_orderstatus").count().collect()  # start the engine
    times = {name: round(run(spark, name, path), 3) for name in names}
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": path.rstrip("/").rsplit("sf", 1)[-1],
        "cpus": int(cpus), "spark": spark.version, "shuffle_partitions": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
