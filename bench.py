"""Times the headline queries and prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from faresight.plans import catalog
from faresight.session import local_session

HEADLINE = [
    "price_bounds", "fare_history", "price_changes", "market_snapshot", "demand_score", "fare_estimate", "calendar_features",
    "stable_seed", "booking_decision", "trend_probability", "fallback_forecast", "forecast_grid", "booking_details",
    "active_alert_details", "alert_matches", "evaluate_alerts", "connecting_routes", "offers_top_k", "dedupe_offers",
    "mark_best_offer", "rank_airports", "customer_kpis", "loyalty_tier", "tier_progress", "confirm_bookings", "apply_coupon",
    "upsert_routes", "regression_metrics", "validate_rejects", "fare_features", "windowed_fares", "booking_refs", "complete_forecast",
    "encode_categories", "train_model", "answer_requests",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus)
    # One small run, so that start-up and first compilation are not charged to the first query.
    catalog.QUERIES["row_counts"](spark, sf).write.format("noop").mode("overwrite").save()
    only = sys.argv[1:]
    seconds = {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline query time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"), "cpus": cpus,
        "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
