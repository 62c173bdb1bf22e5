"""Wall time of the headline queries; prints one JSON line.

Build queries write the core tables from the raw feeds; the others read those tables, as a nightly run would.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from basketry.session import local_session  # noqa: E402
from verify.catalog import QUERIES  # noqa: E402
from verify.registry import warehouse  # noqa: E402

BUILD = ["int_item_logs", "int_item_scd2", "int_promoted", "fct_order", "dim_customer", "rpt_category_monthly"]
HEADLINE = [
    "cur4_curated_events", "scd3_event_windows", "stg3_explode_basket", "jn2_time_valid_broadcast", "jn2_time_valid_asof",
    "jn3_promo_window_broadcast", "jn3_promo_window_asof", "enr4_customer_sequence", "rpt4_category_scorecard", "rpt5_star_products", "rpt6_daypart",
    "rpt7_category_pairs", "rpt8_product_pairs", "rpt9_customer_promo", "ans1_service_area", "ans2_items_prices",
    "ans12_consumption", "ans15_controls", "ans16_star_detail", "bi17_switchable_kpis", "bi22_attach_rates",
    "aud1_curation", "aud7_price_anomaly", "aud15_reconciliation", "dq15_overlapping_promos", "sem4_foreign_dimension",
    "agg1_distinct_rollup",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1_000_000).selectExpr("sum(id)").collect()
    seconds: dict[str, float] = {}

    def timed(name: str, run) -> None:
        start = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - start, 3)

    tables = warehouse(spark, sf_dir)
    for name in BUILD:
        timed(f"build_{name}", lambda: tables[name])
    for name in HEADLINE:
        timed(name, lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    print(
        json.dumps(
            {
                "metric": "total wall time of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
