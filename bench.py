"""Time the headline queries on one machine and print one JSON line.

Every query starts from the parquet files; nothing is cached between queries. Each is run once to warm
the JVM (class loading, code generation) and then timed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tradegrain.registry import QUERIES  # noqa: E402
from tradegrain.session import build_session  # noqa: E402

HEADLINE = [
    "master_orders",
    "q1_top_categories",
    "q2_state_sales_freight",
    "q3_mom_growth",
    "q4_repeat_vs_onetime",
    "q5_payment_installments",
    "q6_delivery_delay_reviews",
    "q7_underperforming_categories",
    "kpi_overview",
    "rfm_segments",
    "pareto_categories",
    "csat_delay_buckets",
    "logistics_by_state",
    "payment_channels",
    "ord_bottleneck_states",
    "rev_by_delivery",
    "eda_category_gmv",
    "dq_nulls",
    "ml_delay_features",
    "ml_roc_auc",
    "ts_forecast",
    "whatif_sweep",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.time()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
