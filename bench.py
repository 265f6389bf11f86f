"""Time the headline queries: python bench.py [key ...]

BENCH_SF_DIR (default /root/testdata/sf0.1) names the data, BENCH_CPUS (default 8) the local cores.
Each query runs once to warm up code generation and file caches, then once for the clock, into the
no-op sink so that every row is computed and none is collected. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

from loupewright.catalog import all_queries
from loupewright.sources.session import local_session

HEADLINE = """
rpt_order_status rpt_item_process rpt_process_totals rpt_casting_repair_order rpt_product_price
rpt_wip_master rpt_qa_calendar rpt_target_history rpt_process_dense rpt_material_lateness rpt_material_by_item
rpt_qa_master rpt_qa_item_detail rpt_qa_bills rpt_repair_bills rpt_repair_reasons rpt_factory_to_qa
rpt_repair_documents rpt_mould_loans rpt_purchase_requests
cumulative_asof_sum range_count_join correlated_agg latest_revision_join nest_children densify_cross
pivot_sum_zero fifo_allocate row_number_display running_balance sort_multi
apply_upserts apply_increments assign_document_numbers explode_document
threshold_alert_batch offline_device_batch monthly_usage_matrix
""".split()


def run(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    plans = all_queries()
    seconds: dict[str, float] = {}
    for key in sys.argv[1:] or HEADLINE:
        run(plans[key](spark, folder))
        started = time.perf_counter()
        run(plans[key](spark, folder))
        seconds[key] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
