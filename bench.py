"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tideline.plans import queries  # noqa: E402
from tideline.session import build_session  # noqa: E402

HEADLINE = (
    "cdc_latest_state", "cdc_fold_changes", "cdc_partial_update", "cdc_replace", "cdc_transpose", "cdc_delta_long",
    "cdc_dead_letter", "cdc_before_after", "payload_decode", "json_records", "typed_cast", "cast_datetime",
    "query_lineage", "describe_fields", "check_primary_key", "check_foreign_key", "symmetric_difference",
    "partnership_roles", "partner_reconcile", "outbound_changes", "identity_column", "order_transitions",
    "order_document", "edi_validate", "edi_items", "stream_apply", "stream_state",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/region.parquet").groupBy("r_name").count().collect()  # start-up is not a query
    wanted = sys.argv[1:] or HEADLINE
    known = queries()
    seconds = {}
    for name in wanted:
        start = time.perf_counter()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
