"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set data and cores;
a query's time covers planning and full execution into a no-op sink.
"""

from __future__ import annotations

import json
import os
import time

from gyre.plans import queries
from gyre.session import local_session

HEADLINE = (
    "f1_adjacent_delta",
    "f5_runs",
    "f7_state_summary",
    "f10_spearman",
    "d3_activation_summary",
    "d1_whole_trace",
    "d7_pixel_state_stats",
    "d11_spatial_participation",
    "d14_flash_morphology",
    "f4_switching",
    "f6_persistence",
    "e14_patch_shift",
    "e19_before_after",
    "g2_extreme_rows",
    "g10_coverage_select",
    "h5_redundancy_matrix",
    "k5_upsert",
    "k15_motion_class",
    "k20_extract_certificate_fields",
    "a8_mark_duplicates",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "gyre-bench")
    registered, times = queries(), {}
    registered["f20_lexicographic_rank"](spark, folder).write.format("noop").mode("overwrite").save()  # warm-up
    for name in HEADLINE:
        began = time.perf_counter()
        registered[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rsplit("sf", 1)[-1]}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
