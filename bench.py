"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from meshtide.plans.queries import QUERIES  # noqa: E402
from meshtide.session import local_session, tables_freed  # noqa: E402

HEADLINE = ["velocity_codes", "cic_paint_int", "tsc_paint_int", "tile_paint_int", "tsc_gather", "poisson_force",
            "coarse_force_matched", "pk_card", "cross_r", "bispectrum", "interlaced_pk", "run_rank", "drift_dithered",
            "migrate_rescale", "tiled_short_force", "two_level_force", "halo_fof_lineitem"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, "meshtide-bench")
    # one untimed query starts the JVM's and the Python workers' machinery
    QUERIES["pk_card"](spark, sf).write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        with tables_freed():
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
