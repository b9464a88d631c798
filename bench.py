"""Headline queries, timed: one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from lumen.plans import queries as core
from lumen.session import session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CORE = ["inj_hits_by_pattern", "verdict_rollup", "zero_width_counts", "homoglyph_words", "trailing_whitespace", "blank_gap_islands", "html_hidden_groups", "deceptive_links", "orphan_parts", "cover_containment", "asof_background", "ordinal_p90_far", "budget_running_sum", "contrast_wcag", "severity_dedup", "text_findings"]


def main() -> None:
    spark = session(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.shuffle.partitions", os.environ.get("BENCH_CPUS", "8"))
    runs = {n: core.QUERIES[n] for n in CORE}
    try:
        from lumen.llm.queries import QUERIES

        runs |= {n: QUERIES[n] for n in ("op1_line_dedup", "op2_best_fit_packing", "op3_ngram_jaccard_join", "op5_source_mixing", "op6_maxent_scores", "op7_nearest_neighbours", "op8_byte_shards", "op9_secret_scan", "op10_quality")}
    except ImportError:
        pass
    took, failed = {}, {}
    for name, f in runs.items():
        times = []
        try:
            for _ in range(2):  # the first run compiles
                t = time.perf_counter()
                f(spark, SF_DIR).write.format("noop").mode("overwrite").save()
                times.append(time.perf_counter() - t)
            took[name] = round(statistics.median(times[1:]), 3)
        except Exception as e:  # one query must not hide the others
            failed[name] = str(e)[:200]
    line = {"metric": "total_warm_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR).removeprefix("sf")}
    print(json.dumps(line | ({"failed": failed} if failed else {})))
    sys.stdout.flush()


if __name__ == "__main__":
    main()
