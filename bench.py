"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gridledger import plans  # noqa: E402
from gridledger.session import build_session  # noqa: E402

HEADLINES = [
    "r6_category_and_total", "r7_overlay_verdicts", "r13_dual_engine_totals", "f4_pending_attempts", "f12_cap_list", "e3_group_cells",
    "e5_paint_cols", "e8_range_members", "x3_references", "x6_formula_class", "x15_text_width", "x17_apply_cf", "c22_formula_errors",
    "c49_black_font", "c65_negative_parentheses", "c80_volatile", "c87_whole_columns", "c93_hidden_columns", "a4_locate_exact",
    "a11_compare_answers", "a14_answer_summary", "p2_period_series", "p23_sheet_dependencies", "t2_dedupe_cumulative", "t4_call_cost",
    "t15_evict_oldest", "st4_windowed_cost",
    "cr1_run_checks", "a5_locate_fuzzy", "c29_clean_names", "e7_contiguous_blocks", "p20_text_sheet_refs", "x3_resolved_references", "s10_formula_texts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINES
    plans.load_all()
    spark = build_session("bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    # the first query would hold the warm-up of the JVM
    plans.QUERIES["r6_category_and_total"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.time()
        plans.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total wall time of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
