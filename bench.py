"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
HEADLINE = [
    "reduce_sum", "minmax_element", "inner_product", "transform_unary", "transform_binary", "inclusive_scan", "exclusive_scan", "adjacent_difference", "halo_sum",
    "sort_reindex", "stable_partition", "unique_consecutive", "top_k", "nth_element", "median_upper", "strided", "chunk_agg", "window_agg_stride", "chunk_by_islands",
    "map_assign_keep_last", "scatter_accumulate", "lineitem_running_quantity",
]
SCALING = (1, 2, 4, 8)


def main() -> None:
    from ordinaut.operators import scan
    from ordinaut.queries import QUERIES, events
    from ordinaut.session import session

    spark = session(CPUS, **{"spark.master": f"local[{CPUS}]", "spark.sql.shuffle.partitions": str(CPUS), "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")

    def took(make) -> float:
        best = float("inf")
        for _ in range(2):  # the second run has the code compiled
            began = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        return round(best, 4)

    took(lambda: QUERIES["reduce_sum"](spark, SF_DIR))
    queries = {name: took(lambda name=name: QUERIES[name](spark, SF_DIR)) for name in HEADLINE}
    for p in SCALING:
        def blocked(p=p):
            s = events(spark, SF_DIR)
            return scan.inclusive_scan(type(s)(s.df, s.size, p)).df

        queries[f"scan_blocks_{p}"] = took(blocked)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(queries.values()), 3), "unit": "sec", "queries": queries, "sf": os.path.basename(SF_DIR.rstrip("/")), "cpus": CPUS}))


if __name__ == "__main__":
    main()
