"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = (
    "s07_read_columnar", "p22_chain_steps", "j02_star_join", "j11_context_join", "j13_shared_key_pairs",
    "a05_several_functions", "a13_quantiles", "a22_segment_rates", "w03_dense_rank", "w07_rolling_min_mean_max",
    "w11_adstock", "w15_topk_per_group", "w16_row_ids", "f03_clean_name", "f17_quantile_bins", "r02_pivot_two_values",
    "v02_box_stats", "v06_kernel_density", "t02_correlation", "t10_multiple_regression", "t18_fixed_effects",
    "e07_tfidf", "m16_ridge_per_user", "c02_association_rules_top", "c10_user_correlation", "c18_neighbour_averaging",
    "c23_topk_unseen", "b02_regret_curve",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.log.level", "ERROR")
        .getOrCreate()
    )
    from tabulon.plans.shared import remove_scratch
    from tabulon.queries import QUERIES, load_all

    load_all()
    names = sys.argv[1:] or list(HEADLINE)
    # The first job pays for class loading; it is not part of any query.
    spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    times: dict[str, list[float]] = {name: [] for name in names}
    # Twice over: the first run of a query compiles its code, the second shows what remains.
    for _ in range(2):
        for name in names:
            start = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            times[name].append(round(time.perf_counter() - start, 3))
    first, again = ({n: t[i] for n, t in times.items()} for i in (0, 1))
    print(json.dumps({"metric": "headline_total", "value": round(sum(first.values()), 3), "unit": "sec", "queries": first, "again": again, "sf": sf.rstrip("/").rsplit("sf", 1)[-1]}))
    remove_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()
