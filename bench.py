"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

HEADLINE = ["pac_q01", "pac_q05", "pac_q06", "pac_q08_ratio", "pac_q12_case", "pac_q13_passthrough", "pac_q14_ratio", "pac_q15_cte", "pac_q19_or", "pac_q22_select", "pac_topk", "pac_count_distinct", "dp_multi", "dp_count"]


RELEASED = ["pac_q01", "pac_q06", "pac_q13_passthrough", "pac_count_distinct"]


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from pyspark.sql import SparkSession

    from veilcast.plans import catalogue

    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp()
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", f"{scratch}/warehouse").config("spark.checkpoint.dir", f"file://{scratch}/shared").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = catalogue.queries(), {}

    def best(make) -> float:
        runs = []
        for _ in range(3):  # one cold run, two warm ones
            at = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - at)
        return round(min(runs[1:]), 4)

    for name in HEADLINE:
        times[name] = best(lambda: queries[name](spark, folder))
    extra = {}
    for name in RELEASED:  # with default settings: noise and the posterior over worlds; and the query as plain Spark runs it
        sql, policy = catalogue.SQL[name][0], catalogue.SQL[name][2]
        extra[f"{name}_released"] = best(lambda: catalogue.session(spark, folder, {}, policy).sql(sql))
        extra[f"{name}_plain"] = best(lambda: spark.sql(sql))
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times, "beside": extra, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
