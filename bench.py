"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "tpch_q1", "tpch_q3", "tpch_q3_scalar", "tpch_q6", "h1", "h2", "h3", "h4", "h5", "h6", "h7", "h8", "h9", "h10", "h11", "h12", "h13", "h14", "h15", "h16", "h17", "h18", "h19", "h20", "h21", "h22", "h23", "h24", "h25",
    "ssb_1", "ssb_4", "ssb_7", "ssb_11", "edgar_q1", "edgar_q2", "edgar_q3", "edgar_q4", "edgar_q6", "edgar_q24", "topk", "window_sum", "zipf_multiplicity",
]


def main() -> None:
    from tessera import catalog
    from tessera.session import session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", **{"spark_sql_shuffle_partitions": cpus, "spark_ui_enabled": "false", "spark_driver_memory": "8g", "spark_ui_showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    made = catalog.queries()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            began = time.perf_counter()
            made[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(min(runs[1:]), 4)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
