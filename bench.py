"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")

    from pyspark.sql import functions as F

    from tablemill.operators import audit, features, links, verdict
    from tablemill.operators.store import stored
    from tablemill.plans import registry
    from tablemill.session import build_session
    from tablemill.sources import rendered, tables

    spark = build_session(f"local[{cpus}]", "bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")

    def run(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    pages = rendered.corpus(spark, sf_dir)
    queries = {
        "render": lambda: run(pages),
        "extract_and_type": lambda: run(tables.type_tables(tables.extract_tables(pages))),
        "verdict": lambda: run(audit.verdict_breakdown(verdict.verdicts(verdict.judge(pages)))),
        "features": lambda: run(features.matrix_digest(features.features(verdict.judge(pages)))),
        "header_and_sidebar_paths": lambda: run(registry.pathed_of(spark, sf_dir, "document", "customer")),
        "total_links": lambda: run(links.total_links(stored(
            registry.pathed_of(spark, sf_dir, "document"), "bench"))),
        "cell_types": lambda: run(registry.QUERIES["detail_type"](spark, sf_dir)),
    }
    run(rendered.customer_pages(spark, sf_dir))        # start the JVM's compilers
    took = {}
    for name, query in queries.items():
        begin = time.time()
        query()
        took[name] = round(time.time() - begin, 3)
    counts = (tables.extract_tables(pages)
              .select(F.aggregate("rows", F.lit(0), lambda n, r: n + F.size(r)).alias("cells"))
              .agg(F.count("*").alias("tables"), F.sum("cells").alias("cells")).first())
    print(json.dumps({
        "metric": "table analytics headline queries", "value": round(sum(took.values()), 3),
        "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").split("sf")[-1],
        "tables": counts["tables"], "cells": counts["cells"],
        "tables_per_sec_verdict": round(counts["tables"] / took["verdict"]),
        "cells_per_sec_extract_and_type": round(counts["cells"] / took["extract_and_type"])}))
    spark.stop()


if __name__ == "__main__":
    main()
