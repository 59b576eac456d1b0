"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the number of local
threads.  Each result is computed in full by Spark's ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
import time

from pyspark.sql import SparkSession

from vertexloom.plans.queries import ALL

HEADLINE = [
    "graph_count",
    "vertex_label_count",
    "edge_label_count",
    "read_edges_excluding",
    "in_degree",
    "out_degree",
    "in_degree_zero_filled",
    "graph_summary",
    "drop_dangling_edges",
    "pagerank",
    "pagerank_tol",
    "pagerank_refers",
    "pagerank_trade",
    "pagerank_tol_trade",
    "connected_components",
    "connected_components_commerce",
    "connected_components_refers",
    "strongly_connected_components",
    "strongly_connected_components_commerce",
    "strongly_connected_components_trade",
    "set_in_degree_property",
    "drop_keys_vertices",
    "property_key_catalogue",
    "lift_typed_property",
    "upsert_merge",
    "job_in_degree",
    "export_json",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    work = tempfile.mkdtemp(prefix="run-bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("vertexloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"{work}/checkpoints")
        .config("spark.local.dir", f"{work}/local")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ALL["graph_count"](spark, folder).collect()  # starts the JVM-side machinery
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        ALL[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    scale = re.search(r"sf([0-9.]+)$", folder)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else folder,
            }
        )
    )


if __name__ == "__main__":
    main()
