"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from weftgraph import queries
from weftgraph.session import session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: From raw text to edges, then graph work on the star schema.
NAMES = ("tokenise", "lexicon_build", "mention_ladder", "cooccurrence_rollup", "connected_components", "graph_rollup", "kin_resolution", "snapshot_delta")


def main() -> None:
    spark = session(f"local[{CPUS}]", int(CPUS), **{"spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false", "spark.sql.execution.arrow.pyspark.enabled": "true"})
    spark.sparkContext.setLogLevel("ERROR")
    found, took = queries.queries(), {}
    spark.read.parquet(f"{SF_DIR}/documents.parquet").selectExpr("count(text)").collect()  # starts what a first action starts
    for name in NAMES:
        began = time.perf_counter()
        found[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
