"""Times the headline queries and prints one line of JSON.

As plan, preparation and execution are told apart: the graph is built and kept
first (``prepare``), planning is driver-side and timed with the query.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))


def main() -> None:
    from pyspark.sql import SparkSession

    from motifloom import Pattern
    from motifloom.operators import delta
    from motifloom.operators.match import match
    from motifloom.queries import _changes, graph

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", str(cpus)).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name: str, work) -> None:
        start = time.perf_counter()
        work()
        times[name] = round(time.perf_counter() - start, 3)

    graphs = {name: graph(spark, sf_dir, name).persist() for name in ("q", "r")}
    for name, g in graphs.items():
        timed(f"prepare_{name}", lambda g=g: (g.edges.count(), g.adj().count()))
    q = graphs["q"]
    timed("stats", lambda: q.stats())
    for name in ("triangle", *(f"p{k}" for k in range(1, 9)), "house"):
        p = Pattern.named(name)
        timed(f"{name}_edge", lambda p=p: match(q, p).collect())
        timed(f"{name}_vertex", lambda p=p: match(q, p, induced="vertex").collect())
    for name in ("p2", "p3", "p5", "p6", "p7", "house"):
        timed(f"{name}_iep", lambda p=Pattern.named(name): match(q, p, iep=True).collect())
    for k in (3, 4, 5):
        timed(f"clique{k}_dense", lambda k=k: match(graphs["r"], Pattern.clique(k)).collect())
    timed("p3_join", lambda: match(q, Pattern.named("p3"), executor="join").collect())
    timed("delta_triangle", lambda: delta.delta_count(q, _changes(q), Pattern.clique(3)).collect())
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(sf_dir).name}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
