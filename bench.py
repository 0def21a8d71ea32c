"""Headline queries on one machine, the operator's overhead and its scaling; prints one JSON line.

``overhead``: items a second through the whole operator with an endpoint that takes no time.
``scaling``: with a call of 0.1 s and 25 calls in flight for each of 1, 4 and 8 tasks, the ideal time
(items x latency / calls in flight) over the time taken."""

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomcast.config import EngineConfig
from loomcast.operators.infer import infer
from loomcast.operators.strategies import MockStrategy
from loomcast.plans import catalogue, runs  # noqa: F401

HEADLINE = (
    "infer_basic", "infer_results", "before_rewrite", "classify_documents", "consecutive_limits", "slow_start_assignment", "batch_rollup", "prompt_dedupe",
    "chunk_documents", "rag_topk", "progress_points", "conversation_prompts",
)
LATENCY, IN_FLIGHT, ROUNDS = 0.1, 25, 30


def timed(df) -> float:
    began = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - began


def calls(spark, n: int, tasks: int, latency: float, workers: int):
    items = spark.range(n).select(F.col("id").cast("string").alias("item_id"), F.concat(F.lit("prompt "), "id").alias("prompt"))
    return infer(items, {"mock": MockStrategy(latency=latency)}, EngineConfig(max_workers=workers), tasks=tasks)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalogue.dry_run_tokens(spark, sf_dir).collect()  # starts the engine
    timed(calls(spark, 100, cpus, 0.0, 4))
    took = {name: round(timed(catalogue.QUERIES[name](spark, sf_dir)), 3) for name in HEADLINE}
    overhead = 40_000 / timed(calls(spark, 40_000, cpus, 0.0, 32))
    scaling = {}
    for tasks in (k for k in (1, 4, 8) if k <= cpus):
        n = tasks * IN_FLIGHT * ROUNDS
        scaling[str(tasks)] = round(ROUNDS * LATENCY / timed(calls(spark, n, tasks, LATENCY, IN_FLIGHT)), 3)
    out = {"metric": "headline_queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}
    print(json.dumps(out | {"overhead": round(overhead), "scaling": scaling}))
    spark.stop()


if __name__ == "__main__":
    main()
