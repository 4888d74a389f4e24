"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Full recomputation against incremental runs at 1, 5 and 10 % changed rows, for a global SUM, a grouped SUM and COUNT, a
copy with dynamic names and a transpose over ``events``, next to scans and path queries.  Each figure is the median of
several runs after a warm-up, in seconds.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomql import queries as core
from loomql.lang.parser import parse
from loomql.operators.combine import add_changes, upsert
from loomql.operators.incremental import WEIGHT, signed_diff
from loomql.plans.compiler import compile_transformation
from loomql.plans.run import sums_of

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "5"))
HEADLINES = ("sum_count_group", "implicit_group", "arith_row", "filter_bool", "list_nested", "horiz_sum", "predicate_step", "word_count", "dynamic_pivot", "transpose")
WORKLOADS = {
    "sum": "OUT._id <- 'result', OUT.sum <- SUM(IN.value)",
    "group": "OUT._id <- IN.event_type, OUT.sum <- SUM(IN.value), OUT.n <- COUNT(IN._id)",
    "copy": "OUT._id <- IN._id, OUT.$(IN.?(@).name()) <- IN.@",
    "transpose": "OUT._id <- IN.*.name(), OUT.$(IN.event_type) <- COUNT(IN.@)",
}


def timed(make) -> float:
    began = time.monotonic()
    make().write.format("noop").mode("overwrite").save()
    return time.monotonic() - began


def measure(make) -> float:
    timed(make)
    return round(median(timed(make) for _ in range(RUNS)), 4)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in HEADLINES:
        seconds[name] = measure(lambda n=name: core.QUERIES[n](spark, SF_DIR))
    new = spark.read.parquet(f"{SF_DIR}/events.parquet").select(F.col("event_id").alias("_id"), "user_id", "event_type", F.round("value", 2).alias("value")).cache()
    new.count()
    for name, body in WORKLOADS.items():
        (t,) = parse(f"IN-ENGINE: memory(), OUT-ENGINE: memory(), {body}")
        seconds[f"{name}_full"] = measure(lambda t=t: compile_transformation(t, new))
        for percent in (1, 5, 10):
            old = new.withColumn("value", F.when(F.col("_id") % 100 < percent, F.col("value") + 1).otherwise(F.col("value"))).cache()
            before = compile_transformation(t, old).cache()
            before.count()

            def run(t=t, old=old, before=before, name=name):
                changes = signed_diff(old, new)
                if name == "copy":
                    return upsert(before, compile_transformation(t, changes.where(f"{WEIGHT} > 0").drop(WEIGHT)))
                return add_changes(before, compile_transformation(t, changes, weight=WEIGHT), sums_of(t.specs))

            seconds[f"{name}_incremental_{percent}"] = measure(run)
            before.unpersist()
            old.unpersist()
    print(json.dumps({"metric": "total of median query seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1]}))
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
