"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from treequill.plans import catalog
from treequill.plans.session import Session

HEADLINE = ("flagship_order_value", "flagship_order_value_dynamic", "p5_wildcard_field", "p5_wildcard_count", "f1_subquery", "f7_any_filter", "m3_multiply", "a2_sum", "c6_irange", "a5_split")
#: The benchmark model: a nested object of 121 values, and the queries over it.
MODEL_QUERIES = {"model_typeof": "count(typeof ** == 'notatype')", "model_recursive_field": "count(**.id == 250)", "model_field": "count(id == 250)", "model_keys": "count(keys(**))", "model_primes": "count(range(1,1000)...{count((_ % range(1,_)...) == 0) == 2})"}


def model(spark: SparkSession, rows: int):
    leaf = F.struct(*[(F.hash("id", F.lit(i)) % 1000).cast("bigint").alias(f"SUB_{i}") for i in range(3)])
    deep = F.struct(F.struct(leaf.alias("SUB_0")).alias("SUB_0"))
    middle = F.struct(*[deep.alias(f"SUB_{i}") for i in range(2)])
    properties = F.struct(*[middle.alias(f"SUB_{i}") for i in range(5)])
    numbers = F.transform(F.sequence(F.lit(0), F.lit(49)), lambda i: (F.hash("id", i) % 1000).cast("bigint"))
    base = spark.range(1, rows + 1)
    return base.select(F.struct("id", (F.col("id") % 7).alias("type"), F.hash("id").cast("bigint").alias("value"), properties.alias("properties"), numbers.alias("numbers")).alias("doc"))


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    times = {}

    def timed(name, df) -> None:
        began = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)

    catalog.QUERIES["p1_field"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts executors and compilers
    for name in HEADLINE:
        timed(name, catalog.QUERIES[name](spark, sf_dir))
    session, docs = Session(), model(spark, 1000)
    for name, query in MODEL_QUERIES.items():
        timed(name, docs.select(session.scalar(docs, "doc", query).alias("value")))
    print(json.dumps({"metric": "document_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
