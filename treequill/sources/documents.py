"""Readers and writers of documents, and the document views over the test tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import QueryError
from ..kinds import Multimap


def read_json(spark: SparkSession, path: str | list[str], lines: bool = False, explode_top_level: bool = False) -> DataFrame:
    """(root_id, doc VARIANT): one row for each file, or line; with explode_top_level, for each item of a top array."""
    text = spark.read.text(path, wholetext=not lines).where(F.trim("value") != "")
    docs = text.select(F.parse_json("value").alias("doc"))
    if explode_top_level:
        docs = docs.select(F.explode(F.coalesce(F.try_variant_get("doc", "$", "array<variant>"), F.array("doc"))).alias("doc"))
    return docs.select(F.monotonically_increasing_id().alias("root_id"), "doc")


def validate(df: DataFrame, text: str) -> DataFrame:
    """Rows whose JSON text is malformed, names a field twice, or has integers that do not fit in 64 bits."""
    parsed = F.try_parse_json(text)
    return df.where(parsed.isNull() | F.schema_of_variant(parsed).rlike(r"DECIMAL\((19|[23]\d),0\)"))


def append(*pools: DataFrame) -> DataFrame:
    """Documents of several DataFrames as one pool, ids made anew."""
    out = pools[0].select("doc")
    for p in pools[1:]:
        out = out.unionByName(p.select("doc"))
    return out.select(F.monotonically_increasing_id().alias("root_id"), "doc")


def encoded(doc: Column) -> Column:
    """A VARIANT as JSON text."""
    return F.to_json(doc)


def write_jsonl(df: DataFrame, path: str, doc: str = "doc") -> None:
    df.select(encoded(F.col(doc)).alias("value")).write.text(path)


def write_pool(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def decode(text: str) -> object:
    """A JSON document in Python, with tagged bytes and multimaps as such; for the evaluator."""

    def fix(v: object) -> object:
        if isinstance(v, list):
            return [fix(x) for x in v]
        if not isinstance(v, dict):
            if isinstance(v, int) and not isinstance(v, bool) and not -(1 << 63) <= v < 1 << 63:
                raise QueryError("DataError", f"Integer out of range: {v}")
            return v
        if v.get("_bytes") is True:
            try:
                return bytes.fromhex(v["hex"])
            except (KeyError, ValueError, TypeError) as e:
                raise QueryError("DataError", "Invalid hex string") from e
        if v.get("_multimap") is True:
            out = Multimap()
            for k in sorted(v):
                if k != "_multimap":
                    if not isinstance(v[k], list):
                        raise QueryError("DataError", "Multimap values must be arrays")
                    out += [(k, fix(x)) for x in v[k]]
            return out
        return {k: fix(v[k]) for k in sorted(v)}

    return fix(json.loads(text))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(root_id, doc): an order with its lines, by line number."""
    item = F.struct(F.col("l_linenumber").cast("bigint").alias("n"), F.col("l_partkey").alias("partkey"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"), F.col("l_returnflag").alias("flag"))
    lines = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("line"))
    rows = _table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    doc = F.struct(F.col("o_orderkey").alias("orderkey"), F.col("o_custkey").alias("custkey"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("total"), "line")
    return rows.select(F.col("o_orderkey").alias("root_id"), doc.alias("doc"))


def order_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(root_id, doc): an order without its lines."""
    doc = F.struct(F.col("o_orderkey").alias("orderkey"), F.col("o_custkey").alias("custkey"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("total"))
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("root_id"), doc.alias("doc"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(root_id, doc): an event, its properties a VARIANT."""
    doc = F.struct(F.col("event_id").alias("id"), F.col("user_id").alias("user"), F.col("event_type").alias("type"), "value", F.try_parse_json("props").alias("props"))
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("root_id"), doc.alias("doc"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(root_id, doc): a region with its nations, and those with their customers."""
    customer = F.struct(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("segment"))
    by_nation = _table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(customer)).alias("customers"))
    nation = F.struct(F.col("n_name").alias("name"), "customers")
    by_region = _table(spark, sf_dir, "nation").join(by_nation, F.col("n_nationkey") == F.col("c_nationkey")).groupBy("n_regionkey").agg(F.array_sort(F.collect_list(nation)).alias("nations"))
    rows = _table(spark, sf_dir, "region").join(by_region, F.col("r_regionkey") == F.col("n_regionkey"))
    return rows.select(F.col("r_regionkey").cast("bigint").alias("root_id"), F.struct(F.col("r_name").alias("name"), "nations").alias("doc"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("root_id"), F.struct(F.col("vec_id").alias("id"), "label", "embedding").alias("doc"))


def dynamic(docs: DataFrame) -> DataFrame:
    """The same documents as VARIANTs."""
    return docs.withColumn("doc", F.to_variant_object("doc"))
