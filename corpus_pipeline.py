"""From raw documents to packed training sequences: five operators, each on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treequill.llm import mixing, near, packing, passages, quality
from treequill.llm._cluster import free_name, written

#: No stage but the last could be put in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None

#: Times that all of a domain's tokens are used at most.
REPEATS = 1.0


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model does not reject."""
    row = free_name(docs, "_row")
    judged = quality.classify(docs, _labels(spark, sf_dir))
    bad = judged.where("NOT kept").select(F.xxhash64("text_key", "lang").alias(row)).distinct()
    keyed = docs.withColumn(row, F.xxhash64(F.xxhash64(F.coalesce("text", F.lit(""))), F.col("lang").cast("string")))
    return keyed.join(bad, row, "left_anti").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8)."""
    return near.one_of_each_group(docs, near.jaccard_classes(docs))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that another has at an earlier place."""
    cut = passages.cut_passages(docs, passages.repeated_passages(docs))
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says.

    Noise and toxic documents are mostly gone by now.  A domain that has less than its share is not repeated
    to meet it (REPEATS): its target is lowered to what there is.
    """
    row, times_ = free_name(docs, "_row"), free_name(docs, "_times")
    rates = mixing.mix(docs, mixing.domains_of(_labels(spark, sf_dir)), repeats=REPEATS)
    times = rates.where("copies > 0").groupBy(F.xxhash64("doc_id", "text_key").alias(row)).agg(F.max("copies").cast("int").alias(times_))
    keyed = docs.withColumn(row, F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit("")))))
    return keyed.join(times, row).select(*docs.columns, F.explode(F.array_repeat(F.lit(0), F.col(times_)))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Placement of every piece of every document in sequences of 2048 tokens."""
    return packing.pack(written(packing.cut_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))))


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("passages", cut_repeats),
    ("mixing", mix_domains),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
    return docs
