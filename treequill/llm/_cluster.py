"""What the operators need from the session: shared storage, code shipping, small exact helpers."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import time
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()
_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Where that is unset, a session of one machine (local master) gets a temporary folder; on a cluster it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="treequill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    archive = os.path.join(tempfile.mkdtemp(prefix="treequill-code-"), "treequill_code.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for path in root.rglob("*.py"):
            z.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _forget() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  that session has ended before us; the folder's owner cleans it
            continue


atexit.register(_forget)


def written(df: DataFrame) -> DataFrame:
    """The same rows as a table in the shared folder: lineage ends here, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/treequill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._treequill_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that no later step reads."""
    for table in tables:
        _delete(table.sparkSession, table._treequill_path)
        _written.remove((table.sparkSession, table._treequill_path))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of queries that nothing refers to any more."""
    for _ in range(2):  # plans go with the first collection, what they alone held with the second; files in the background
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.7)


#: The setting for the bytes of an Arrow batch; without a value, one may hold 64 MB, several times over on its way to Python.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, size: int = 4 << 20) -> Iterator[None]:
    """What is run meanwhile gets Arrow batches of about ``size`` bytes at most; a smaller limit of the session stays."""
    before = spark.conf.get(BATCH_BYTES, None)
    limit = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before) if before else 0
    if 0 < limit <= size:
        yield
        return
    spark.conf.set(BATCH_BYTES, str(size))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_BYTES)
        else:
            spark.conf.set(BATCH_BYTES, before)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def share_of(size: DataFrame | int, each: int) -> int:
    """How many groups of ``each`` there are in a number, or in the bytes that the optimizer expects of a table."""
    if isinstance(size, DataFrame):
        size = int(str(size._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(1, min(-(-size // each), 1 << 20))


#: Rows of two numbers or so that may be broadcast (some 32 MB); larger tables are joined by a shuffle.
BROADCAST_ROWS = 500_000


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, to be broadcast where its counted ``rows`` allow that."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def bits_for(n: int) -> int:
    """Bits of a bitmap for n marks: a power of two, 8 kB to 32 MB; beyond that it only lets more pass in vain."""
    return 1 << min(max((max(n, 1) - 1).bit_length(), 16), 28)


def pieces(column, limit: int = 1 << 20) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first, end, UTF-8 texts) of runs of about ``limit`` bytes of an Arrow string column; null is empty.

    Only one run at a time is held as Python objects, so that memory doesn't follow the batch.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    column = column.cast(pa.binary())
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype("int64") + 1
    start = size = 0
    for i, n in enumerate(sizes.tolist()):
        size += n
        if size >= limit or i + 1 == len(sizes):
            yield start, i + 1, [b"" if x is None else x for x in column.slice(start, i + 1 - start).to_pylist()]
            start, size = i + 1, 0


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b): component is the smallest id reachable.

    Alternates large-star and small-star contraction; each round is written, so that lineage
    stays short.  A node's neighbours are never gathered: rounds use only min() and joins.
    """
    edges = written(links.where("a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct())
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(least.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        roots = after.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        discard(edges)
        if not roots and not after.join(after.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count():
            return after.select(F.col("u").alias("id"), F.col("v").alias("component")).union(after.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        edges = after


def bitmap(spots: DataFrame, bits: int) -> bytes:
    """The set of a long column ``spot`` (0 to bits - 1) as a bitmap; bits / 32768 rows of 4 kB reach the driver at most."""
    buckets = spots.groupBy(F.shiftright("spot", 15).cast("int").alias("bucket")).agg(F.bitmap_construct_agg(F.col("spot").bitwiseAND(F.lit(32767).cast("long"))).alias("bits"))
    out = bytearray(bits // 8)
    for row in buckets.collect():
        out[row["bucket"] * 4096 : row["bucket"] * 4096 + len(row["bits"])] = row["bits"]
    return bytes(out)
