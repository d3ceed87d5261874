"""Media columns: payloads kept losslessly as 8-bit samples in a content-addressed chunk store.

A payload is stored as the sample block of a mono 8-bit PCM WAV file.  A rolling gear hash cuts it into
chunks, so that equal passages give equal chunks wherever they stand.  Chunks that occur more
than once are stored once, under their digest; the others stay in their record.  Which are
shared is found by a join of digest counts; a bitmap of fixed size tells the writing pass which chunks
may be shared, and its false positives only move a private chunk into the shared table.  Reading back
joins each record's ordered chunk list with the shared table and checks every digest.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._cluster import bitmap, pieces, ship, written

UNIT = 64
RATE = 8000
#: log2 of the mean chunk size; least and greatest chunk.
MEAN_BITS, LEAST, MOST = 11, 512, 16384
#: Bits of the shared-chunk bitmap: 2 MB, whatever the size of the data.
BITMAP_BITS = 1 << 24
_GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 2**32, 256, dtype=np.uint32)


def payload(text: bytes) -> bytes:
    """The text's bytes, filled with zeros to a positive multiple of 64."""
    return text + b"\0" * (-len(text) % UNIT or (UNIT if not text else 0))


def header(samples: int) -> bytes:
    """Of a WAV file with that many 8-bit mono samples (an even number, so that it needs no fill byte)."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + samples, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", samples)


def _cut_marks(block: np.ndarray) -> np.ndarray:
    """Positions after which the gear hash of the last 32 bytes asks for a cut."""
    h = _GEAR[block]
    for shift in (1, 2, 4, 8, 16):
        late = h[shift:] + (h[:-shift] << np.uint32(shift))
        h = np.concatenate([h[:shift], late])
    return np.flatnonzero(h >> np.uint32(32 - MEAN_BITS) == 0)


def chunks(data: bytes) -> list[bytes]:
    """Content-defined chunks of a payload, in order.

    The rolling hash sees the payload alone, so equal passages are cut alike; chunks have LEAST to MOST
    bytes, the last one maybe fewer.
    """
    marks = (_cut_marks(np.frombuffer(data, dtype=np.uint8)) + 1).tolist()
    out, start, n = [], 0, len(data)
    for mark in marks:
        while mark - start > MOST:
            out.append(data[start : start + MOST])
            start += MOST
        if mark - start >= LEAST:
            out.append(data[start:mark])
            start = mark
    while n - start > MOST:
        out.append(data[start : start + MOST])
        start += MOST
    if start < n:
        out.append(data[start:])
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()


def features(samples: bytes) -> str:
    """Exact integer statistics of the samples: sum, sum of squares, changes of side of the middle level."""
    x = np.frombuffer(samples, dtype=np.uint8).astype(np.int64)
    return f"sum={int(x.sum())};energy={int((x * x).sum())};crossings={int(np.count_nonzero(np.diff(x >= 128)))}"


def _maybe_shared(bits: bytes, key: bytes) -> bool:
    a, b = int.from_bytes(key[0:3], "big"), int.from_bytes(key[8:11], "big")
    return bool(bits[a >> 3] >> (a & 7) & 1 and bits[b >> 3] >> (b & 7) & 1)


def shared_bitmap(counts: DataFrame) -> bytes:
    """The bitmap of a column ``digest``: two bits for each, BITMAP_BITS in all."""
    at = lambda i: F.conv(F.hex(F.substring("digest", i, 3)), 16, 10).cast("long")
    spots = counts.select(F.explode(F.array(at(1), at(9))).alias("spot"))
    return bitmap(spots, BITMAP_BITS)


_PARTS = "array<struct<digest: binary, bytes: binary>>"


def write_store(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(records, shared) of all documents; null texts are empty, repeated rows and null ids keep records of their own.

    records: doc_id, n_bytes, payload_bytes, parts: array of (digest, zlib bytes or null) in order.
    shared: digest, zlib bytes; a chunk that occurs twice or more is there once.  Both are written.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def digests(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for _, _, texts in pieces(batch.column(0)):
                out = [d for t in texts for d in map(digest, chunks(payload(t)))]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["digest"])

    counts = rows.select("text").mapInArrow(digests, "digest binary").groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    known = spark.sparkContext.broadcast(shared_bitmap(counts))

    def shared_bytes(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bits = known.value
        for batch in batches:
            seen: dict[bytes, bytes] = {}
            for _, _, texts in pieces(batch.column(0)):
                for t in texts:
                    for c in chunks(payload(t)):
                        if _maybe_shared(bits, d := digest(c)) and d not in seen:
                            seen[d] = zlib.compress(c, 1)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.binary())], names=["digest", "bytes"])

    def recorded(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bits = known.value
        kind = pa.list_(pa.struct([("digest", pa.binary()), ("bytes", pa.binary())]))
        for batch in batches:
            for start, end, texts in pieces(batch.column(1)):
                lists, sizes = [], []
                for t in texts:
                    p = payload(t)
                    sizes.append(len(p))
                    lists.append([{"digest": (d := digest(c)), "bytes": None if _maybe_shared(bits, d) else zlib.compress(c, 1)} for c in chunks(p)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), pa.array([len(t) for t in texts], pa.int64()), pa.array(sizes, pa.int64()), pa.array(lists, kind)], names=["doc_id", "n_bytes", "payload_bytes", "parts"])

    shared = rows.select("text").mapInArrow(shared_bytes, "digest binary, bytes binary").dropDuplicates(["digest"])
    return written(rows.mapInArrow(recorded, f"doc_id long, n_bytes long, payload_bytes long, parts {_PARTS}")), written(shared)


def reconstruct(records: DataFrame, shared: DataFrame) -> DataFrame:
    """Records whose parts all have their bytes, in order.

    Complete records pass as they are read, without a shuffle; the others get row numbers, their missing chunks
    are joined by digest, and each is put together again under a row number of its own.
    """
    lacks = F.exists("parts", lambda p: p["bytes"].isNull())
    open_ = written(records.where(lacks).withColumn("_row", F.monotonically_increasing_id()))
    each = open_.select("_row", F.posexplode("parts").alias("pos", "part")).select("_row", "pos", "part.digest", "part.bytes")
    found = each.where("bytes IS NULL").drop("bytes").join(shared, "digest").select("_row", "pos", "digest", "bytes")
    whole = each.where("bytes IS NOT NULL").select("_row", "pos", "digest", "bytes").union(found)
    filled = whole.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "digest", "bytes"))), lambda p: F.struct(p["digest"].alias("digest"), p["bytes"].alias("bytes"))).alias("parts"))
    back = open_.select("_row", "doc_id", "n_bytes", "payload_bytes").join(filled, "_row").select("doc_id", "n_bytes", "payload_bytes", "parts")
    return records.where(~lacks).union(back)


def read_media(reconstructed: DataFrame, with_media: bool = False) -> DataFrame:
    """Digests and features of media read back from the store; with ``with_media`` the WAV bytes too.

    A chunk whose bytes do not match its digest, or a payload of the wrong length, is an error.
    """
    import pyarrow as pa

    fields = (("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("media", pa.binary()))[: 8 + with_media]

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            out: list[list] = [[] for _ in range(5 + with_media)]
            parts = batch.column(3)
            for row, size in enumerate(batch.column(2).to_pylist()):
                data = []
                for part in parts[row].as_py():
                    data.append(zlib.decompress(part["bytes"]))
                    if digest(data[-1]) != part["digest"]:
                        raise ValueError("a stored chunk does not match its digest")
                media = header(size) + b"".join(data)
                samples = media[44:]
                if len(samples) != size:
                    raise ValueError("a stored payload has the wrong length")
                values = (hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), hashlib.sha256(media).hexdigest(), features(samples), len(media), media)
                for column, value in zip(out, values):
                    column.append(value)
            sha, crc, media_sha, feature, length, *media_ = out
            columns = [batch.column(0), batch.column(1), batch.column(2), sha, crc, length, media_sha, feature, *media_]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kind) for c, (_, kind) in zip(columns, fields)], names=[n for n, _ in fields])

    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return reconstructed.mapInArrow(run, ", ".join(f"{n} {kinds[k]}" for n, k in fields))
