"""Best-fit packing of token sequences, with certified bin counts.

Documents longer than a sequence are cut; full pieces are sequences of their own.  The rest is dealt to
partitions of a bounded number of pieces, each packed by best fit decreasing.  A lower bound from dual
feasible functions certifies a partition whose bin count meets it.  Partitions with a gap give up the
documents of their unfilled bins; those are dealt anew, to new partitions, and packed again, as long as
that saves bins.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._cluster import free_name, ship, written

LENGTH = 2048
#: Pieces in a partition at most; what one task holds while packing.
PER_PARTITION = 40_000


class Encoder:
    """Ids of the byte-level BPE in a tokenizers file, as little-endian unsigned 32-bit bytes.

    The ranks are the file's own vocabulary, whose ids follow the order of its merges; the merge loop
    is tiktoken's, which is several times faster on texts of rare words and gives the same ids.  Texts are
    first split at the file's added tokens, each of which is one id, as the tokenizers library does.  A
    file whose added tokens take in the spaces or need word borders beside them is an error.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        added = model["added_tokens"]
        if model["normalizer"] or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError(f"{path}: a normalizer, or added tokens that depend on what is beside them")
        special = {t["content"]: t["id"] for t in added}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        ranks = {bytes(letters[c] for c in piece): i for piece, i in model["model"]["vocab"].items() if piece not in special}
        self.encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = set(special)

    def ids(self, text: str) -> bytes:
        return bytes(memoryview(self.encoding._core_bpe.encode_to_tiktoken_buffer(text, self.special)))


_encoders: dict[str, Encoder] = {}


def cut_pieces(docs: DataFrame, tokenizer: str, doc: str = "doc_id", text: str = "text", length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of all documents, each ended by id 0.

    A document of more than ``length`` tokens is cut into pieces of ``length``, the first one shorter
    where that is not a divisor.  Null texts are empty (one piece, the end mark); null ids and repeated
    rows stay as they are.
    """
    import pyarrow as pa

    ship(docs.sparkSession)
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches: Iterator) -> Iterator:
        if tokenizer not in _encoders:
            _encoders[tokenizer] = Encoder(tokenizer)
        encode = _encoders[tokenizer].ids
        for batch in batches:
            out: list[list] = [[] for _ in range(5 + with_ids)]
            for doc_id, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(t or "") + b"\0\0\0\0"
                total = len(ids) // 4
                start, size, piece = 0, total % length or length, 0
                while start < total:
                    size = min(size, total)
                    part = ids[4 * start : 4 * (start + size)]
                    for column, value in zip(out, (doc_id, piece, start, size, zlib.crc32(part), part)):
                        column.append(value)
                    start, size, piece = start + size, length, piece + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    return rows.mapInArrow(run, schema)


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of the volume bound and of two families of dual feasible functions."""
    if not len(sizes):
        return 0
    n = np.bincount(sizes, minlength=capacity + 1)[: capacity + 1].astype(np.int64)
    each = np.arange(capacity + 1)
    count, volume = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * each)])
    best = -(-int(volume[-1]) // capacity)
    # f_a: sizes over capacity - a fill a bin, sizes under a vanish
    a = np.arange(0, capacity // 2 + 1)
    full = count[-1] - count[capacity - a + 1]
    middle = volume[capacity - a + 1] - volume[a]
    best = max(best, int((full + -(-middle // capacity)).max()))
    # u_k: floor((k + 1) x) / k, and x where (k + 1) x is whole
    for k in range(1, 33):
        whole = (k + 1) * each % capacity == 0
        scaled = np.where(whole, each * k, (k + 1) * each // capacity * capacity)
        best = max(best, -(-int((n * scaled).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item: items by falling size, each into the fullest bin that it fits."""
    bins = np.zeros(len(sizes), dtype=np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room left
    rooms = 0  # bit r is set while some bin has r tokens of room
    made = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                rooms ^= 1 << room
        else:
            room, b, made = capacity, made, made + 1
        bins[i] = b
        if left := room - size:
            free[left].append(b)
            rooms |= 1 << left
    return bins


def pack(pieces: DataFrame, length: int = LENGTH, per_partition: int = PER_PARTITION) -> DataFrame:
    """``pieces`` (any columns, ``length`` among them) with sequence_id and offset.

    Every row is placed exactly once, whatever its other columns hold.  Rounds end when every partition is
    certified, when one partition holds all that is left, or when a round saves no bin.  Rows should come
    from a written table: they are read once a round.
    """
    import pyarrow as pa

    spark = pieces.sparkSession
    ship(spark)
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    pieces = pieces.select(*names)
    whole = pieces.where(F.col("length") >= length)
    done = [whole.select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    salt, part_, open_ = (free_name(pieces, n) for n in ("_salt", "_part", "_open"))
    packed_schema = StructType([*pieces.schema.fields]).add(salt, "long").add("sequence_id", "long").add("offset", "long").add(open_, "boolean")

    def packer(turn: int):
        def run(key: tuple, table: pa.Table) -> pa.Table:
            sizes = table.column("length").to_numpy().astype(np.int64)
            bins = best_fit_decreasing(sizes, length)
            made, bound = int(bins.max()) + 1, lower_bound(sizes, length)
            order = np.lexsort((-sizes, bins))
            ends = np.cumsum(sizes[order])
            first = np.flatnonzero(np.diff(bins[order], prepend=-1))
            begins = ends - sizes[order]
            offset = np.empty(len(sizes), dtype=np.int64)
            offset[order] = begins - np.repeat(begins[first], np.diff(first, append=len(order)))
            fill = np.bincount(bins, weights=sizes)
            unfilled = (fill < length)[bins] if made > bound else np.zeros(len(sizes), dtype=bool)
            ids = ((turn << 56) | (int(key[0].as_py()) << 24)) + bins
            out = table.drop_columns([part_])
            for name, values in (("sequence_id", ids), ("offset", offset), (open_, unfilled)):
                out = out.append_column(name, pa.array(values))
            return out

        return run

    pool = pieces.where(F.col("length") < length).withColumn(salt, F.xxhash64(F.monotonically_increasing_id()))
    before: DataFrame | None = None
    before_bins, turn = 0, 0
    while True:
        turn += 1
        parts = max(1, -(-pool.count() // per_partition))
        dealt = pool.withColumn(part_, F.pmod(F.xxhash64(salt, F.lit(turn)), F.lit(parts)))
        result = written(dealt.groupBy(part_).applyInArrow(packer(turn), packed_schema))
        if before is not None and result.select("sequence_id").distinct().count() >= before_bins:
            done.append(before.select(*names, "sequence_id", "offset"))
            break
        unfilled = result.where(F.col(open_))
        bins = unfilled.select("sequence_id").distinct().count() if parts > 1 else 0
        if not bins:
            done.append(result.select(*names, "sequence_id", "offset"))
            break
        done.append(result.where(~F.col(open_)).select(*names, "sequence_id", "offset"))
        before, before_bins, pool = unfilled, bins, unfilled.select(*names, salt)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out
