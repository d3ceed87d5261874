"""Quality classifier: perplexity under an interpolated modified Kneser-Ney bigram model of trusted text.

The model is a table of additive weights by n-gram key.  With L(w) the log of the lower-order probability
and U(v) the log of the back-off mass of a context, a document's log-probability is the sum over its words
of L and U, and over its bigrams that the model has of ``log p(w|v) - U(v) - L(w)``; so scoring is one
join of n-gram counts with weights.  It is sharded by key range: a piece (a run of documents of one task)
sends each shard the n-grams that its documents have, with the documents of each and their counts, and a
bitmap sized by the model keeps n-grams that the model does not have at home (its false positives only
travel in vain).  Every count is exact; n-grams are counted by 128 bits and looked up by KEY_BITS, so that one
that the model does not have is taken for one that it has once in 2**KEY_BITS / size of the model.  A document is rejected above
a quantile of its language's trusted documents, taken from trusted documents outside the training fold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._cluster import bitmap, bits_for, broadcast_if_small, discard, pieces, release, share_of, ship, written

#: Part of the held-out trusted documents of a language that may lie above the threshold.
QUANTILE = 0.995
#: Model keys, and bytes of documents, of a shard, about.
KEYS_PER_SHARD, BYTES_PER_SHARD = 400_000, 24 << 20
#: Bytes of text in a piece: equal n-grams of a piece travel once.
PIECE = 8 << 20
#: Bits of an n-gram's key in the model.
KEY_BITS = 48
BOS, EOS = np.uint64(0xB05), np.uint64(0xE05)


class Model(NamedTuple):
    """Of a language model: a written table (shard, size, keys, weights) and its number of shards and keys.

    unknown is the log-probability of a word outside the vocabulary, edge what a document's start and end weigh.
    """

    table: DataFrame
    shards: int
    keys: int
    unknown: float
    edge: float


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _text.mix(a * np.uint64(0x9FB21C651E98DF25) + b)


def _bigrams(owner: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, context, word) with a start before and an end after each text that has words."""
    first = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, dtype=bool)
    last = np.append(first[1:], True) if len(owner) else first
    context = np.concatenate([[BOS], words[:-1]]) if len(words) else words
    context = np.where(first, BOS, context)
    return np.concatenate([owner, owner[last]]), np.concatenate([context, words[last]]), np.concatenate([words, np.full(int(last.sum()), EOS)])


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins, in sorted columns."""
    if not len(columns[0]):
        return np.zeros(0, dtype=np.int64)
    return np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns])]))


def count_bigrams(texts: DataFrame) -> DataFrame:
    """(v, w, n): bigrams of word hashes over all rows of the one text column."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for _, _, data in pieces(batch.column(0), 4 << 20):
                owner, words, _, _ = _text.word_hashes(data)
                _, v, w = _bigrams(owner, words)
                order = np.lexsort((w, v))
                v, w = v[order], w[order]
                at = _starts(v, w)
                yield pa.RecordBatch.from_arrays([pa.array(v[at].view(np.int64)), pa.array(w[at].view(np.int64)), pa.array(np.diff(at, append=len(v)))], names=["v", "w", "n"])

    return texts.mapInArrow(run, "v long, w long, n long").groupBy("v", "w").agg(F.sum("n").alias("n"))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney from counts of counts; 0.5, 1 and 1.5 where these are too few."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.05 * k), float(k)) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))  # type: ignore[return-value]


def _count_of_counts(counts: DataFrame, column: str) -> list[int]:
    row = counts.agg(*[F.sum((F.col(column) == k).cast("long")) for k in (1, 2, 3, 4)]).first()
    return [x or 0 for x in row]


def _discount(c, d: tuple[float, float, float]):
    return F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])


def kneser_ney(bigrams: DataFrame) -> tuple[DataFrame, dict[str, float], list[DataFrame]]:
    """(key, weight, w) of the model of written ``bigrams`` (v, w, n), its constants, as in Model, and the written tables that its rows need.

    w is null in rows of words and contexts.
    """
    d = discounts(*_count_of_counts(bigrams, "n"))
    after = written(bigrams.groupBy("w").agg(F.count("*").alias("k")))
    e = discounts(*_count_of_counts(after, "k"))
    totals = after.agg(F.sum("k"), F.sum(_discount(F.col("k"), e)), F.count("*")).first()
    types, mass, size = totals[0] or 1, totals[1] or 1.0, (totals[2] or 0) + 1
    floor = mass / types / size
    low = after.select("w", F.log((F.col("k") - _discount(F.col("k"), e)) / types + F.lit(floor)).alias("low"))
    context = bigrams.groupBy("v").agg(F.sum("n").alias("c"), F.sum(_discount(F.col("n"), d)).alias("left"))
    context = written(context.select("v", "c", F.log(F.col("left") / F.col("c")).alias("back")))
    n_words = size - 1
    seen = bigrams.join(broadcast_if_small(context, n_words + 1), "v").join(broadcast_if_small(low, n_words), "w")
    p = (F.col("n") - _discount(F.col("n"), d)) / F.col("c") + F.exp(F.col("back") + F.col("low"))
    pairs = seen.select("v", "w", (F.log(p) - F.col("back") - F.col("low")).alias("weight"))
    unknown = math.log(floor)
    words = low.select(F.col("w").alias("key"), (F.col("low") - unknown).alias("weight")).union(context.select(F.col("v").alias("key"), F.col("back").alias("weight"))).groupBy("key").agg(F.sum("weight").alias("weight"))
    ends = {r["key"]: r["weight"] for r in words.where(F.col("key").isin(int(BOS), int(EOS))).collect()}
    return words.select("key", "weight", F.lit(None).cast("long").alias("w")).union(pairs.select(F.col("v").alias("key"), "weight", "w")), {"unknown": unknown, "edge": ends.get(int(BOS), 0.0) + ends.get(int(EOS), 0.0)}, [after, context]


def _squeeze(values: np.ndarray, width: int = 4) -> bytes:
    """Unsigned numbers of ``width`` bytes, byte by byte of all of them.

    Each of the bytes has a code of its own, since random ones would spoil that of small ones; it is left out
    where it is 0 in all numbers, and kept as it is where the code is no shorter.
    """
    import zstandard

    code, out = zstandard.ZstdCompressor(level=1), []
    for k in range(width):
        plane = (values >> values.dtype.type(8 * k)).astype(np.uint8)
        short = code.compress(plane) if plane.any() else b""
        out.append(short if len(short) < len(plane) else plane.tobytes())
    return np.array([len(values), *map(len, out)], dtype="<u4").tobytes() + b"".join(out)


def _unsqueeze(data: bytes, width: int = 4) -> np.ndarray:
    import zstandard

    n, *sizes = np.frombuffer(data, dtype="<u4", count=width + 1).tolist()
    out, at = np.zeros((n, 8), dtype=np.uint8), 4 * (width + 1)
    for k, size in enumerate(sizes):
        if size:
            plane = data[at : at + size]
            out[:, k] = np.frombuffer(plane if size == n else zstandard.ZstdDecompressor().decompress(plane), dtype=np.uint8)
        at += size
    return out.view("<i8").ravel()


def _squeeze_floats(values: np.ndarray) -> bytes:
    return _squeeze(values.astype(np.float32).view(np.uint32))


def _unsqueeze_floats(data: bytes) -> np.ndarray:
    return _unsqueeze(data).astype(np.uint32).view(np.float32)


def _steps(keys: np.ndarray) -> bytes:
    """Rising keys, as the steps between them."""
    return _squeeze(np.diff(keys, prepend=keys.dtype.type(0)), KEY_BITS // 8)


def _shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    return (key >> np.uint64(KEY_BITS - 32)) * np.uint64(shards) >> np.uint64(32)


def _keyed(model: DataFrame, shards: int) -> DataFrame:
    """(shard, size, keys, weights): the model, packed by shard, with one hash for words and pairs alike."""
    import pyarrow as pa

    def key(batches: Iterator) -> Iterator:
        for batch in batches:
            v = batch.column(0).to_numpy().view(np.uint64)
            pair = np.array(batch.column(2).is_valid())
            w = batch.column(2).fill_null(0).to_numpy().view(np.uint64)
            k = np.where(pair, _pair(v, w), v) >> np.uint64(64 - KEY_BITS)
            yield pa.RecordBatch.from_arrays([pa.array(_shard_of(k, shards).astype(np.int32)), pa.array(k.view(np.int64)), pa.array(batch.column(1).to_numpy().astype(np.float32))], names=["shard", "key", "weight"])

    def pack(key, table):
        keys = table.column("key").to_numpy()
        order = np.argsort(keys, kind="stable")
        weights = _squeeze_floats(table.column("weight").to_numpy()[order])
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "size": pa.array([len(keys)], pa.int64()), "keys": pa.array([_steps(keys[order])], pa.binary()), "weights": pa.array([weights], pa.binary())})

    return model.mapInArrow(key, "shard int, key long, weight float").groupBy("shard").applyInArrow(pack, "shard int, size long, keys binary, weights binary")


def _known(model: Model, bits: int) -> bytes:
    """The bitmap of the model's keys, two marks for each."""
    import pyarrow as pa

    def spots(batches: Iterator) -> Iterator:
        for batch in batches:
            for keys in batch.column(0).to_pylist():
                k = np.cumsum(_unsqueeze(keys, KEY_BITS // 8))
                for s in range(0, len(k), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[s : s + (1 << 16)] for x in (k & (bits - 1), k >> (KEY_BITS - bits.bit_length() + 1))]))], names=["spot"])

    return bitmap(model.table.select("keys").mapInArrow(spots, "spot long"), bits)


def _packed(docs: DataFrame, shards: int, known, bits_: int) -> DataFrame:
    """Counts of the n-grams that the model may have, by piece and shard.

    Of each n-gram (keys) the number of its documents (sizes), the steps from one to the next (gaps) and
    how often each has it (times).  The shard a piece is at home in gets what identifies its documents, too.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    meta = ["ids", "langs", "text_keys", "totals"]

    def run(batches: Iterator) -> Iterator:
        bits = np.frombuffer(known.value, dtype=np.uint8)
        mask, high = np.uint64(bits_ - 1), np.uint64(KEY_BITS - bits_.bit_length() + 1)
        has = lambda s: bits[s >> np.uint64(3)] >> (s & np.uint64(7)).astype(np.uint8) & 1
        piece = TaskContext.get().partitionId() << 32

        def grams(data: list[bytes], first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            owner, words, _, _ = _text.word_hashes(data)
            who, v, w = _bigrams(owner, words)
            key = np.concatenate([words, _pair(v, w)]) >> np.uint64(64 - KEY_BITS)
            keep = np.flatnonzero(has(key & mask) & has(key >> high))
            return np.concatenate([owner, who])[keep].astype(np.int32) + np.int32(first), key[keep], np.bincount(owner, minlength=len(data))

        for batch in batches:
            for start, end, texts in pieces(batch.column(3), PIECE):
                n = end - start
                parts = [grams(data, s) for s, _, data in pieces(pa.array(texts, pa.binary()))]
                who, key, total = (np.concatenate(x) for x in zip(*parts))
                del parts, texts
                order = np.argsort(key, kind="stable")
                who, key = who[order], key[order]
                inner = np.lexsort((who, key)) if (np.diff(who)[np.diff(key) == 0] < 0).any() else None
                if inner is not None:  # words and pairs of one key, which hashing all but rules out
                    who, key = who[inner], key[inner]
                at = _starts(key, who)
                times, who, key = np.diff(at, append=len(key)), who[at].astype(np.int64), key[at]
                first = _starts(key)
                gaps = np.diff(who, prepend=0)
                gaps[first] = who[first]
                keys = key[first]
                edges = np.searchsorted(_shard_of(keys, shards), np.arange(shards + 1))
                ends = np.append(first, len(who))
                rows: list[list] = [[] for _ in range(7)]
                home = piece % shards
                for s in range(shards):
                    a, b = edges[s], edges[s + 1]
                    if a == b and s != home:
                        continue
                    i, j = ends[a], ends[b]
                    values = (s, piece, _steps(keys[a:b]), _squeeze(np.diff(ends[a : b + 1])), _squeeze(gaps[i:j]), _squeeze(times[i:j]), s == home)
                    for column, x in zip(rows, values):
                        column.append(x)
                piece += 1
                own = [batch.column(0).slice(start, n), batch.column(1).slice(start, n), batch.column(2).slice(start, n), pa.array(total.astype(np.int64))]
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(rows[6])]) * n, pa.int32()), x) for x in own]
                columns = [pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int64()), *[pa.array(c, pa.binary()) for c in rows[2:6]], *lists]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "piece", "keys", "sizes", "gaps", "times", *meta])

    return docs.mapInArrow(run, "shard int, piece long, keys binary, sizes binary, gaps binary, times binary, ids array<long>, langs array<string>, text_keys array<long>, totals array<long>")


def _join_shard(key, packed, model):
    """Sums of weights by document, piece by piece, of the n-grams in one shard."""
    import pyarrow as pa

    known = [(np.cumsum(_unsqueeze(k, KEY_BITS // 8)), _unsqueeze_floats(w)) for k, w in zip(model.column("keys").to_pylist(), model.column("weights").to_pylist())]
    full, weight = known[0] if known else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32))
    docs, sums = [], []
    for row in range(packed.num_rows):
        keys, sizes, gaps, times = (packed.column(c)[row].as_py() for c in ("keys", "sizes", "gaps", "times"))
        asked, sizes, gaps = np.cumsum(_unsqueeze(keys, KEY_BITS // 8)), _unsqueeze(sizes), _unsqueeze(gaps)
        value = np.zeros(len(asked))
        if len(full) and len(asked):
            at = np.minimum(np.searchsorted(full, asked), len(full) - 1)
            value = np.where(full[at] == asked, weight[at], 0.0)
        who = np.cumsum(gaps)
        first = np.cumsum(sizes) - sizes
        who -= np.repeat(who[first] - gaps[first], sizes)
        total = np.bincount(who, weights=np.repeat(value, sizes) * _unsqueeze(times))
        some = np.flatnonzero(total)
        docs.append(_squeeze(np.diff(some, prepend=0)))
        sums.append(_squeeze_floats(total[some]))
    rest = {c: packed.column(c) for c in ("ids", "langs", "text_keys", "totals")}
    return pa.table({"shard": packed.column("shard"), "piece": packed.column("piece"), "docs": pa.array(docs, pa.binary()), "sums": pa.array(sums, pa.binary())} | rest)


def _sum_piece(unknown: float, edge: float):
    import pyarrow as pa

    def run(key, table):
        table = table.sort_by("shard")  # equal texts are summed in one order, so they come out equal
        home = int(np.flatnonzero(table.column("ids").combine_chunks().value_lengths().to_numpy())[0])
        ids, langs, text_keys, n = (table.column(c)[home].values for c in ("ids", "langs", "text_keys", "totals"))
        n = n.to_numpy()
        score = np.zeros(len(n))
        for docs, sums in zip(table.column("docs").to_pylist(), table.column("sums").to_pylist()):
            score[np.cumsum(_unsqueeze(docs))] += _unsqueeze_floats(sums)
        steps = n + 1  # the end is a step too
        log_p = steps * unknown + score + edge
        return pa.table({"doc_id": ids, "lang": langs, "text_key": text_keys, "n_words": pa.array(n), "perplexity": pa.array(np.exp(-log_p / steps), mask=n == 0)})

    return run


def perplexities(rows: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang, text_key, n_words, perplexity) of every row (doc_id, lang, text_key, text).

    Texts without words have no perplexity.
    """
    bits = bits_for(8 * model.keys)
    known = rows.sparkSession.sparkContext.broadcast(_known(model, bits))
    release(rows.sparkSession)
    packed = _packed(rows, model.shards, known, bits)
    meta = "ids array<long>, langs array<string>, text_keys array<long>, totals array<long>"
    sums = packed.groupBy("shard").cogroup(model.table.groupBy("shard")).applyInArrow(_join_shard, f"shard int, piece long, docs binary, sums binary, {meta}")
    return sums.groupBy("piece").applyInArrow(_sum_piece(model.unknown, model.edge), "doc_id long, lang string, text_key long, n_words long, perplexity double")


def train(texts: DataFrame, least_shards: int = 1) -> Model:
    """The model of all rows of one text column."""
    spark = texts.sparkSession
    # bigrams of one context lie side by side, so that files and shuffles hold it about once
    bigrams = written(count_bigrams(texts).repartition("v").sortWithinPartitions("v"))
    release(spark)
    n = bigrams.count()
    rows, constants, parts = kneser_ney(bigrams)
    shards = max(share_of(n, KEYS_PER_SHARD), least_shards)
    table = written(_keyed(rows, shards))
    discard(bigrams, *parts)
    release(spark)
    return Model(table, shards, table.agg(F.sum("size")).first()[0] or 0, **constants)


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(doc_id, lang, text_key, n_words, perplexity, threshold, kept) of every row of docs.

    Trusted are documents that ``labels`` (doc_id, quality, toxic) calls quality 1 and not toxic.  Half of
    them by hash train the model; the others set the thresholds, by language, and for all languages
    together where a language (or a null one) has none.  Texts without words (null,
    empty, blank) are rejected.  Without trusted documents nothing else is.  Ties with the threshold are
    kept; repeated rows are judged alike.  Texts of any length are counted in full.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    trusted = labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    trusted = written(trusted.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("trusted")), F.lit(2))))
    n_trusted = trusted.count()
    fold = lambda k: broadcast_if_small(trusted.where(F.col("fold") == k).select("doc_id"), n_trusted)
    model = train(rows.select("doc_id", "text").join(fold(0), "doc_id", "left_semi").select("text"), share_of(rows, BYTES_PER_SHARD))
    scored = written(perplexities(rows, model))
    discard(model.table)
    release(spark)
    held = scored.join(fold(1), "doc_id", "left_semi").where("perplexity IS NOT NULL")
    cut = F.percentile_approx("perplexity", quantile, 10000).alias("threshold")
    by_lang = held.where("lang IS NOT NULL").groupBy("lang").agg(cut)
    everywhere = held.agg(cut).first()[0]
    judged = scored.join(by_lang, "lang", "left").withColumn("threshold", F.coalesce("threshold", F.lit(everywhere).cast("double")))
    kept = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return judged.select("doc_id", "lang", "text_key", "n_words", "perplexity", "threshold", kept.alias("kept"))
