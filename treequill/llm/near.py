"""N-gram Jaccard join of documents by vertical partitioning.

The global order of n-grams (by hash) is cut into fragments.  Each fragment counts, on its own, how many
documents have each of its n-grams and hands every document back the ones that it shares.  Summed over
fragments, a document whose shared n-grams are too few to reach the threshold with anything is done.  The
rest are ordered by rising frequency; two documents that link share an n-gram of their prefixes, so
prefix lists give candidate groups.  Within blocks of a group, partial overlaps are counted fragment by
fragment and summed per pair.  Documents with equal sets are one class throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._cluster import broadcast_if_small, components, discard, free_name, partitions, pieces, release, ship, written

#: n-grams of all documents that one fragment holds, about; documents of a block.
PER_FRAGMENT, BLOCK = 3_000_000, 512
#: Columns of a block's matrix that are multiplied at once.
_COLUMNS = 4096


def _sets(column, words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, class ids, offsets, sorted distinct n-grams) of successive groups of texts of an Arrow column.

    A class id is a 64-bit hash of the set, 0 for the empty one.
    """
    for start, end, texts in pieces(column):
        owner, hashes, _, _ = _text.word_hashes(texts)
        who, val, _ = _text.shingle_hashes(owner, hashes, words, True)
        val, off = _text.distinct_per_text(who, val, end - start)
        n = np.diff(off)
        total = np.concatenate([[np.uint64(0)], np.cumsum(_text.mix(val + np.uint64(0x51ED270B)))])
        ids = _text.mix((total[off[1:]] - total[off[:-1]]) * np.uint64(0x9E3779B97F4A7C15) + n.astype(np.uint64))
        ids[n == 0] = 0
        yield start, ids.view(np.int64), off, val


def with_classes(docs: DataFrame, words: int, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_key, class, n_shingles) of every row; text_key is Spark's xxhash64 of the text."""
    import pyarrow as pa

    ship(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for start, ids, off, _ in _sets(batch.column(2), words):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(ids)), batch.column(1).slice(start, len(ids)), pa.array(ids), pa.array(np.diff(off))], names=["doc_id", "text_key", "class", "n_shingles"])

    return docs.select(F.col(doc).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, text_key long, class long, n_shingles long")


def _fragments(docs: DataFrame, words: int, fragments: int, text: str) -> DataFrame:
    """(fragment, low, high, classes, counts): packed n-grams of 40 bits within a fragment, class by class."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for _, ids, off, val in _sets(batch.column(0), words):
                n = np.diff(off)
                first = np.zeros(len(ids), dtype=bool)
                first[np.unique(ids, return_index=True)[1]] = True
                keep = np.repeat(first & (ids != 0), n)
                val, who = val[keep], np.repeat(np.arange(len(ids)), n)[keep]
                part = ((val >> np.uint64(40)) % np.uint64(fragments)).astype(np.int64)
                order = np.lexsort((who, part))
                part, who, val = part[order], who[order], val[order]
                edges = np.searchsorted(part, np.arange(fragments + 1))
                rows: list[list] = [[], [], [], [], []]
                for f in np.flatnonzero(np.diff(edges)):
                    a, b = edges[f], edges[f + 1]
                    w, counts = np.unique(who[a:b], return_counts=True)
                    v = val[a:b]
                    for column, x in zip(rows, (int(f), v.astype(np.uint32).tobytes(), (v >> np.uint64(32)).astype(np.uint8).tobytes(), ids[w].tobytes(), counts.astype(np.int32).tobytes())):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *[pa.array(c, pa.binary()) for c in rows[1:]]], names=["fragment", "low", "high", "classes", "counts"])

    return docs.select(F.col(text)).mapInArrow(run, "fragment int, low binary, high binary, classes binary, counts binary")


def _shared(buckets: int):
    """Of one fragment, by bucket of classes: the n-grams that other classes have too, and in how many each is.

    Frequencies over 255 count as 255: they only order n-grams, alike for all classes.
    """
    import pyarrow as pa

    def run(key, table):
        load = lambda name, kind: np.concatenate([np.frombuffer(x, dtype=kind) for x in table.column(name).to_pylist()])
        gram = (load("high", np.uint8).astype(np.uint64) << np.uint64(32)) | load("low", np.uint32)
        who = np.repeat(load("classes", np.int64), load("counts", np.int32))
        order = np.lexsort((who, gram))
        gram, who = gram[order], who[order]
        new = np.ones(len(gram), dtype=bool)
        new[1:] = (gram[1:] != gram[:-1]) | (who[1:] != who[:-1])  # a class may come from several batches
        gram, who = gram[new], who[new]
        starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        df = np.repeat(sizes := np.diff(starts, append=len(gram)), sizes)
        several = df > 1
        gram, who, df = gram[several], who[several], np.minimum(df[several], 255).astype(np.uint8)
        bucket = who % buckets
        order = np.lexsort((gram, who, bucket))
        gram, who, df, bucket = gram[order], who[order], df[order], bucket[order]
        edges = np.searchsorted(bucket, np.arange(buckets + 1))
        rows: list[list] = [[], [], [], [], [], []]
        for k in np.flatnonzero(np.diff(edges)):
            at = slice(edges[k], edges[k + 1])
            first = np.flatnonzero(np.concatenate([[True], who[at][1:] != who[at][:-1]]))
            counts = np.diff(first, append=edges[k + 1] - edges[k]).astype(np.int32)
            for column, x in zip(rows, (int(k), who[at][first].tobytes(), counts.tobytes(), gram[at].astype(np.uint32).tobytes(), (gram[at] >> np.uint64(32)).astype(np.uint8).tobytes(), df[at].tobytes())):
                column.append(x)
        return pa.table({"bucket": pa.array(rows[0], pa.int32()), "fragment": pa.array([key[0].as_py()] * len(rows[0]), pa.int32())} | {n: pa.array(c, pa.binary()) for n, c in zip(("classes", "counts", "low", "high", "dfs"), rows[1:])})

    return run


def _prefixes(percent: int):
    """Of one bucket: the classes whose shared n-grams, summed over fragments, can reach the threshold.

    Each comes with its shared n-grams and its prefix of them, by rising frequency.
    """
    import pyarrow as pa

    def run(key, packed, sizes):
        classes = sizes.column("class").to_numpy()
        by_class = np.argsort(classes)
        out: list[list] = [[], [], [], [], []]
        parts = list(zip(*[packed.column(n).to_pylist() for n in ("fragment", "classes", "counts", "low", "high", "dfs")]))
        if parts:
            who = np.concatenate([np.repeat(np.frombuffer(c, np.int64), np.frombuffer(n, np.int32)) for _, c, n, *_ in parts])
            gram = np.concatenate([(np.uint64(f) << np.uint64(40)) | (np.frombuffer(h, np.uint8).astype(np.uint64) << np.uint64(32)) | np.frombuffer(low, np.uint32) for f, _, _, low, h, _ in parts])
            df = np.concatenate([np.frombuffer(d, np.uint8) for *_, d in parts])
            order = np.lexsort((gram, df, who))
            who, gram = who[order], gram[order]
            starts = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
            found = by_class[np.searchsorted(classes[by_class], who[starts])]
            n_of, rows_of = sizes.column("size").to_numpy()[found], sizes.column("rows").to_numpy()[found]
            for start, end, n, rows in zip(starts.tolist(), [*starts[1:].tolist(), len(who)], n_of.tolist(), rows_of.tolist()):
                prefix = end - start - -(-percent * n // 100) + 1  # n-grams of this class alone come first and are gone
                if prefix > 0:
                    for column, x in zip(out, (int(who[start]), n, np.sort(gram[start:end]).tobytes(), gram[start : start + prefix].view(np.int64).tolist(), rows)):
                        column.append(x)
        return pa.table({"class": pa.array(out[0], pa.int64()), "n": pa.array(out[1], pa.int64()), "grams": pa.array(out[2], pa.binary()), "prefix": pa.array(out[3], pa.list_(pa.int64())), "rows": pa.array(out[4], pa.int64())})

    return run


def _block_links(percent: int):
    """Spanning links of the classes of one block, or between two: partial overlaps by fragments, summed per pair."""
    import pyarrow as pa

    def run(key, table):
        two = key[2].as_py() or key[3].as_py() != key[4].as_py()
        left = table.column("left").to_numpy(zero_copy_only=False)
        cls = table.column("class").to_numpy()
        n = table.column("n").to_numpy()
        grams = [np.frombuffer(x, dtype=np.uint64) for x in table.column("grams").to_pylist()]
        row = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        gram = np.concatenate(grams)
        vocabulary, column, df = np.unique(gram, return_inverse=True, return_counts=True)
        several = df[column] > 1
        row, column = row[several], column[several]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        column = np.cumsum(np.diff(column, prepend=column[:1]) != 0) if len(column) else column
        a = np.flatnonzero(left)
        b = np.flatnonzero(~left) if two else a
        place = np.zeros(len(cls), dtype=np.int64)
        place[a] = np.arange(len(a))
        place[b] = np.arange(len(b))
        overlap = np.zeros((len(a), len(b)), dtype=np.float32)
        last = int(column[-1]) + 1 if len(column) else 0
        for start in range(0, last, _COLUMNS):
            i, j = np.searchsorted(column, [start, start + _COLUMNS])
            width = min(_COLUMNS, last - start)
            x = np.zeros((len(a), width), dtype=np.float32)
            in_a = left[row[i:j]]
            x[place[row[i:j][in_a]], column[i:j][in_a] - start] = 1
            if two:
                y = np.zeros((len(b), width), dtype=np.float32)
                y[place[row[i:j][~in_a]], column[i:j][~in_a] - start] = 1
            else:
                y = x
            overlap += x @ y.T
        inter = overlap.astype(np.int64)
        ok = 100 * inter >= percent * (n[a][:, None] + n[b][None, :] - inter)
        # the least place reachable within the block, by rounds of taking the least of all neighbours
        label, none = np.arange(len(cls)), len(cls)
        while True:
            old = label.copy()
            label[a] = np.minimum(label[a], np.where(ok, label[b][None, :], none).min(axis=1, initial=none))
            label[b] = np.minimum(label[b], np.where(ok, label[a][:, None], none).min(axis=0, initial=none))
            label = label[label]
            if (label == old).all():
                break
        joined = np.flatnonzero(label != np.arange(len(cls)))
        rows = table.column("rows").to_numpy()
        degree = np.zeros(len(cls), dtype=np.int64)
        if not two:
            np.fill_diagonal(ok, False)
        degree[a] += ok @ rows[b]
        if two:
            degree[b] += ok.T @ rows[a]
        linked = np.flatnonzero(degree)
        return pa.table({"a": pa.array(np.concatenate([cls[joined], cls[linked]]), pa.int64()), "b": pa.array(cls[label[joined]].tolist() + [None] * len(linked), pa.int64()), "degree": pa.array(np.concatenate([np.zeros(len(joined), dtype=np.int64), degree[linked]]), pa.int64())})

    return run


def links(docs: DataFrame, classes: DataFrame, words: int, percent: int, text: str = "text") -> DataFrame:
    """(a, b, degree): spanning links between classes (b not null), and the linked rows of a class in each block (b null)."""
    spark = docs.sparkSession
    total = classes.agg(F.sum("n_shingles")).first()[0] or 0
    fragments = max(partitions(spark), -(-total // PER_FRAGMENT))
    packed = _fragments(docs, words, fragments, text)
    buckets = max(partitions(spark), -(-total // PER_FRAGMENT))
    shared = packed.repartition(fragments, "fragment").groupBy("fragment").applyInArrow(_shared(buckets), "bucket int, fragment int, classes binary, counts binary, low binary, high binary, dfs binary")
    sizes = classes.groupBy("class").agg(F.first("n_shingles").alias("size"), F.count("*").alias("rows"))
    sizes = sizes.withColumn("bucket", F.pmod("class", F.lit(buckets)).cast("int"))
    rest = written(shared.groupBy("bucket").cogroup(sizes.groupBy("bucket")).applyInArrow(_prefixes(percent), "class long, n long, grams binary, prefix array<long>, rows long"))
    del packed, shared, sizes
    release(spark)
    postings = rest.select("class", F.explode("prefix").alias("gram"))
    firsts = postings.groupBy("gram").agg(F.min("class").alias("least"), F.count("*").alias("m")).where("m > 1")
    groups = components(postings.join(firsts, "gram").select(F.col("class").alias("a"), F.col("least").alias("b")))
    members = written(rest.select("class", "n", "grams", "rows").join(groups.withColumnRenamed("id", "class"), "class"))
    discard(rest)
    release(spark)
    dealt = _dealt(members, percent)
    return dealt.groupBy("component", "band", "up", "x", "y").applyInArrow(_block_links(percent), "a long, b long, degree long")


def _dealt(members: DataFrame, percent: int) -> DataFrame:
    """``members``, each with every pair of blocks (component, band, up, x, y) that it is compared in.

    A component of more than BLOCK classes is cut into bands of set sizes, such that classes that can link are
    in one band or in neighbouring ones, and each band into blocks.  Blocks of a band are paired with each
    other, and (up) with those of the next band.
    """
    size = written(members.groupBy("component").agg(F.count("*").alias("m")))
    size = broadcast_if_small(size, size.count())
    width = math.log(100 / percent) * (1 + 1e-6) if percent < 100 else 1e-9
    banded = members.join(size, "component").withColumn("band", F.when(F.col("m") > BLOCK, F.floor(F.log(F.col("n")) / width)).otherwise(0).cast("long")).drop("m")
    counts = written(banded.groupBy("component", "band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    n = counts.count()
    own = banded.join(broadcast_if_small(counts, n), ["component", "band"]).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("other")
    values = ["class", "n", "grams", "rows"]
    same = own.select("*", others("blocks")).select("component", "band", F.lit(False).alias("up"), F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), *values, (F.col("block") <= F.col("other")).alias("left"))
    upper = counts.select("component", (F.col("band") - 1).alias("band"), F.col("blocks").alias("there"))
    lower = counts.select("component", (F.col("band") + 1).alias("band"), F.col("blocks").alias("there"))
    up = own.join(broadcast_if_small(upper, n), ["component", "band"]).select("*", others("there")).select("component", "band", F.lit(True).alias("up"), F.col("block").alias("x"), F.col("other").alias("y"), *values, F.lit(True).alias("left"))
    down = own.join(broadcast_if_small(lower, n), ["component", "band"]).select("*", others("there")).select("component", (F.col("band") - 1).alias("band"), F.lit(True).alias("up"), F.col("other").alias("x"), F.col("block").alias("y"), *values, F.lit(False).alias("left"))
    # dealt by all keys: rows that lie by component satisfy the grouping too, with a large component in one task
    return same.union(up).union(down).repartition("component", "band", "up", "x", "y")


def jaccard_classes(docs: DataFrame, words: int = 5, percent: int = 80, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_key, class, group, n_shingles, n_links, component_id) of every row of docs.

    Two rows link when ``100 * |A & B| >= percent * |A | B|`` for their sets of ``words``-word shingles (a
    shorter text is one shingle).  Empty sets (null, empty or blank texts) link with nothing; equal sets
    always link.  n_links counts other linked rows; group is null for an
    empty set, else equal for all rows that can reach one another.  component_id is the smallest doc_id reachable;
    rows with a null id can link, and take part in components as the others do.  Repeated rows link with
    each other.  n-grams are compared by 40 bits within a fragment, classes by 64-bit hashes.
    """
    classes = written(with_classes(docs, words, doc, text))
    found = written(links(docs, classes.where("class <> 0"), words, percent, text))
    sizes = classes.where("class <> 0").groupBy("class").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    joined = components(found.where("b IS NOT NULL").select("a", "b"))
    named = written(sizes.join(joined.withColumnRenamed("id", "class"), "class", "left").select("class", "least", "rows", F.coalesce("component", "class").alias("component"), F.col("component").isNotNull().alias("linked")))
    least = named.where("linked").groupBy("component").agg(F.min("least").alias("component_id"))
    degrees = found.where("b IS NULL").groupBy("a").agg(F.sum("degree").alias("degree")).withColumnRenamed("a", "class")
    known = named.join(least, "component", "left").join(degrees, "class", "left")
    known = known.select("class", F.col("component").alias("group"), (F.coalesce("degree", F.lit(0)) + F.col("rows") - 1).alias("n_links"), F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    alone = F.col("class") == 0
    return classes.join(known, "class", "left").select("doc_id", "text_key", "class", "group", "n_shingles", F.when(alone, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each_group(docs: DataFrame, found: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` that stay, of the groups in ``found`` = jaccard_classes(docs): the smallest doc_id of each.

    A null id comes last; of rows with one id and text only one stays.  Rows with an empty set all stay.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    first = found.where("group IS NOT NULL").groupBy("group").agg(F.min(order).alias("first"))
    row, once_ = free_name(docs, "_row"), free_name(docs, "_once")
    stay = first.select(F.xxhash64("first.doc_id", "first.text_key").alias(row), F.lit(True).alias(once_))
    alone = found.where("group IS NULL").select(F.xxhash64("doc_id", "text_key").alias(row), F.lit(False).alias(once_)).distinct()
    keyed = docs.withColumn(row, F.xxhash64(F.col(doc).cast("long"), F.xxhash64(text)))
    marked = keyed.join(stay.union(alone), row)
    once = marked.where(F.col(once_)).dropDuplicates([row])
    return once.union(marked.where(~F.col(once_))).select(*docs.columns)
