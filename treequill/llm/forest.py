"""Near-duplicate embeddings by a forest of random-projection trees with spill.

Every tree splits the vectors of one label at the median of random projections.  A vector within a margin
of the split goes to both sides, so that a linked pair parts only if its projections differ by more than
twice the margin.  Splits are fitted on a bounded sample of each node (SAMPLE vectors, chosen by hash);
all vectors are then dealt to the leaves, and leaves that are still too large are fitted and split again.
Pairs are compared within leaves, in double precision, in blocks of bounded size; a pair is counted in
the first leaf that both have.  Leaves that cannot be split (vectors all close together) are compared in
pairs of blocks.  Equal vectors of a label are one class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._cluster import components, ship, written
from ._text import mix

TREES, LEAF, SAMPLE, DEPTH = 4, 512, 4096, 9


def _directions(tree: int, turn: int, dim: int) -> np.ndarray:
    d = np.random.Generator(np.random.PCG64([tree, turn, dim])).standard_normal((dim, DEPTH))
    return d / np.linalg.norm(d, axis=0)


def _unit_vectors(vectors: DataFrame, id_: str, embedding: str, label: str) -> DataFrame:
    """(vec_id, label, unit binary), unit null where the vector can't link."""
    import pyarrow as pa

    rows = vectors.select(F.col(id_).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast("array<double>").alias("embedding"))

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            units = []
            for v, lab in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist()):
                unit = None
                if v and lab is not None and None not in v:
                    x = np.array(v, dtype=np.float64)
                    top = np.abs(x).max()
                    if np.isfinite(top) and top > 0:
                        x = x / top  # so that no square overflows or vanishes
                        unit = (x / np.sqrt(x @ x)).tobytes()
                units.append(unit)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(units, pa.binary())], names=["vec_id", "label", "unit"])

    return rows.mapInArrow(run, "vec_id long, label string, unit binary")


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(len(column), -1)


def _descend(x: np.ndarray, cuts: np.ndarray, directions: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of every leaf that a row reaches; cuts by heap place, NaN at leaves."""
    projected = x @ directions
    rows, places = np.arange(len(x)), np.ones(len(x), dtype=np.int64)
    out_rows, out_places = [], []
    for level in range(DEPTH + 1):
        cut = cuts[places] if level < DEPTH else np.full(len(places), np.nan)
        ended = np.isnan(cut)
        out_rows.append(rows[ended])
        out_places.append(places[ended])
        rows, places, cut = rows[~ended], places[~ended], cut[~ended]
        if not len(rows):
            break
        value = projected[rows, level]
        left, right = value < cut + margin, value >= cut - margin
        rows, places = np.concatenate([rows[left], rows[right]]), np.concatenate([2 * places[left], 2 * places[right] + 1])
    return np.concatenate(out_rows), np.concatenate(out_places)


def _fit(turn: int, leaf: int, margin: float):
    import pyarrow as pa

    def run(key, table):
        x = _matrix(table.column("unit"))
        tree, size = table.column("tree")[0].as_py(), table.column("size")[0].as_py()
        projected = x @ _directions(tree, turn, x.shape[1])
        enough = leaf * len(x) / size
        cuts = np.full(1 << DEPTH, np.nan)
        todo = [(1, 0, np.arange(len(x)))]
        while todo:
            place, level, rows = todo.pop()
            if level == DEPTH or len(rows) <= max(enough, 8):
                continue
            value = projected[rows, level]
            cut = np.median(value)
            left, right = rows[value < cut + margin], rows[value >= cut - margin]
            if len(left) + len(right) > 1.8 * len(rows):
                continue  # the margin takes all that the split would give
            cuts[place] = cut
            todo += [(2 * place, level + 1, left), (2 * place + 1, level + 1, right)]
        return pa.table({"node": pa.array([key[0].as_py()], pa.int64()), "cuts": pa.array([cuts.tobytes()], pa.binary())})

    return run


def _assign(turn: int, margin: float):
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            nodes = batch.column(1).to_numpy()
            trees = batch.column(0).to_numpy()
            cuts = batch.column(4)
            for node in np.unique(nodes):
                at = np.flatnonzero(nodes == node)
                part = batch.take(pa.array(at))
                x = _matrix(part.column(3))
                table = np.frombuffer(cuts[int(at[0])].as_py(), dtype=np.float64)
                rows, places = _descend(x, table, _directions(int(trees[at[0]]), turn, x.shape[1]), margin)
                fresh = mix(np.full(len(places), np.uint64(np.int64(node).view(np.uint64))) + places.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                taken = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([taken.column(0), pa.array(fresh), taken.column(2), taken.column(3), pa.array(np.full(len(rows), bool(np.isnan(table[1]))))], names=["tree", "node", "class", "unit", "stuck"])

    return run


def _compare(threshold: float):
    import pyarrow as pa

    def run(key, table):
        node, two = key[0].as_py(), key[1].as_py() != key[2].as_py()
        left = table.column("block").to_numpy() == key[1].as_py()
        a, b = np.flatnonzero(left), np.flatnonzero(~left if two else left)
        cls, rows = table.column("class").to_numpy(), table.column("rows").to_numpy()
        x = _matrix(table.column("unit"))
        lists = table.column("nodes").to_pylist()
        linked = x[a] @ x[b].T >= threshold
        # a pair is counted in the first leaf that both have: not here, if they share one before this
        owner = np.repeat(np.arange(len(lists)), [len(n) for n in lists])
        nodes = np.fromiter((n for ns in lists for n in ns), dtype=np.int64, count=len(owner))
        before = nodes < node
        names, place = np.unique(nodes[before], return_inverse=True)
        for s in range(0, len(names), 1024):
            part = (place >= s) & (place < s + 1024)
            has = np.zeros((len(lists), 1024), dtype=np.float32)
            has[owner[before][part], place[part] - s] = 1
            linked &= has[a] @ has[b].T == 0
        if not two:
            np.fill_diagonal(linked, False)
        degree = np.zeros(len(cls), dtype=np.int64)
        degree[a] += linked @ rows[b]
        if two:
            degree[b] += linked.T @ rows[a]
        # the least place reachable within the block, by rounds of taking the least of all neighbours
        label, none = np.arange(len(cls)), len(cls)
        while True:
            old = label.copy()
            label[a] = np.minimum(label[a], np.where(linked, label[b][None, :], none).min(axis=1, initial=none))
            label[b] = np.minimum(label[b], np.where(linked, label[a][:, None], none).min(axis=0, initial=none))
            label = label[label]
            if (label == old).all():
                break
        joined = np.flatnonzero(label != np.arange(len(cls)))
        some = np.flatnonzero(degree)
        return pa.table({"a": pa.array(np.concatenate([cls[joined], cls[some]]), pa.int64()), "b": pa.array(cls[label[joined]].tolist() + [None] * len(some), pa.int64()), "degree": pa.array(np.concatenate([np.zeros(len(joined), dtype=np.int64), degree[some]]), pa.int64())})

    return run


def leaves(classes: DataFrame, threshold: float, dim: int, trees: int = TREES, leaf: int = LEAF, spill: float = 1.2) -> DataFrame:
    """(tree, node, class, unit) of every leaf that a class (label, class, unit) is in."""
    margin = spill * float(np.sqrt(max(2 - 2 * threshold, 1e-12) / max(dim, 1)))
    every = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    now = classes.select(every, "label", "class", "unit").select("tree", F.xxhash64("tree", "label", F.length("unit")).alias("node"), "class", "unit", F.lit(False).alias("stuck"))
    done = []
    turn = 0
    while True:
        now = written(now)
        sizes = now.groupBy("node").agg(F.count("*").alias("size"), F.first("stuck").alias("stuck"))
        large = written(sizes.where((F.col("size") > leaf) & ~F.col("stuck")).select("node", "size"))
        if not large.limit(1).count():
            return _union([*done, now.drop("stuck")])
        done.append(now.join(large, "node", "left_anti").select("tree", "node", "class", "unit"))
        chosen = F.pmod(F.xxhash64("class", F.lit(turn)), F.lit(1 << 30)) < F.lit(SAMPLE * float(1 << 30)) / F.col("size")
        sample = now.join(large, "node").where(chosen).select("node", "tree", "size", "unit")
        cuts = written(sample.groupBy("node").applyInArrow(_fit(turn, leaf, margin), "node long, cuts binary"))
        now = now.drop("stuck").join(cuts, "node").select("tree", "node", "class", "unit", "cuts").mapInArrow(_assign(turn, margin), "tree int, node long, class long, unit binary, stuck boolean")
        turn += 1


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def near_vectors(vectors: DataFrame, threshold: float = 0.98, id_: str = "vec_id", embedding: str = "embedding", label: str = "label", trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors.

    Two rows link if their labels are equal and not null, their vectors have the same length and their
    cosine, in double precision, is at least ``threshold``.  A vector that is null, empty, zero or holds a
    null or non-finite value links with nothing, and is kept.  n_links counts other linked rows (repeated
    rows link with each other); component_id is the smallest id reachable, itself included.  A null id
    can link; alone, its component is null.
    """
    spark = vectors.sparkSession
    ship(spark)
    units = _unit_vectors(vectors, id_, embedding, label).withColumn("class", F.when(F.col("unit").isNotNull(), F.xxhash64("label", "unit")))
    units = written(units)
    classes = written(units.where("class IS NOT NULL").groupBy("class").agg(F.first("label").alias("label"), F.first("unit").alias("unit"), F.min("vec_id").alias("least"), F.count("*").alias("rows")))
    dim = (classes.agg(F.max(F.length("unit"))).first()[0] or 8) // 8
    placed = written(leaves(classes.select("label", "class", "unit"), threshold, dim, trees, leaf))
    crowded = placed.groupBy("node").agg(F.count("*").alias("size")).where("size > 1").select("node", F.ceil(F.col("size") / (2 * leaf)).cast("int").alias("blocks"))
    member = placed.groupBy("class").agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    dealt = placed.join(crowded, "node").join(member, "class").join(classes.select("class", "rows"), "class")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("class", F.lit(77)), F.col("blocks")).cast("int")).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("node", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "class", "unit", "nodes", "rows", "block")
    found = written(dealt.groupBy("node", "x", "y").applyInArrow(_compare(threshold), "a long, b long, degree long"))
    degrees = found.where("b IS NULL").groupBy("a").agg(F.sum("degree").alias("degree")).withColumnRenamed("a", "class")
    joined = components(found.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("id", "class")
    named = written(classes.select("class", "least", "rows").join(joined, "class", "left").select("class", "least", "rows", F.coalesce("component", "class").alias("component")))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    known = named.join(least, "component").join(degrees, "class", "left").select("class", "component_id", (F.coalesce("degree", F.lit(0)) + F.col("rows") - 1).alias("n_links"))
    out = units.select("vec_id", "class").join(known, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.col("class").isNull()).alias("kept"))
