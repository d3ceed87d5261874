import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from treequill.llm import _cluster, forest, near


def sets_of(text, words):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = [x for x in re.split("[\x20\x09-\x0d]+", low) if x]
    if not w:
        return set()
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)}


def reach(ids, linked):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in linked:
        p, q = find(i), find(j)
        parent[p] = q
    out = []
    for i in range(len(ids)):
        own = [ids[j] for j in range(len(ids)) if find(j) == find(i) and ids[j] is not None]
        out.append(min(own) if own else None)
    return out


def brute(rows, words, percent):
    sets = [sets_of(t, words) for _, t in rows]
    n = len(rows)
    linked = [(i, j) for i in range(n) for j in range(n) if i != j and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    component = reach([r[0] for r in rows], linked)
    degree = [0] * n
    for i, _ in linked:
        degree[i] += 1
    return sorted(repr((rows[i][0], len(sets[i]), component[i] if sets[i] else rows[i][0], degree[i])) for i in range(n))


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 4)))
    rows = []
    for base in range(12):
        w = [word() for _ in range(rng.choice([2, 3, 4, 30, 80, 200]))]
        rows.append((len(rows), " ".join(w)))
        for _ in range(rng.choice([0, 1, 5, 12])):
            v = list(w)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                v[rng.randrange(len(v))] = word()
            rows.append((len(rows), rng.choice([" ", "\n", " \t "]).join(v).upper() if rng.random() < 0.3 else " ".join(v)))
    shared = " ".join(word() for _ in range(20))
    rows += [(1000 + i, shared + " " + " ".join(word() for _ in range(25))) for i in range(10)]
    rows += [(2000, None), (2001, ""), (2002, " \n "), (2003, "one"), (2004, "ONE"), (None, "one two"), (2005, "one  two"), (7, rows[3][1]), (7, rows[3][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("words,percent,block", [(4, 85, 512), (5, 80, 4)])
def test_jaccard_equals_brute_force(spark, monkeypatch, words, percent, block):
    monkeypatch.setattr(near, "BLOCK", block)
    rows = corpus(words)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS class", "0L AS component_id").repartition(3)
    got = near.jaccard_classes(docs, words, percent).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    assert sorted(repr(tuple(r)) for r in got) == brute(rows, words, percent)


def test_jaccard_of_an_empty_table(spark):
    assert near.jaccard_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def vectors(seed, dim=16):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(60):
        base = rng.standard_normal(dim)
        label = int(rng.integers(0, 3))
        for _ in range(int(rng.choice([1, 2, 6]))):
            rows.append((len(rows), (base + rng.standard_normal(dim) * rng.choice([0, 0.1, 0.16])).tolist(), label))
    hub = rng.standard_normal(dim)
    rows += [(10_000 + i, (hub + rng.standard_normal(dim) * 0.13).tolist(), 1) for i in range(150)]
    odd = [(90_000, None, 1), (90_001, [], 1), (90_002, [0.0] * dim, 1), (90_003, [float("nan")] * dim, 1), (90_004, [None] * dim, 1), (90_005, [float("inf")] + [0.0] * (dim - 1), 1), (90_006, rows[0][1], None), (90_007, [1.0, 2.0], 1), (90_008, [2.0, 4.0], 1), (None, rows[5][1], rows[5][2]), (4, rows[4][1], rows[4][2])]
    return rows + odd


def test_forest_equals_brute_force(spark):
    rows = vectors(5)
    spark_rows = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS node", "'x' AS unit")
    got = forest.near_vectors(spark_rows, leaf=24).collect()
    ok = [v is not None and len(v) > 0 and lab is not None and None not in v and np.isfinite(v).all() and np.any(v) for _, v, lab in rows]
    linked = []
    for i, (_, u, a) in enumerate(rows):
        for j, (_, v, b) in enumerate(rows):
            if i != j and ok[i] and ok[j] and a == b and len(u) == len(v) and np.dot(u, v) / np.sqrt(np.dot(u, u) * np.dot(v, v)) >= 0.98:
                linked.append((i, j))
    component = reach([r[0] for r in rows], linked)
    degree = [0] * len(rows)
    for i, _ in linked:
        degree[i] += 1
    expected = [(rows[i][0], degree[i], component[i] if ok[i] else rows[i][0], (rows[i][0] == (component[i] if ok[i] else rows[i][0])) if rows[i][0] is not None else False) for i in range(len(rows))]
    assert sum(degree) > 2000
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, expected))


def test_forest_of_an_empty_table(spark):
    assert forest.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


@pytest.mark.parametrize("limit", [0, 500_000])
def test_blocks_of_one_component_are_dealt_over_tasks(spark, monkeypatch, limit):
    """Whether its sizes are broadcast or joined by a shuffle, a large component is not one task's."""
    monkeypatch.setattr(_cluster, "BROADCAST_ROWS", limit)
    one = {"class": F.col("id"), "n": F.lit(100).cast("long"), "grams": F.lit(b"12345678"), "rows": F.lit(1).cast("long"), "component": F.lit(7).cast("long")}
    members = spark.range(near.BLOCK * 6).select(*[c.alias(name) for name, c in one.items()])
    dealt = near._dealt(members, 80)
    assert dealt.where("x < y").select("x", "y").distinct().count() == 15
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which merges tasks as small as these
    try:
        held = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert any("hashpartitioning(component#" in x and "band#" in x and "up#" in x for x in plan.splitlines())
    assert max(held) < 0.8 * sum(held)
