"""The pipeline's stages against plain versions of what each decides, on a small corpus."""

import random
from collections import Counter

import corpus_pipeline
from treequill.llm import mixing, quality


def write(spark, folder, docs, labels):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def corpus():
    rng = random.Random(11)
    vocabulary = [f"word{i}" for i in range(300)]
    weights = [1 / (i + 3) for i in range(300)]
    docs, labels = [], []
    for i in range(160):
        words = rng.choices(vocabulary, weights, k=rng.randint(60, 120))
        if i % 8 == 7:
            words = [f"{w}%%{rng.randint(0, 10**6)}" for w in words]
        docs.append([i, " ".join(words), "en", "s"])
        labels.append((i, int(i % 8 != 7), 0))
    copy, near = docs[3][1], docs[4][1].split()
    near[30] = "changed"
    passage = [f"pass{i}" for i in range(60)]
    docs += [[200, copy, "en", "s"], [201, " ".join(near), "en", "s"]]
    for i, k in ((202, 10), (203, 12)):
        base = docs[k][1].split()
        docs.append([i, " ".join([*rng.sample(base, len(base)), *passage, *rng.sample(base, len(base))]), "en", "s"])
    docs += [[204, None, None, None], [205, "", "en", "s"]]
    return [(*d, None if d[1] is None else len(d[1])) for d in docs], labels


def test_stages_and_run(spark, tmp_path):
    docs, labels = corpus()
    folder = str(tmp_path)
    write(spark, folder, docs, labels)
    now = spark.read.parquet(f"{folder}/documents.parquet")
    columns = now.columns
    kept = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, folder)
        now.write.parquet(f"{folder}/out{i}")
        now = spark.read.parquet(f"{folder}/out{i}")
        kept[name] = now.collect()
        assert now.columns == columns or name == "packing"
    whole = {d[0]: d for d in docs}
    # what the classifier keeps is what goes on
    judged = {r["doc_id"]: r["kept"] for r in quality.classify(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    assert sorted(r["doc_id"] for r in kept["quality"]) == sorted(i for i, k in judged.items() if k)
    assert not [r for r in kept["quality"] if r["doc_id"] in (204, 205) or r["doc_id"] % 8 == 7 and r["doc_id"] < 160]
    # one of each group of near copies, by brute force over five-word shingles
    sets = {r["doc_id"]: frozenset(tuple(w[k : k + 5]) for w in [r["text"].split()] for k in range(len(w) - 4)) for r in kept["quality"]}
    alone = [i for i, a in sets.items() if not any(j < i and len(a & b) >= 0.8 * len(a | b) for j, b in sets.items())]
    assert sorted(r["doc_id"] for r in kept["near_copies"]) == sorted(alone)
    # the passage stays where it is first
    texts = {r["doc_id"]: r["text"] for r in kept["passages"]}
    if {202, 203} <= set(texts):
        assert "pass30" in texts[202] and "pass30" not in texts[203]
    assert all(texts[i] == whole[i][1] for i in texts if i < 160) and all(r["n_chars"] == len(r["text"]) for r in kept["passages"])
    # as many copies as the rates say, and each packed piece once
    rates = {r["doc_id"]: r["copies"] for r in mixing.mix(spark.read.parquet(f"{folder}/out2"), mixing.domains_of(spark.read.parquet(f"{folder}/labels.parquet")), repeats=corpus_pipeline.REPEATS).collect()}
    assert Counter(r["doc_id"] for r in kept["mixing"]) == {i: n for i, n in rates.items() if n}
    pieces = Counter(r["doc_id"] for r in kept["packing"])
    assert pieces == Counter(r["doc_id"] for r in kept["mixing"])  # each is shorter than a sequence
    fill = Counter()
    for r in kept["packing"]:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048
    assert corpus_pipeline.run(spark, folder).count() == len(kept["packing"])
