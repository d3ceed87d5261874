import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from treequill.llm import chat, mixing, quality, urls


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [x for x in re.split("[\x20\x09-\x0d]+", low) if x]


def brute_kneser_ney(texts):
    c = Counter()
    for t in texts:
        w = ["<s>", *words_of(t), "</s>"]
        if len(w) > 2:
            c.update(zip(w, w[1:]))
    d = quality.discounts(*[sum(n == k for n in c.values()) for k in (1, 2, 3, 4)])
    after = Counter(w for _, w in c)
    e = quality.discounts(*[sum(n == k for n in after.values()) for k in (1, 2, 3, 4)])
    of = lambda n, x: x[min(n, 3) - 1]
    types, mass = sum(after.values()), sum(of(k, e) for k in after.values())
    floor = mass / types / (len(after) + 1)
    low = lambda w: (after[w] - of(after[w], e)) / types + floor if w in after else floor
    total, left = Counter(), defaultdict(float)
    for (v, _), n in c.items():
        total[v] += n
        left[v] += of(n, d)

    def p(v, w):
        if v not in total:
            return low(w)
        n = c[v, w]
        return (max(n - of(n, d), 0) / total[v] if n else 0) + left[v] / total[v] * low(w)

    return p


def perplexity(p, text):
    w = ["<s>", *words_of(text), "</s>"]
    return math.exp(-sum(math.log(p(a, b)) for a, b in zip(w, w[1:])) / (len(w) - 1)) if len(w) > 2 else None


ROWS = "doc_id long, lang string, text_key long, text string"


def scores(spark, texts, asked):
    from treequill.llm._cluster import ship

    ship(spark)
    model = quality.train(spark.createDataFrame([(t,) for t in texts], "text string"), 5)
    rows = spark.createDataFrame([(i, None, i, t) for i, t in enumerate(asked)], ROWS).repartition(3)
    return {r["doc_id"]: r["perplexity"] for r in quality.perplexities(rows, model).collect()}


def test_perplexity_equals_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(30)], k=rng.randint(5, 60))) for _ in range(40)]
    asked = [*texts[:3], "w1 unseen W2 w3", "w0 w1 w2", "", "w0 " * 50, texts[0]]
    found, p = scores(spark, texts, asked), brute_kneser_ney(texts)
    for i, t in enumerate(asked):
        assert found[i] == (pytest.approx(perplexity(p, t), rel=1e-5) if t else None)
    assert found[0] == found[7]


def test_very_long_documents_are_counted_in_full(spark):
    texts = [" ".join(random.Random(i).choices([f"w{k}" for k in range(20)], k=200)) for i in range(20)]
    many = " ".join(f"u{i % 90_000} w{i % 20}" for i in range(150_000))  # 300 000 words, of which 90 000 are distinct
    long = " ".join(texts * 5)  # 20 000 words, each about 1 000 times
    texts += [" ".join(f"u{i}" for i in range(90_000))]
    found, p = scores(spark, texts, [long, many, "w1 " * 1500]), brute_kneser_ney(texts)
    for i, t in enumerate([long, many, "w1 " * 1500]):
        assert found[i] == pytest.approx(perplexity(p, t), rel=1e-5)


def test_thresholds_and_verdicts_equal_brute_force(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        lang = ("en", "fr", None)[i % 3]
        rows.append((i, " ".join(rng.choices([f"{lang}{k}" for k in range(40)], [1 / (k + 1) for k in range(40)], k=rng.randint(1, 40))), lang))
        if i % 4:
            labels.append((i, i % 5 != 0, i % 7 == 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fold = {r["doc_id"]: r["f"] for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit("trusted")), F.lit(2)).alias("f")).collect()}
    trusted = {i for i, q, t in labels if q and not t}
    p = brute_kneser_ney([t for i, t, _ in rows if i in trusted and fold[i] == 0])
    value = {i: perplexity(p, t) for i, t, _ in rows}
    held = [(lang, value[i]) for i, _, lang in rows if i in trusted and fold[i] == 1]

    def cut(values):
        values = sorted(values)
        return values[max(math.ceil(0.9 * len(values)) - 1, 0)]

    got = {r["doc_id"]: r for r in quality.classify(docs, spark.createDataFrame([(i, int(q), int(t)) for i, q, t in labels], "doc_id long, quality int, toxic int"), quantile=0.9).collect()}
    for i, _, lang in rows:
        threshold = cut([x for k, x in held if k == lang or lang is None])
        assert got[i]["threshold"] == pytest.approx(threshold, rel=1e-5)
        assert got[i]["kept"] == (value[i] <= threshold * (1 + 1e-5)) or value[i] == pytest.approx(threshold, rel=1e-5)


def test_model_counts_every_trusted_document_of_its_fold(spark, monkeypatch):
    n = 30_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), "id").alias("text"), F.lit("en").alias("lang"))
    seen = []
    monkeypatch.setattr(quality, "kneser_ney", lambda bigrams, fit=quality.kneser_ney: seen.append(bigrams.agg(F.sum("n")).first()[0]) or fit(bigrams))
    quality.classify(docs, docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")))
    fold = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("trusted")), F.lit(2)) == 0).count()
    assert fold > 12_000 and seen == [2 * fold]  # a start and an end for each text of one word


def test_packed_numbers_come_back_and_take_little_room():
    rng = np.random.default_rng(4)
    for width, values in ((4, [0, 0, 0]), (4, [1]), (4, [2**32 - 1, 0, 7]), (6, [2**48 - 1, 2**40, 0, 3]), (4, []), (4, rng.integers(0, 3000, 5000)), (4, [5] * 70_000)):
        values = np.array(values, dtype=np.int64)
        assert quality._unsqueeze(quality._squeeze(values, width), width).tolist() == values.tolist()
    floats = np.concatenate([rng.normal(size=1000), [0, -0.0, 1e-40, np.inf, -np.inf]]).astype(np.float32)
    assert quality._unsqueeze_floats(quality._squeeze_floats(floats)).tobytes() == floats.tobytes()
    keys = np.unique(rng.integers(0, 2**48 // 30, 20_000, dtype=np.uint64))
    assert np.cumsum(quality._unsqueeze(quality._steps(keys), 6)).tolist() == keys.tolist()
    least = len(keys) * (math.log2(2**48 / 30 / len(keys)) + math.log2(math.e)) / 8  # what any code of such steps takes
    assert len(quality._steps(keys)) < 1.02 * least


def test_training_leaves_only_the_model_and_packing_begins_without_old_shuffles(spark, monkeypatch):
    from treequill.llm import _cluster

    steps = []
    for name in ("_known", "release", "_packed"):
        monkeypatch.setattr(quality, name, lambda *a, f=getattr(quality, name), name=name: (f(*a), steps.append(name))[0])
    _cluster.ship(spark)
    before = len(_cluster._written)
    model = quality.train(spark.createDataFrame([("a b c a b",), ("b c",)], "text string"))
    assert [x[1] for x in _cluster._written[before:]] == [model.table._treequill_path]
    steps.clear()
    assert quality.perplexities(spark.createDataFrame([(0, None, 0, "a b")], ROWS), model).count() == 1
    assert steps == ["_known", "release", "_packed"]


def test_classifier_of_no_documents(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, labels).count() == 0


def labelled(seed=3, n=300):
    rng = random.Random(seed)
    good = [f"good{i}" for i in range(40)]
    docs, labels = [], []
    for i in range(n):
        kind = ("clean", "noise", "toxic")[i % 3 if i % 5 else 0]
        words = rng.choices(good, k=60)
        if kind == "toxic":
            words[10] = words[20] = "badword"
        if kind == "noise":
            words = [w + "%%%" + (str(rng.randint(0, 9999)) if rng.random() < 0.7 else "") for w in words]
        docs.append((i, " ".join(words), "en"))
        labels.append((i, int(kind != "noise"), int(kind == "toxic")))
    return docs + [(1000, None, None), (1001, "", "en"), (None, docs[0][1], "xx"), (0, docs[0][1], "en")], labels


def test_classifier_rejects_noise(spark):
    docs, labels = labelled()
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("kept", F.lit("clash"))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.classify(d, lab).collect()
    assert len(got) == len(docs)
    truth = {i: q for i, q, _ in labels}
    assert all(not r["kept"] for r in got if truth.get(r["doc_id"]) == 0 or r["doc_id"] in (1000, 1001))
    clean = {i for i, q, t in labels if q and not t}
    kept = [r["kept"] for r in got if r["doc_id"] in clean]
    assert sum(kept) >= 0.95 * len(kept)
    assert all(r["kept"] or r["n_words"] == 0 for r in quality.classify(d, lab.limit(0)).collect())


def test_mix_meets_targets(spark):
    docs, labels = labelled()
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    domains = mixing.domains_of(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    targets = {"clean": 0.8, "noise": 0.2}
    got = mixing.mix(d, domains, targets).collect()
    assert len(got) == len(docs)
    sums = {k: sum(r["n_tokens"] * r["rate"] * r[f"p_{k}"] for r in got) for k in targets}
    for k, t in targets.items():
        assert sums[k] / sum(sums.values()) == pytest.approx(t, abs=1e-4)
    truth = {i: "clean" if q else "noise" for i, q, t in labels if not t}
    assert sum(r[f"p_{truth[r['doc_id']]}"] > 0.5 for r in got if r["doc_id"] in truth) > 0.95 * len(truth)
    assert all(0 <= r["rate"] and r["copies"] in (math.floor(r["rate"]), math.floor(r["rate"]) + 1) for r in got)
    assert mixing.mix(d.limit(0), domains, targets).count() == 0


def brute_rates(rows, weights, steps=60):
    """Projected gradient in the Gram metric of the rows above 0, one row at a time."""
    k = len(weights)
    have = [sum(n * p[i] for n, *p in rows) for i in range(k)]
    main = max(range(k), key=lambda i: weights[i])
    target = [w / weights[main] * have[main] for w in weights]
    rates = [1.0] * len(rows)
    for _ in range(steps):
        reached = [sum(n * p[i] * r for (n, *p), r in zip(rows, rates)) for i in range(k)]
        if max(abs(r - t) for r, t in zip(reached, target)) <= 1e-7 * sum(target):
            break
        gram = np.array([[sum(n * p[i] * p[j] for (n, *p), r in zip(rows, rates) if r > 0) for j in range(k)] for i in range(k)])
        step = np.linalg.solve(gram + 1e-9 * gram.max() * np.eye(k), np.subtract(reached, target))
        rates = [max(0.0, r - float(np.dot(p, step))) for (_, *p), r in zip(rows, rates)]
    return rates


@pytest.mark.parametrize("weights", [[0.7, 0.3], [0.99, 0.01], [0.5, 0.5]])
def test_rates_equal_brute_force(spark, weights):
    rng = random.Random(2)
    rows = [(rng.randint(1, 500), p, 1 - p) for p in (rng.betavariate(0.3, 0.1) for _ in range(60))]
    base = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, n_tokens long, p0 double, p1 double")
    got = {r["i"]: r["rate"] for r in mixing.fit_rates(base, weights).collect()}
    sums = [sum(n * p[i] * got[j] for j, (n, *p) in enumerate(rows)) for i in (0, 1)]
    assert sums[0] / sum(sums) == pytest.approx(weights[0], abs=1e-5)
    for i, rate in enumerate(brute_rates(rows, weights)):
        assert got[i] == pytest.approx(rate, rel=1e-3, abs=1e-3)


def test_mix_meets_targets_of_a_scarce_domain(spark):
    rows = [(1000, 0.99, 0.01)] * 50 + [(1000, 0.01, 0.99)]
    base = spark.createDataFrame(rows, "n_tokens long, p0 double, p1 double")
    for repeats, share in ((None, 0.3), (1.0, None)):
        rated = mixing.fit_rates(base, [0.7, 0.3], repeats=repeats).collect()
        sums = [sum(r["n_tokens"] * r["rate"] * r[p] for r in rated) for p in ("p0", "p1")]
        if share:
            assert sums[1] / sum(sums) == pytest.approx(share, abs=1e-4)
        else:  # no more of it than there is
            assert sums[1] == pytest.approx(sum(n * q for n, _, q in rows), rel=1e-4)


CHAT = [(1, 0, "user", "a<b \\ c"), (1, 1, "user", "</turn>\n<sep/>"), (1, 2, "assistant", "x\\l"), (1, 3, "assistant", ""), (1, 4, "user", None), (2, 5, "assistant", "only"), (3, None, None, "no role"), (3, 1, "ro\nle<", "t"), (None, 0, "assistant", "é🙂"), (2, 5, "assistant", "only")]


def test_chat_round_trip(spark):
    rows = spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    formatted = chat.format_conversations(rows)
    for r in chat.read_back(formatted).join(formatted.select(F.col("conv_id").alias("c"), "formatted", "mask"), F.col("conv_id").eqNullSafe(F.col("c"))).collect():
        turns = sorted([(t if t is not None else -1, role or "", text or "") for c, t, role, text in CHAT if c == r["conv_id"]])
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(role, text) for _, role, text in turns]
        assert r["loss_text"] == "".join(text for _, role, text in turns if role == "assistant")
        at, under = 0, []
        for run in r["mask"]:
            under += [r["formatted"][at : at + run["chars"]]] if run["loss"] else []
            at += run["chars"]
        assert at == len(r["formatted"]) == r["formatted_chars"]
        assert "".join(under).replace("\\l", "<").replace("\\b", "\\") == r["loss_text"]
    digests = {r["conv_id"]: r for r in chat.digests(formatted).collect()}
    assert digests[2]["turns_sha256"] == hashlib.sha256(b"assistant\nonly\n" * 2).hexdigest() and digests[1]["n_turns"] == 5
    assert chat.digests(chat.format_conversations(rows.limit(0))).count() == 0


def test_chat_loss_is_read_by_the_mask(spark):
    rows = spark.createDataFrame([(1, 0, "user", "\u00e9<q\\"), (1, 1, "assistant", "a\U0001f600<"), (1, 2, "assistant", ""), (1, 3, "assistant", "\\l"), (1, 4, "user", "z")], "conv_id long, turn long, role string, text string")
    loss = lambda f: chat.read_back(f).first()["loss_text"]
    formatted = chat.format_conversations(rows)
    assert loss(formatted) == "a\U0001f600<\\l"
    assert loss(chat.format_conversations(rows, loss_roles=("user",))) == "\u00e9<q\\z"
    assert loss(formatted.withColumn("mask", F.transform("mask", lambda r: r.withField("loss", F.lit(False))))) == ""


def test_urls(spark):
    pages, labels = [], []
    for i in range(200):
        bad = i % 4 == 0
        pages.append((i, f"https://{'spam.site.info' if bad else 'www.fine.info'}/{'buy' if bad else 'read'}/{i}?q={i}"))
        labels.append((i, int(not bad), 0))
    pages += [(900, None), (901, "no scheme"), (902, "HTTP://WWW.Example.ORG/es/x?y#z"), (903, "x://a.org"), (904, "x://de.com/fr/1"), (905, "x://de.com/de/1"), (906, "x://spam.site.info/buy/7"), (907, "x://notexample.org/es/"), (908, "x://example.org?/es/"), (906, "x://spam.site.info/buy/7")]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert len(got) == len(pages) - 1
    assert all(got[i]["verdict"] == ("block" if i % 4 == 0 else "allow") for i in range(200))
    assert (got[902]["host"], got[902]["path"], got[902]["rule"], got[902]["verdict"]) == ("www.example.org", "/es/x", "example.org/es/", "block")
    assert [got[i]["rule"] for i in (900, 901, 903, 904, 905, 906, 907, 908)] == [None, None, None, "com/fr/", "com/de/", None, "org/", None]
    assert got[906]["verdict"] == "block" and got[900]["verdict"] == "allow" and got[908]["path"] == ""


def test_mined_rules_match_as_brute_force_does(spark):
    rng = random.Random(6)
    rules = [(rng.sample("abcdefgh", rng.randint(1, 3)), 0.9, 0.1) for _ in range(12)]
    rows = [(f"u{i}", rng.sample("abcdefghij", rng.randint(1, 5))) for i in range(200)]
    got = urls.matching(spark.createDataFrame(rows, "url string, tokens array<string>"), spark.createDataFrame(rules, "tokens array<string>, confidence double, support double"))
    assert {r["url"] for r in got.collect()} == {u for u, have in rows if any(set(rule) <= set(have) for rule, _, _ in rules)}


def test_no_pages(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_urls_with_a_late_marker(spark):
    marked = lambda i: {0: f"/en/2024/casino-win/{i}", 1: f"/en/2024/a{i}/b/casino-win", 2: f"/en/2024/{i}.exe", 3: f"/en/2024/{i}?to=casino&n={i}"}[i // 4 % 4]
    pages = [(i, f"https://www.fine{i % 7}.info{marked(i) if i % 4 == 0 else f'/en/2024/news/{i}.html?to=home&n={i}'}") for i in range(400)]
    labels = [(i, int(i % 4 != 0), 0) for i in range(400)]
    got = urls.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert all(r["verdict"] == ("block" if r["page_id"] % 4 == 0 else "allow") for r in got)
