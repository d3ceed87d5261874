"""Mixing to target weights with soft domain membership, in DataFrame expressions only.

A naive Bayes classifier over informative words, fitted on labelled documents, gives every document
posteriors p over domains.  Document rates r >= 0 are fitted by projected gradient least squares, so
that the expected tokens of each domain, the sum of r * tokens * p, meet their targets.  The metric is
that of the token Gram matrix of the rows above 0: a step is r <- max(0, r - p . G^-1 (S - T)), of which each
costs one aggregation of a few numbers; the rates are an expression over the posteriors, never a table of state.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._cluster import broadcast_if_small, discard, written

#: Labelled documents that the classifier is fitted on (the smallest by hash), at most.
MAX_LABELLED = 6_000
#: The classifier knows every word that so many of them have.
LEAST_DOCUMENTS = 5
#: Steps in a row that come no nearer to the targets, after which they count as out of reach.
PATIENCE = 8
#: Steps after which a rate is written as a column, so that its expression stays short.
WRITE_EVERY = 20
#: A word is a run of these characters.
SEPARATOR = "[ \\t\\n\\x0B\\f\\r]+"
#: Target weights of the domains that the labels define.
TARGETS = {"clean": 0.975, "noise": 0.005, "toxic": 0.02}
_UNIT = 1 << 30


def domains_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of labels (doc_id, quality, toxic): toxic first, then quality; contradicting rows count as toxic or noise."""
    each = labels.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)").groupBy("doc_id").agg(F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"), F.min(F.coalesce("quality", F.lit(1))).alias("quality"))
    return each.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean").otherwise("noise").alias("domain"))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SEPARATOR), lambda w: w != "")


def fit_words(docs: DataFrame, labelled: DataFrame, domains: list[str], max_labelled: int = MAX_LABELLED) -> tuple[DataFrame, list[float]]:
    """(word, w0, w1, ...): words with their log likelihood in each domain; the log priors."""
    import math

    sample = labelled.where(F.col("domain").isin(domains)).orderBy(F.xxhash64("doc_id", F.lit("labelled")), "doc_id").limit(max_labelled)
    texts = written(docs.join(broadcast_if_small(sample, max_labelled), "doc_id").select("domain", F.array_distinct(_words(F.col("text"))).alias("words")))
    sizes = {r["domain"]: r["n"] for r in texts.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    priors = [math.log((sizes.get(d, 0) + 1) / (total + len(domains))) for d in domains]
    has = texts.select("domain", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), *[F.sum((F.col("domain") == d).cast("long")).alias(f"n{k}") for k, d in enumerate(domains)])
    rate = [(F.col(f"n{k}") + 0.1) / (sizes.get(d, 0) + 1.0) for k, d in enumerate(domains)]
    overall = (F.col("n") + 0.1) / (total + 1.0)
    words = written(has.where(F.col("n") >= LEAST_DOCUMENTS).select("word", *[F.log(r / overall).alias(f"w{k}") for k, r in enumerate(rate)]))
    discard(texts)
    return words, priors


def posteriors(docs: DataFrame, words: DataFrame, priors: list[float]) -> DataFrame:
    """(doc_id, text_key, n_tokens, p0, p1, ...) of every row of docs (doc_id, text).

    A row's words are summed within the task that reads it; one row for each document is dealt.
    """
    k = len(priors)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_key"), _words(F.col("text")).alias("words"))
    each = rows.select("row", "doc_id", "text_key", F.size("words").cast("long").alias("n_tokens"), F.explode_outer(F.array_distinct("words")).alias("word"))
    found = each.join(broadcast_if_small(words, words.count()), "word", "left")
    first = [F.max(c).alias(c) for c in ("doc_id", "text_key", "n_tokens")]
    both = found.groupBy("row").agg(*first, *[F.sum(f"w{i}").alias(f"s{i}") for i in range(k)])
    scores = [F.lit(priors[i]) + F.coalesce(f"s{i}", F.lit(0.0)) for i in range(k)]
    top = F.greatest(*scores) if k > 1 else scores[0]
    powers = [F.exp(s - top) for s in scores]
    return both.select("doc_id", "text_key", "n_tokens", *[(p / sum(powers[1:], powers[0])).alias(f"p{i}") for i, p in enumerate(powers)])


def _solve(a: list[list[float]], b: list[float]) -> list[float]:
    """Of a small symmetric system, with a ridge against domains without tokens."""
    n = len(b)
    ridge = 1e-9 * max([a[i][i] for i in range(n)] + [1e-30])
    m = [[*a[i], b[i]] for i in range(n)]
    for i in range(n):
        m[i][i] += ridge
    for i in range(n):
        pivot = max(range(i, n), key=lambda r: abs(m[r][i]))
        m[i], m[pivot] = m[pivot], m[i]
        for r in range(n):
            if r != i:
                f = m[r][i] / m[i][i]
                m[r] = [x - f * y for x, y in zip(m[r], m[i])]
    return [m[i][n] / m[i][i] for i in range(n)]


def feasible(weights: list[float], have: list[float], repeats: float) -> list[float]:
    """Shares of domains, next to ``weights``, that no domain is repeated more than ``repeats`` times for.

    The domain of the largest weight is used once.  A domain that has too few tokens gets what it has, so
    many times; the others keep their weights to one another.
    """
    whole = sum(weights)
    main = max(range(len(weights)), key=lambda i: weights[i])
    total = have[main] / (weights[main] / whole)
    tokens = [min(w / whole * total, repeats * h) if i != main else h for i, (w, h) in enumerate(zip(weights, have))]
    return [t / sum(tokens) for t in tokens] if sum(tokens) else [w / whole for w in weights]


def fit_rates(base: DataFrame, weights: list[float], total: float | None = None, tolerance: float = 1e-7, most: float | None = None, repeats: float | None = None) -> DataFrame:
    """``base`` (n_tokens, p0, p1, ...) with the column ``rate``.

    ``total`` is the number of tokens of the mix; by default so many that the domain of the largest weight
    is used once, neither thinned nor repeated.  Weights are scaled to sum to 1.  Rates are projected onto
    0 and above (onto 0 to ``most`` where a caller sets that); with ``repeats`` the targets are first made
    feasible.  Steps end when the targets are met, or when PATIENCE steps came no nearer: then they can't be.
    """
    k = len(weights)
    p = [F.col(f"p{i}") for i in range(k)]
    n = F.col("n_tokens").cast("double")
    sums = base.agg(*[F.sum(n * p[i]) for i in range(k)], *[F.sum(n * p[i] * p[j]) for i in range(k) for j in range(k)]).first()
    have = [sums[i] or 0.0 for i in range(k)]
    gram = [[sums[k + i * k + j] or 0.0 for j in range(k)] for i in range(k)]
    share = feasible(weights, have, repeats) if repeats is not None else [w / sum(weights) for w in weights]
    if not sum(have):
        return base.withColumn("rate", F.lit(1.0))
    if total is None:
        main = max(range(k), key=lambda i: share[i])
        total = have[main] / share[main]
    target = [s * total for s in share]
    reached, rate, rated, done = have, F.lit(1.0), base, 0
    miss = lambda: max(abs(r - t) for r, t in zip(reached, target))
    best, since = miss(), 0
    while miss() > tolerance * max(total, 1.0) and since < PATIENCE:
        step = _solve(gram, [r - t for r, t in zip(reached, target)])
        rate = F.greatest(F.lit(0.0), rate - sum((p[i] * step[i] for i in range(k)), F.lit(0.0)))
        rate = rate if most is None else F.least(F.lit(most), rate)
        free = F.when(rate > 0, n)  # rows at 0 don't follow a step: the next one is measured by the others
        row = rated.agg(*[F.sum(n * p[i] * rate) for i in range(k)], *[F.sum(free * p[i] * p[j]) for i in range(k) for j in range(k)]).first()
        reached, done = [x or 0.0 for x in row[:k]], done + 1
        gram = [[row[k + i * k + j] or 0.0 for j in range(k)] for i in range(k)]
        best, since = (miss(), 0) if miss() < 0.99 * best else (best, since + 1)
        if done % WRITE_EVERY == 0:
            rated, rate = written(rated.withColumn("rate", rate)), F.col("rate")
    return rated.withColumn("rate", rate)


def mix(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float] = TARGETS, total: float | None = None, max_labelled: int = MAX_LABELLED, repeats: float | None = None) -> DataFrame:
    """(doc_id, text_key, n_tokens, p_<domain> ..., rate, copies) of every row of docs (doc_id, text).

    ``labelled`` is (doc_id, domain); domains outside ``targets`` are ignored.  Tokens are words between white
    space.  copies is the rate rounded up or down by a hash of the row, so that its mean is the rate.  Null
    and empty texts have 0 tokens and the prior as posterior; repeated rows have equal values.  Without labels
    every posterior is the same and rates only meet the total.
    """
    names = list(targets)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    words, priors = fit_words(rows, labelled, names, max_labelled)
    base = written(posteriors(rows, words, priors))
    discard(words)
    rated = fit_rates(base, [targets[d] for d in names], total, repeats=repeats)
    dice = F.pmod(F.xxhash64("doc_id", "text_key", F.lit("copies")), F.lit(_UNIT)) / F.lit(float(_UNIT))
    return rated.select("doc_id", "text_key", "n_tokens", *[F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(names)], "rate", F.floor(F.col("rate") + dice).cast("long").alias("copies"))
