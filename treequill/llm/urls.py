"""URL filters: fixed host/path rules first, then association rules mined from labelled pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._cluster import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The site rules (verdict, host and path).
SITE_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: The item that stands for the label in a transaction.
BLOCKED = "=block"


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path.  A null url, or one without ``://``, has both empty."""
    rest = F.coalesce(_rest(F.col(url)), F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"^[^?#]*", 0)
    return pages.withColumns({"host": F.translate(raw, UPPER, LOWER), "path": path})


def site_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = SITE_RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls.  rules is a list on the driver, so it is bounded."""

    def fits(rule: str) -> Column:
        h, _, p = rule.partition("/")
        return ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)

    longest = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    return (F.coalesce(*[F.when(fits(r), F.lit(r)) for _, r in longest], F.lit(None).cast("string")), F.coalesce(*[F.when(fits(r), F.lit(v)) for v, r in longest], F.lit(None).cast("string")))


def with_tokens(pages: DataFrame) -> DataFrame:
    """Adds the set of items of a url: its host, parent domain, path parts (with and without their place), file ending, query keys and pairs."""
    labels = F.split("host", r"\.")
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    word = lambda x: F.when(x.rlike(r"^[0-9]+"), F.regexp_replace(x, r"[0-9]+", "#")).otherwise(x)
    query = F.regexp_extract(F.col("url"), r"\?([^#]*)", 1)
    fields = F.filter(F.split(query, "&"), lambda x: x != "")
    keys = F.transform(fields, lambda x: F.concat(F.lit("query:"), F.substring_index(x, "=", 1)))
    pairs = F.transform(F.filter(fields, lambda x: F.instr(x, "=") > 0), lambda x: F.concat(F.lit("pair:"), F.substring_index(x, "=", 1), F.lit("="), word(F.substr(x, F.instr(x, "=") + 1))))
    ending = F.regexp_extract("path", r"[^/]\.([^./]+)$", 1)
    items = F.concat(
        F.array(F.concat(F.lit("host:"), F.col("host")), F.concat(F.lit("domain:"), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."))),
        F.transform(parts, lambda x, i: F.concat(F.lit("part"), i.cast("string"), F.lit(":"), word(x))),
        F.transform(parts, lambda x: F.concat(F.lit("part:"), word(x))),
        F.when(ending != "", F.array(F.concat(F.lit("ending:"), ending))).otherwise(F.array().cast("array<string>")),
        keys,
        pairs,
    )
    return pages.withColumn("tokens", F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.array_distinct(items)))


def mine_rules(labelled: DataFrame, min_support: float = 0.005, min_confidence: float = 0.8) -> DataFrame:
    """(tokens, confidence, support) of the rules ``tokens => block``, from rows (tokens, blocked boolean).

    Frequent sets number at most what ``min_support`` allows, whatever the size of the table.
    """
    baskets = labelled.select(F.when(F.col("blocked"), F.array_append("tokens", BLOCKED)).otherwise(F.col("tokens")).alias("items")).where(F.size("items") > 0)
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where(F.col("consequent") == F.array(F.lit(BLOCKED)))
    return written(rules.select(F.col("antecedent").alias("tokens"), F.col("confidence").cast("double").alias("confidence"), F.col("support").cast("double").alias("support")))


def matching(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct ``url`` of rows (url, tokens) that some rule's tokens are a subset of.

    The inverted index has each rule once, under the token that the fewest rules have (a rare token is
    found in few urls); containment of the whole rule is checked on the joined row.
    """
    exploded = rules.withColumn("rule_id", F.monotonically_increasing_id()).select("rule_id", "tokens", F.explode("tokens").alias("token"))
    rarity = exploded.groupBy("token").agg(F.count("*").alias("n"))
    index = exploded.join(rarity, "token").groupBy("rule_id").agg(F.min(F.struct("n", "token"))["token"].alias("token"), F.first("tokens").alias("rule_tokens")).groupBy("token").agg(F.collect_set("rule_tokens").alias("rules"))
    asked = urls.select("url", "tokens", F.explode("tokens").alias("token"))
    hit = F.exists("rules", lambda r: F.size(F.array_except(r, F.col("tokens"))) == 0)
    return asked.join(index, "token").where(hit).select("url").distinct()


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = SITE_RULES, min_support: float = 0.005, min_confidence: float = 0.8) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of pages.

    ``labels`` (doc_id, quality, toxic) names bad pages: quality 0 or toxic 1.  A site rule decides
    where one fits; else a url is blocked if a mined rule matches it, and allowed otherwise.  A null
    or malformed url has no tokens and is allowed.  Repeated page rows are each judged.
    """
    parts = with_parts(pages.select("page_id", "url"))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False)))).alias("blocked"))
    tokens = with_tokens(parts)
    mined = mine_rules(tokens.join(known, F.col("page_id") == F.col("doc_id")).select("tokens", "blocked"), min_support, min_confidence)
    bad = matching(tokens.where(F.size("tokens") > 0).select("url", "tokens").distinct(), mined).select(F.col("url").alias("bad_url"))
    rule, verdict = site_rule(F.col("host"), F.col("path"), rules)
    return parts.join(bad, F.col("url") == F.col("bad_url"), "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("bad_url").isNotNull(), "block").otherwise("allow")).alias("verdict"))
