"""URL filters: listed rules first, then association rules that FP-growth mines from labelled URLs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroframe.llm.common import small, written

#: A mined rule must hold for this share of the labelled URLs with its tokens, and for so many URLs.
MIN_CONFIDENCE = 0.8
MIN_URLS = 20
BAD = "!bad"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def listed(host: Column, path: Column, rules: Mapping[str, str]) -> Column:
    """Struct of ``rule`` and ``verdict`` of the longest rule (``host/path`` -> verdict) that fits, else null.

    A rule fits its host and all its subdomains, if the path starts with the rule's. ``rules`` is configuration: it is
    part of the plan.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        at, _, rest = rule.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{rest}")
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(rules[rule]).alias("verdict"))).otherwise(out)
    return out


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a URL: scheme, host labels and their hyphened parts, the host's last two labels, path
    segments and query names. Digits count as one ``0``, as numbers name single pages."""
    plain = F.regexp_replace(F.coalesce(url, F.lit("")), "[0-9]+", "0")
    host, path = host_of(plain), path_of(plain)
    query = F.regexp_extract(plain, r"(?s)^[^#?]*\?([^#]*)", 1)
    named = lambda mark, items: F.transform(F.filter(items, lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))
    return F.array_distinct(
        F.concat(
            named("s=", F.array(F.regexp_extract(plain, "^([A-Za-z+.-]*)://", 1))), named("l=", F.split(host, r"\.")),
            named("w=", F.split(host, r"[.-]")), named("d=", F.array(F.substring_index(host, ".", -2))), named("p=", F.split(path, "/")),
            named("q=", F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))),
        )
    )


def _told_apart(baskets: DataFrame) -> DataFrame:
    """Tokens (``token``, ``same``) of at least ``MIN_URLS`` baskets (``items``): the least of each set of tokens that are in the
    same baskets, with all of that set. Baskets are known by a hash of their items, sets of them by sizes and sums."""
    held = baskets.select(F.explode("items").alias("token"), F.xxhash64("items").cast("decimal(20,0)").alias("h"))
    sums = held.groupBy("token").agg(F.count("*").alias("n"), F.sum("h").alias("h")).where((F.col("n") >= MIN_URLS) & (F.col("token") != BAD))
    return sums.groupBy("n", "h").agg(F.min("token").alias("token"), F.collect_list("token").alias("same")).select("token", "same")


def mined_rules(urls: DataFrame) -> DataFrame:
    """Rules ``rule_id``, ``tokens``, ``confidence``, ``urls`` from all labelled URLs (``url``, ``bad``).

    FP-growth counts token combinations over the cluster; a rule stays if it has the confidence and the URLs asked
    for, at any number of labelled URLs, and no rule with fewer of its tokens is as confident. Of tokens that are in the same
    URLs one is mined; rules with the others follow from its rules. That bounds the combinations and leaves out no rule.
    """
    items = F.concat(tokens_of(F.col("url")), F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>")))
    baskets = written(urls.where(F.col("bad").isNotNull()).select(F.monotonically_increasing_id().alias("basket"), items.alias("items")), "baskets")
    n = baskets.count()
    names = "rule_id string, tokens array<string>, confidence double, urls bigint"
    if n < MIN_URLS:
        return urls.sparkSession.createDataFrame([], names)
    parts = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    apart = written(_told_apart(baskets), "apart")
    kept = apart.select(F.col("token").alias("item")).unionByName(urls.sparkSession.createDataFrame([(BAD,)], "item string"))
    fewer = baskets.select("basket", F.explode("items").alias("item")).join(small(written(kept, "kept")), "item").groupBy("basket").agg(F.collect_list("item").alias("items"))
    fewer = written(baskets.select("basket").join(fewer, "basket", "left").select(F.coalesce("items", F.array().cast("array<string>")).alias("items")).repartition(parts), "fewer")
    # half a URL less than asked for: the share times the number must not be rounded up past it
    model = FPGrowth(itemsCol="items", numPartitions=parts, minSupport=(MIN_URLS - 0.5) / n, minConfidence=MIN_CONFIDENCE).fit(fewer)
    r = model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD))).where(F.size("antecedent") > 0)
    r = r.select(F.sort_array("antecedent").alias("tokens"), "confidence", F.round(F.col("support") * n).cast("long").alias("urls"))
    r = _least(written(r.where(F.col("urls") >= MIN_URLS).withColumn("rule_id", F.array_join("tokens", " & ")), "rules"))
    others = r.select("rule_id", F.explode("tokens").alias("token")).join(apart, "token").groupBy("rule_id").agg(F.collect_list("same").alias("same"))
    product = lambda a, same: F.flatten(F.transform(a, lambda t: F.transform(same, lambda x: F.concat(t, F.array(x)))))
    every = F.aggregate("same", F.array(F.array().cast("array<string>")), product)
    r = r.drop("tokens").join(others, "rule_id").select(F.explode(every).alias("tokens"), "confidence", "urls").withColumn("tokens", F.sort_array("tokens"))
    return r.select(F.array_join("tokens", " & ").alias("rule_id"), "tokens", "confidence", "urls")


def _least(r: DataFrame) -> DataFrame:
    """The rules of which no rule with fewer of their tokens is as confident."""
    less = r.select(F.explode("tokens").alias("token"), F.col("tokens").alias("part"), F.col("confidence").alias("c"))
    worse = r.select("rule_id", "tokens", "confidence", F.explode("tokens").alias("token")).join(less, "token")
    inside = (F.size("part") < F.size("tokens")) & (F.size(F.array_except("part", "tokens")) == 0) & (F.col("c") >= F.col("confidence"))
    return r.join(worse.where(inside).select("rule_id").distinct(), "rule_id", "left_anti")


def matched(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``page_key`` and ``mined`` (the most confident rule) of the pages (``page_key``, ``url``) that have all of a rule's tokens.

    An inverted index holds each rule under its last token in order; pages meet it by their tokens, then must have the others.
    """
    index = rules.select(F.element_at("tokens", -1).alias("token"), "rule_id", "tokens", "confidence")
    p = pages.select("page_key", tokens_of(F.col("url")).alias("has")).select("page_key", "has", F.explode("has").alias("token"))
    hit = p.join(small(index), "token").where(F.size(F.array_except("tokens", "has")) == 0)
    return hit.groupBy("page_key").agg(F.max_by("rule_id", F.struct("confidence", "rule_id")).alias("mined"))


def judged(pages: DataFrame, rules: Mapping[str, str], labelled: DataFrame) -> DataFrame:
    """Per row of ``pages`` (``page_id``, ``url``): ``host``, ``path``, the listed ``rule`` that fits or null, ``verdict``
    (that rule's; else "block" if a mined rule has all its tokens in the URL, else "allow") and that ``mined`` rule.

    ``labelled`` (``url``, ``bad``) are the URLs to mine. Null URLs, and those without ``://``, have an empty host and
    path and no rule; rows that share an id are judged each; empty tables give no rules and an empty result.
    """
    key = F.xxhash64("url")
    mined = small(written(matched(pages.where(F.col("url").isNotNull()).select(key.alias("page_key"), "url").distinct(), mined_rules(labelled)), "mined"))
    p = pages.select("page_id", "url", key.alias("page_key"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    p = p.join(mined, "page_key", "left").withColumn("listed", listed(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("mined").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return p.select("page_id", "host", "path", F.col("listed.rule").alias("rule"), F.coalesce("listed.verdict", own).alias("verdict"), "mined")
