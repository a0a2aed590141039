"""URL filters: listed rules, and association rules mined from labelled URLs."""

from __future__ import annotations

import re

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.llm.batches import materialize

# Verdict, host, path.
LISTED = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
MIN_SUPPORT = 0.02
MIN_CONFIDENCE = 0.9

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without one."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """Behind the host, up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed_rule(host: Column, path: Column, rules: tuple = LISTED) -> Column:
    """struct(rule, verdict) of the longest listed rule that fits, or null."""
    longest_first = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [
        F.when(
            ((host == h) | host.endswith("." + h)) & path.startswith(p),
            F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for v, h, p in longest_first
    ]
    return F.coalesce(*fits, F.lit(None).cast("struct<rule:string,verdict:string>"))


def url_tokens(url: Column) -> Column:
    """The set of tokens of a URL: scheme, host labels, path words, ending, query names, fragment.

    Numbers in a path are one token, whatever their digits.
    """
    host, path = host_of(url), path_of(url)
    scheme = F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))
    words = F.filter(F.split(path, "/"), lambda w: w != "")
    named = F.transform(words, lambda w: F.concat(F.lit("path "), F.regexp_replace(w, r"\d+", "0")))
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    names = F.filter(F.transform(F.split(query, "&"), lambda q: F.regexp_extract(q, r"(?s)^([^=]*)", 1)), lambda q: q != "")
    tokens = F.concat(
        F.when(scheme != "", F.array(F.concat(F.lit("scheme "), scheme))).otherwise(F.array().cast("array<string>")),
        F.transform(F.filter(F.split(host, r"\."), lambda w: w != ""), lambda w: F.concat(F.lit("host "), w)),
        named,
        F.transform(names, lambda q: F.concat(F.lit("query "), q)),
        F.when(F.contains(url, F.lit("#")), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
    )
    return F.array_sort(F.array_distinct(F.coalesce(tokens, F.array().cast("array<string>"))))


def list_tokens(rules: tuple = LISTED) -> list[str]:
    """The tokens that the listed rules' own conditions are made of."""
    hosts = [f"host {label}" for _, host, _ in rules for label in host.split(".")]
    words = [f"path {re.sub(r'[0-9]+', '0', word)}" for _, _, path in rules for word in path.split("/") if word]
    return sorted({*hosts, *words})


def mine_rules(
    labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE
) -> DataFrame:
    """(tokens, verdict, support, confidence): what token combinations say about a URL.

    `labelled` (tokens, verdict) is mined by FP-growth with the verdict as one
    more item, so a set's support with and without it gives the confidence.
    Rows with a null verdict have no such item: they count in the supports that
    a confidence is divided by, so a rule isn't sure of what it never saw
    decided.  Support counts rows; a rule is dropped when a shorter one with the
    same verdict, whose tokens it holds, is as sure.  Without a verdict there is
    no rule.
    """
    mark = "verdict "
    spark = labelled.sparkSession
    said = F.when(F.col("verdict").isNotNull(), F.array(F.concat(F.lit(mark), "verdict")))
    baskets = labelled.select(F.concat("tokens", F.coalesce(said, F.array().cast("array<string>"))).alias("items"))
    if labelled.where("verdict is not null").isEmpty():
        return spark.createDataFrame([], "tokens array<string>, verdict string, support bigint, confidence double")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=1.0, numPartitions=width).fit(baskets)
    sets = materialize(
        model.freqItemsets.select(
            F.array_sort(F.filter("items", lambda t: ~t.startswith(mark))).alias("tokens"),
            F.substr(F.get(F.filter("items", lambda t: t.startswith(mark)), F.lit(0)), F.lit(len(mark) + 1)).alias("verdict"),
            F.col("freq").alias("support"),
        ).where(F.size("tokens") > 0)
    )
    whole = sets.where("verdict is null").select("tokens", F.col("support").alias("all"))
    rules = materialize(
        sets.where("verdict is not null")
        .join(whole, "tokens")
        .select("tokens", "verdict", "support", (F.col("support") / F.col("all")).alias("confidence"))
        .where(F.col("confidence") >= min_confidence)
    )
    # each shorter rule is found under one of its tokens
    shorter = rules.select(
        F.get("tokens", F.lit(0)).alias("token"),
        F.col("tokens").alias("less"),
        "verdict",
        F.col("confidence").alias("sure"),
    )
    covered = (
        rules.select("tokens", "verdict", "confidence", F.explode("tokens").alias("token"))
        .join(shorter, ["token", "verdict"])
        .where(
            (F.size("less") < F.size("tokens"))
            & (F.size(F.array_except("less", "tokens")) == 0)
            & (F.col("sure") >= F.col("confidence"))
        )
        .select("tokens", "verdict")
        .distinct()
    )
    return rules.join(covered, ["tokens", "verdict"], "left_anti")


def match_rules(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, mined): the surest rule's verdict for each distinct token set that one fits.

    The inverted index holds a rule under its rarest token, so a set meets only
    rules that it shares that token with; then all tokens are compared.  Ties
    go to larger support, longer rules, and `allow`.
    """
    spread = rules.select(F.explode("tokens").alias("token")).groupBy("token").count()
    keyed = (
        rules.withColumn("token", F.explode("tokens"))
        .join(spread, "token")
        .groupBy("tokens", "verdict", "support", "confidence")
        .agg(F.min_by("token", F.struct("count", "token")).alias("token"))
    )
    index = keyed.select("token", F.col("tokens").alias("needs"), "verdict", "support", "confidence")
    rank = F.struct("confidence", "support", F.size("needs"), (F.col("verdict") == "allow").cast("int"))
    return (
        sets.select("tokens", F.explode("tokens").alias("token"))
        .join(index, "token")
        .where(F.size(F.array_except("needs", "tokens")) == 0)
        .groupBy("tokens")
        .agg(F.max_by("verdict", rank).alias("mined"))
    )


def judge_urls(
    pages: DataFrame,
    rules: tuple = LISTED,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """(id, host, path, rule, verdict) for every page.

    URLs that a listed rule fits have its verdict and are the labels: mined
    rules carry what they have in common to the others, which count as undecided
    in support and confidence.  Tokens of the listed rules' own conditions are
    left out, since a rule of them says again what the list says.  URLs are
    reduced to tokens that occur in some mined rule, so the rules are matched
    once for each combination of such tokens.  Without a mined rule that fits, a
    URL is allowed.  A null URL, or one without ://, has an empty host and path;
    repeated rows count as often as they come.
    """
    url = pages[url_col]
    own = F.array(*map(F.lit, list_tokens(rules))) if rules else F.array().cast("array<string>")
    rows = pages.select(
        pages[id_col].alias("id"),
        host_of(url).alias("host"),
        path_of(url).alias("path"),
        F.array_except(url_tokens(url), own).alias("tokens"),
    ).withColumn("listed", listed_rule(F.col("host"), F.col("path"), rules))
    found = materialize(
        mine_rules(
            rows.select("tokens", F.col("listed.verdict").alias("verdict")),
            min_support,
            min_confidence,
        )
    )
    # every token of a rule has the least support, so these are few
    told = [r.token for r in found.select(F.explode("tokens").alias("token")).distinct().orderBy("token").collect()]
    kept = F.array(*map(F.lit, told)) if told else F.array().cast("array<string>")
    open_ = rows.where("listed is null").withColumn("tokens", F.array_intersect("tokens", kept))
    judged = match_rules(open_.select("tokens").distinct(), found)
    rest = open_.join(judged, "tokens", "left").select(
        "id", "host", "path", F.lit(None).cast("string").alias("rule"), F.coalesce("mined", F.lit("allow")).alias("verdict")
    )
    ruled = rows.where("listed is not null").select("id", "host", "path", "listed.rule", "listed.verdict")
    return ruled.unionByName(rest).withColumnRenamed("id", id_col)
