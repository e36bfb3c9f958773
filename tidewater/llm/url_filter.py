"""URL filters by hash-prefix lookup.

A rule is a host, a path and a verdict. It fits a URL whose host is the rule's or a subdomain of it and whose path
starts with the rule's. Every URL is expanded into the host-suffix and path-prefix expressions that a rule could
have; expressions meet rules by a short prefix of their SHA-256, full digests confirm, and the longest rule decides.
Only host depths and path lengths that occur in the rules are expanded, so a URL of any length yields a bounded
number of expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, free_names, fresh, others

#: Production rules: host, path, verdict.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
#: Hex digits of the digest that the join compares first.
SHORT = 8
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """host, path and verdict of the rules, as a relation of constants."""
    each = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules])
    return spark.range(1).select(F.inline(each))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def expressions(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The URL's host suffixes of so many labels, each with its path prefix of so many characters."""
    labels = F.size(F.split(host, r"\."))
    each = [
        F.when(
            (host != "") & (labels >= depth) & (F.length(path) >= length),
            F.concat(F.substring_index(host, ".", -depth), F.substring(path, 1, length)),
        )
        for depth, length in shapes
    ]
    return F.array_compact(F.array(*each)) if each else F.array().cast("array<string>")


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict added.

    A null URL, or one without ``://``, has an empty host and path, no rule and the default verdict. Repeated pages
    are judged alike and all returned. Of rules that fit, the one with most characters wins; of equal ones, block.
    Rules without a host fit nothing; with an empty path they fit every path. Columns host, path, rule and verdict
    of the input are replaced, others stay whatever their names; an empty table gives an empty result.
    """
    rules = rules.where(F.coalesce(F.col("host"), F.lit("")) != "").select(
        F.translate("host", UPPER, LOWER).alias("_host"),
        F.coalesce(F.col("path"), F.lit("")).alias("_path"),
        F.col("verdict").alias("_verdict"),
    )
    shapes = sorted(
        (r[0], r[1])
        for r in rules.select(F.size(F.split("_host", r"\.")).alias("depth"), F.length("_path").alias("length")).distinct().collect()
    )
    keyed = rules.withColumn("_rule", F.concat("_host", "_path")).withColumn("_full", F.sha2("_rule", 256))
    keyed = keyed.select(F.substring("_full", 1, SHORT).alias("_short"), "_full", "_rule", "_verdict")

    own, key, top = free_names(pages.columns, "_url", "_key", "_best")
    host, path = host_of(F.col("_url")), path_of(F.col("_url"))
    urls = pages.select(F.col(url_col).alias("_url")).where(F.col("_url").isNotNull()).distinct()
    asked = urls.select("_url", F.explode(expressions(host, path, shapes)).alias("_expression"))
    asked = asked.select("_url", F.sha2("_expression", 256).alias("_digest"))
    met = asked.join(keyed, F.substring("_digest", 1, SHORT) == F.col("_short")).where(F.col("_digest") == F.col("_full"))
    best = met.groupBy("_url").agg(
        F.max(F.struct(F.length("_rule").alias("n"), (F.col("_verdict") == "block").alias("b"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))).alias("_best")
    )
    best = best.select(fresh("_url").alias(key), F.col("_best").alias(top))

    kept = others(pages.columns, "host", "path", "rule", "verdict")
    rows = pages.select(*kept, F.col(url_col).alias(own)).join(best, F.col(own) == F.col(key), "left")
    return rows.select(
        *kept,
        host_of(F.col(own)).alias("host"),
        path_of(F.col(own)).alias("path"),
        F.col(top)["rule"].alias("rule"),
        F.coalesce(F.col(top)["verdict"], F.lit(default)).alias("verdict"),
    )
