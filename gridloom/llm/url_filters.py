"""URL filters: expressions of host suffixes and path prefixes, met with the rules by short hash prefixes and confirmed by whole digests.

A rule (host, path, verdict) fits a URL whose host is the rule's or a subdomain of it and whose path starts with the rule's; of the
rules that fit, the longest text of host and path decides, then the longer host, and of rules with the same text block. Each URL is
expanded only into expressions of lengths that some rule has, the path prefixes by length of host suffix, so the number of expressions
a URL does not grow with the number of rules. Expressions meet the rules by the first eight hex digits of their
SHA-256, and what meets is kept where the whole digests agree. A URL that no rule fits gets the default verdict.

The lengths are the one thing the driver holds: at most a pair for each host length and path length in use. Equal URLs are judged once,
and a common URL goes back to its rows by a join whose hot side adaptive execution splits. The table of rules is broadcast by Spark
where its estimated size is under spark.sql.autoBroadcastJoinThreshold, and joined by a shuffle beyond.

Defined results: a null URL, an empty one and one without :// have empty host and path and fit no rule of a host; texts of any length
are judged whole; repeated rows each give a row; an empty table gives no rows, and no rules give the default everywhere; rules with a
null in any column fit nothing; only the named columns are read, so further columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits by which expressions and rules meet.
SHORT = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: behind the first :// up to /, ?, # or the end, A-Z lower-cased; path: from there up to ?, # or the end."""
    found = F.instr(url, F.lit("://"))
    rest = F.when(found > 0, F.substring(url, found + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def prepared_rules(rules: DataFrame) -> DataFrame:
    """A row a text of a rule: rule, verdict, host_size, path_size, digest, short. Rules that no URL can fit are left out."""
    own = rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), F.col("path").alias("path"), F.col("verdict").alias("verdict")).dropna()
    can = ~F.col("host").rlike("[/?#]") & ~F.col("path").rlike("[?#]") & (F.col("path").startswith("/") | (F.col("path") == ""))
    own = own.where(can).groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block is after allow
    text = F.concat("host", "path")
    return own.select(text.alias("rule"), "verdict", F.length("host").alias("host_size"), F.length("path").alias("path_size"), F.sha2(text, 256).alias("digest")).withColumn("short", F.substring("digest", 1, SHORT))


def expressions(urls: DataFrame, sizes: dict[int, list[int]]) -> DataFrame:
    """urls (host, path and more) with expression: every host suffix at a dot and path prefix whose lengths sizes has."""
    host, path = F.col("host"), F.col("path")

    def of_suffix(h: int, paths: list[int]) -> Column:
        fits = (F.length(host) == h) | ((F.length(host) > h) & (F.substring(host, F.length(host) - h, F.lit(1)) == "."))
        suffix = F.substring(host, F.length(host) - h + 1, F.lit(h))
        reached = F.filter(F.array(*[F.lit(p) for p in paths]), lambda p: p <= F.length(path))
        return F.when(fits, F.transform(reached, lambda p: F.concat(suffix, F.substring(path, F.lit(1), p))))

    found = F.array(*[of_suffix(h, paths) for h, paths in sorted(sizes.items())])
    return urls.withColumn("expression", F.explode(F.flatten(F.filter(found, lambda x: x.isNotNull()))))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (null if none fits), verdict: a row for each row of pages (page_id, url)."""
    ready = prepared_rules(rules)
    pairs = ready.select("host_size", "path_size").distinct().collect()
    sizes: dict[int, list[int]] = {}
    for h, p in sorted((x.host_size, x.path_size) for x in pairs):
        sizes.setdefault(h, []).append(p)
    own = pages.select(F.col("page_id"), F.col("url"))
    urls = own.select("url").where("url IS NOT NULL").distinct()
    host, path = host_and_path(F.col("url"))
    urls = urls.withColumn("host", host).withColumn("path", path)
    if sizes:
        asked = expressions(urls, sizes).select("url", F.sha2("expression", 256).alias("asked"))
        met = asked.withColumn("short", F.substring("asked", 1, SHORT)).join(ready, "short").where("asked = digest")
        best = met.groupBy("url").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.col("host_size") + F.col("path_size"), F.col("host_size"))).alias("best"))
        own = own.join(best, "url", "left")
    else:
        own = own.withColumn("best", F.lit(None).cast("struct<rule:string,verdict:string>"))
    host, path = host_and_path(F.coalesce("url", F.lit("")))
    return own.select("page_id", host.alias("host"), path.alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
