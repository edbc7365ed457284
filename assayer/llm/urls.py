"""URL rules: host-suffix and path-prefix expressions of each URL meet the rules by an equi-join on short hash prefixes.

Full digests confirm what the prefixes propose; then the longest rule wins.  Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Hex digits of a digest that are the join key.
PREFIX = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or end, A-Z lower-cased; path: from there up to ?, # or end.  Null or no
    :// gives two empty strings."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (action, host, path) as a table."""
    return spark.createDataFrame(rules, "action string, host string, path string")


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id_col, host, path, rule, verdict) for each row of pages.

    rules: (action, host, path).  A rule fits its host and all subdomains if the path begins with the rule's.  The
    longest fitting rule (host and path together) wins, then the longer host, then block before allow.  Null rules or
    rules without host fit nothing.  No rule: rule null and the default verdict; so for null and empty urls and those
    without ://.  Equal urls are judged once; repeated rows and null ids keep their row.  Further columns are ignored.
    """
    digest = lambda e: F.sha2(e.cast("binary"), 256)
    key = lambda d: F.conv(F.substring(d, 1, PREFIX), 16, 10).cast("long")
    rule_host = F.translate("host", UPPER, LOWER)
    table = rules.where((F.col("host") != "") & F.col("path").isNotNull() & F.col("action").isNotNull())
    table = table.select("action", F.concat(rule_host, "path").alias("rule"), F.length("host").alias("host_chars"), F.length("path").alias("path_chars"),
                         F.size(F.split("host", "\\.", -1)).alias("labels"))
    table = table.withColumn("digest", digest(F.col("rule"))).withColumn("prefix", key(F.col("digest")))
    # which expressions can fit at all: as many distinct path lengths as rules have, at most a URL's length
    shape = table.agg(F.sort_array(F.collect_set("path_chars")).alias("cuts"), F.coalesce(F.max("labels"), F.lit(0)).alias("most")).first()

    pages = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"))
    host, path = host_and_path(F.col("_url"))
    parts = pages.select("_url").where("_url is not null").distinct().select("_url", host.alias("host"), path.alias("path")).where("host <> ''")
    parts = parts.withColumn("labels", F.split("host", "\\.", -1))
    tails = F.transform(F.sequence(F.lit(1), F.least(F.size("labels"), F.lit(shape["most"] or 1))),
                        lambda k: F.array_join(F.slice("labels", -k, k), "."))
    heads = F.array(*[F.when(F.length("path") >= c, F.substring("path", 1, c)) for c in shape["cuts"]]).cast("array<string>")
    tries = F.flatten(F.transform(tails, lambda t: F.transform(F.filter(heads, lambda h: h.isNotNull()), lambda h: F.concat(t, h))))
    asked = parts.select("_url", F.explode(F.transform(tries, lambda e: digest(e))).alias("asked")).withColumn("prefix", key(F.col("asked")))
    hits = asked.join(table, "prefix").where("asked = digest")
    best = hits.groupBy("_url").agg(F.max(F.struct((F.col("host_chars") + F.col("path_chars")).alias("length"), "host_chars",
                                                   (F.col("action") == "block").alias("blocks"), "action", "rule")).alias("best"))
    return pages.join(best, "_url", "left").select(F.col("_id").alias(id_col), host.alias("host"), path.alias("path"),
                                                   F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
