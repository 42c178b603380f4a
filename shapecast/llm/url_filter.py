"""URL filters: prefix rules as intervals over reversed-host keys, matched by one sorted sweep.

A host turned around, with a dot at its end (`www.example.org` -> `org.example.www.`), makes "this host and all its
subdomains" a prefix, and so an interval from `org.example.` to `org.example/` ("/" follows "."). Rule hosts nest or are
disjoint; the rules that hold at a key are those on the stack after the last interval border at or before it. Rows and
borders are sorted together within (first label, salt); a window carries the last border's stack to each row. A rule's path
can't be part of the key, as the labels of subdomains stand between host and path; it is compared with the rules on the stack.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Scratch, partitions, small, written


def _reversed(host):
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _top(key):
    """First label of a key."""
    first = F.substring_index(key, ".", 1)
    return F.when(first == key, F.regexp_replace(key, "/$", "")).otherwise(first)


def borders(rules: DataFrame) -> DataFrame:
    """(key, stack) for each start and end of a rule host's interval; stack: the rules that hold from there on."""
    r = rules.where("host is not null and host <> ''").select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").distinct()
    r = r.select("host", F.struct(F.length(F.concat("host", "path")).alias("len"), F.concat("host", "path").alias("rule"), "verdict", "path").alias("r"))
    by_host = r.groupBy("host").agg(F.collect_set("r").alias("own"))
    labels = F.split("host", r"\.")
    up = by_host.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(i.alias("at"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("anc")))).alias("x")).select("host", "x.*")
    held = up.join(by_host.select(F.col("host").alias("anc"), "own"), "anc")
    both = held.groupBy("host").agg(F.flatten(F.collect_list("own")).alias("at_start"), F.flatten(F.collect_list(F.when(F.col("at") > 1, F.col("own")))).alias("at_end"))
    start = both.select(_reversed(F.col("host")).alias("key"), F.col("at_start").alias("stack"))
    end = both.select(F.regexp_replace(_reversed(F.col("host")), r"\.$", "/").alias("key"), F.col("at_end").alias("stack"))
    return start.union(end)


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", salts: int | None = None) -> DataFrame:
    """One row per page: id, host, path, rule, verdict.

    rules: (host, path, verdict). A rule fits its host and all subdomains if the path starts with the rule's; the longest
    fitting rule decides, at equal length and text `block`. Rules with a null or empty host are left out; a null path
    counts as empty. A null url, or one without ://, has empty host and path and gets the default verdict. Repeated rows
    stay repeated. Other columns are not looked at.

    A first label with more than a task's share of the pages is split by a hash into so many salts that each part has about
    a share; only the rules under such a label are copied, once per salt. `salts` overrides the number for all labels.
    """
    spark = pages.sparkSession
    url = F.coalesce(F.col(url_col), F.lit(""))
    p = pages.select(F.col(id_col).alias("id"), F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER).alias("host"), F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1).alias("path"))
    p = p.withColumn("key", _reversed(F.col("host"))).withColumn("top", _top(F.col("key")))
    if salts is None:
        shares = Scratch()
        n = shares(p.groupBy("top").agg(F.count("*").alias("n")), "labels")
        share = F.lit(max(1, (n.agg(F.sum("n")).first()[0] or 0) // partitions(spark)))
        split = small(written(n.where(F.col("n") > share).select("top", F.ceil(F.col("n") / share).cast("int").alias("salts")), "hot"))
        shares.clear()
    else:
        split = F.broadcast(p.select("top").limit(0).withColumn("salts", F.lit(1)))
    parts = F.coalesce("salts", F.lit(salts or 1))
    p = p.join(split, "top", "left").withColumn("salt", F.pmod(F.xxhash64("id", "host", "path"), parts).cast("int")).drop("salts")
    b = borders(rules).withColumn("top", _top(F.col("key"))).join(split, "top", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("salts")
    rows = p.withColumn("url_row", F.lit(1)).unionByName(b.withColumn("url_row", F.lit(0)), allowMissingColumns=True)
    w = W.partitionBy("top", "salt").orderBy("key", "url_row").rowsBetween(W.unboundedPreceding, 0)
    swept = rows.withColumn("active", F.last("stack", ignorenulls=True).over(w)).where("url_row = 1")
    best = F.array_max(F.filter("active", lambda r: F.startswith(F.col("path"), r["path"])))
    return swept.select(F.col("id").alias(id_col), "host", "path", best.alias("b")).select(id_col, "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"))
