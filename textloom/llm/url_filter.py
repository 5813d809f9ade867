"""URL filters: a blocked Bloom filter before an exact hash join (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.bloom import bloom, maybe_listed
from textloom.llm.common import UPPER, small

def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, UPPER.lower())


def url_path(url: Column) -> Column:
    """After the host up to ? # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def canonical(listed: DataFrame) -> DataFrame:
    """(key, host, path, action, ruling) of listed hosts and paths: A-Z of hosts lower-cased, outer dots and a leading www. dropped, an empty path is /.

    Rows with null host or action are dropped: they list nothing.
    """
    host = F.regexp_replace(F.translate("host", UPPER, UPPER.lower()), r"^\.+|\.+$", "")
    path = F.when(F.coalesce("path", F.lit("")).startswith("/"), F.col("path")).otherwise(F.concat(F.lit("/"), F.coalesce("path", F.lit(""))))
    plain = F.when(F.col("ruling"), host).otherwise(F.regexp_replace(host, r"^www\.", ""))
    return listed.filter("host is not null and action is not null").select(plain.alias("host"), path.alias("path"), "action", "ruling").select(F.concat("host", "path").alias("key"), "*").distinct()


def judge_urls(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    listed: (host, path, action, ruling).  Rows with ruling are rules: one fits its host and all
    subdomains if the path starts with its own, the longest host and path wins (then the longest host), and its action is
    the verdict.  Without a fitting rule, a page under any other listed host and path is 'block', else 'allow'.

    A page looks up its host and parent domains of as many labels as listed hosts have, with each prefix of its path that has a listed
    length.  The blocked Bloom filter drops keys that are not listed; what passes is joined by
    hash with the list, which removes false positives.  The list is broadcast if its counted
    rows stay under a bound; else Spark shuffles both sides and splits hot keys.

    Null url, or one without ://, has empty host and path and is allowed.  Repeated rows are judged one by one.
    """
    rules = canonical(listed)
    rows = rules.count()
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    depths = sorted(r[0] for r in rules.select(F.size(F.split("host", r"\."))).distinct().collect())
    table, blocks = bloom(rules.select(F.xxhash64("key").alias("key")), rows)
    base = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"), F.monotonically_increasing_id().alias("_row"))
    labels = base.withColumn("_labels", F.split("host", r"\."))
    numbers = lambda x: F.array(*[F.lit(n) for n in x]) if x else F.expr("cast(array() as array<int>)")
    tails = F.transform(F.filter(numbers(depths), lambda n: F.size("_labels") >= n), lambda n: F.array_join(F.slice("_labels", -n, n), "."))
    heads = F.transform(F.filter(numbers(lengths), lambda n: F.length("path") >= n), lambda n: F.substr(F.col("path"), F.lit(1), n))
    keyed = labels.withColumn("_tails", tails).withColumn("_heads", heads)
    all_keys = F.flatten(F.transform("_tails", lambda t: F.transform("_heads", lambda h: F.concat(t, h))))
    passed = keyed.select("page_id", "host", "path", "_row", F.filter(all_keys, lambda k: maybe_listed(F.xxhash64(k), table, blocks)).alias("_keys"))
    probes = passed.select("page_id", "host", "path", "_row", F.explode_outer("_keys").alias("key"))
    exact = rules.select("key", F.col("host").alias("_h"), "action", "ruling")
    met = probes.join(small(exact, rows), "key", "left")
    best = F.max(F.when(F.col("ruling"), F.struct(F.length("key").alias("n"), F.length("_h").alias("m"), F.col("key").alias("rule"), F.col("action").alias("action")))).alias("_best")
    each = met.groupBy("_row", "page_id", "host", "path").agg(best, F.coalesce(F.max(~F.col("ruling")), F.lit(False)).alias("_listed"))
    return each.select("page_id", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.action", F.when(F.col("_listed"), F.lit("block")).otherwise("allow")).alias("verdict"))
