"""URL filters: rules of a host and a path against every URL, by expressions, hash prefixes and digests.

A URL gives one expression for each pair of a suffix of its host (at a dot, the whole host included) and a
prefix of its path (empty, or up to a slash). A rule gives one: its host, and its path up to the last slash. Both
sides meet in an equi-join on the first PREFIX hex digits of the expressions' SHA-256; then the full digest must
agree and the URL's path must start with the rule's whole path. Of the rules that fit a URL the one with the
longest text (host and path) decides; among equally long ones the longer host, then block. A URL that no rule fits
is allowed: a filter list blocks what it names, and nothing else.

Built-in functions throughout. The rules are broadcast if there are at most BROADCAST_RULES of them, which is
counted; more are joined by shuffle, where a URL's expressions are dealt to SALTS tasks for each key, so that a
host with a third of all URLs (or the expression `com/`, which nearly all share) is spread.

Defined results: a null URL, or one without `://`, has an empty host and path and is allowed. Rows that repeat an
id or a URL are judged one by one, rows with a null id too. Expressions longer or deeper than any rule are
never made, so a very long URL costs no more than another. Rules with a null host or path don't count, rules that
are repeated count once, and if they differ in the verdict alone, block wins. Without rules, or URLs, nothing is
blocked, or returned. Other columns are ignored, whatever their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits of the digest that the join compares.
PREFIX = 8
#: At 100 bytes for each, 20 MB.
BROADCAST_RULES = 200_000
#: Tasks for each key, where the rules are joined by shuffle.
SALTS = 16
ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def suffixes(host: Column, most: Column) -> Column:
    """The host's last 1..most labels, and the host itself where it has no more."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), F.least(n, most)), lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))


def directories(path: Column, most: Column) -> Column:
    """The empty prefix, and those up to the first 1..most slashes."""
    steps = F.split(path, "/")
    whole = F.least(F.size(steps) - 1, most)  # what follows the last slash is no directory
    return F.transform(F.sequence(F.lit(0), whole), lambda k: F.when(k > 0, F.concat(F.array_join(F.slice(steps, 1, k), "/"), F.lit("/"))).otherwise(""))


def keyed(rules: DataFrame) -> DataFrame:
    """(key, digest, rule, rule_path, order, verdict, labels, slashes) of rules (host, path, verdict)."""
    host, path = F.translate("host", _UPPER, _LOWER), F.col("path")
    directory = F.regexp_extract(path, r"(?s)^(?:.*/)?", 0)
    digest = F.sha2(F.concat(host, F.lit("\n"), directory), 256)
    known = rules.where(F.col("host").isNotNull() & path.isNotNull()).select(
        digest.alias("digest"), F.concat(host, path).alias("rule"), path.alias("rule_path"), F.col("verdict").alias("rule_verdict"),
        F.length(host).alias("host_length"), F.size(F.split(host, r"\.")).alias("labels"), (F.size(F.split(path, "/")) - 1).alias("slashes"),
    )
    order = F.struct(F.length("rule").alias("n"), "host_length", (F.col("rule_verdict") == BLOCK).cast("int").alias("block"), "rule", F.col("rule_verdict").alias("verdict"))
    return known.select(F.substring("digest", 1, PREFIX).alias("key"), "digest", "rule_path", order.alias("found"), "labels", "slashes")


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """(key, host, path, rule, verdict): one row for each row of pages; rules has (host, path, verdict).

    One row a page is shuffled: a page's expressions are added up where they are made. The driver learns three
    numbers of the rules: how many, and the most labels and slashes of any."""
    known = keyed(rules)
    size = known.agg(F.count(F.lit(1)), F.coalesce(F.max("labels"), F.lit(0)), F.coalesce(F.max("slashes"), F.lit(0))).head()
    host, path = parts(F.col(url))
    own = pages.select(F.col(key).alias("id"), F.monotonically_increasing_id().alias("row"), host.alias("host"), path.alias("path"))
    each = own.select(
        "id", "row", "host", "path", F.explode(suffixes(F.col("host"), F.lit(max(1, size[1])))).alias("suffix")
    ).select("*", F.explode(directories(F.col("path"), F.lit(size[2]))).alias("directory"))
    each = each.withColumn("digest", F.sha2(F.concat("suffix", F.lit("\n"), "directory"), 256)).withColumn("key", F.substring("digest", 1, PREFIX))
    on = ["key"]
    known = known.withColumnRenamed("digest", "full").drop("labels", "slashes")
    if size[0] <= broadcast_rules:
        known = F.broadcast(known)
    else:
        on.append("salt")
        each = each.withColumn("salt", (F.col("row") % SALTS).cast("int"))
        known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    fits = (F.col("full") == F.col("digest")) & F.startswith("path", F.col("rule_path"))
    met = each.join(known, on, "left").select("id", "row", "host", "path", F.when(fits, F.col("found")).alias("found"))
    best = met.groupBy("row").agg(*[F.any_value(c).alias(c) for c in ("id", "host", "path")], F.max("found").alias("found"))
    verdict = F.coalesce("found.verdict", F.lit(ALLOW))
    return best.select(F.col("id").alias(key), "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"))


def rules_of(spark, *rules: tuple[str, str, str]) -> DataFrame:
    """A short list of (verdict, host, path) as a table."""
    rows = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for v, h, p in rules]
    if not rows:
        return spark.createDataFrame([], "host string, path string, verdict string")
    return spark.range(1).select(F.inline(F.array(*rows)))
