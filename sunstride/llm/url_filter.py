"""URL rules by hashed expressions, in DataFrame operations only.

A URL is expanded into one expression for each host suffix and each path prefix that some rule could have; expressions
meet rules by the first bytes of their SHA-256, then by the whole digest, and the longest rule decides.

Defined results: a null URL, or one without ``://``, has an empty host and path and fits no rule; an empty path fits
only rules with an empty path; a very long URL is expanded by as many suffixes and prefixes as rules have lengths; repeated URLs each get their row; an empty table gives an empty result; other columns
are kept untouched, but for those named host, path, rule and verdict, which the result replaces. Of rules with equal host and path, and of equally long ones, ``block`` wins.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import free, join_groups

#: Rules as a table of so many rows at most are broadcast; larger ones are joined by shuffling.
BROADCAST_RULES = 20_000
_HEX = 8  # characters of the digest that the equi-join uses


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z in lower case; else empty."""
    rest = _after(url)
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?`` or ``#``; else empty."""
    return F.regexp_extract(F.regexp_replace(_after(url), r"^[^/?#]*", ""), r"^[^?#]*", 0)


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """Rules given as (verdict, host, path)."""
    return spark.createDataFrame([(v, h.lower(), p) for v, h, p in rules], "verdict string, rule_host string, rule_path string")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = "allow") -> DataFrame:
    """``pages`` plus host, path, rule (host and path of the rule that decides, else null) and verdict."""
    made = [c for c in ("host", "path", "rule", "verdict") if c in pages.columns and c != url]
    parsed = pages.drop(*made).withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    listed = (
        rules.groupBy("rule_host", "rule_path").agg(F.max(F.col("verdict") == "block").alias("blocks"))
        .withColumn("digest", _digest(F.col("rule_host"), F.col("rule_path")))
        .withColumn("short", F.substring("digest", 1, _HEX))
    )
    # lengths of rule paths and labels of rule hosts: as many as there are different ones, which URL syntax bounds, not the number of rules
    lengths, sizes = (sorted(r[0] for r in listed.select(x).distinct().collect()) for x in (F.length("rule_path"), F.size(F.split("rule_host", r"\."))))
    if not lengths:
        return parsed.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(otherwise)})
    few = listed.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES

    # one expansion for each different (host, path): a URL that a third of all rows repeat is expanded once
    key, many, found_rule, found_verdict = free(parsed, "key", "many", "found_rule", "found_verdict")
    rows = parsed.where("host <> ''").withColumn(key, F.concat("host", F.lit("\n"), "path"))
    parts = rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias(many))
    labels = F.split("host", r"\.")
    fits = lambda values, size: F.filter(F.array(*map(F.lit, values)), lambda n: n <= size)
    suffixes = F.transform(fits(sizes, F.size(labels)), lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    prefixes = F.transform(fits(lengths, F.length("path")), lambda n: F.expr("path").substr(F.lit(1), n))
    expanded = (
        parts.withColumn("of_host", F.explode(suffixes)).withColumn("of_path", F.explode(prefixes))
        .withColumn("found", _digest(F.col("of_host"), F.col("of_path")))
        .withColumn("found_short", F.substring("found", 1, _HEX))
    )
    listed = F.broadcast(listed) if few else listed
    met = expanded.join(listed, F.col("found_short") == F.col("short")).where(
        (F.col("found") == F.col("digest")) & (F.col("of_host") == F.col("rule_host")) & (F.col("of_path") == F.col("rule_path"))
    )
    rule = F.concat("rule_host", "rule_path")
    won = met.groupBy("host", "path").agg(F.max(F.struct(F.length(rule).alias("long"), F.col("blocks"), rule.alias("rule"))).alias("won"))
    won = won.select(F.concat("host", F.lit("\n"), "path").alias(key), F.col("won.rule").alias(found_rule), F.when(F.col("won.blocks"), "block").otherwise("allow").alias(found_verdict))
    judged = parts.select(F.concat("host", F.lit("\n"), "path").alias(key), many).join(won, key, "left").withColumn(found_verdict, F.coalesce(found_verdict, F.lit(otherwise)))
    # rows of an often repeated URL are dealt over tasks; those without a host go past the join
    out = join_groups(rows, key, F.monotonically_increasing_id(), judged, many)
    past = parsed.where("host = ''").withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(otherwise)})
    return out.withColumns({"rule": F.col(found_rule), "verdict": F.col(found_verdict)}).select(*past.columns).unionByName(past)
