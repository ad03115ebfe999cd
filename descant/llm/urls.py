"""URL filters by hashed host-suffix and path-prefix expressions (DataFrame functions only).

Each URL is expanded into every (host suffix, path prefix) expression: the suffixes are the whole host
and what follows each of its dots, the prefixes have the lengths that paths of rules have. An
expression's SHA-256 is compared with the rules' in two steps: an equi-join on the first 4 bytes finds
candidates, then the full digests must agree. The longest rule wins; among equal lengths the longer
host, then `block`. Without a rule the verdict is `allow`.

The rules' side of the join has a row per rule: Spark broadcasts it while its size is under the
session's broadcast limit, and joins by sorted hash prefixes beyond it. Expressions are grouped by
(id, host, path) right where they are made, so one row per distinct page is shuffled and a hot host
or a hot rule has no task of its own.

Edge cases: a null url or one without `://` has empty host and path, which no rule fits; null rules
are ignored; repeated pages give as many rows; other columns of either table are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

DEFAULT_VERDICT = "allow"
PREFIX_HEX = 8  # 4 bytes


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)  # empty without a match
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.when(url.contains("://"), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise("")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def rule_table(rules: DataFrame) -> DataFrame:
    """rules (rule, verdict), a rule being host/path: one row per rule with its digest and rank; of
    equal rules with different verdicts `block` holds."""
    host = F.translate(F.substring_index("rule", "/", 1), string.ascii_uppercase, string.ascii_lowercase)
    path = F.expr("substr(rule, instr(rule, '/'))")
    return (
        rules.where(F.col("rule").contains("/") & F.col("verdict").isin("allow", "block"))
        .select("rule", "verdict", host.alias("rule_host"), path.alias("rule_path"))
        .groupBy("rule_host", "rule_path")
        .agg(F.max("verdict").alias("verdict"), F.min("rule").alias("rule"))
        .withColumn("digest", _digest(F.col("rule_host"), F.col("rule_path")))
        .withColumn("short", F.substring("digest", 1, PREFIX_HEX))
        .withColumn("best", F.struct(F.length("rule").alias("n"), F.length("rule_host").alias("h"), "verdict", "rule"))
    )


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", lengths: list[int] | None = None) -> DataFrame:
    """(id_col, host, path, rule, verdict) per row of pages. lengths: the path lengths that rules
    have; read from the rules if not given (one row per distinct length)."""
    table = rule_table(rules)
    if lengths is None:
        lengths = sorted(r[0] for r in table.select(F.length("rule_path")).distinct().collect())
    url = F.col("__url")
    plain = pages.select(F.col(id_col).alias("__id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("__url"))
    parsed = plain.select("__id", host_of(url).alias("host"), path_of(url).alias("path"))
    dots = F.split("host", r"\.")
    n = F.size(dots)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat_ws(".", F.slice(dots, i, n)))
    # an expression only where the path is long enough; the first one of a row also counts its copies
    prefixes = F.filter(F.array(*(F.when(F.length("path") >= k, F.substring("path", 1, k)) for k in lengths)), lambda p: p.isNotNull()) if lengths else F.array().cast("array<string>")
    pairs = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.sha2(F.concat(h, F.lit("\n"), p), 256))))
    # a leading null keeps rows that have no expression, and counts the copies of a row
    expanded = parsed.select("__id", "host", "path", F.explode(F.concat(F.array(F.lit(None).cast("string")), pairs)).alias("expression"))
    joined = expanded.withColumn("short", F.substring("expression", 1, PREFIX_HEX)).join(table.select("short", "digest", "best"), "short", "left")
    found = joined.groupBy("__id", "host", "path").agg(
        F.count_if(F.col("expression").isNull()).alias("copies"),
        F.max(F.when(F.col("expression") == F.col("digest"), F.col("best"))).alias("best"),
    )
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        F.col("__id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(DEFAULT_VERDICT)).alias("verdict")
    )
