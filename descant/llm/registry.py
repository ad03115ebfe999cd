"""Queries of this subpackage by name, and their SQL for DuckDB where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import codes, decontamination, html, languages, mixing, neardup, paragraphs, periodic, quality, sharding, substrings, urls, warc
from .common import cut, scope, tables

#: The rules of the production filter.
URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def written(result: Callable[[], DataFrame]) -> DataFrame:
    """The result as a table of its own; those that it came from are deleted."""
    with scope() as keep:
        return keep(cut(result()))


def op1_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the documents, those that lose something have n_removed > 0; the others are whole."""
    return written(lambda: paragraphs.dedup(tables(spark, sf_dir, "documents")).drop("spans"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    return urls.judge(tables(spark, sf_dir, "pages"), rules)


def op3_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = written(lambda: neardup.classes(tables(spark, sf_dir, "documents")))
    return found.withColumn("is_kept", F.col("doc_id") == F.col("class_id"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(tables(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_deep_shallow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(tables(spark, sf_dir, "documents")).drop("spans")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "benchmark"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(tables(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")


def op8_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = written(lambda: sharding.shard(tables(spark, sf_dir, "documents"), 16))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(tables(spark, sf_dir, "pages"))
    number = lambda c: F.expr(f"try_cast({c} AS bigint)")
    return found.select(number("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(tables(spark, sf_dir, "pages"))


def periodic_tails(docs: DataFrame) -> DataFrame:
    """With h = crc32(doc_id) and g = h / 10: where h % 10 = 0, the words from a = g % n on become the first
    p = 1 + (n - a) / (3 + g % 8) of them over and over."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g, digit = F.floor(h / 10), h % 10

    def tail(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        new = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, at(i).cast("int")))
        return F.when(n > 0, F.array_join(new, " "))

    words = F.array(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)")))
    return docs.withColumn("text", F.when(digit == 0, F.get(F.transform(words, tail), F.lit(0))).otherwise(F.col("text")))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find(periodic_tails(tables(spark, sf_dir, "documents")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    digest = F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        digest.alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return languages.predict(docs, languages.train(docs.where(~held_out)), keep={"held_out": held_out})


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = codes.compress(tables(spark, sf_dir, "embeddings"))
    return found.withColumn("codebooks_sha256", F.lit(codes.fingerprint(books)))


_OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM m
"""
_OP2_SQL = r"""
WITH rules(rule, verdict) AS (VALUES ('com/en/','block'), ('example.com/en/7','allow'), ('net/de/','allow'), ('example.net/de/8','block'), ('org/es/','block')),
r AS (SELECT rule, verdict, split_part(rule, '/', 1) AS rh, substr(rule, instr(rule, '/')) AS rp FROM rules),
p AS (SELECT page_id, row_number() OVER () AS n,
  CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
  CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM (SELECT page_id, coalesce(url, '') AS url FROM pages)),
m AS (SELECT p.*, rule, verdict, row_number() OVER (PARTITION BY n ORDER BY length(rule) DESC NULLS LAST, length(rh) DESC, verdict DESC) AS k
  FROM p LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""

#: One round: the nearest entry of each part, then the floor of the mean of its parts.
_OP13_ROUND = """
a{r} AS MATERIALIZED (SELECT vec_id, p, min(d)[1] AS error, min(d)[2] AS e FROM (SELECT vec_id, c.p, [list_sum(list_transform(list_zip(t.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, e] AS d FROM parts t JOIN c{r} c ON c.p = t.p) GROUP BY ALL)"""
_OP13_UPDATE = """,
s{r} AS (SELECT p, e, i, sum(v)::BIGINT AS s, count(*)::BIGINT AS n FROM (SELECT a.p, a.e, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{r} a JOIN parts USING (vec_id, p)) GROUP BY ALL),
m{r} AS (SELECT p, e, list((s - (s % n + n) % n) // n ORDER BY i) AS x FROM s{r} GROUP BY ALL),
c{n} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (p, e)),"""
_OP13_SQL = (
    """
WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, p, v[p * (len(v) // 8) + 1 : (p + 1) * (len(v) // 8)] AS x FROM kept, range(8) r(p)),
c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 16)),"""
    + "".join(_OP13_ROUND.format(r=r) + _OP13_UPDATE.format(r=r, n=r + 1) for r in range(codes.ROUNDS))
    + _OP13_ROUND.format(r=codes.ROUNDS)
    + """,
coded AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(error)::BIGINT AS error FROM a6 GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM c6) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_paragraph_minhash, op2_url_filters, op3_bag_minhash, op4_source_mix, op5_deep_shallow, op6_decontamination, op7_quality_rules, op8_kd_shards, op9_warc_round_trip, op10_main_text, op11_periodic_runs, op12_language_id, op13_vector_codes)}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filters": _OP2_SQL, "op9_warc_round_trip": _OP9_SQL, "op13_vector_codes": _OP13_SQL}
