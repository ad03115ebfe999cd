"""Rules over what the tables' own texts hold, where other queries make their cases from row numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import browse as B
from ..sources import readers as R
from . import words  # noqa: F401
from .base import SQL, dealt, query, table

_MAP = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in T.CONTRACTIONS.items()) + "}"
_WORDS = "SELECT DISTINCT unnest(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z]+', ' ', 'g')), ' ')) AS a FROM conversations"
#: What contractions stand for, and the words of it: the partners of a word besides itself.
_LISTED = ", ".join(f"('{x}')" for x in sorted({w for a, b in T.CONTRACTIONS.items() for w in (a, *b.split())}))


@query(f"""WITH w AS ({_WORDS}), v AS (SELECT * FROM (VALUES {_LISTED}) t(b)), p AS (SELECT a, b FROM w, v UNION SELECT a, a FROM w),
x AS (SELECT a, b, {_MAP}[a] AS x, {_MAP}[b] AS y FROM p)
SELECT a, b, a = b OR coalesce(x = b, false) OR coalesce(y = a, false) OR coalesce(x = y, false) OR coalesce(list_contains(string_split(x, ' '), b), false) OR coalesce(list_contains(string_split(y, ' '), a), false) AS same FROM x WHERE a <> ''""")
def words_same(spark: SparkSession, sf: str) -> DataFrame:
    """Every word of the conversations against itself and every word that the contractions know."""
    c = table(spark, sf, "conversations").select(F.explode(F.split(F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+", " ")), " ")).alias("a")).where("a <> ''").distinct()
    listed = sorted({w for a, b in T.CONTRACTIONS.items() for w in (a, *b.split())})
    pairs = c.select("a", F.explode(F.array_distinct(F.concat(F.array("a"), F.array(*map(F.lit, listed))))).alias("b"))
    return pairs.select("a", "b", T.same_word(F.col("a"), F.col("b")).alias("same"))


_SETTING = """SELECT *, CASE WHEN low IN ('true', 'yes', 'on', 'false', 'no', 'off') THEN 'bool' WHEN regexp_matches(bare, '^[0-9]+$') THEN 'int' WHEN regexp_matches(regexp_replace(bare, '^([^.]*)\\.([^.]*.*)$', '\\1\\2'), '^[0-9]+$') THEN 'float' ELSE 'string' END AS kind
FROM (SELECT name, v, lower(v) AS low, regexp_replace(v, '^-+', '') AS bare FROM s)"""


@query(f"""WITH s AS (SELECT 'c' || c_custkey AS name, unnest([c_name, c_acctbal::VARCHAR, (c_nationkey - 5)::VARCHAR, c_mktsegment, CASE WHEN c_acctbal < 0 THEN 'No' ELSE 'ON' END]) AS v FROM customer UNION ALL SELECT 'd' || doc_id, text FROM documents)
SELECT name, kind, CASE WHEN kind = 'bool' THEN low IN ('true', 'yes', 'on') END AS as_bool, CASE WHEN kind = 'int' THEN try_cast(v AS BIGINT) END AS as_long, CASE WHEN kind = 'float' THEN try_cast(v AS DOUBLE) END AS as_double, CASE WHEN kind = 'string' THEN v END AS as_string FROM ({_SETTING})""")
def settings_of_values(spark: SparkSession, sf: str) -> DataFrame:
    """Names, amounts, numbers, words and whole texts read as settings."""
    held = F.array("c_name", F.col("c_acctbal").cast("string"), (F.col("c_nationkey") - 5).cast("string"), "c_mktsegment", F.when(F.col("c_acctbal") < 0, "No").otherwise("ON"))
    c = table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("name"), F.explode(held).alias("v"))
    d = table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), F.col("text").alias("v"))
    return c.unionByName(d).select("name", F.inline(F.array(T.setting(F.col("v")))))


@query("SELECT doc_id, CASE WHEN n_chars % 3 < 2 THEN text END AS genius_id, CASE WHEN n_chars % 3 > 0 THEN source END AS mode FROM documents")
def choices_of_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Choices whose fields are whole texts: quotes, line ends and letters of all kinds go through the JSON."""
    d = table(spark, sf, "documents")
    n = F.col("n_chars") % 3
    body = F.to_json(F.struct(F.when(n < 2, F.col("text")).alias("genius_id"), F.when(n > 0, F.col("source")).alias("mode"), "lang"))
    return d.select("doc_id", R.choice(body).alias("c")).select("doc_id", "c.*")


@query(f"""WITH a AS ({SQL["srt_parse"]}), b AS ({SQL["lyric_lines"]})
SELECT doc_id, cue_no AS line_no, text, trim(regexp_replace(translate(text, '()', ''), '\\s+', ' ', 'g')) AS align_text FROM a WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, line_id, text, align_text FROM b WHERE doc_id % 2 = 1""")
def lyrics_of_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Captions and plain lyrics made of all texts, read by the extension of their files."""
    d = words.srt_songs(spark, sf).join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    even = F.col("doc_id") % 2 == 0
    files = d.select("doc_id", F.concat(F.lit("lyrics/"), F.col("doc_id").cast("string"), F.when(even, ".srt").otherwise(".txt")).alias("path"), F.when(even, F.col("srt")).otherwise(F.col("text")).alias("text"))
    return R.lyrics(dealt(files), ["doc_id"], "path", "text").withColumn("line_no", F.col("line_no").cast("bigint"))


@query("SELECT doc_id FROM documents WHERE substr(strip_accents(lower(text)), 1, 1) = 'e'")
def browse_letter_of_texts(spark: SparkSession, sf: str) -> DataFrame:
    return B.starts_with_letter(dealt(table(spark, sf, "documents").select("doc_id", "text")), "E", "text").select("doc_id")


@query("SELECT page_id, trim(regexp_replace(url, '[<>:\"/\\\\|?*]', '-', 'g')) AS windows, trim(html) AS other FROM pages")
def safe_names_of_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses as file names of Windows, whole pages as names elsewhere."""
    return table(spark, sf, "pages").select("page_id", T.safe_name(F.col("url"), windows=True).alias("windows"), T.safe_name(F.col("html")).alias("other"))


@query("""WITH n AS (SELECT p_partkey, lower(p_name) AS a, lower(lead(p_name) OVER (ORDER BY p_partkey)) AS b, split_part(lower(p_name), ' ', 1) AS c FROM part)
SELECT p_partkey, a <> '' AND coalesce(b, '') <> '' AND (contains(a, coalesce(b, '')) OR contains(coalesce(b, ''), a)) AS next_similar, a <> '' AND c <> '' AS first_similar, contains(a || ' - ' || c, ' - ') AND NOT contains(a, ' - ') AS separated FROM n""")
def names_of_parts(spark: SparkSession, sf: str) -> DataFrame:
    """A name against the next one, and against its own first word."""
    p = table(spark, sf, "part").select("p_partkey", F.lower("p_name").alias("a"))
    following = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b"))
    both = p.join(following, "p_partkey", "left").withColumns({"b": F.coalesce("b", F.lit("")), "c": F.split("a", " ")[0]})
    return both.select("p_partkey", T.similar(F.col("a"), F.col("b")).alias("next_similar"), T.similar(F.col("a"), F.col("c")).alias("first_similar"), (T.has_separator(F.concat("a", F.lit(" - "), "c")) & ~T.has_separator(F.col("a"))).alias("separated"))
