"""Timing queries. A conversation stands for a song, its turns for lyric lines; users' events for cues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..operators import render as R, songs as S
from ..operators.ranks import medians
from .base import query, table


def songs(spark: SparkSession, sf: str) -> DataFrame:
    """One row per conversation: the sentences of its turns as lines, words aligned 0.6 s apart, and heard words
    with gaps: every seventh is missing, and from the fourth line on they come 4 s later than aligned."""
    sentences = F.split(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")), r"(?<=[.!?]) ")
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("song"), "turn", sentences.alias("said"))
    t = S.dealt(turns, "song").groupBy("song").agg(F.array_sort(F.collect_list(F.struct("turn", "said"))).alias("ls")).select("song", F.flatten("ls.said").alias("lines"))
    t = t.withColumn("flat", F.flatten(F.transform("lines", lambda line, i: F.transform(F.filter(F.split(line, " "), lambda w: w.rlike(r"[\p{L}\p{N}_]")), lambda w: F.struct(w.alias("word"), i.alias("line"))))))
    timed = lambda extra: F.transform("flat", lambda x, i: F.struct(x["word"].alias("word"), (i * 0.6 + extra(x)).alias("start"), (i * 0.6 + 0.5 + extra(x)).alias("end"), i.alias("i")))
    aligned = F.transform(timed(lambda x: F.lit(0.0)), lambda w: w.dropFields("i"))
    heard = F.transform(F.filter(timed(lambda x: F.when(x["line"] >= 3, 4.05).otherwise(0.05)), lambda w: w["i"] % 7 != 6), lambda w: w.dropFields("i"))
    cues = F.transform("lines", lambda line, i: F.struct(i.alias("line_id"), (i * 4.0 + F.when(i % 5 == 4, 30.0).otherwise(1.5)).alias("start"), (i * 4.0 + 5.0).alias("end")))
    return t.select("song", "lines", F.col("lines").alias("align_lines"), aligned.alias("aligned"), heard.alias("heard"), cues.alias("cues"), (F.size("flat") * 0.6 + 5.0).alias("duration"))


@query()
def joint(spark: SparkSession, sf: str) -> DataFrame:
    return S.joint(songs(spark, sf), keep=["song"]).select("song", *S.STATS, F.col("placed.source").alias("sources"))


@query()
def repair(spark: SparkSession, sf: str) -> DataFrame:
    return S.repaired(songs(spark, sf)).select("song", "n_anchors", "n_suspects", "n_spans", "n_replayed", F.col("placed.source").alias("sources"))


@query()
def timing_prior(spark: SparkSession, sf: str) -> DataFrame:
    return S.with_prior(songs(spark, sf)).select("song", "n_fit", "bailed", "offset", "spread", "snapped", "filled")


@query()
def global_align(spark: SparkSession, sf: str) -> DataFrame:
    low = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_ ]", "")
    n = songs(spark, sf).select("song", "cues", F.transform("lines", low).alias("sheet"))
    n = n.withColumn("cue_lines", F.filter(F.transform("sheet", lambda x, i: F.when(i % 4 != 3, F.regexp_replace(x, "e$", ""))), lambda x: x.isNotNull()))
    return S.mapped(n).select("song", F.inline("pairs"))


@query()
def render_script(spark: SparkSession, sf: str) -> DataFrame:
    placed = S.joint(songs(spark, sf), keep=["song"]).select("song", F.inline_outer("placed")).where("line_id is not null")
    return R.karaoke_script(placed, "song")


@query()
def bundle_summary(spark: SparkSession, sf: str) -> DataFrame:
    placed = S.joint(songs(spark, sf), keep=["song"]).select("song", "placed")
    return placed.select("song", S.summary(F.col("placed")).alias("s")).select("song", "s.*", R.bundle({"summary": F.col("s")}).alias("bundle"))


# pairs, windows and chains


def _lockstep_sql(ahead_left: int, ahead_right: int, confirm: int, budget: int, then_select: str = "") -> str:
    """One step a row: a pair, a jump to one, a right token passed over, or a left one given up."""
    then = " AND ".join([f"(i + di + {c} >= nl OR j + dj + {c} >= nr OR l[i + di + {c} + 1] = r[j + dj + {c} + 1])" for c in range(1, confirm)] or ["true"])
    return f"""WITH RECURSIVE w AS (SELECT conv_id, turn, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' '), lambda x: x <> '') AS l FROM conversations),
b AS (SELECT conv_id, turn, l, len(l) AS nl, r, len(r) AS nr FROM (SELECT *, flatten(list_transform(l, lambda x, k: CASE WHEN k % 6 = 5 THEN [] WHEN k % 9 = 4 THEN ['zz', x, 'zz'] ELSE [x] END)) AS r FROM (SELECT conv_id, turn, list_transform(l, lambda x: 'q' || x) AS l FROM w))),
s AS (SELECT conv_id, turn, 0::BIGINT AS i, 0::BIGINT AS j, 0::BIGINT AS passed, NULL::BIGINT AS a, NULL::BIGINT AS c FROM b
UNION ALL SELECT conv_id, turn, CASE WHEN hit IS NOT NULL THEN i + hit[2] + 1 WHEN passed + 1 >= {budget} THEN i + 1 ELSE i END, CASE WHEN hit IS NOT NULL THEN j + hit[3] + 1 ELSE j + 1 END, CASE WHEN hit IS NOT NULL OR passed + 1 >= {budget} THEN 0 ELSE passed + 1 END, i + hit[2], j + hit[3]
FROM (SELECT s.*, CASE WHEN l[i + 1] = r[j + 1] THEN [0, 0, 0] ELSE list_min(flatten(list_transform(range(least({ahead_left + 1}, nl - i)), lambda di: list_transform(list_filter(range(least({ahead_right + 1}, nr - j)), lambda dj: di + dj > 0 AND l[i + di + 1] = r[j + dj + 1] AND {then}), lambda dj: [di + dj, di, dj])))) END AS hit
  FROM s JOIN b USING (conv_id, turn) WHERE i < nl AND j < nr))""" + (then_select or """
SELECT conv_id, turn, a AS "left", c AS "right" FROM s WHERE a IS NOT NULL""")


def _told_twice(spark: SparkSession, sf: str) -> DataFrame:
    """A turn's tokens, and the same with some left out and some put in."""
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}_]+", " "), " "), lambda x: x != "")
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.transform(words, lambda x: F.concat(F.lit("q"), x)).alias("left"))
    other = lambda x, k: F.when(k % 6 == 5, F.array().cast("array<string>")).when(k % 9 == 4, F.array(F.lit("zz"), x, F.lit("zz"))).otherwise(F.array(x))
    return c.withColumn("right", F.flatten(F.transform("left", lambda x, k: other(x, k + 1))))


def _pairs(spark: SparkSession, sf: str, **options: int) -> DataFrame:
    found = S.paired(_told_twice(spark, sf), ["conv_id", "turn"], **options)
    out = found.select("conv_id", "turn", F.posexplode("pairs").alias("left", "right")).where(F.col("right").isNotNull())
    return out.select("conv_id", "turn", F.col("left").cast("bigint").alias("left"), F.col("right").cast("bigint").alias("right"))


@query(_lockstep_sql(3, 10, 2, 10))
def lockstep_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf)


@query(_lockstep_sql(3, 3, 1, 1))
def lockstep_window(spark: SparkSession, sf: str) -> DataFrame:
    """As inside a window of the placement."""
    return _pairs(spark, sf, ahead_left=3, ahead_right=3, confirm=1, budget=1)


_TIMES = """, m AS (SELECT conv_id, turn, nl, nr, unnest(range(nl)) AS i FROM b), o AS (SELECT m.*, s.c, CASE WHEN s.c IS NOT NULL THEN m.i END AS own FROM m LEFT JOIN (SELECT conv_id, turn, a, c FROM s WHERE a IS NOT NULL) s ON s.conv_id = m.conv_id AND s.turn = m.turn AND s.a = m.i),
n AS (SELECT *, max(own) OVER p AS prev, min(own) OVER f AS nxt, last_value(c IGNORE NULLS) OVER p AS pc, first_value(c IGNORE NULLS) OVER f AS nc FROM o
  WINDOW p AS (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
g AS (SELECT *, coalesce(pc * 0.5::DOUBLE + 0.25::DOUBLE, 0.0) AS lo, greatest(coalesce(pc * 0.5::DOUBLE + 0.25::DOUBLE, 0.0), coalesce(nc * 0.5::DOUBLE, (nr - 1) * 0.5::DOUBLE + 0.25::DOUBLE)) AS hi FROM n),
k AS (SELECT *, (hi - lo) / (coalesce(nxt, nl) - coalesce(prev, -1) - 1) AS slot, i - coalesce(prev, -1) - 1 AS at_ FROM g)
SELECT conv_id, turn, i AS "left", CASE WHEN c IS NOT NULL THEN c * 0.5::DOUBLE ELSE lo + at_ * slot END AS start, CASE WHEN c IS NOT NULL THEN c * 0.5::DOUBLE + 0.25::DOUBLE ELSE lo + (at_ + 1) * slot END AS "end" FROM k"""


@query(_lockstep_sql(3, 3, 1, 1, _TIMES))
def window_words(spark: SparkSession, sf: str) -> DataFrame:
    """The times of a turn's words: their partner's, or an even share of the gap between their neighbours'."""
    found = S.paired(_told_twice(spark, sf), ahead_left=3, ahead_right=3, confirm=1, budget=1)
    at = F.transform("right", lambda w, j: F.struct((j * 0.5).alias("start"), (j * 0.5 + 0.25).alias("end")))
    words = S.window_words(found.withColumn("right_at", at), ["conv_id", "turn"]).select("conv_id", "turn", F.posexplode("words").alias("left", "w"))
    return words.select("conv_id", "turn", F.col("left").cast("bigint").alias("left"), "w.start", "w.end")


_SAID = r"""s AS (SELECT conv_id, turn, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT conv_id, turn, string_split(regexp_replace(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), '([.!?]) ', '\1' || chr(10), 'g'), chr(10)) AS ls FROM conversations)),
l AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1 AS line_id, list_filter(string_split(regexp_replace(lower(line), '[^\p{L}\p{N}_ ]', '', 'g'), ' '), lambda x: x <> '') AS ws FROM s),
h AS (SELECT conv_id, list_transform(list_filter(list_zip(ws, range(0, len(ws)::BIGINT)), lambda x: x[2] % 5 <> 4), lambda x: x[1]) AS hs FROM (SELECT conv_id, flatten(list(ws ORDER BY line_id)) AS ws FROM l GROUP BY 1)),
e AS (SELECT l.conv_id, line_id, len(ws) AS n, len(hs) AS m, array_to_string(list_transform(ws, lambda x: chr((32 + list_position(ws, x))::INTEGER)), '') AS a, array_to_string(list_transform(hs, lambda x: chr((32 + coalesce(nullif(list_position(ws, x), 0), 94))::INTEGER)), '') AS b FROM l JOIN h ON h.conv_id = l.conv_id),
z AS (SELECT *, unnest(range(greatest(1, n - 2), n + 4)) AS size FROM e WHERE n > 0),
w AS (SELECT conv_id, line_id, n, a, size, start, substr(b, start + 1, size) AS win FROM (SELECT *, unnest(range(0, m - size + 1)) AS start FROM z WHERE m >= size)),"""


def _sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Per conversation its sentences and what was heard of them (four words of five), as tokens. A sentence has
    93 words at most in the given tables, which lets the SQL use one letter a word."""
    said = F.split(F.regexp_replace(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")), r"([.!?]) ", "$1\n"), "\n")
    tokens = F.transform(said, lambda x: F.filter(F.split(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}_ ]", ""), " "), lambda w: w != ""))
    t = table(spark, sf, "conversations").select(F.col("conv_id").alias("song"), F.struct("turn", tokens.alias("ls")).alias("t"))
    g = S.dealt(t, "song").groupBy("song").agg(F.array_sort(F.collect_list("t")).alias("ts")).select("song", F.flatten("ts.ls").alias("lines"))
    return g.withColumn("heard", F.filter(F.flatten("lines"), lambda w, i: i % 5 != 4))


def _found(df: DataFrame, rescued: bool) -> DataFrame:
    rows = df.select("song", F.inline_outer("windows")).where(F.col("rescued") == rescued)
    return rows.select("song", *(F.col(c).cast("bigint").alias(c) for c in ("line_id", "from", "to", "score")))


@query(f"""WITH {_SAID} d AS (SELECT *, levenshtein(a, win) AS d FROM w) SELECT conv_id AS song, line_id, start AS "from", start + size AS "to", n - d AS score FROM d WHERE d <= greatest(1, floor(n * 0.25)) AND n - d >= least(2, n)""")
def fuzzy_window(spark: SparkSession, sf: str) -> DataFrame:
    return _found(S.windows(_sentences(spark, sf), ratio=0.25, fallback=False), False)


@query(f"""WITH {_SAID} d AS (SELECT *, levenshtein(a, win) AS d FROM w), f AS (SELECT DISTINCT conv_id, line_id FROM d WHERE d <= greatest(1, floor(n * 0.1)) AND n - d >= least(2, n)),
o AS (SELECT w.*, greatest(3, n // 3) AS need FROM w ANTI JOIN f ON f.conv_id = w.conv_id AND f.line_id = w.line_id),
k AS (SELECT *, list_max(list_filter(range(need, n + 1), lambda k: len(list_filter(range(1, n - k + 2), lambda i: contains(win, substr(a, i, k)))) > 0)) AS score FROM o WHERE n >= need AND len(list_filter(range(1, n - need + 2), lambda i: contains(win, substr(a, i, need)))) > 0)
SELECT conv_id AS song, line_id, start AS "from", start + size AS "to", score FROM k""")
def anchor_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return _found(S.windows(_sentences(spark, sf), ratio=0.1), True)


@query("""WITH RECURSIVE c AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY line_id, t0, t1, score) AS i, line_id, t0, t1, score FROM (SELECT user_id, event_id % 12 AS line_id, (event_id % 97)::DOUBLE AS t0, (event_id % 97 + abs(value) % 9)::DOUBLE AS t1, round_even(abs(value), 0) + 1 AS score FROM events)),
g AS (SELECT user_id, count(*) AS n, list(line_id ORDER BY i) AS ls, list(t0 ORDER BY i) AS a, list(t1 ORDER BY i) AS b, list(score ORDER BY i) AS s FROM c GROUP BY 1),
r AS (SELECT user_id, 0::BIGINT AS i, []::DOUBLE[] AS total, []::BIGINT[] AS link FROM g
  UNION ALL SELECT user_id, i + 1, list_append(total, s[i + 1] + greatest(best, 0)), list_append(link, CASE WHEN best > 0 THEN list_position(sums, best) ELSE 0 END)
  FROM (SELECT *, coalesce(list_max(sums), 0) AS best FROM (SELECT r.user_id, r.i, total, link, s, list_transform(range(1, r.i + 1), lambda j: CASE WHEN ls[j] < ls[r.i + 1] AND b[j] <= a[r.i + 1] THEN total[j] END) AS sums FROM r JOIN g ON g.user_id = r.user_id WHERE r.i < n))),
t AS (SELECT r.user_id, link, list_position(total, list_max(total)) AS pos FROM r JOIN g ON g.user_id = r.user_id WHERE r.i = n),
p AS (SELECT user_id, link, pos FROM t UNION ALL SELECT user_id, link, link[pos] FROM p WHERE link[pos] > 0)
SELECT p.user_id AS song, line_id, t0, t1, score FROM p JOIN c ON c.user_id = p.user_id AND c.i = p.pos""")
def interval_schedule(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id")
    c = F.struct((n % 12).cast("int").alias("line_id"), (n % 97).cast("double").alias("t0"), (n % 97 + F.abs("value") % 9).cast("double").alias("t1"), (F.bround(F.abs("value"), 0) + 1).alias("score"))
    g = table(spark, sf, "events").groupBy(F.col("user_id").alias("song")).agg(F.array_sort(F.collect_list(c)).alias("candidates"))
    return S.schedule(g).select("song", F.inline_outer("chain")).where("line_id is not null").withColumn("line_id", F.col("line_id").cast("bigint"))


#: Heard words half a second apart, aligned ones 0.6 s; each line's range, its fuzzy windows, and how they agree.
_CANDIDATES = f"""{_SAID} d AS (SELECT *, levenshtein(a, win) AS d FROM w),
f AS (SELECT conv_id, line_id, start AS "from", start + size AS upto, size, n - d AS score FROM d WHERE d <= greatest(1, floor(n * 0.25)) AND n - d >= least(2, n)),
y AS (SELECT l.conv_id, line_id, len(ws) AS n, ws, hs, sum(len(ws)) OVER (PARTITION BY l.conv_id ORDER BY line_id) - len(ws) AS base FROM l JOIN h ON h.conv_id = l.conv_id),
x AS (SELECT *, base * 0.6::DOUBLE AS a0, (base + n - 1) * 0.6::DOUBLE + 0.5::DOUBLE AS a1 FROM y WHERE n > 0),
v AS (SELECT *, len(list_filter(range(len(hs)), lambda k: k * 0.5::DOUBLE < a0 - 0.3::DOUBLE)) AS lo, len(list_filter(range(len(hs)), lambda k: k * 0.5::DOUBLE < a1 + 0.3::DOUBLE)) AS hi FROM x),
k AS (SELECT conv_id, line_id, 0 AS kind, 0 AS size, base AS "from", a0 AS t0, a1 AS t1, coalesce((SELECT max(score) FROM f WHERE f.conv_id = v.conv_id AND f.line_id = v.line_id AND f."from" >= lo AND f.upto <= hi), 0) + CASE WHEN hi - lo >= 2 AND NOT list_has_any(ws, hs[lo + 1:hi]) THEN 0.0::DOUBLE ELSE 2.0::DOUBLE END AS score FROM v
  UNION ALL SELECT f.conv_id, f.line_id, 1, size, f."from", t0, t1, f.score + 2.0::DOUBLE * least(1.0::DOUBLE, greatest(least(t1, a1) - greatest(t0, a0), 0.0::DOUBLE) / (a1 - a0)) FROM (SELECT *, "from" * 0.5::DOUBLE AS t0, (upto - 1) * 0.5::DOUBLE + 0.4::DOUBLE AS t1 FROM f) f JOIN x USING (conv_id, line_id))"""
_CHAIN = """, c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY line_id, t0, kind, size) AS i FROM k),
g AS (SELECT conv_id, count(*) AS n, list(line_id ORDER BY i) AS ls, list(t0 ORDER BY i) AS a, list(t1 ORDER BY i) AS b, list(score ORDER BY i) AS s FROM c GROUP BY 1),
r AS (SELECT conv_id, 0::BIGINT AS i, []::DOUBLE[] AS total, []::BIGINT[] AS link FROM g
  UNION ALL SELECT conv_id, i + 1, list_append(total, s[i + 1] + greatest(best, 0)), list_append(link, CASE WHEN best > 0 THEN list_position(sums, best) ELSE 0 END)
  FROM (SELECT *, coalesce(list_max(sums), 0) AS best FROM (SELECT r.conv_id, r.i, total, link, s, list_transform(range(1, r.i + 1), lambda j: CASE WHEN ls[j] < ls[r.i + 1] AND b[j] <= a[r.i + 1] THEN total[j] END) AS sums FROM r JOIN g ON g.conv_id = r.conv_id WHERE r.i < n))),
t AS (SELECT r.conv_id, link, list_position(total, list_max(total)) AS pos FROM r JOIN g ON g.conv_id = r.conv_id WHERE r.i = n),
p AS (SELECT conv_id, link, pos FROM t UNION ALL SELECT conv_id, link, link[pos] FROM p WHERE link[pos] > 0)
SELECT p.conv_id AS song, line_id, CASE kind WHEN 0 THEN 'align' ELSE 'transcribe' END AS source, "from", t0, t1, score FROM p JOIN c ON c.conv_id = p.conv_id AND c.i = p.pos"""


def _clocked(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda words, step, length: F.transform(words, lambda w, i: F.struct((i * step).alias("start"), (i * step + length).alias("end")))
    return _sentences(spark, sf).withColumns({"heard_at": at(F.col("heard"), 0.5, 0.4), "aligned_at": at(F.flatten("lines"), 0.6, 0.5)})


def _candidate_rows(spark: SparkSession, sf: str, column: str) -> DataFrame:
    scored = S.candidates(_clocked(spark, sf), ratio=0.25, fallback=False, keep=["song"], wanted=(column,))
    rows = scored.select("song", F.inline_outer(column)).where("line_id IS NOT NULL")
    return rows.select("song", F.col("line_id").cast("bigint").alias("line_id"), "source", F.col("from").cast("bigint").alias("from"), "t0", "t1", "score")


@query(f"""WITH {_CANDIDATES} SELECT conv_id AS song, line_id, CASE kind WHEN 0 THEN 'align' ELSE 'transcribe' END AS source, "from", t0, t1, score FROM k""")
def placement_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """What could place each line: its aligned range and the windows of heard words, scored by what was heard and by
    how far the two agree."""
    return _candidate_rows(spark, sf, "candidates")


@query(f"WITH RECURSIVE {_CANDIDATES}{_CHAIN}")
def placement_chain(spark: SparkSession, sf: str) -> DataFrame:
    """The candidates that place the lines: in order, without overlap, of the largest sum."""
    return _candidate_rows(spark, sf, "chain")


@query(f"""WITH {_CANDIDATES}, o AS (SELECT *, line_id % 8 = 3 OR line_id % 8 = 5 OR line_id % 8 = 7 AS unplaced, count(*) OVER (PARTITION BY conv_id, ws) AS often,
CASE WHEN line_id % 8 = 5 THEN 0.0 ELSE coalesce((SELECT max(score) FROM f WHERE f.conv_id = v.conv_id AND f.line_id = v.line_id AND f."from" >= lo AND f.upto <= hi), 0)::DOUBLE / n END AS share FROM v)
SELECT conv_id AS song, line_id, unplaced OR share < 0.5 AS suspect, NOT unplaced AND n >= 4 AND often = 1 AND share >= 0.75 AS anchor FROM o""")
def anchors_and_suspects(spark: SparkSession, sf: str) -> DataFrame:
    """Lines at their aligned ranges, some without a place and some interpolated: which of them the heard words
    confirm, and which they do not."""
    t = _clocked(spark, sf).withColumn("upto", F.transform("lines", lambda line, i: F.size(F.flatten(F.slice("lines", F.lit(1), i + 1)))))

    def line(words: F.Column, i: F.Column) -> F.Column:
        low, high = F.get("upto", i) - F.size(words), F.get("upto", i) - 1
        start = F.when(i % 8 != 5, F.get("aligned_at", low)["start"])
        return F.struct(i.alias("line_id"), start.alias("start"), F.get("aligned_at", high)["end"].alias("end"), F.when(i % 4 == 3, "interp").when(i % 4 == 1, "transcribe").otherwise("align").alias("source"))

    found = S.judged(t.withColumn("placed", F.transform("lines", line)), ratio=0.25)
    rows = found.select("song", F.posexplode("lines").alias("line_id", "words"), "anchors", "suspects").where(F.size("words") > 0)
    return rows.select("song", F.col("line_id").cast("bigint").alias("line_id"), F.array_contains("suspects", F.col("line_id")).alias("suspect"), F.exists("anchors", lambda a: a["line_id"] == F.col("line_id")).alias("anchor"))


_SRT = "lpad((({0}) // 3600000)::VARCHAR, 2, '0') || ':' || lpad((({0}) // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((({0}) // 1000 % 60)::VARCHAR, 2, '0') || ',' || lpad((({0}) % 1000)::VARCHAR, 3, '0')"


@query(f"SELECT conv_id, string_agg((turn + 1)::VARCHAR || chr(10) || {_SRT.format('turn * 2250')} || ' --> ' || {_SRT.format('turn * 2250 + 1125')} || chr(10) || text || chr(10) || chr(10), '' ORDER BY turn) AS srt FROM conversations WHERE turn % 5 <> 3 AND text IS NOT NULL GROUP BY 1")
def render_captions(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("turn")
    words = F.when(t % 5 != 3, F.array("role")).otherwise(F.array().cast("array<string>"))
    lines = table(spark, sf, "conversations").where("text is not null").select("conv_id", t.alias("line_id"), "text", words.alias("words"), (t * 2.25).alias("start"), (t * 2.25 + 1.125).alias("end"))
    return R.captions(lines, "conv_id")


# repair and prior on placed lines


_PLACED = """l AS (SELECT conv_id, turn AS k, CASE WHEN turn % 4 <> 3 THEN turn * 10.0 + (conv_id % 7) / 2.0 END::DOUBLE AS start, CASE WHEN turn % 4 <> 3 THEN turn * 10.0 + 4 END::DOUBLE AS "end" FROM conversations)"""


def _placed(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as placed lines, every fourth without a place, and cues that lag by four seconds, some by nine."""
    t, n = F.col("turn"), F.col("conv_id")
    there = t % 4 != 3
    o = F.struct(t.cast("int").alias("line_id"), F.when(there, t * 10.0 + (n % 7) / 2.0).alias("start"), F.when(there, t * 10.0 + 4.0).cast("double").alias("end"))
    return table(spark, sf, "conversations").groupBy(n.alias("song")).agg(F.array_sort(F.collect_list(o)).alias("placed"))


@query(f"""WITH {_PLACED}, n AS (SELECT conv_id, max(k) + 1 AS n, max(k) * 10.0 + 20 AS d FROM l GROUP BY 1),
e AS (SELECT conv_id, k, start, "end" FROM l WHERE k % 3 = 1 AND start IS NOT NULL UNION ALL SELECT conv_id, -1, 0.0, 0.0 FROM n UNION ALL SELECT conv_id, n, d, d FROM n),
p AS (SELECT conv_id, k AS a, start AS s, lead(k) OVER w AS b, lead("end") OVER w AS e FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY k))
SELECT conv_id AS song, a AS after, b AS before, greatest(s - 0.75, 0.0)::DOUBLE AS t0, least(e + 0.75, d)::DOUBLE AS t1 FROM p JOIN n USING (conv_id) WHERE b - a > 1""")
def repair_spans(spark: SparkSession, sf: str) -> DataFrame:
    anchors = F.filter("placed", lambda o: (o["line_id"] % 3 == 1) & o["start"].isNotNull())
    n = F.try_element_at("placed", F.lit(-1))["line_id"]
    spans = _placed(spark, sf).select("song", F.inline_outer(S.spans(anchors, n + 1, (n * 10.0 + 20).cast("double")))).where("after is not null")
    return spans.select("song", F.col("after").cast("bigint").alias("after"), F.col("before").cast("bigint").alias("before"), "t0", "t1")


@query(f"""WITH {_PLACED}, c AS (SELECT conv_id, max(k) + 1 AS n, list(k ORDER BY k) FILTER (k % 5 = 2 AND start IS NOT NULL) AS anchors, list(k ORDER BY k) FILTER (start IS NULL OR k % 9 = 4) AS suspects FROM l GROUP BY 1),
e AS (SELECT conv_id, n, coalesce(len(anchors), 0) AS a, coalesce(len(suspects), 0) AS s, suspects, [-1] || coalesce(anchors, []) || [n] AS edges FROM c),
g AS (SELECT conv_id, a, s, CASE WHEN a > 0 AND s > 0 THEN list_filter(list_transform(range(1, len(edges)), lambda i: [edges[i], edges[i + 1]]), lambda x: x[2] - x[1] > 1) ELSE [] END AS spans, suspects FROM e)
SELECT conv_id AS song, a AS n_anchors, s AS n_suspects, len(spans) AS n_spans, len(list_filter(spans, lambda x: len(list_filter(suspects, lambda k: x[1] < k AND k < x[2])) > 0)) AS n_replayed FROM g""")
def realign_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Which spans of a song are placed anew, counted; songs without anchors or suspects have none."""
    p = _placed(spark, sf)
    there = F.filter("placed", lambda o: (o["line_id"] % 5 == 2) & o["start"].isNotNull())
    bad = F.transform(F.filter("placed", lambda o: o["start"].isNull() | (o["line_id"] % 9 == 4)), lambda o: o["line_id"])
    n = F.try_element_at("placed", F.lit(-1))["line_id"] + 1
    plan = S.replay_plan(p.select("song", there.alias("anchors"), bad.alias("suspects"), n.alias("n"), (n * 10.0).cast("double").alias("duration")))
    return plan.select("song", *(F.col(c).cast("bigint").alias(c) for c in S.PLAN))


@query(f"""WITH {_PLACED}, m AS (SELECT conv_id, k, start AS old, CASE WHEN k % 6 = 0 THEN NULL WHEN k % 6 = 2 THEN k * 10.0 - 9 ELSE k * 10.0 + 1 END AS new, k % 2 = 1 AS heard FROM l),
c AS (SELECT conv_id, max(k) AS last, max(k) // 2 AS b FROM l GROUP BY 1), e AS (SELECT c.*, (SELECT "end" FROM l WHERE l.conv_id = c.conv_id AND k = 0) - 0.5 AS low, (SELECT start FROM l WHERE l.conv_id = c.conv_id AND k = b) + 0.5 AS high FROM c),
v AS (SELECT m.conv_id, k, CASE WHEN NOT (k > 0 AND k < b) OR (old IS NULL AND NOT heard) OR (new IS NOT NULL AND (coalesce(new < low, false) OR coalesce(new + 2 > high, false))) THEN old ELSE new END AS start FROM m JOIN e USING (conv_id))
SELECT conv_id AS song, k AS line_id, start::DOUBLE AS start FROM v WHERE start IS NOT NULL""")
def repair_merge(spark: SparkSession, sf: str) -> DataFrame:
    k = lambda o: o["line_id"]
    words = lambda there, s: F.when(there, F.array(F.struct(F.lit("w").alias("word"), s.alias("start"), s.alias("end")))).otherwise(F.array().cast(S.WORDS))
    line = lambda o, s, e, said: F.struct(k(o).alias("line_id"), F.lit("").alias("text"), words(s.isNotNull(), s).alias("words"), s.alias("start"), e.alias("end"), said.alias("source"))
    first = F.transform("placed", lambda o: line(o, o["start"], o["end"], F.lit("align")))
    new_start = lambda o: F.when(k(o) % 6 == 0, None).when(k(o) % 6 == 2, k(o) * 10.0 - 9).otherwise(k(o) * 10.0 + 1).cast("double")
    again = F.transform("placed", lambda o: line(o, new_start(o), new_start(o) + 2, F.when(k(o) % 2 == 1, "transcribe").otherwise("align")))
    last = F.try_element_at("placed", F.lit(-1))["line_id"]
    p = _placed(spark, sf).withColumns({"first": first, "n": last + 1, "results": F.array(F.struct(F.lit(0).alias("after"), F.floor(last / 2).cast("int").alias("before"), again.alias("placed")))})
    out = S.merged(p.withColumn("song_end", F.lit(0.0))).select("song", F.inline_outer("merged")).where("source <> 'interp'")
    return out.select("song", F.col("line_id").cast("bigint").alias("line_id"), "start")


@query(f"""WITH {_PLACED}, e AS (SELECT *, coalesce(last_value("end" IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS low,
coalesce(first_value(start IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 500.0) AS high FROM l)
SELECT conv_id AS song, k AS line_id, coalesce(start, low)::DOUBLE AS start, coalesce("end", greatest(low, high))::DOUBLE AS "end", CASE WHEN start IS NULL THEN 'interp' ELSE 'align' END AS source FROM e""")
def interpolation(spark: SparkSession, sf: str) -> DataFrame:
    """Lines without a place, between those that have one."""
    line = lambda o: F.struct(o["line_id"].alias("line_id"), F.lit("").alias("text"), F.array().cast(S.WORDS).alias("words"), o["start"].alias("start"), o["end"].alias("end"), F.lit("align").alias("source"))
    there = F.transform(F.filter("placed", lambda o: o["start"].isNotNull()), line)
    p = _placed(spark, sf).select("song", there.alias("placed"), (F.try_element_at("placed", F.lit(-1))["line_id"] + 1).alias("n"), F.lit(500.0).alias("song_end"))
    return S.filled(p).select("song", F.inline("filled")).select("song", F.col("line_id").cast("bigint").alias("line_id"), "start", "end", "source")


@query(f"""WITH {_PLACED}, q AS (SELECT *, k * 10.0 - 4 + CASE WHEN k % 5 = 2 THEN -9 ELSE 0 END AS cue FROM l), f AS (SELECT conv_id, count(*) AS n_fit, median(start - cue) AS med FROM q WHERE start IS NOT NULL AND k % 3 <> 0 GROUP BY 1),
d AS (SELECT conv_id, n_fit, any_value(med) AS med, median(abs(start - cue - med)) AS mad FROM q JOIN f USING (conv_id) WHERE start IS NOT NULL AND k % 3 <> 0 GROUP BY 1, 2),
a AS (SELECT q.conv_id, k, start, greatest(cue + med, 0.0) AS target, n_fit, CASE WHEN coalesce(n_fit, 0) < 4 THEN 'few_anchors' WHEN mad > 0.75 THEN 'wide_spread' END AS bailed FROM q LEFT JOIN d USING (conv_id))
SELECT conv_id AS song, k AS line_id, bailed, CASE WHEN bailed IS NOT NULL THEN coalesce(start, 0.0) WHEN start IS NULL OR abs(target - start) > 2 THEN target ELSE start END::DOUBLE AS start FROM a""")
def prior_moves(spark: SparkSession, sf: str) -> DataFrame:
    word = lambda s, e: F.array(F.struct(F.lit("w").alias("word"), s.alias("start"), e.alias("end")))
    line = lambda o: F.struct(o["line_id"].alias("line_id"), F.lit("w").alias("text"), F.when(o["start"].isNotNull(), word(o["start"], o["end"])).otherwise(F.array().cast(S.WORDS)).alias("words"), F.coalesce(o["start"], F.lit(0.0)).alias("start"), F.coalesce(o["end"], F.lit(0.0)).alias("end"), F.lit("align").alias("source"))
    lag = lambda o: o["line_id"] * 10.0 - 4 + F.when(o["line_id"] % 5 == 2, -9.0).otherwise(0.0)
    p = _placed(spark, sf).withColumns({
        "anchors": F.filter("placed", lambda o: o["start"].isNotNull() & (o["line_id"] % 3 != 0)), "lines": F.transform("placed", lambda o: F.lit("w")), "tokens": F.transform("placed", lambda o: F.array(F.struct(F.lit("w").alias("norm"), F.lit("w").alias("raw")))),
        "cues": F.transform("placed", lambda o: F.struct(o["line_id"].alias("line_id"), lag(o).cast("double").alias("start"), (lag(o) + 3).cast("double").alias("end"))),
    })
    out = S.corrected(p.withColumn("placed", F.transform("placed", line)))
    return out.select("song", "bailed", F.inline_outer("placed")).select("song", F.col("line_id").cast("bigint").alias("line_id"), "bailed", "start")


# pieces with an oracle


@query("""WITH w AS (SELECT user_id, event_id, epoch(ts)::DOUBLE AS start FROM events)
SELECT r.event_id AS range_id, count(*) AS n FROM w r JOIN w ON w.user_id = r.user_id AND w.start >= r.start - 0.3 AND w.start < r.start + 3600 + 0.3 GROUP BY 1""")
def range_join(spark: SparkSession, sf: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    e = table(spark, sf, "events").select(F.col("user_id").alias("song"), "event_id", at.alias("start"))
    r = e.select("song", F.col("event_id").alias("range_id"), F.col("start").alias("t0"), (F.col("start") + 3600).alias("t1"))
    return S.words_in_range(e, r, width=3600.0).groupBy("range_id").agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE l AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS line_id, (turn * 7 + conv_id) % 5 AS n FROM conversations), g AS (SELECT conv_id, list(n ORDER BY line_id) AS ns FROM l GROUP BY 1),
r AS (SELECT conv_id, -1::BIGINT AS line_id, ns, 0::BIGINT AS pos, NULL::BIGINT AS f, NULL::BIGINT AS t FROM g
  UNION ALL SELECT conv_id, line_id + 1, ns, CASE WHEN fits THEN pos + n ELSE pos END, CASE WHEN fits THEN pos END, CASE WHEN fits THEN pos + n END FROM (SELECT *, ns[line_id + 2] AS n, ns[line_id + 2] > 0 AND pos + ns[line_id + 2] <= 5 + conv_id % 4 AS fits FROM r WHERE line_id + 1 < len(ns)))
SELECT conv_id AS song, line_id, f AS "from", t AS "to" FROM r WHERE line_id >= 0""")
def align_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Five to eight aligned words a song, so that lines overflow and shorter ones follow."""
    n = ((F.col("turn") * 7 + F.col("conv_id")) % 5).cast("int")
    t = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("song")).agg(F.array_sort(F.collect_list(F.struct("turn", n.alias("n")))).alias("x")).select("song", F.col("x.n").alias("sizes"))
    return S.token_ranges(t, t.select("song", (5 + F.col("song") % 4).cast("int").alias("n"))).select("song", *(F.col(c).cast("bigint").alias(c) for c in ("line_id", "from", "to")))


@query("SELECT user_id, event_id, coalesce(lead(epoch(ts)::DOUBLE) OVER (PARTITION BY user_id ORDER BY ts, event_id), epoch(ts)::DOUBLE + 4.0) AS \"end\" FROM events")
def cue_lead(spark: SparkSession, sf: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return S.cue_ends(table(spark, sf, "events").withColumn("start", at), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "end")


@query("SELECT user_id, event_id, epoch(ts)::DOUBLE - coalesce(lag(epoch(ts)::DOUBLE + 1) OVER (PARTITION BY user_id ORDER BY ts, event_id), epoch(ts)::DOUBLE) AS gap FROM events")
def gaps(spark: SparkSession, sf: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    e = table(spark, sf, "events").withColumns({"start": at, "end": at + 1})
    return S.word_gaps(e, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "gap")


_MASK = "SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN event_id::DOUBLE END AS s, CASE WHEN event_id % 3 = 0 THEN event_id + 0.5::DOUBLE END AS e FROM events"


def _masked(spark: SparkSession, sf: str) -> DataFrame:
    placed = F.col("event_id") % 3 == 0
    return table(spark, sf, "events").select("user_id", "event_id", F.when(placed, F.col("event_id").cast("double")).alias("start"), F.when(placed, F.col("event_id") + 0.5).cast("double").alias("end"))


@query(f"SELECT user_id, event_id, last_value(e IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_end, first_value(s IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_start FROM ({_MASK})")
def nearest_placed(spark: SparkSession, sf: str) -> DataFrame:
    return S.neighbours(_masked(spark, sf), "user_id", "event_id", "start", "end").select("user_id", "event_id", "prev_end", "next_start")


@query(f"""WITH m AS ({_MASK}), r AS (SELECT *, count(s) OVER (PARTITION BY user_id ORDER BY event_id) AS run, first_value(s IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM m),
g AS (SELECT user_id, run, count(*) FILTER (s IS NULL) AS k, coalesce(max(e), 0.0) AS lo FROM r GROUP BY 1, 2), h AS (SELECT r.*, lo, k, coalesce(nxt, lo) AS hi, row_number() OVER (PARTITION BY r.user_id, r.run, s IS NULL ORDER BY event_id) - 1 AS k0 FROM r JOIN g USING (user_id, run))
SELECT user_id, event_id, CASE WHEN s IS NULL THEN lo + k0 * ((greatest(hi, lo) - lo) / k) ELSE s END AS start, CASE WHEN s IS NULL THEN lo + (k0 + 1) * ((greatest(hi, lo) - lo) / k) ELSE e END AS "end" FROM h""")
def spread_runs(spark: SparkSession, sf: str) -> DataFrame:
    return S.spread_runs(_masked(spark, sf), "user_id", "event_id").select("user_id", "event_id", "start", "end")


@query("SELECT conv_id, turn, count(*) OVER (PARTITION BY role, len(text)) = 1 AS is_unique FROM conversations")
def unique_seq(spark: SparkSession, sf: str) -> DataFrame:
    seq = F.array("role", F.coalesce(F.length("text").cast("string"), F.lit("-")))
    return S.unique_sequences(table(spark, sf, "conversations").withColumn("seq", seq), "seq").select("conv_id", "turn", "is_unique")


@query("WITH m AS (SELECT user_id, median(value) AS med FROM events GROUP BY 1) SELECT user_id, count(value) AS n, any_value(med) AS median, median(abs(value - med)) AS mad FROM events JOIN m USING (user_id) GROUP BY 1")
def robust_offset(spark: SparkSession, sf: str) -> DataFrame:
    return S.robust_offset(table(spark, sf, "events"), "user_id", "value")


@query("SELECT event_type, count(value) AS n, median(value) AS median FROM events GROUP BY 1")
def hot_medians(spark: SparkSession, sf: str) -> DataFrame:
    """Medians of few large keys, by digits."""
    return medians(table(spark, sf, "events"), "event_type", "value", small=50)


@query("SELECT conv_id, list_sort(list(len(text)))[count(*) // 2 + 1] AS mid FROM conversations GROUP BY 1")
def upper_median(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(F.length("text").cast("bigint")).alias("x"))
    return g.select("conv_id", S.upper_median(F.col("x")).alias("mid"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0.0::DOUBLE WHEN event_id % 7 = 0 THEN CASE WHEN t0 <= a0 AND a0 <= t1 THEN 1.0 ELSE 0.0 END ELSE least(1.0, greatest(least(t1, a1) - greatest(t0, a0), 0.0) / (a1 - a0)) END AS agreement, CASE WHEN event_id % 4 >= 2 AND event_id % 3 <> 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
FROM (SELECT event_id, (event_id % 10)::DOUBLE AS t0, (event_id % 10 + 3)::DOUBLE AS t1, (event_id % 8)::DOUBLE AS a0, (event_id % 8 + 2)::DOUBLE AS a1 FROM events)""")
def agreement(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id")
    d = lambda x: x.cast("double")
    a0 = F.when(n % 5 != 0, d(n % 8))
    a1 = F.when(n % 7 == 0, d(n % 8)).otherwise(d(n % 8 + 2))
    return table(spark, sf, "events").select("event_id", S.agreement(d(n % 10), d(n % 10 + 3), a0, a1).alias("agreement"), S.alpha_weight(n % 3 == 0, n % 4).alias("weight"))


@query("SELECT conv_id, count(*) / (nullif(sum(len(text)), 0) / 60.0) AS wpm, coalesce(count(*) / (nullif(sum(len(text)), 0) / 60.0) < 0.5, false) AS retry FROM conversations GROUP BY 1")
def words_per_minute(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("s"))
    wpm = S.words_per_minute(F.col("n"), F.col("s").cast("double"))
    return g.select("conv_id", wpm.alias("wpm"), F.coalesce(wpm < 0.5, F.lit(False)).alias("retry"))


_ASS = "(floor(({0})/3600)::BIGINT || ':' || lpad(floor((({0})%3600)/60)::BIGINT::VARCHAR,2,'0') || ':' || lpad(floor(({0})%60)::BIGINT::VARCHAR,2,'0') || '.' || lpad(floor((({0})%1)*100)::BIGINT::VARCHAR,2,'0'))"


@query(rf"""WITH w AS (SELECT conv_id, turn, (turn * 10.25)::DOUBLE AS s, role FROM conversations)
SELECT conv_id, turn, 'Dialogue: 0,' || {_ASS.format('greatest(s - 0.8::DOUBLE, 0.0)')} || ',' || {_ASS.format('s + 5.0 + 0.2::DOUBLE')} || ',Karaoke,,0,0,0,,' || CASE WHEN s > 0 THEN '{{\k80}}' ELSE '' END || '{{\kf150}}' || role || ' {{\k50}}{{\kf10}}und {{\kf100}}so {{\k72}}{{\kf125}}' || role AS event FROM w""")
def render_ass(spark: SparkSession, sf: str) -> DataFrame:
    """Words with and without gaps between them, one of them shorter than a sweep may be. Times are binary fractions."""
    at = F.col("turn") * F.lit(10.25)
    word = lambda w, a, b: F.struct(w.alias("word"), (at + a).alias("start"), (at + b).alias("end"))
    words = F.array(word(F.col("role"), 0.0, 1.5), word(F.lit("und"), 2.0, 2.03125), word(F.lit("so"), 2.03125, 3.03125), word(F.col("role"), 3.75, 5.0))
    return table(spark, sf, "conversations").select("conv_id", "turn", R.karaoke_event(words).alias("event"))


@query("SELECT c_custkey, '[ti:' || c_name || ']' || chr(10) || '[ar:' || c_mktsegment || ']' || chr(10) || '[length:' || lpad((c_custkey % 90 // 60)::VARCHAR, 2, '0') || ':' || lpad((c_custkey % 90 % 60)::VARCHAR, 2, '0') || ']' || chr(10) || '[lrclib_id:' || c_custkey || ']' || chr(10) || '[00:01.00] x' AS text FROM customer WHERE c_custkey % 90 > 0")
def write_lrc(spark: SparkSession, sf: str) -> DataFrame:
    r = F.struct(F.col("c_name").alias("trackName"), F.col("c_mktsegment").alias("artistName"), F.lit(None).cast("string").alias("albumName"), (F.col("c_custkey") % 90).cast("string").alias("duration"), F.col("c_custkey").alias("id"), F.lit("[00:01.00] x").alias("syncedLyrics"))
    return table(spark, sf, "customer").where("c_custkey % 90 > 0").withColumn("r", r).select("c_custkey", R.stamped_lyrics("r").alias("text"))
