"""Text functions, sources and matching on golden cases."""

import os
import random
import re
import subprocess
import sys

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from descant.functions import text as T
from descant.operators import browse as B, matching as M
from descant.sources import readers as R


def one(spark, f, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(f(*(F.col(f"c{i}") for i in range(len(values)))).alias("r")).first().r


@pytest.mark.parametrize(
    "f,value,want",
    [
        (T.video_id, "/m/Song---abcdefghij_.mp4", "abcdefghij_"), (T.video_id, "Song [abcdefghij-].webm", "abcdefghij-"), (T.video_id, "Song.mp4", None), (T.stem, "/a/b.c.d", "b.c"), (T.stem, ".hidden", ".hidden"),
        (T.detect_format, "a/B.MP4", "mp4"), (T.detect_format, "a.b/c", ""), (T.id_from_url, "https://e.com/watch?v=xyz?t=1", "xyz"), (T.id_from_url, "https://m.e.com/?v=xyz", None), (T.id_from_url, "https://yu.be/q", "q"),
        (T.clean_query, "🎤Song_Name (Live) [HD] official video", "Song Name"), (T.tidy, "Ann - Song (Official Video)", "Ann - Song"), (T.tidy, "Song (In the Style of Ann) Karaoke", "Song - Ann"), (T.tidy, "Ann – Song HD lyrics", "Ann - Song"),
        (T.lyric_line, "<i>Hé</i> [x] ♪ ‘a’\nb", "Hé 'a' b"), (T.caption_line, "(music)", ""), (T.caption_line, "Oh (yes) my", "Oh my"), (T.align_text, "(I can't) go", "I can't go"), (T.plain_line, "<b>Don´t</b> STOP, Café", "dont stop cafe"),
        (T.normalize_token, "Wеre’s", "weres"), (T.normalize_token, "Éa_1!", "ea_1"), (T.strip_accents, "ñéü", "neu"), (T.clean_key, "Song (Live) [2009] feat. Bo", "Song"), (T.clean_key, "(Only) ", "(Only)"),
        (T.length_tag, "185.4", "03:05"), (T.length_tag, "x", None), (T.length_tag, "0", None), (T.length_seconds, "03:05", 185.0), (T.length_seconds, "bad", None), (T.comparable, "A-ha.x_y's", "a ha x y s"), (T.before_playlist, "u?v=1&list=2", "u?v=1"),
        (T.has_english, '{"EN-gb": []}', True), (T.has_english, "broken", False), (T.stem_role, "a_(Vocals)_(Noreverb).wav", "vocal"), (T.stem_role, "a no vocals", "instrumental"), (T.comparable_name, "Ä – B", "a - b"),
    ],
)
def test_functions(spark, f, value, want):
    assert one(spark, f, value) == want


@pytest.mark.parametrize("value,kind", [("Yes", "bool"), ("-12", "int"), ("1.5", "float"), ("1.2.3", "string"), ("", "string"), ("off", "bool")])
def test_settings(spark, value, kind):
    assert one(spark, T.setting, value).kind == kind


def test_times(spark):
    df = spark.createDataFrame([(3723.29,), (1.15,), (0.0,), (None,)], "s double")
    assert [r.t for r in df.select(T.ass_time(F.col("s")).alias("t")).collect()] == ["1:02:03.28", "0:00:01.14", "0:00:00.00", None]
    assert [r.t for r in df.select(T.clock(F.col("s")).alias("t")).collect()] == ["62:03", "0:01", "0:00", None]


@pytest.mark.parametrize("a,b,want", [("im", "i am", True), ("im", "am", True), ("go", "go", True), ("go", "went", False), ("am", "im", True)])
def test_same_word(spark, a, b, want):
    assert one(spark, T.same_word, a, b) == want


def test_parts_and_artist(spark):
    assert tuple(one(spark, T.query_parts, "Ann - Song - x")) == ("ann", "song") and tuple(one(spark, T.query_parts, "Ann|Song")) == ("ann", "song") and tuple(one(spark, T.query_parts, " Ann ")) == ("ann", "")
    assert one(spark, T.without_artist, "Big.Ann - Song", "big ann") == "Song" and one(spark, T.without_artist, "Song", "ann") == "Song"
    assert one(spark, M.kept_artist, "Ann & Bo - Song", "Bo") == "Ann & Bo" and one(spark, M.kept_artist, "Béa - Song", "Bea") == "Béa" and one(spark, M.kept_artist, "Song", "Bo") is None


def test_relevance(spark):
    rows = [("ann - blue song", 0, "Blue Song (Live)", "Ann", None), ("ann - blue song", 1, "Blue Song", "Ann", None), ("ann - blue song", 2, "Blue Song", "Ann", "id"), ("ann - blue song", 3, "OTHER", "Zed", None)]
    df = spark.createDataFrame(rows, "query string, place int, name string, artist string, mbid string")
    got = {r.place: r.score for r in M.scored(df, mbid="mbid").collect()}
    assert got == {0: 50 - 30, 1: 100, 2: 105, 3: -10 - 1000 - 100}
    assert M.first_best(M.scored(df), ["query"], [F.col("score")], "place").first().place == 1
    assert one(spark, M.corrected, "ann - blue song", None, "Blue Song (feat. x)", "Ann") == "Ann - Blue Song" and one(spark, M.corrected, "blue song - ann", None, "Blue Song", "Ann") == "Blue Song - Ann"


def test_stamped_lyrics(spark):
    text = "[ti:T]\n[lrclib_id:12]\n[length:01:05]\nno stamp\n[00:05.00][0:01.50] two\n[00:03] three\n[00:04.00]\n"
    df = spark.createDataFrame([(1, text)], "song int, text string")
    got = [(r.pos, r.text, r.start, r.end) for r in R.stamped_rows(df, ["song"], "text").orderBy("pos").collect()]
    assert got == [(0, "two", 1.5, 3.0), (1, "three", 3.0, 5.0), (2, "two", 5.0, 9.0)]
    h = df.select(R.stamped_header(F.col("text")).alias("h")).first().h
    assert (h.trackName, h.artistName, h.id, h.duration) == ("T", None, 12, 65.0)


def test_captions_and_lyrics(spark):
    srt = "1\n00:00:01,000 --> 00:00:02,500\n(music)\n\n2\n00:00:03,000 --> 00:00:04,000\n<i>Hello</i>\nthere\n"
    df = spark.createDataFrame([(1, "a.srt", srt), (2, "a.txt", "[Verse]\n\n(Oh) hi\n***\nbye")], "song int, path string, text string")
    got = [(r.song, r.text, r.align_text) for r in R.lyrics(df, ["song"], "path", "text").orderBy("song", "line_no").collect()]
    assert got == [(1, "Hello there", "Hello there"), (2, "(Oh) hi", "Oh hi"), (2, "bye", "bye")]


def test_loudness_takes_the_last_block(spark):
    log = 'x\n{\n"input_i" : "1"\n}\nmore\n{\n"input_i" : "-9.5",\n"input_tp" : "-1",\n"input_lra" : "2",\n"input_thresh" : "-20",\n"target_offset" : "0.5",\n"normalization_type" : "dynamic"\n}\n'
    r = one(spark, R.loudness, log)
    assert r.ok and r.input_i == -9.5 and r.loudnorm_type == "dynamic"
    assert not one(spark, R.loudness, "nothing").ok and not one(spark, R.loudness, '{\n"input_i": "x"\n}').ok


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for n in ("a.MP4", "b.txt", "sub/c.webm"):
        (tmp_path / n).write_text("x")
    got = R.files(spark, str(tmp_path)).where(T.is_media(F.col("path")))
    assert sorted(r.p for r in got.select(T.basename(F.col("path")).alias("p")).collect()) == ["a.MP4", "c.webm"]


def test_browse(spark):
    df = spark.createDataFrame([(1, "Éa"), (2, "eb"), (3, "7x"), (4, "Z")], "k int, name string")
    assert [r.k for r in B.starts_with_letter(df, "e", "name").orderBy("k").collect()] == [1, 2] and [r.k for r in B.starts_with_number(df, "name").collect()] == [3]
    assert [r.k for r in B.page(df, [B.sort_key(F.col("name"))], 2, 2).orderBy("position").collect()] == [2, 4]


@pytest.mark.parametrize("gone", ["corpus_pipeline", "descant.llm"])
def test_the_library_stands_without_the_optional_operators(gone):
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"import sys; sys.modules[{gone!r}] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=here, check=True)


def test_a_missing_library_is_an_error():
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isfile(os.path.join(here, "descant", "llm", "registry.py")) and os.path.isfile(os.path.join(here, "corpus_pipeline.py")):
        assert subprocess.run([sys.executable, "-c", "import sys; sys.modules['zstandard'] = None; import __spark_entry__"], cwd=here, capture_output=True).returncode


@pytest.mark.parametrize(
    "f,value,want",
    [
        (T.collapse, "Song\u3000\u3000x \u00a0", "Song x"), (T.clean_query, "Song\u3000 (Live)\u00a0", "Song"), (T.tidy, "Song\u3000 (Live)\u00a0", "Song"), (T.clean_key, "\u2003Song [Live]\u00a0", "Song"), (T.safe_name, "\u00a0a b\u3000", "a b"),
        (T.lyric_line, "a\u00a0\u2003b", "a b"), (T.strip, "\x1c a\x85", "a"), (T.tidy, "Song\u2009–\u2009Ann", "Song - Ann"),
    ],
)
def test_unicode_spaces(spark, f, value, want):
    assert one(spark, f, value) == want


def test_nested_answers(spark):
    hits = '{"sections": [{"hits": [{"type": "song", "result": {"id": 1, "title": "A", "artist_names": "", "primary_artist": {"name": "Ann"}}}, {"type": "album", "result": {}}, {"type": "song", "result": {"id": 2, "title": "B", "artist_names": "Site Covers"}}, {"type": "song", "result": {"id": 3, "title": "C"}}]}, {"hits": []}]}'
    rows = [("q", hits), ("the Site", hits), ("broken", hits.replace('"id": 1, ', "")), ("none", '{"sections": []}'), ("text", "<html>"), ("null", None)]
    got = sorted((r.query, r.rank, r.id, r.artist) for r in R.song_hits(spark.createDataFrame(rows, "query string, body string"), "query", "body", "site").collect())
    assert got == [("q", 0, 1, "Ann"), ("q", 1, 3, ""), ("the Site", 0, 1, "Ann"), ("the Site", 1, 2, "Site Covers"), ("the Site", 2, 3, "")]
    tracks = [("a", '{"results": {"trackmatches": {"track": [{"name": "N", "artist": "A"}]}}}'), ("b", '{"error": 29}'), ("c", "{}"), ("d", "x"), ("e", None)]
    assert [(r.q, r.pos, r["name"], r.mbid) for r in R.track_rows(spark.createDataFrame(tracks, "q string, b string"), ["q"], "b").collect()] == [("a", 0, "N", None)]
    records = [("a", '[{"id": 4, "trackName": "T"}, {}]'), ("b", '{"message": "no"}'), ("c", None), ("d", "[]")]
    got = R.caption_records(spark.createDataFrame(records, "q string, b string"), ["q"], "b").select("q", "pos", R.provenance(F.col("record")).alias("p")).collect()
    assert sorted((r.q, r.pos, r.p.id, r.p.trackName) for r in got) == [("a", 0, 4, "T"), ("a", 1, None, None)]


def test_bundles_round_trip(spark, tmp_path):
    from descant.operators import render

    rows = spark.createDataFrame([("a", ["x", "y"]), ("b c", [])], "stem string, lines array<string>")
    made = rows.select("stem", render.bundle({"lyrics": F.struct(F.col("lines").alias("align_lines"))}).alias("bundle"))
    render.write_bundles(made, f"{tmp_path}/b")
    assert {r.stem: r.align_lines for r in R.bundles(spark, f"{tmp_path}/b").collect()} == {"a": ["x", "y"], "b c": []}
    (tmp_path / "song.json").write_text("{broken")
    (tmp_path / "other.json").write_text('{"lyrics": {"align_lines": ["z"]}}')
    assert {r.stem: r.align_lines for r in R.bundle_files(spark, f"{tmp_path}/*.json").collect()} == {"song": None, "other": ["z"]}


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_each_text_is_read_once(spark):
    d = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    srt = plan(R.caption_rows(d, ["doc_id"], "text"))
    assert srt.count("-->") == 1 and srt.count(r"\([^)]*\)") == 1
    assert plan(d.select(F.inline(F.array(T.setting(F.col("text")))))).count("[0-9.]") == 1
    assert plan(d.select(T.caption_line(F.col("text")).alias("r"))).count("♪") == 1
    for f in (T.tidy, T.clean_query, T.lyric_line, T.align_text):
        assert "translate(" not in plan(d.select(f(F.col("text")).alias("r")))


def test_a_file_of_one_row_group_is_dealt(spark, tmp_path):
    from descant.plans.base import dealt

    pq.write_table(pa.table({"doc_id": range(4000), "text": [f"{k * 7919} " * 50 for k in range(4000)]}), tmp_path / "documents.parquet", compression="none")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        t = dealt(spark.read.parquet(str(tmp_path / "documents.parquet")))
        sizes = [r["count"] for r in t.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(sizes) >= 3 * spark.sparkContext.defaultParallelism and max(sizes) < 2000


def test_patterns_equal_plain_rules(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", " ", "  ", "\t", "\n", "_", "(", ")", "[x]", "-", "é", " ", " ", "Karaoke", " karaoke x", "HD", "’", "“"]) for _ in range(rng.randrange(12))) for _ in range(400)]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k long, x string")
    got = rows.select("k", T.collapse(F.col("x")), T.swap(F.col("x"), "‘’“”", "''\"\""), T.swap(F.col("x"), "()", "")).collect()
    space = r"[\s\x1c-\x1f\x85\xa0  -     　]+"
    for k, a, b, c in got:
        assert a == re.sub(space, " ", texts[k]).strip(" ")
        assert b == texts[k].translate(str.maketrans("‘’“”", "''\"\"")) and c == texts[k].replace("(", "").replace(")", "")


@pytest.mark.parametrize("value, kind", [("-" * 3 + "12", "int"), (".5", "float"), ("5.", "float"), ("1.2.3", "string"), ("x1.2", "string"), ("TRUE", "bool"), ("truely", "string"), ("", "string"), ("12\n", "int")])
def test_settings_at_the_edges(spark, value, kind):
    assert spark.createDataFrame([(value,)], "v string").select(T.setting(F.col("v"))["kind"]).first()[0] == kind


def test_a_letter_needs_the_head_of_a_text_only(spark):
    names = ["Étude " * 50, "\u0301\u0308Ecole", "e", "\u0301e", "", "\né", "東e", "İx", None, "ÉÉ", "zebra"]
    rows = spark.createDataFrame(list(enumerate(names)), "k long, name string")
    for letter in ("E", "i", "z"):
        got = B.starts_with_letter(rows, letter, "name")
        assert {r.k for r in got.collect()} == {r.k for r in rows.where(F.substring(B.sort_key(F.col("name")), 1, 1) == letter.lower()).collect()}
    assert "regexp_extract" in plan(got)
