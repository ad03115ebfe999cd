"""Document operators against brute force, and their edge cases."""

import hashlib
import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from descant.llm import decontamination, deepshallow, graph, mixing, neardup, paragraphs, quality, sharding, substrings
from descant.llm.common import bag_as_set, jaccard, normal_bytes, shingles, word_hashes
from tests import oracle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(rng, n, vocabulary=3000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, pasted passages, empty and null texts, long texts."""
    rng = random.Random(5)
    texts: list[str | None] = []
    for _ in range(40):
        lines = []
        for _ in range(rng.randrange(1, 4)):
            lines.append(" ".join(w.capitalize() + ("." if rng.random() < 0.15 else "") for w in words(rng, rng.randrange(20, 90))) + ".")
        texts.append("\n".join(lines))
    texts += [texts[0], texts[0], texts[3]]
    for k in (1, 2, 1, 4):
        w = texts[k].split(" ")
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    passage = " ".join(w.capitalize() + ("." if i % 9 == 8 else "") for i, w in enumerate(words(rng, 63)))
    for k in (5, 6):
        w = texts[k].split(" ")
        texts.append(" ".join([*w[:7], passage, *w[7:]]))
    texts += ["", None, "one two", "Ünïcode " * 30, "a" * 500, "a" * 700, " ".join(words(rng, 3000))]
    return [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 7 else None, 0) for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({"id": F.lit(1), "key": F.lit("x"), "label": F.lit(None).cast("int"), "bucket": F.lit(2)}).repartition(3)


def test_trie_and_sort_order_strings():
    rng = np.random.default_rng(1)
    raw = rng.integers(97, 99, (400, 64)).astype(np.uint8)
    raw[200:300] = raw[:100]
    raw[:, :40] = 97  # ties reach the tries
    order, group = deepshallow.sort(np.ascontiguousarray(raw).view(">u8").astype(np.uint64), shallow=2)
    strings = [r.tobytes() for r in raw]
    assert [strings[i] for i in order] == sorted(strings)
    assert len(set(strings)) == group[-1] + 1
    assert all((strings[order[i]] == strings[order[i + 1]]) == (group[i] == group[i + 1]) for i in range(399))


def removed_by_brute_force(rows):
    seen: dict[bytes, int] = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            seen[b[k : k + 50]] = min(i, seen.get(b[k : k + 50], i))
    out = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if seen[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("chunk", [2000, 1 << 20])
def test_substrings_equal_brute_force(spark, corpus, monkeypatch, chunk):
    monkeypatch.setattr(substrings, "CHUNK", chunk)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.dedup(frame(spark, corpus)).collect()}
    assert got == removed_by_brute_force(corpus)


def test_substrings_edges(spark):
    assert substrings.dedup(frame(spark, [])).count() == 0
    twice = [(1, "x" * 60, None, None, 0), (1, "x" * 60, None, None, 0), (None, "x" * 60, None, None, 0)]
    got = sorted((r.doc_id is None, r.n_removed) for r in substrings.dedup(frame(spark, twice)).collect())
    assert got == [(False, 0), (False, 0), (True, 60)]


def bags(rows):
    w, f = word_hashes([normal_bytes(t) for _, t, *_ in rows])
    return [bag_as_set(shingles(w[f[k] : f[k + 1]])) for k in range(len(rows))]


def classes_by_brute_force(rows):
    b = bags(rows)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if len(b[i]) and len(b[j]) and jaccard(b[i], b[j]) >= 0.8:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {r[0]: rows[find(k)][0] for k, r in enumerate(rows)}


def test_bag_min_hash_estimates_weighted_jaccard():
    a, b = {i: 1 + i % 9 for i in range(40)}, {i: 1 + i % 5 for i in range(10, 50)}
    true = sum(min(a.get(i, 0), b.get(i, 0)) for i in range(50)) / sum(max(a.get(i, 0), b.get(i, 0)) for i in range(50))
    same = []
    for t in range(80):
        h = [neardup.mix(np.array([*x], np.uint64) + np.uint64(1000 * t)) for x in (a, b)]
        s = neardup.bag_min_hash(np.repeat([0, 1], 40), np.concatenate(h), np.array([*a.values(), *b.values()]), 2)
        same.append((s[0] == s[1]).mean())
    assert abs(np.mean(same) - true) < 0.03


def test_near_duplicates_equal_brute_force(spark, corpus):
    got = {r.doc_id: r.class_id for r in neardup.classes(frame(spark, corpus)).collect()}
    assert got == classes_by_brute_force(corpus)
    assert got[40] == 0 and got[43] == 1


def test_family_of_edited_copies_is_whole(spark):
    """Members that are not similar to the pivot still find each other by their differences."""
    rng = random.Random(3)
    base = words(rng, 120, 10**6)
    rows = []
    for v in range(3):  # three variants that differ by a quarter, each with light edits
        variant = list(base)
        variant[30 * v : 30 * v + 30] = words(rng, 30, 10**6)
        for _ in range(12):
            w = list(variant)
            w[rng.randrange(120)] = "edit"
            rows.append((len(rows), " ".join(w), None, None, 0))
    rows.append((len(rows), " ".join(base), None, None, 0))
    rng.shuffle(rows)
    rows = sorted(rows)
    got = {r.doc_id: r.class_id for r in neardup.classes(frame(spark, rows)).collect()}
    assert got == classes_by_brute_force(rows)
    assert len(set(got.values())) > 1


def linked_by_brute_force(sets):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in range(len(sets))}


@pytest.mark.parametrize("star", [8, 1024])
def test_open_groups_are_compared_in_full(spark, monkeypatch, star):
    """Families of two blocks each: every difference to a pivot is shared by members of several families."""
    monkeypatch.setattr(graph, "STAR", star)
    rng = random.Random(11)
    draw = lambda n: {rng.randrange(1 << 64) for _ in range(n)}
    parts = [draw(40 + k) for k in range(5)]
    sets = [parts[i] | parts[j] | draw(2) for i in range(5) for j in range(i) for _ in range(50)]
    rng.shuffle(sets)
    bags = spark.createDataFrame([(i, graph.pack(np.sort(np.array([*s], np.uint64)))) for i, s in enumerate(sets)], "id long, bag binary")
    keys = spark.createDataFrame([(i, 1) for i in range(len(sets))], "id long, key long")
    labels = {r.id: r.label for r in graph.link(keys, lambda wanted: wanted.join(bags, "id"), 0.8).collect()}
    want = linked_by_brute_force(sets)
    assert {i: labels.get(i, i) for i in want} == want
    assert len(set(want.values())) == 10


def test_a_hot_group_of_edited_copies_equals_brute_force(spark, monkeypatch):
    """500 copies of one text in three families, compared both as one small star and as large ones."""
    rng = random.Random(5)
    base = words(rng, 100, 10**6)
    rows = []
    for v in range(3):
        variant = list(base)
        variant[30 * v : 30 * v + 22] = words(rng, 22, 10**6)
        for _ in range(166):
            w = list(variant)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(100)] = f"edit{rng.randrange(40)}"
            rows.append((len(rows), " ".join(w), None, None, 0))
    rows += [(498, " ".join(base), None, None, 0), (499, " ".join(base), None, None, 0)]
    want = classes_by_brute_force(rows)
    for star in (1024, 64):
        monkeypatch.setattr(graph, "STAR", star)
        assert {r.doc_id: r.class_id for r in neardup.classes(frame(spark, rows)).collect()} == want
    assert 1 < len(set(want.values())) < 200


def edited_sets(rng, n):
    """Sets around one original: about half are not similar to it, and their rarest hashes are the original's."""
    base = [rng.randrange(1 << 64) for _ in range(100)]
    out = []
    for _ in range(n):
        k = rng.choice([1, 4, 9, 12, 13, 16])
        out.append(set(base) - set(rng.sample(base, k)) | {rng.randrange(1 << 64) for _ in range(k)})
    return out


def test_a_large_star_is_settled_in_one_step(spark, monkeypatch):
    """Not in a step for each pivot: the open members of a star have hashes in common with nearly all others."""
    monkeypatch.setattr(graph, "STAR", 32)
    steps = []
    stars = graph.stars
    monkeypatch.setattr(graph, "stars", lambda keys: steps.append(1) or (stars(keys) if len(steps) == 1 else pytest.fail("a second step")))
    sets = edited_sets(random.Random(7), 300)
    sets += [sets[-1] ^ {1 << 60}]
    bags = spark.createDataFrame([(i, graph.pack(np.sort(np.array([*s], np.uint64)))) for i, s in enumerate(sets)], "id long, bag binary")
    keys = spark.createDataFrame([(i, 1) for i in range(len(sets))], "id long, key long")
    labels = {r.id: r.label for r in graph.link(keys, lambda wanted: wanted.join(bags, "id"), 0.8).collect()}
    want = linked_by_brute_force(sets)
    assert {i: labels.get(i, i) for i in want} == want
    assert 50 < len(set(want.values())) < 250


def test_blocks_of_a_star_compare_all_pairs():
    """Each block alone and both against each other: together the links of the whole star."""
    rng = random.Random(2)
    sets = edited_sets(rng, 200) + edited_sets(rng, 60)
    bags = [graph.unpack(graph.pack(np.sort(np.array([*s], np.uint64)))) for s in sets]
    side = np.array([rng.randrange(2) for _ in sets])
    whole = graph.star_links([*range(len(sets))], 0, bags, 0.8)
    parts = graph.star_links([*range(len(sets))], None, bags, 0.8, side)
    for s in (0, 1):
        own = np.flatnonzero(side == s).tolist()
        parts += graph.star_links(own, None, [bags[k] for k in own], 0.8)
    for links in (whole, parts):
        label = {}
        for a, b in links:
            label.setdefault(a, set()).add(b)
            label.setdefault(b, set()).add(a)
        seen = {}
        for i in range(len(sets)):
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen[x] = i
                    todo += label.get(x, ())
        assert seen == linked_by_brute_force(sets)


@pytest.mark.skipif(not os.path.isdir(oracle.SF), reason="no driver tables")
def test_near_duplicates_of_the_given_table_equal_brute_force(spark):
    """Pairs that share a rare shingle are all that can be similar: the prefix principle, on one machine."""
    docs = spark.read.parquet(f"{oracle.SF.replace('0.001', '0.01')}/documents.parquet")
    got = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").sort("doc_id").collect()]
    sets = [set(b.tolist()) for b in bags(rows)]
    count = Counter(x for s in sets for x in s)
    index = defaultdict(list)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in enumerate(sets):
        near = set()
        for x in sorted(s, key=lambda x: (count[x], x))[: len(s) - -(-4 * len(s) // 5) + 1]:
            near.update(index[x])
            index[x].append(k)
        for j in near:
            if 5 * len(s & sets[j]) >= 4 * len(s | sets[j]):
                a, b = find(k), find(j)
                parent[max(a, b)] = min(a, b)
    want = {rows[k][0]: rows[find(k)][0] for k in range(len(rows))}
    wrong = [i for i in want if want[i] != got[i]]
    assert not wrong and len(set(want.values())) < len(rows)


def test_keep_one_keeps_all_columns(spark, corpus):
    rows = [*corpus, corpus[7]]
    docs = frame(spark, rows)
    got = neardup.keep_one(docs)
    assert got.columns == docs.columns
    want = {i for i, c in classes_by_brute_force(corpus).items() if i == c}
    assert sorted(r.doc_id for r in got.collect()) == sorted(want)
    odd = [(None, corpus[7][1], None, None, 0), (None, None, None, None, 0), (None, None, None, None, 0), (7, "other words " * 20, None, None, 0)]
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in neardup.keep_one(frame(spark, [*rows, *odd])).collect())
    assert got == sorted([(False, i) for i in want] + [(True, 0)])
    assert neardup.keep_one(frame(spark, [])).count() == 0


def test_keep_one_of_a_large_group_of_edited_copies(spark, monkeypatch):
    """The pipeline's second stage: about half of the copies are not similar to the original, and stay."""
    monkeypatch.setattr(graph, "STAR", 32)
    steps = []
    stars = graph.stars
    monkeypatch.setattr(graph, "stars", lambda keys: steps.append(1) or (stars(keys) if len(steps) == 1 else pytest.fail("a second step")))
    rng = random.Random(9)
    base = words(rng, 100, 10**6)
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5])):
            w[rng.randrange(100)] = f"edit{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), None, None, 0))
    want = {i for i, c in classes_by_brute_force(rows).items() if i == c}
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, frame(spark, rows), "").collect()) == sorted(want)
    assert 50 < len(want) < 250


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(50, 40), (40, 60), (99, 98)]
    got = {r.id: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 31)}, 40: 40, 50: 40, 60: 40, 98: 98, 99: 98}


def test_paragraphs_catch_passages_and_leave_the_rest(spark, corpus):
    got = {r.doc_id: r for r in paragraphs.dedup(frame(spark, corpus)).collect()}
    n = len(corpus)
    copies = {40, 41, 42}
    assert all(got[i].n_removed > 0.9 * got[i].n_bytes for i in copies if len(corpus[i][1].split()) > 30)
    pasted = [i for i in (47, 48)]
    assert got[pasted[1]].n_removed > 0  # the passage is in an earlier document too
    assert all(got[i].n_removed == 0 for i in range(40))
    assert len(got) == n and all(r.n_removed == 0 for r in got.values() if r.n_bytes < 50)
    for r in got.values():
        assert r.n_removed == sum(s.end - s.begin for s in r.spans) <= r.n_bytes
    assert paragraphs.dedup(frame(spark, [])).count() == 0


def plain_words(raw):
    """(word, begin, end) of the bytes: lower case, ASCII punctuation as separators."""
    low = bytes(c + 32 if 65 <= c <= 90 else 32 if 33 <= c <= 126 and not chr(c).isalnum() else c for c in raw)
    return [(m.group(), m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", low)]


def spans_by_brute_force(rows):
    """Removed byte spans per row number, from all pairs of paragraphs and all sentences."""
    lines, sentences = [], []
    for n, (i, t, *_) in enumerate(rows):
        raw, at = (t or "").encode(), 0
        for line in raw.split(b"\n"):
            w = [(x, b + at, e + at) for x, b, e in plain_words(line)]
            if len(w) >= paragraphs.MIN_WORDS and i is not None:
                names = [x for x, *_ in w]
                lines.append((n, i, w[0][1], w[-1][2], {tuple(names[k : k + 5]) for k in range(len(names) - 4)}))
            begin = 0
            for m in [*re.finditer(rb"[.!?](?=[\x20\x09-\x0D]|$)", line), None]:
                end = m.end() if m else len(line)
                own = [x for x in w if begin <= x[1] - at < end]
                if len(own) >= paragraphs.MIN_SENTENCE and i is not None:
                    sentences.append((n, i, own[0][1], own[-1][2], len(own), b" ".join(x for x, *_ in own)))
                begin = end
            at += len(line) + 1
    group = linked_by_brute_force([p[4] for p in lines])
    first = {}
    for k, p in enumerate(lines):
        first[group[k]] = min(first.get(group[k], p[1]), p[1])
    found = defaultdict(list)
    for k, (n, i, b, e, _) in enumerate(lines):
        if i > first[group[k]]:
            found[n].append((b, e))
    earliest = {}
    for _, i, _, _, _, text in sentences:
        earliest[text] = min(earliest.get(text, i), i)
    for n in range(len(rows)):
        run = []
        for s in [*(s for s in sentences if s[0] == n), None]:
            if s is not None and earliest[s[5]] < s[1]:
                run.append(s)
                continue
            if sum(x[4] for x in run) >= paragraphs.MIN_WORDS:
                found[n].append((run[0][2], run[-1][3]))
            run = []
    gone = {}
    for n, (_, t, *_) in enumerate(rows):
        marks = bytearray(len((t or "").encode()))
        for b, e in found[n]:
            marks[b:e] = b"\1" * (e - b)
        gone[n] = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(marks))]
    return gone


def test_paragraphs_equal_brute_force(spark, corpus):
    rng = random.Random(21)
    rows = list(corpus)
    for k in range(12):  # near copies of paragraphs, several edits apart, in new surroundings
        lines = rows[k % 6][1].split("\n")
        w = lines[0].split(" ")
        for _ in range(k % 3):
            w[rng.randrange(len(w))] = "edit"
        rows.append((200 + k, "\n".join([" ".join(words(rng, 30)), " ".join(w), ""]), None, None, 0))
    rows += [(None, rows[0][1], None, None, 0), rows[41], (41, rows[1][1], None, None, 0)]
    want = spans_by_brute_force(rows)
    got = paragraphs.dedup(frame(spark, rows)).collect()
    key = lambda i, n, spans: (i is None, i or 0, n, spans)
    assert sorted(key(r.doc_id, r.n_bytes, [(s.begin, s.end) for s in r.spans]) for r in got) == sorted(key(r[0], len((r[1] or "").encode()), want[n]) for n, r in enumerate(rows))
    assert sum(bool(x) for x in want.values()) >= 12


def test_min_hash_bands_find_similar_paragraphs(spark):
    rng = random.Random(2)
    rows = []
    for k in range(30):
        w = words(rng, 120, 10**6)
        rows.append((2 * k, " ".join(w), None, None, 0))
        w[60] = "other"
        rows.append((2 * k + 1, " ".join(w), None, None, 0))
    got = [r.doc_id for r in paragraphs.dedup(frame(spark, rows)).where("n_removed > 0").collect()]
    assert set(got) <= {2 * k + 1 for k in range(30)} and len(got) >= 28


# quality


def base_by_brute_force(text):
    t = text or ""
    w = WORD.findall(t)
    n3 = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k + i for k in range(len(w) - 2) if n3[tuple(w[k : k + 3])] > 1 for i in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_quality_figures_equal_brute_force(spark, corpus):
    odd = [(900 + k, t, "en", None, 0) for k, t in enumerate(["a b c a b c\n\nx\nx\n \n ", "###| <é> ß\x0bq\x0cr\x85s", "日本 語 " * 70, "same line\nsame line\nsame line ", " "])]
    rows = [*corpus, *odd, corpus[3]]
    got = quality.judge(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t, *_ in rows:
        r = by[i]
        want = base_by_brute_force(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, i
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)


def share(counts):
    total = sum(counts)
    return [c * 1_000_000 // max(total, 1) for c in counts]


def histograms(text):
    """Parts per million of the character classes and of the common words of a text."""
    t = text or ""
    kinds = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "\t\x0b\x0c\r ", "\n", ".,;:!?'\"()-", "#*$%&|<>"]
    chars = [0] * 9
    for c in t:
        chars[8 if ord(c) > 127 else next((k for k, s in enumerate(kinds) if c in s), 7)] += 1
    order = sorted(set(quality.COMMON_WORDS), key=lambda w: int(word_hashes([normal_bytes(w)])[0][0]))
    words = Counter(normal_bytes(t).split())
    own = [words[w.encode()] for w in order]
    return share(chars), share([*own, sum(words.values()) - sum(own)])


def divergence(p, q):
    p, q = [x / max(sum(p), 1) for x in p], [x / max(sum(q), 1) for x in q]
    part = lambda a: sum(x * math.log2(2 * x / (x + y)) for x, y in a if x > 0)
    return math.sqrt(max((part(zip(p, q)) + part(zip(q, p))) / 2, 0))


def test_quality_verdicts_equal_brute_force(spark):
    rng = random.Random(12)
    common = quality.COMMON_WORDS
    rows = []
    for i in range(150):
        kind = i % 15
        if kind < 13:
            t = " ".join(rng.choice(common) if rng.random() < 0.4 else f"w{'abcdefgh'[rng.randrange(8)] * rng.randrange(2, 7)}{rng.randrange(9)}" for _ in range(rng.randrange(40, 300))) + ".\nÄnd"
        elif kind == 13:
            t = " ".join(f"{rng.randrange(10**6)} # {rng.choice('<>|')}" for _ in range(rng.randrange(20, 90)))
        else:
            t = " ".join(rng.choice(["XX", "YY", "the"]) + str(rng.randrange(50)) for _ in range(rng.randrange(90, 130)))
        rows.append((i, t, [None, "en", "rare"][0 if i % 3 == 0 else 1 if i % 40 else 2], None, 0))
    rows += [(150, None, None, None, 0), (151, "", "en", None, 0), rows[3]]
    base = {i: base_by_brute_force(t) for i, t, *_ in rows}
    failed = lambda i: base[i][0] < 50 or 100 * base[i][4] > 50 * base[i][0]
    hist = {i: histograms(t) for i, t, *_ in rows}
    refs = {}
    for lang in {r[2] for r in rows}:
        good = [r[0] for r in rows if r[2] == lang and not failed(r[0])]
        if len(good) >= quality.MIN_REFERENCE:
            refs[lang] = [[sum(c) for c in zip(*(hist[i][k] for i in good))] for k in (0, 1)]
    got = {r.doc_id: r for r in quality.judge(frame(spark, rows)).collect()}
    kept = set()
    for i, _, lang, *_ in rows:
        want = [divergence(hist[i][k], refs[lang][k]) if lang in refs and base[i][0] >= least else None for k, least in ((0, 50), (1, 100))]
        have = [got[i].char_distance, got[i].word_distance]
        assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9) for a, b in zip(want, have)), i
        ok = not failed(i) and all(d is None or d <= most for d, most in zip(want, (quality.MAX_CHAR_DISTANCE, quality.MAX_WORD_DISTANCE)))
        assert got[i].kept == ok, i
        kept |= {i} if ok else set()
    assert "rare" not in refs and None in refs and 20 < len(kept) < 140
    assert sorted(r.doc_id for r in quality.keep(frame(spark, rows)).collect()) == sorted(i for i, *_ in rows if i in kept)


def test_quality_rejects_junk_and_keeps_prose(spark):
    rng = random.Random(1)
    prose = "the of and to in is that for it as with was on are by this be".split()
    rows = [(i, " ".join(rng.choice(prose) if rng.random() < 0.45 else f"wo{rng.randrange(500)}rd".replace("0", "a") for _ in range(200)) + ".", "en", "s", 0) for i in range(80)]
    rows += [(100 + i, " ".join(f"{rng.choice('#$%&|')*3}{rng.randrange(10**6)}" for _ in range(200)), "en", "s", 0) for i in range(5)]
    docs = frame(spark, rows)
    kept = {r.doc_id for r in quality.keep(docs).collect()}
    assert kept == set(range(80))
    assert quality.keep(docs).columns == docs.columns
    assert quality.keep(frame(spark, [])).count() == 0


# decontamination


def test_leaks_equal_brute_force(spark):
    rng = random.Random(9)
    items = [(i, ". ".join(" ".join(words(rng, rng.randrange(6, 14), 400)) for _ in range(3))) for i in range(60)] + [(60, "too short"), (61, None), (62, "")]
    docs = []
    for i in range(120):
        w = words(rng, rng.randrange(0, 400), 400)
        if i % 4 == 0:
            item = items[i % 60][1].split()
            if i % 8 == 0 and len(item) > 25:
                item[0] = "changed"
            at = rng.randrange(len(w) + 1)
            w[at:at] = item
        docs.append((i, " ".join(w).upper() if i % 5 == 0 else " ".join(w), None, None, 0))
    docs += [(500, None, None, None, 0), (501, "Too, SHORT!", None, None, 0), (502, "not too short", None, None, 0), (503, "five words make an item", None, None, 0), (504, " ".join(words(rng, 40, 400)) + " five words make an item", None, None, 0)]
    items.append((63, "Five words make an item."))
    index = decontamination.Index([x for x in items if x[1]])
    want = set()
    for i, t, *_ in docs:
        w = word_hashes([normal_bytes(t)])[0]
        for k in range(len(index.ids)):
            size, step = 2 * index.longest, index.longest
            for b in range(0, max(1, len(w)), step):
                part = w[b : b + size]
                if len(part) and index.verify(k, part)[0] >= 0.8 and index.verify(k, part)[1] >= 0.5:
                    want.add((i, index.ids[k]))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(3))
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(frame(spark, docs), bench).collect()}
    assert {x for x in got if x[1] == 60} == {(501, 60)} and {(503, 63), (504, 63)} <= got
    assert got - {(501, 60)} == want and len(want) >= 28
    assert decontamination.leaks(frame(spark, docs), bench.limit(0)).count() == 0
    assert decontamination.leaks(frame(spark, []), bench).count() == 0


def test_index_in_parts_gives_the_same(spark, monkeypatch):
    rng = random.Random(4)
    items = [(i, " ".join(words(rng, 20, 10**5))) for i in range(30)]
    docs = frame(spark, [(i, items[i][1], None, None, 0) for i in range(30)])
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontamination, "INDEX_BYTES", 1000)
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, bench).collect()} == {(i, i) for i in range(30)}


def test_wand_equals_exhaustive_scoring():
    rng = random.Random(6)
    index = decontamination.Index([(i, " ".join(words(rng, rng.randrange(6, 30), 60))) for i in range(100)])
    index.threshold = 0.3
    for _ in range(100):
        terms = sorted(rng.sample(range(len(index.terms)), 20))
        scores = defaultdict(float)
        for t in terms:
            for item, x in index.postings[t]:
                scores[item] += x
        want = {i: s for i, s in scores.items() if s >= 0.3}
        got = dict(index.wand(terms))
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got)


# mixing


def level_targets(sizes, weights, total):
    """Iterative resharing."""
    target = dict.fromkeys(sizes, 0.0)
    free, rest = set(sizes), total
    while free:
        w = sum(weights[s] for s in free)
        over = {s for s in free if rest * weights[s] / w > 2 * sizes[s]}
        if not over:
            return target | {s: rest * weights[s] / w for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
        rest -= sum(2.0 * sizes[s] for s in over)
        free -= over
    return target


def test_mix_follows_targets(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(words(rng, rng.randrange(0, 300))) if i % 50 else None, None, rng.choice(["a", "b", "c", "é", "Z", None, "a", "a"]), 0) for i in range(600)]
    rows.append(rows[10])
    got = mixing.mix(frame(spark, rows)).toPandas()
    again = mixing.mix(frame(spark, rows).repartition(7)).toPandas()
    key = ["doc_id", "size", "taken", "target"]
    assert got[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()
    assert len(got) == 601 and (got["taken"] <= 2 * got["size"]).all()
    size = Counter()
    for _, t, _, s, _ in rows:
        size[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    target = level_targets(size, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(size.values()))
    for s in order:
        own = got[got["source"].isna() if s is None else got["source"] == s]
        assert abs(own["target"].iloc[0] - target[s]) < 1e-6 and own["source_size"].iloc[0] == size[s]
        assert abs(own["taken"].sum() - target[s]) <= max(0.05 * target[s], -(-size[s] // mixing.PARTS))
    assert mixing.mix(frame(spark, [])).count() == 0


def test_small_sources_beside_a_hot_one_meet_their_targets(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(words(rng, 200)), None, "hot", 0) for i in range(150)]
    for k in range(20):
        rows += [(1000 + 10 * k + j, " ".join(words(rng, 20 + 4 * k)), None, f"tail{k:02}", 0) for j in range(3)]
    got = mixing.mix(frame(spark, rows)).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert len(got) == 21 and all(abs(r.taken - r.target) <= 0.1 * r.target for r in got)


def test_mix_materialised(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(words(rng, 50)), "en", "abc"[i % 3], 0) for i in range(300)] + [(7, " ".join(["x"] * 40), "en", None, 0)]
    docs = frame(spark, rows)
    out = mixing.materialise(docs)
    assert out.columns == docs.columns
    n = Counter(r.source for r in out.collect())
    assert n["a"] > n["b"] > n["c"] > 0 and n["a"] <= 200


# sharding


def tree_by_brute_force(units, leaves):
    """Shard of each unit (row of units_of): the rule of the tree, on sorted lists."""
    home = {}

    def halve(own, first, share, level):
        if share == 1 or not own:
            home.update({(u.group, u.size, u.part): first for u in own})
            return
        total = sum(u.weight for u in own)
        spread = []
        for d in sharding.DIMENSIONS:
            x = [u[d] >> (sharding.BITS - sharding.COARSE) for u in own]
            spread.append(total * sum(u.weight * v * v for u, v in zip(own, x)) - sum(u.weight * v for u, v in zip(own, x)) ** 2)
        dim = sharding.DIMENSIONS[spread.index(max(spread))]
        order = sorted(own, key=lambda u: ((((2 << sharding.BITS) - 1 if u.tie >> level & 1 else 0) if u.heavy else u[dim] + 1), u.tie))
        left = share // 2
        goal, upto, k = total * left // share, 0, 0
        while upto + order[k].weight <= goal:
            upto, k = upto + order[k].weight, k + 1
        if upto + order[k].weight - goal < goal - upto:
            k += 1
        halve(order[:k], first, left, level + 1)
        halve(order[k:], first + left, share - left, level + 1)

    halve(list(units), 0, leaves, 0)
    return home


def test_tree_equals_brute_force(spark):
    rng = random.Random(13)
    rows = [(i, "y" * int(2 ** (rng.random() * 11)) + str(rng.randrange(700)), rng.choice(["en", "fr", None]), f"s{min(int(rng.expovariate(0.3)), 9)}", 0) for i in range(1200)]
    rows += [(2000 + i, "copy " * 30, "en", "hot", 0) for i in range(60)] + [(3000 + i, "hot copy " * 40, "en", "hot", 0) for i in range(300)]
    light = sharding._light(frame(spark, rows), "doc_id", "text", "source", "lang")
    total = light.agg(F.sum("size")).first()[0]
    for leaves in (1, 5, 16):
        parts, units = sharding.units_of(light, leaves, total)
        listed = units.collect()
        got = {(r.group, r.size, r.part): r.shard for r in sharding.tree(units, leaves).collect()}
        assert got == tree_by_brute_force(listed, leaves)
        assert sum(u.weight for u in listed) == total and parts.count() == len(rows)
    # of groups of equal texts only those above SPLIT of a target are dealt out
    several = {g for g, n in Counter((u.group, u.size) for u in listed).items() if n > 1}
    weight = Counter()
    for u in listed:
        weight[u.group, u.size] += u.weight
    assert several and several == {g for g, w in weight.items() if w > sharding.SPLIT * total / 16}


def test_shards_are_even_and_slots_gapless(spark, corpus):
    rng = random.Random(2)
    rows = [(i, "x" * rng.randrange(2000), rng.choice(["en", "fr", None]), f"s{rng.randrange(5)}", 0) for i in range(1500)] + [(5000 + i, "copy " * 200, "en", "hot", 0) for i in range(800)] + [(None, None, None, None, 0), (3, "dup", None, None, 0), (3, "dup", None, None, 0)]
    got = sharding.shard(frame(spark, rows), 16).toPandas()
    assert len(got) == len(rows) and set(got["shard"]) == set(range(16))
    per = got.groupby("shard")["size"].sum()
    assert per.max() - per.min() < 0.05 * per.mean()
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    again = sharding.shard(frame(spark, rows).repartition(5), 16).toPandas()
    cols = ["text_crc32", "size", "shard"]
    assert got[cols].sort_values(cols).values.tolist() == again[cols].sort_values(cols).values.tolist()
    assert sharding.shard(frame(spark, []), 16).count() == 0
    assert sharding.shard(frame(spark, corpus), target_bytes=2000).count() == len(corpus)
