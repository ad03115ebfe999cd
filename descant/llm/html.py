"""Main text of web pages: the host suffix array, with page structure as protection and evidence.

A page is cut into blocks by its block-level tags, in one pass. Structure says of each block what it can: parts
that HTML itself names (nav, footer, aside, form and the like) and elements whose class, id or role names such a
part and nothing else (comments, ad-slot-3) are marked; prose inside the article is protected, headings too. A
name of which only a part does (social-history, story-search) marks weakly: its block goes if the array finds the
same element and name on MIN_PAGES pages of the host, wherever they stand there, and stays otherwise. The
article is the clean `article` elements, else those that stand in marked wrappers; `main` where the
articles are not half of its text. An element that holds the article is never marked by its name. What
structure leaves open is decided by the host suffix array: blocks of pages without article and main, and
short blocks inside an article that are no sentence (share lines, labels). Outside the article of a page
that has one, nothing is text.

The token streams of marked and open blocks, names before words, of all distinct pages of a host are concatenated, the suffix
array over them is built by prefix doubling, and tokens covered by a run of at least MIN_RUN tokens that
MIN_PAGES distinct pages hold are boilerplate; an open block goes if COVERED of its tokens are covered.
Prose inside an article is never removed for being repeated: passages that articles share are content.

Hosts are dealt into shards of about SHARD pages by the hash of the whole page, so that no task holds a hot
host. Equal pages are in one shard and count once; for hosts of several shards each shard's suffix array
gives its runs with their pages, these are summed over the host, and the runs that MIN_PAGES pages hold go
back to the shards that have them.

Edge cases: null or empty html gives the empty text; a null url has the empty host; elements that are not closed
end where the document ends, a head at the first element or text that it cannot hold; a known tag that is
not closed ends at the next `<` or with the page, an unclosed comment or script with the page; repeated rows give equal rows;
other columns are ignored. Time is in proportion to a page's length, however it is malformed.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded, cut, mix, release
from .urls import host_of

MIN_RUN, MIN_PAGES, SHARD = 6, 3, 1_000
COVERED = 0.9  # of a block's tokens, to drop it
LABEL_WORDS = 8  # a block inside an article of at most so many words and without a sentence end is open
#: Elements that hold no text of the page, and those that HTML itself names as no part of an article (fixed values).
SILENT = frozenset("head title script style noscript template iframe object embed svg canvas audio video select option optgroup textarea button datalist".split())
NAMED = frozenset("nav aside footer form dialog menu".split())
#: Elements without an end tag, those whose start ends a block, those without markup inside, and those that may
#: stand in the head; any other ends it (fixed values of HTML).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
IN_HEAD = frozenset("base head html link meta noscript script style template title".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark picture q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Parts of class tokens and ids that mark what is not the article, and those that take it back (fixed values).
MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements adsense sponsor sponsored sponsors promo promos promotion banner banners sidebar menu menus nav navbar navigation breadcrumb breadcrumbs masthead "
    "header footer cookie cookies consent notice notices alert popup modal newsletter subscribe signup login share sharing social related recommended recommendations comment comments commentlist disqus "
    "respond reply replies widget widgets toolbar pagination pager copyright disclaimer search form".split()
)
STATES = frozenset("has no with without is not hide show js".split())
OWN = frozenset("article content entry page post story".split())  # "post-header" holds a title
#: Parts that say only where or how a marked element stands (fixed values).
PLACES = frozenset("area bar block bottom box container group inner item items left link links list main outer panel posts right row section site slot thread top unit wrap wrapper".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
_NAME = re.compile(r"</?([a-zA-Z][^\s/<>]*)")
_SKIP = re.compile(r"[\s/]*")
_ATTR = re.compile(r"(=?[^\s/<>=]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s<>\"'][^\s>]*)?)?")
_SPACE = re.compile(r"\s+")
_SENTENCE = re.compile(r"[.!?…:;。！？]\W*$")
#: What becomes of a block. A WEAK one is open too, with the name that may mark it as evidence.
MARKED, OPEN, SAFE, WEAK = 0, 1, 2, 3

#: How sure a mark is: by a part of a name, by a whole class, id or role, or by the element itself.
BY_PART, BY_NAME, BY_TAG = 1, 2, 3


@lru_cache(1 << 16)
def _mark_of(token: str) -> int:
    """A class token or id: BY_NAME if it says nothing but what is marked and where it stands, BY_PART if it
    says something else too (`social-history`), else 0."""
    parts = [x for x in re.split(r"[-_]+", token) if x]
    if not parts or parts[0] in STATES or parts[0] in OWN and parts[-1] in ("header", "form") or MARKS.isdisjoint(parts):
        return 0
    return BY_NAME if all(x in MARKS or x in PLACES or x.isdigit() for x in parts) else BY_PART


def _marked(tag: str, attributes: list[tuple[str, str]], inside: bool) -> tuple[int, str | None]:
    """The mark of an element and, of a mark by part, the name that it is by."""
    if tag in NAMED and not (inside and tag == "menu") or tag == "header" and not inside:
        return BY_TAG, None
    best: tuple[int, str | None] = (BY_PART, "menu") if tag == "menu" else (0, None)
    if tag in ("html", "body"):
        return best
    for name, value in attributes:
        value = value.lower()
        if name == "hidden" and value in ("", "hidden"):
            return BY_TAG, None
        if name == "role" and value.strip() in ROLES:
            best = BY_NAME, None
        elif name in ("class", "id"):
            for token in value.split():
                if (sure := _mark_of(token)) > best[0]:
                    best = sure, f"{tag}.{token}" if sure == BY_PART else None
    return best


class _Element:
    """An open element with what holds from the page's root down to it. Inside an article or main only marks
    from that element on count: its wrappers say nothing about its text."""

    __slots__ = ("article", "block", "main", "mark", "name", "seen", "silent", "tag", "tainted")

    def __init__(self, tag: str, own: tuple[int, str | None], up: _Element | None, at: int) -> None:
        self.tag = tag
        self.silent = tag in SILENT or up is not None and up.silent
        inside = up is not None and (up.article or up.main)
        root = tag == "article" and not (inside and own[0] >= BY_NAME) or tag == "main"
        if root:  # a page's own article is not marked by its class
            own = 0, None
        #: Whether an article or main stands in a marked wrapper, and whether any element is marked.
        self.tainted = up is not None and (up.tainted or root and up.seen)
        self.seen = up is not None and up.seen or own[0] >= BY_NAME
        self.article = root and tag == "article" or up is not None and up.article
        self.main = root and tag == "main" or up is not None and up.main
        self.mark, self.name = own if root and not inside or up is None or own[0] > up.mark else (up.mark, up.name)
        #: The place of the nearest block-level element on the stack, itself included.
        self.block = at if tag in BLOCK else up.block if up is not None else -1


class _Block:
    """A block's text, the tag it stands in, its mark, and whether it stands in an article, in one outside
    marked wrappers, in main."""

    __slots__ = ("article", "clean", "main", "marked", "name", "tag", "text")

    def __init__(self, text: str, marked: int, name: str | None, at: _Element | None) -> None:
        self.text, self.marked, self.name = text, marked, name
        self.tag, self.article, self.main, self.clean = (at.tag, at.article, at.main, at.article and not at.tainted) if at else ("", False, False, False)


def _tag_at(page: str, at: int) -> tuple[int, str, list[tuple[str, str]], bool] | None:
    """The tag that starts at `at`: (end, name, attributes, closes itself). A quote counts at the start of a value
    only. A known tag without an end stops at the next `<` or with the page; what is no tag gives None."""
    m = _NAME.match(page, at)
    if m is None:
        return None
    tag, pos, attributes = m[1].lower(), m.end(), []
    while True:
        pos = _SKIP.match(page, pos).end()
        c = page[pos : pos + 1]
        if c == ">":
            return pos + 1, tag, attributes, page[pos - 1] == "/"
        if not c or c == "<":
            known = tag in BLOCK or tag in VOID or tag in RAW or tag in INLINE
            return (pos, tag, attributes, False) if known else None
        m = _ATTR.match(page, pos)
        value = m[2] or ""
        attributes.append((m[1].lower(), value[1:-1] if value[:1] in ("'", '"') else value))
        pos = max(m.end(), pos + 1)


def _pieces(page: str) -> list[_Block]:
    """The blocks of a page in its order, silent parts left out. One pass: nothing is looked for twice."""
    found: list[_Block] = []
    text: list[tuple[str, int, str | None]] = []
    stack: list[_Element] = []
    open_tags: Counter[str] = Counter()

    def cut_to(k: int) -> None:
        for e in stack[k:]:
            open_tags[e.tag] -= 1
        del stack[k:]

    def add(s: str) -> None:
        if stack and stack[-1].tag == "head" and not s.isspace():
            cut_to(len(stack) - 1)  # text ends the head
        if not stack:
            text.append((s, 0, None))
        elif not stack[-1].silent:
            text.append((s, stack[-1].mark, stack[-1].name))

    def flush() -> None:
        for mark, name in sorted({(m, n or "") for _, m, n in text}):
            s = _SPACE.sub(" ", _html.unescape("".join(t for t, m, n in text if (m, n or "") == (mark, name)))).strip()
            if s:
                found.append(_Block(s, mark, name or None, stack[-1] if stack else None))
        text.clear()

    pos, n = 0, len(page)
    while pos < n:
        at = page.find("<", pos)
        if at != pos:
            add(page[pos : at if at >= 0 else n])
        if at < 0:
            break
        if page.startswith(("<!", "<?"), at):
            comment = page.startswith("<!--", at)
            end = page.find("-->", at + 2) if comment else page.find(">", at)
            pos = n if end < 0 else end + (3 if comment else 1)
            continue
        start = _tag_at(page, at)
        if start is None:
            add("<")
            pos = at + 1
            continue
        pos, tag, attributes, closed = start
        ends = page[at + 1] == "/"
        if not ends and tag not in IN_HEAD and open_tags["head"]:
            cut_to(next(k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == "head"))
        if tag in BLOCK:
            flush()
        elif tag == "br":
            add(" ")
        if ends:
            if open_tags[tag]:
                cut_to(next(k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == tag))
            continue
        if tag in VOID or closed and tag not in BLOCK:
            continue
        if tag in RAW:  # no markup inside
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, pos)
            pos = end.end() if end else n
            continue
        if tag in BLOCK:  # a block ends an open paragraph; an item ends the open one of its kind
            kinds = {"p"} | ({tag} if tag in ("li", "tr", "td", "th") else {"dt", "dd"} if tag in ("dt", "dd") else set())
            k = stack[-1].block if stack else -1
            while k >= 0:
                if stack[k].tag in kinds:
                    cut_to(k)
                    break
                if tag != "tr" or stack[k].tag not in ("td", "th"):
                    break
                k = stack[k - 1].block if k else -1
        up = stack[-1] if stack else None
        stack.append(_Element(tag, _marked(tag, attributes, up is not None and (up.article or up.main)), up, len(stack)))
        open_tags[tag] += 1
    flush()
    return found


Piece = tuple[str, int, str | None]


def blocks(page: str) -> list[Piece]:
    """(text, MARKED, OPEN, SAFE or WEAK, the name of a weak mark) of the blocks of a page."""
    found = _pieces(page)
    size = lambda keep: sum(len(b.text) for b in found if keep(b) and b.marked < BY_NAME)
    article = (lambda b: b.clean) if size(lambda b: b.clean) else (lambda b: b.article)
    in_article, in_main = size(article), size(lambda b: b.main)
    text = (lambda b: b.main or article(b)) if 2 * in_article < in_main else article if in_article else None
    # where everything is marked by names alone, they are not believed
    least = BY_NAME if text or size(lambda b: True) else BY_TAG
    out = []
    for b in found:
        if b.marked >= least or text is not None and not text(b):
            out.append((b.text, MARKED, b.name))
        elif b.name:
            out.append((b.text, WEAK, b.name))
        elif text is None or len(b.text.split()) <= LABEL_WORDS and b.tag not in HEADINGS and not _SENTENCE.search(b.text):
            out.append((b.text, OPEN, None))
        else:
            out.append((b.text, SAFE, None))
    return out


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling; stops when MIN_RUN tokens or more are in order."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    step = 1
    order = np.argsort(rank, kind="stable")
    while step < max(MIN_RUN * 8, 2) and n:
        second = np.full(n, -1, np.int64)
        second[: n - step] = rank[step:]
        order = np.lexsort((second, rank))
        a, b = rank[order], second[order]
        new = np.concatenate([[0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            break
        step *= 2
    return order


class Runs:
    """The runs of min_run tokens of streams; streams of one page, or of equal ones, count once."""

    def __init__(self, streams: list[list[str]], pages: list | None = None, min_run: int = MIN_RUN) -> None:
        self.min_run = min_run
        pages = list(map(tuple, streams)) if pages is None else pages
        first: dict = {}
        self.of = [first.setdefault(p, len(first)) for p in pages]
        self.distinct = list(dict(zip(self.of[::-1], streams[::-1], strict=True)).items())
        self.distinct = [s for _, s in sorted(self.distinct, key=lambda x: x[0])]
        ids: dict[str, int] = {}
        parts, owner = [], []
        for k, s in enumerate(self.distinct):
            parts += [ids.setdefault(t, len(ids)) for t in s]
            parts.append(-1 - k)  # a separator of its own: no run crosses pages
            owner += [k] * (len(s) + 1)
        tokens, own = np.array(parts, np.int64), np.array(owner, np.int64)
        self.words = list(ids)
        self.order, self.group, self.pages = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.n = len(tokens)
        if self.n:
            self.order = suffix_array(tokens)
            padded = np.concatenate([tokens, np.full(min_run, -(1 << 40))])
            self.heads = np.stack([padded[self.order + i] for i in range(min_run)])
            same = np.concatenate([[False], (self.heads[:, 1:] == self.heads[:, :-1]).all(0)])
            self.group = np.cumsum(~same)
            pairs = np.unique(np.stack([self.group, own[self.order]]), axis=1)
            self.pages = np.bincount(pairs[0], minlength=self.group[-1] + 1)

    def hashed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, hash that streams elsewhere share, pages) of each run that lies inside a page."""
        if not self.n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        first = np.flatnonzero(np.concatenate([[True], self.group[1:] != self.group[:-1]]))
        first = first[(self.heads[:, first] >= 0).all(0)]
        word = np.array([int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for w in self.words], np.uint64)
        h = np.zeros(len(first), np.uint64)
        with np.errstate(over="ignore"):
            for row in self.heads[:, first]:
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + word[row])
        return self.group[first], h, self.pages[self.group[first]]

    def covered(self, wanted: np.ndarray) -> list[np.ndarray]:
        """Per stream which tokens lie in a run whose group is wanted."""
        covered = np.zeros(self.n, bool)
        for start in self.order[wanted[self.group]] if self.n else ():
            covered[start : start + self.min_run] = True
        out, at = [], 0
        for s in self.distinct:
            out.append(covered[at : at + len(s)])
            at += len(s) + 1
        return [out[k] for k in self.of]


def repeated(streams: list[list[str]], min_run: int = MIN_RUN, min_pages: int = MIN_PAGES) -> list[np.ndarray]:
    """Per stream which tokens lie in a run of min_run tokens that min_pages streams of distinct content hold."""
    runs = Runs(streams, min_run=min_run)
    return runs.covered(runs.pages >= min_pages)


def _tokens(piece: Piece) -> list[str]:
    """A block's words; before them its name MIN_RUN times, so that a name is a run of its own."""
    text, _, name = piece
    return [f"\0{name}"] * (MIN_RUN if name else 0) + text.split()


def _stream(page: list[Piece]) -> list[str]:
    return [t for piece in page for t in _tokens(piece)]


def boilerplate(pages: list[list[Piece]], marks: list, frequent: set[int] | None = None) -> list[list[int]]:
    """Per page, given as its marked and open blocks, the numbers of the open blocks that go: repeated runs cover
    their words, or the name of a weak mark is a repeated run itself. frequent: hashes of the host's repeated
    runs, where the pages are but a part of the host."""
    runs = Runs(list(map(_stream, pages)), marks)
    wanted = runs.pages >= MIN_PAGES
    if frequent is not None:
        group, h, _ = runs.hashed()
        wanted = np.zeros(len(runs.pages), bool)
        wanted[group] = np.isin(h.view(np.int64), np.fromiter(frequent, np.int64, len(frequent)))
    out = []
    for page, hit in zip(pages, runs.covered(wanted), strict=True):
        gone, at, k = [], 0, 0
        for piece in page:
            n, named = len(_tokens(piece)), MIN_RUN if piece[2] else 0
            if piece[1] in (OPEN, WEAK):
                words = hit[at + named : at + n]
                if named and hit[at : at + named].all() or words.sum() >= COVERED * max(len(words), 1):
                    gone.append(k)
                k += 1
            at += n
        out.append(gone)
    return out


_BLOCK = pa.list_(pa.struct([("text", pa.string()), ("kind", pa.int8()), ("name", pa.string())]))
_FOUND = pa.schema([("mark", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("kept", _BLOCK), ("stream", _BLOCK)])
_FOUND_DDL = "mark long, page_id long, url string, kept array<struct<text:string,kind:tinyint,name:string>>, stream array<struct<text:string,kind:tinyint,name:string>>"


def _cut_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, len(batch), 128):
            out = []
            for r in batch.slice(begin, 128).to_pylist():
                found = [{"text": t, "kind": k, "name": n} for t, k, n in blocks(r["html"] or "")]
                out.append({"mark": r["mark"], "page_id": r["page_id"], "url": r["url"], "kept": [b for b in found if b["kind"] != MARKED], "stream": [b for b in found if b["kind"] != SAFE]})
            yield pa.RecordBatch.from_pylist(out, _FOUND)


def _lists(rows: pd.DataFrame) -> list[list[Piece]]:
    return [[(b["text"], b["kind"], b["name"]) for b in page] for page in rows["stream"]]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) per row of pages."""
    url, page = F.col(url_col).cast("string"), F.col(html_col).cast("string")
    plain = pages.select(F.xxhash64(page).alias("mark"), F.col(id_col).cast("long").alias("page_id"), url.alias("url"), page.alias("html"))
    found = cut(plain.mapInArrow(_cut_pages, _FOUND_DDL)).withColumn("host", host_of(F.coalesce("url", F.lit(""))))
    # equal pages of a host are judged once; one without marked or open blocks says nothing
    each = found.where("size(stream) > 0").select("host", "mark", "stream").dropDuplicates(["host", "mark"])
    shards = each.groupBy("host").agg(F.ceil(F.count("*") / SHARD).alias("shards"))
    streams = cut(each.join(shards, "host").withColumn("shard", F.pmod("mark", F.col("shards"))))

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        _, h, n = Runs(list(map(_stream, _lists(rows)))).hashed()
        return pd.DataFrame({"host": rows["host"].iloc[0], "shard": rows["shard"].iloc[0], "run": h.view(np.int64), "n": n})

    def judge(rows: pd.DataFrame, runs: pd.DataFrame | None = None) -> pd.DataFrame:
        gone = boilerplate(_lists(rows), list(rows["mark"]), None if runs is None else set(runs["run"]))
        some = [bool(g) for g in gone]
        return pd.DataFrame({"host": rows["host"][some], "mark": rows["mark"][some], "gone": pd.Series([g for g in gone if g], index=rows.index[some], dtype=object)})

    kind = "host string, mark long, gone array<int>"
    gone = streams.where("shards = 1").groupBy("host", "shard").applyInPandas(lambda rows: judge(rows), kind)
    parts = streams.where("shards > 1")
    if not parts.isEmpty():
        runs = cut(parts.groupBy("host", "shard").applyInPandas(count, "host string, shard long, run long, n long"))
        frequent = runs.groupBy("host", "run").agg(F.sum("n").alias("pages")).where(F.col("pages") >= MIN_PAGES).select("host", "run")
        back = runs.join(frequent, ["host", "run"]).select("host", "shard", "run")
        gone = gone.unionByName(parts.groupBy("host", "shard").cogroup(back.groupBy("host", "shard")).applyInPandas(lambda rows, runs: judge(rows, runs), kind))
    gone = cut(gone)
    release(streams)
    # the k-th open block goes if k is in `gone`
    start = F.struct(F.lit(0).alias("k"), F.array().cast("array<string>").alias("out"))

    def step(a, b):  # noqa: ANN001, ANN202
        is_open = b["kind"].isin(OPEN, WEAK)
        stays = ~is_open | ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), a["k"])
        return F.struct((a["k"] + is_open.cast("int")).alias("k"), F.when(stays, F.array_append(a["out"], b["text"])).otherwise(a["out"]).alias("out"))

    all_ = F.array_join(F.col("kept.text"), "\n\n")
    text = F.when(F.col("gone").isNull(), all_).otherwise(F.array_join(F.aggregate("kept", start, step)["out"], "\n\n"))
    out = found.join(bounded(gone, 128), ["host", "mark"], "left").select("page_id", "url", text.alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
