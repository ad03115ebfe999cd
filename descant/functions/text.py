"""Text functions: names, identifiers, lyric lines, stamps. All are column expressions except the Unicode
folds, which Spark has no function for; those are Arrow UDFs over batches.

Regular expressions use `(?U)` where letters beyond ASCII count. A null argument gives null.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

#: Blocks whose characters are dropped from names (fixed values).
EMOJI = (
    r"[\x{1F1E0}-\x{1F1FF}\x{1F300}-\x{1F5FF}\x{1F600}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F700}-\x{1F77F}\x{1F780}-\x{1F7FF}"
    r"\x{1F800}-\x{1F8FF}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FA6F}\x{1FA70}-\x{1FAFF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}]+"
)
#: Words that say nothing about a song, as patterns, in order of precedence (fixed values).
NOISE_WORDS = [
    "official", "music", "video", "audio", "lyrics?", "karaoke", "karaokê", "complete", "completo", "ao vivo", "live", "remix", "version",
    r"feat\.?", r"ft\.?", "remaster", "as popularized by", "karafun", "instrumental", "minus one", "minusone", "made famous by", "by",
    "karaoke version", "hd", "hq", "coversph", "singkaraoke", "in the style of", "no lead vocal", "with lyrics", "cc",
]
#: All of them behind one look at the first letter, which most places fail.
NOISE = rf"(?=[{''.join(sorted({w[0] for w in NOISE_WORDS}))}])\b(?:{'|'.join(NOISE_WORDS)})\b"
#: Marks of a special version in a track's name (fixed values).
VERSION_MARKS = [" - ", "ao vivo", "live", "remix", "version", "karaoke", "acoustic", "instrumental", "cover", "radio edit", "extended"]
#: Phrases that introduce the artist (fixed values).
_CREDIT = r"(?:made\s+famous\s+by|in\s+the\s+style\s+of|originally\s+performed\s+by|as\s+popularized\s+by)"
CREDIT_IN_PARENS = rf"(?i)\((?:as\s+)?{_CREDIT}[:\s]+([^)]+)\)"
CREDIT_INLINE = rf"(?i)\b{_CREDIT}[:\s]+(.+?)(?:\s*[\(\[]|$)"
#: What a title loses at its end (fixed values).
TAIL_KARAOKE = r"(?i)\bkaraoke\b.*$"
TAIL_NOISE = r"(?i)(?:\s*\b(?:official\s+(?:music\s+)?video|lyrics?|hd|hq|instrumental|with\s+lyrics|no\s+lead\s+vocal|cc)\b[\s.!]*)+$"
#: Cyrillic letters that look like Latin ones, and these (fixed values).
LOOK_ALIKES = ("аеіоруѕсхј", "aeiopyscxj")
#: Contractions and what they stand for (fixed values).
CONTRACTIONS = {
    "im": "i am", "ive": "i have", "id": "i would", "ill": "i will", "youre": "you are", "youve": "you have", "youd": "you would",
    "youll": "you will", "hes": "he is", "shes": "she is", "its": "it is", "weve": "we have", "were": "we are", "theyre": "they are",
    "theyve": "they have", "dont": "do not", "doesnt": "does not", "didnt": "did not", "cant": "cannot", "wont": "will not",
    "isnt": "is not", "arent": "are not", "wasnt": "was not", "werent": "were not", "wanna": "want to", "gonna": "going to",
    "gotta": "got to", "aint": "are not",
}
MEDIA_FORMATS = ["mp4", "mp3", "zip", "mkv", "avi", "webm", "mov"]


#: White space as in Unicode: what `strip` takes from the ends and what collapses (fixed values).
SPACE = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


_SPACES = "".join(chr(k) for k in (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c, with c evaluated once however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_SPACES))


_BLANKS = r" \t\n\x0B\f\r\x1C\x1D\x1E\x1F"


def collapse(c: Column) -> Column:
    """White space runs as one space, none at the ends; ASCII text takes the cheaper pattern. Single spaces, which most
    runs are, match neither."""
    ascii_, other = rf"[{_BLANKS[1:]}][{_BLANKS}]*| [{_BLANKS}]+", rf"{SPACE[:-1]}&&[^ ]]{SPACE}*| {SPACE}+"
    return let(c, lambda x: F.trim(F.when(is_ascii(x), F.regexp_replace(x, ascii_, " ")).otherwise(F.regexp_replace(x, other, " "))))


def swap(c: Column, old: str, new: str) -> Column:
    """Each of the characters as another one, or gone; as `translate`, which makes an object of every character."""
    for x in dict.fromkeys([new] if not new else new):
        own = old if not new else "".join(a for a, b in zip(old, new, strict=True) if b == x)
        c = F.replace(c, F.lit(own), F.lit(x)) if len(own) == 1 else F.regexp_replace(c, f"[{own}]", x)
    return c


def remove_all(c: Column, *patterns: str) -> Column:
    for p in patterns:
        c = F.regexp_replace(c, p, "")
    return c


# Unicode


@F.pandas_udf(StringType())
def strip_accents(s: pd.Series) -> pd.Series:
    """NFD without nonspacing marks."""
    return s.map(lambda x: x if x is None or x.isascii() else "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c) != "Mn"))


_LATIN = str.maketrans(*LOOK_ALIKES)


def fold_text(x: str) -> str:
    return x if x.isascii() else "".join(c for c in unicodedata.normalize("NFKD", x.translate(_LATIN)) if not unicodedata.combining(c))


_NON_WORD = re.compile(r"[^\w]")


@lru_cache(1 << 16)
def token(x: str) -> str:
    return _NON_WORD.sub("", fold_text(unicodedata.normalize("NFKC", x).lower()))


@F.pandas_udf(StringType())
def fold_to_ascii(s: pd.Series) -> pd.Series:
    """Look-alikes and combining marks folded; expects lower case."""
    return s.map(lambda x: None if x is None else fold_text(x))


@F.pandas_udf(StringType())
def normalize_token(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else token(x))


@F.pandas_udf(StringType())
def ascii_only(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFD", x).encode("ascii", "ignore").decode())


# paths and identifiers


def basename(p: Column) -> Column:
    return F.substring_index(p, "/", -1)


def dirname(p: Column) -> Column:
    return F.when(F.contains(p, F.lit("/")), F.regexp_replace(p, "/[^/]*$", "")).otherwise("")


def stem(p: Column) -> Column:
    return F.regexp_replace(basename(p), r"^(\.*[^.].*)\.[^.]*$", "$1")


def detect_format(p: Column) -> Column:
    return F.lower(F.regexp_extract(basename(p), r"^\.*[^.].*\.([^.]*)$", 1))


def is_media(p: Column) -> Column:
    return detect_format(p).isin(MEDIA_FORMATS)


def id_suffix(p: Column) -> Column:
    s = stem(p)
    dashes = F.regexp_extract(s, r"(---[A-Za-z0-9_-]{11})$", 1)
    return F.when(dashes != "", dashes).otherwise(F.regexp_extract(s, r"(\s*\[[A-Za-z0-9_-]{11}\])$", 1))


def video_id(p: Column) -> Column:
    s = id_suffix(p)
    return F.nullif(F.when(s.startswith("---"), F.substring(s, 4, 11)).otherwise(F.regexp_extract(s, r"\[(.{11})\]", 1)), F.lit(""))


def is_video_id(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z0-9_-]{11}$")


def id_from_url(url: Column) -> Column:
    """The part after the only `watch?v=` (or `u.be/` if there is no `v=`), cut at `?`; else null."""
    parts = F.when(url.contains("v="), F.split(url, r"watch\?v=")).otherwise(F.split(url, r"u\.be/"))
    return F.when(F.size(parts) == 2, F.substring_index(F.try_element_at(parts, F.lit(2)), "?", 1))


def before_playlist(url: Column) -> Column:
    return F.substring_index(url, "&list=", 1)


# names


def _by_script(c: Column, rule: Callable[[Column, bool], Column]) -> Column:
    """rule(c, ascii): ASCII text needs neither the patterns of Unicode classes nor those of other characters."""
    return let(c, lambda x: F.when(is_ascii(x), rule(x, True)).otherwise(rule(x, False)))


def _without_noise(c: Column, ascii_: bool) -> Column:
    return remove_all(c, f"(?i){NOISE}" if ascii_ else f"(?iU){NOISE}")


def _plain(c: Column, ascii_: bool) -> Column:
    return swap(c if ascii_ else remove_all(c, EMOJI), "_", " ")


def clean_query(c: Column) -> Column:
    return collapse(_by_script(c, lambda x, a: _without_noise(remove_all(_plain(x, a), r"\([^)]*\)", r"\[[^\]]*\]"), a)))


def clean_lyric_query(c: Column) -> Column:
    return collapse(_by_script(c, lambda x, a: _without_noise(_plain(x, a), a)))


def _without_tail(c: Column) -> Column:
    """Without karaoke and what follows, then without noise words at the end; each pattern runs only on text that
    holds its word, or ends in one."""
    cut = lambda x: let(remove_all(x, TAIL_KARAOKE), lambda y: F.when(y != x, F.rtrim(y, F.lit(" \t\n\x0b\f\r"))).otherwise(x))
    c = let(c, lambda x: F.when(F.lower(x).contains("karaoke"), cut(x)).otherwise(x))
    last = lambda x: F.substring(F.rtrim(x, F.lit(" \t\n\x0b\f\r.!")), -20, 20)
    return let(c, lambda x: F.when(last(x).rlike(r"(?i)\b(?:video|lyrics?|hd|hq|instrumental|vocal|cc)$"), remove_all(x, TAIL_NOISE)).otherwise(x))


def _credited(c: Column) -> Column:
    """Without its credit, then ` - ` and the artist; null without a credit."""
    artist = F.trim(F.when(c.rlike(CREDIT_IN_PARENS), F.regexp_extract(c, CREDIT_IN_PARENS, 1)).otherwise(F.regexp_extract(c, CREDIT_INLINE, 1)))
    title = _without_tail(remove_all(c, CREDIT_IN_PARENS, CREDIT_INLINE, rf"{SPACE}*[\(\[][^\)\]]*[\)\]]{SPACE}*$"))
    may = let(F.lower(c), lambda low: low.contains("famous") | low.contains("style") | low.contains("performed") | low.contains("popularized"))
    return F.when(F.when(may, c.rlike(rf"(?i){_CREDIT}")), let(artist, lambda a: F.when(a != "", F.concat(F.trim(remove_all(title, r"\s*-\s*$")), F.lit(" - "), a))))


def _tidied(c: Column, ascii_: bool) -> Column:
    c = F.regexp_replace(c, r"[\t\n\x0B\f\r\x1C\x1D\x1E\x1F_]", " ") if ascii_ else F.regexp_replace(remove_all(c, EMOJI), f"{SPACE[:-1]}_]", " ")
    # a group at the end is looked for where one ends
    group = lambda x, mark, pattern: let(x, lambda y: F.when(F.rtrim(y).endswith(mark), remove_all(y, pattern)).otherwise(y))
    plain = lambda x: _without_tail(group(group(x, ")", r" *\([^)]*\) *$"), "]", r" *\[[^\]]*\] *$"))
    c = let(c, lambda x: F.coalesce(_credited(x), plain(x)))
    return c if ascii_ else F.regexp_replace(c, rf"{SPACE}*[–—]{SPACE}*", " - ")


def tidy(c: Column) -> Column:
    """A display name: with a credit phrase `title - artist`, else without trailing groups and noise."""
    return let(collapse(_by_script(c, _tidied)), lambda x: F.when(x.endswith("-"), remove_all(x, r"\s*-\s*$")).otherwise(x))


def display_name(p: Column) -> Column:
    suffix = id_suffix(p)
    bare = F.substring(stem(p), F.lit(1), F.length(stem(p)) - F.length(suffix))
    return F.when(suffix == "", stem(p)).otherwise(F.coalesce(F.nullif(tidy(bare), F.lit("")), bare))


def comparable(c: Column) -> Column:
    return collapse(F.regexp_replace(F.lower(c), r"[._\-']", " "))


def comparable_name(c: Column) -> Column:
    """For rename suggestions: dashes unified, ASCII, lower case."""
    return F.lower(ascii_only(collapse(F.regexp_replace(c, r"[-–—−]", "-"))))


def has_separator(c: Column) -> Column:
    return c.contains(" - ")


def query_parts(c: Column) -> Column:
    """The first two parts around a spaced separator, else around any; struct (a, b)."""
    q = F.lower(c)
    spaced, tight = F.split(q, r"(?U)\s+[-|｜]\s+"), F.split(q, r"(?U)\s*[-|｜]\s*")
    parts = F.when(F.size(spaced) > 1, spaced).otherwise(tight)
    return F.struct(strip(parts[0]).alias("a"), strip(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))).alias("b"))


def without_artist(track: Column, artist: Column) -> Column:
    """The track without a leading artist and separator, if what stands before the separator is the artist."""
    sep = r"(?sU)^(.{0,50}?(?:\s*[-–—|:]\s*|\s+/\s+))(.+)$"
    before = F.regexp_replace(strip(F.regexp_extract(track, sep, 1)), r"(?U)\s*[-–—|:/]\s*$", "")
    leads = F.startswith(comparable(track), F.concat(comparable(artist), F.lit(" ")))
    return F.when(leads & track.rlike(sep) & (comparable(before) == comparable(artist)), F.regexp_extract(track, sep, 2)).otherwise(track)


#: Credits of further artists (fixed value).
_FEAT = r"(?iU)\s*[(\[]?\s*(?:feat\.?|ft\.?|featuring)\b.*$"


def clean_key(c: Column) -> Column:
    """Without feature credits and trailing groups; the trimmed original if nothing is left."""
    cleaned = strip(F.regexp_replace(remove_all(c, _FEAT), r"(?U)(?:\s*[(\[][^)\]]*[)\]]\s*)+$", ""))
    return F.when(cleaned == "", strip(c)).otherwise(cleaned)


def similar(a: Column, b: Column) -> Column:
    return (a != "") & (b != "") & (a.contains(b) | b.contains(a))


# lyric lines

_LETTER = r"\p{L}"


def lyric_line(c: Column) -> Column:
    c = remove_all(swap(c, "\n", " "), r"<[^>]+>", r"\[[^\]]*\]", "[♪♫♬♩]")
    return collapse(swap(c, "‘’“”", "''\"\""))


def caption_line(c: Column) -> Column:
    """lyric_line without (..), empty if no letter is left."""
    return let(collapse(remove_all(lyric_line(c), r"\([^)]*\)")), lambda out: F.when(out.rlike(_LETTER), out).otherwise(""))


def align_text(c: Column) -> Column:
    return collapse(swap(c, "()", ""))


def is_lyric(c: Column) -> Column:
    """A stripped line that is neither blank nor a bracketed header and has a letter once cleaned."""
    return is_cleaned_lyric(strip(c), lyric_line(strip(c)))


def is_cleaned_lyric(stripped: Column, cleaned: Column) -> Column:
    """The same of a line that is stripped and cleaned already."""
    return (stripped != "") & ~stripped.rlike(r"^\[[^\]]*\]$") & cleaned.rlike(_LETTER)


def plain_line(c: Column) -> Column:
    """Lower case, tags gone, apostrophes gone, folded, [a-z0-9 ] only, collapsed."""
    c = remove_all(F.regexp_replace(F.lower(c), r"<[^>]+>", " "), "['‘’`´]")
    return collapse(F.regexp_replace(fold_to_ascii(c), "[^a-z0-9 ]+", " "))


def expand(c: Column) -> Column:
    """What a contraction stands for, else null."""
    return F.create_map(*(F.lit(x) for pair in CONTRACTIONS.items() for x in pair))[c]


def same_word(a: Column, b: Column) -> Column:
    """Equal tokens, or one the other's contraction or a word of it."""
    x, y = expand(a), expand(b)
    no = F.lit(False)
    return (
        (a == b) | F.coalesce(x == b, no) | F.coalesce(y == a, no) | F.coalesce(x == y, no)
        | F.coalesce(F.array_contains(F.split(x, " "), b), no) | F.coalesce(F.array_contains(F.split(y, " "), a), no)
    )


# numbers and stamps


def clock(seconds: Column) -> Column:
    """M:SS of whole seconds."""
    s = F.floor(seconds).cast("long")
    return F.when(s.isNotNull(), F.format_string("%d:%02d", F.floor(s / 60).cast("long"), s % 60))


def ass_time(s: Column) -> Column:
    """H:MM:SS.cc, truncated."""
    return F.when(s.isNotNull(), F.format_string("%d:%02d:%02d.%02d", F.floor(s / 3600).cast("long"), F.floor((s % 3600) / 60).cast("long"), F.floor(s % 60).cast("long"), F.floor((s % 1) * 100).cast("long")))


def length_tag(duration: Column) -> Column:
    """mm:ss of the rounded duration; null if not a positive number."""
    n = F.bround(duration.try_cast("double"), 0).cast("long")
    return F.when(n > 0, F.format_string("%02d:%02d", F.floor(n / 60).cast("long"), n % 60))


def length_seconds(tag: Column) -> Column:
    parts = F.split(tag, ":")
    m, s = F.trim(F.try_element_at(parts, F.lit(1))).try_cast("int"), F.trim(F.try_element_at(parts, F.lit(2))).try_cast("int")
    return F.when(F.size(parts) == 2, (m * 60 + s).cast("double"))


def safe_name(c: Column, windows: bool = False) -> Column:
    """A file name without white space around it; on Windows, without the characters illegal there."""
    return strip(F.regexp_replace(c, r'[<>:"/\\|?*]', "-") if windows else c)


def setting(c: Column, text: Column | bool = False) -> Column:
    """A typed reading of a stored setting: struct (kind, as_bool, as_long, as_double, as_string). text:
    whether the setting's default is text; then it is read as it stands."""
    # no reading as a truth value is longer than five characters, and a number begins as one: long texts stop there
    low = F.when(F.length(c) <= 5, F.lower(c))
    number = lambda bare: F.when(bare.rlike("^[0-9]+$"), "int").when(F.when(bare.rlike("^[0-9.]"), F.regexp_replace(bare, r"^([^.]*)\.([^.]*.*)$", "$1$2").rlike("^[0-9]+$")), "float").otherwise("string")
    kind = (
        F.when(F.lit(text) if isinstance(text, bool) else text, "string")
        .when(low.isin("true", "yes", "on", "false", "no", "off"), "bool")
        .otherwise(let(F.ltrim(c, F.lit("-")), number))
    )
    return let(kind, lambda k: F.struct(
        k.alias("kind"), F.when(k == "bool", low.isin("true", "yes", "on")).alias("as_bool"), F.when(k == "int", c.try_cast("bigint")).alias("as_long"),
        F.when(k == "float", c.try_cast("double")).alias("as_double"), F.when(k == "string", c).alias("as_string"),
    ))


def stem_role(name: Column) -> Column:
    """Which track a separator's output file holds: vocal, instrumental or null."""
    n = F.lower(name)
    return (
        F.when(n.contains("(noreverb)"), "vocal")
        .when(n.contains("(reverb)"), "instrumental")
        .when(n.contains("instrumental") | n.contains("no vocal") | n.contains("no_vocal") | n.contains("(other)"), "instrumental")
        .when(n.contains("vocal"), "vocal")
    )


def has_english(captions: Column) -> Column:
    """Whether a JSON object of captions has a key that starts with `en`; broken JSON has none."""
    keys = F.map_keys(F.from_json(captions, "map<string,string>"))
    return F.coalesce(F.exists(keys, lambda k: F.lower(k).startswith("en")), F.lit(False))
