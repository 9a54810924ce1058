"""Text functions of the evaluation: normal forms, distances, rates, names and hashes."""

from __future__ import annotations

import difflib
import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: White space as Python's str.split() sees it.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

#: Two spaces, or a character that may be white space other than the plain one; quicker to look for than SPACE.
MAYBE_UNEVEN = r"[^ -~\xa1-\u167f]|  "
#: Distances up to here are looked for near the diagonal first.
NEAR = 16


def bind(value: Column, body) -> Column:
    """Evaluates value once for body."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalize_text(text: Column) -> Column:
    """Lower case, each run of white space one space, none at the ends; null is empty."""
    whole = F.coalesce(text, F.lit(""))
    return F.btrim(F.when(whole.rlike(MAYBE_UNEVEN), F.regexp_replace(F.lower(whole), SPACE + "+", " ")).otherwise(F.lower(whole)))


def is_blank(text: Column) -> Column:
    """Whether the normal form of a text is empty."""
    return ~F.coalesce(text.rlike("[^" + SPACE[1:]), F.lit(False))


def tokens(text: Column) -> Column:
    """Words of a normalised text; none if it is empty."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))


#: Characters beyond the Basic Multilingual Plane, one for each distinct word of a pair. More words would take 10 ** 12 steps to compare.
FIRST, DISTINCT = 0x10000, 0x100000


def word_distance(a: Column, b: Column) -> Column:
    """Edit distance of two arrays of words: each distinct word of the pair becomes one character. Over DISTINCT of them it is an error.

    Finding a word's place takes time in the square of the words, as the distance itself does.
    """

    def encoded(d: Column, ws: Column) -> Column:
        few = F.array_join(F.transform(ws, lambda w: F.char(F.array_position(d, w))), "")
        hexes = F.transform(ws, lambda w: F.lpad(F.hex(F.lit(FIRST - 1) + F.array_position(d, w)), 8, "0"))
        return F.when(F.size(d) < 256, few).otherwise(F.decode(F.unhex(F.array_join(hexes, "")), "UTF-32"))

    def apart(a: Column, b: Column) -> Column:
        return bind(F.array_distinct(F.concat(a, b)), lambda d: F.when(F.size(d) > DISTINCT, F.raise_error(F.lit(f"over {DISTINCT} distinct words")).cast("int")).otherwise(F.levenshtein(encoded(d, a), encoded(d, b))))

    return bind(F.struct(a.alias("a"), b.alias("b")), lambda s: F.when(s["a"] == s["b"], F.lit(0)).when(F.size(s["b"]) == 0, F.size(s["a"])).otherwise(apart(s["a"], s["b"])))


def distance(a: Column, b: Column) -> Column:
    """Edit distance of two texts. Most are alike or close, for which a narrow band of the table is enough."""
    near = lambda s: bind(F.levenshtein(s["a"], s["b"], NEAR), lambda n: F.when(n < 0, F.levenshtein(s["a"], s["b"])).otherwise(n))
    return bind(F.struct(a.alias("a"), b.alias("b")), lambda s: F.when(s["a"] == s["b"], 0).otherwise(near(s)))


def char_errors(gt: Column, predicted: Column) -> Column:
    return distance(normalize_text(gt), normalize_text(predicted))


def word_errors(gt: Column, predicted: Column) -> Column:
    return word_distance(tokens(normalize_text(gt)), tokens(normalize_text(predicted)))


def cer(gt: Column, predicted: Column) -> Column:
    """Character errors over the characters of gt, at least one."""
    return char_errors(gt, predicted) / F.greatest(F.lit(1), F.length(normalize_text(gt)))


def wer(gt: Column, predicted: Column) -> Column:
    return word_errors(gt, predicted) / F.greatest(F.lit(1), F.size(tokens(normalize_text(gt))))


def join_ordered(texts: Column) -> Column:
    """Texts that are not blank, stripped, one a line."""
    strip = lambda t: F.regexp_replace(F.regexp_replace(t, f"^{SPACE}+", ""), f"{SPACE}+$", "")
    return F.array_join(F.filter(F.transform(texts, strip), lambda t: t != ""), "\n")


def text_signature(text: Column) -> Column:
    """Without white space, hyphens and soft hyphens."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"(?:{SPACE}|[-\\xad])+", "")


def slug(text: Column, default: str = "item", keep: str = "a-zA-Z0-9") -> Column:
    made = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{keep}]+", "_"), F.lit("_"))
    return F.when(made == "", F.lit(default)).otherwise(made)


def block_id(kind: Column, number: Column) -> Column:
    return F.format_string("%s_%04d", kind, number)


def line_id(block: Column, number: Column) -> Column:
    return F.format_string("%s_line_%03d", block, number)


def svg_pixels(length: Column) -> Column:
    """Pixels of an SVG length at 96 a inch; null if it has no number or another unit."""
    number = F.expr("1.0D") * F.when(length.rlike(r"^\s*[0-9.]+"), F.regexp_extract(length, r"^\s*([0-9]*\.?[0-9]+)", 1).try_cast("double"))
    unit = F.lower(F.regexp_extract(length, r"^\s*[0-9.]+\s*([a-zA-Z%]*)\s*$", 1))
    factor = F.when(unit.isin("", "px"), 1.0).when(unit == "pt", 96 / 72).when(unit == "pc", 16.0).when(unit == "in", 96.0).when(unit == "cm", 96 / 2.54).when(unit == "mm", 96 / 25.4).when(unit.isin("em"), 16.0).when(unit == "ex", 8.0)
    return number * factor


def is_numeric_cell(text: Column) -> Column:
    """Whether a cell is a number once commas and percent signs are taken away."""
    return F.coalesce(F.regexp_replace(F.btrim(text), "[,%]", "").rlike(r"^\s*[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+)?\s*$|^\s*[+-]?(?i:nan|inf|infinity)\s*$"), F.lit(False))


def format_metric(value: Column) -> Column:
    return F.when(value.isNull(), "N/A").otherwise(F.format_string("%.4f", value))


def has_offset(stamp: Column) -> Column:
    """Whether an ISO-8601 time states its offset from UTC."""
    return F.coalesce(stamp.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)$") & stamp.try_cast("timestamp").isNotNull(), F.lit(False))


#: What goes from encyclopedia text, in this order, and what it becomes.
WIKI_CLEANUP = [(r"\[\s*\d+\s*\]", ""), (r"\s+([,.;:!?])", "$1"), (r"[(]\s+", "("), (r"\s+[)]", ")")]


def clean_wiki(text: Column) -> Column:
    """White space is single, then reference marks go and spaces before signs and inside round brackets; what a mark leaves on both sides stays."""
    t = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", " "))
    for pattern, by in WIKI_CLEANUP:
        t = F.regexp_replace(t, pattern, by)
    return t


def clean_heading(text: Column) -> Column:
    return clean_wiki(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s*\[edit\]\s*", " "))


def wiki_target(url: Column) -> Column:
    """Struct of language, title, revision and problem (scheme, host, path, title or oldid; null if there is none) of an article's URL."""
    shape = r"^([^:/?#]+)://([^/?#]*)([^?#]*)(\?[^#]*)?"
    part = lambda i: F.coalesce(F.regexp_extract(url, shape, i), F.lit(""))
    values = lambda name: F.filter(F.regexp_extract_all(part(4), F.lit(f"[?&]{name}=([^&]*)"), F.lit(1)), lambda v: v != "")
    host, path, old, titles = F.lower(part(2)), part(3), values("oldid"), values("title")
    language = F.regexp_extract(host, r"^([a-z][a-z0-9-]*)\.(?:m\.)?wikipedia\.org$", 1)
    decode = lambda c: F.replace(F.try_url_decode(c), F.lit("_"), F.lit(" "))
    in_path = path.startswith("/wiki/")
    title = F.when(in_path, decode(F.replace(F.substr(path, F.lit(7)), F.lit("+"), F.lit("%2B")))).when(path == "/w/index.php", decode(F.get(titles, F.lit(0))))
    number = F.get(old, F.lit(0)).try_cast("long")
    bad_old = (F.size(old) > 1) | ((F.size(old) == 1) & ~F.coalesce(F.get(old, F.lit(0)).rlike("^[0-9]+$") & (number >= 1), F.lit(False)))
    problem = F.when(~F.lower(part(1)).isin("http", "https"), "scheme").when(language == "", "host").when(bad_old, "oldid").when(~(in_path | (path == "/w/index.php")), "path").when((path == "/w/index.php") & (F.size(titles) > 1), "title").when((F.coalesce(title, F.lit("")) == "") & (F.size(old) == 0), "title")
    good = lambda c: F.when(problem.isNull(), c)
    return F.struct(good(language).alias("language"), good(F.nullif(title, F.lit(""))).alias("title"), good(number).alias("revision"), problem.alias("problem"))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio, its rule for frequent characters of b included."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def _no_constants(name: str):
    raise ValueError(f"{name} is not allowed in canonical JSON")


@F.pandas_udf(StringType())
def canonical_json_sha256(value: pd.Series) -> pd.Series:
    """Of JSON texts: SHA-256 of the form with sorted keys, no spaces and characters as they are."""

    def one(text):
        if text is None:
            return None
        made = json.dumps(json.loads(text, parse_constant=_no_constants), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
        return hashlib.sha256(made.encode()).hexdigest()

    return pd.Series([one(x) for x in value])


@F.pandas_udf(StringType())
def derived_seed(parts: pd.Series) -> pd.Series:
    """Of arrays of strings: SHA-256 of their JSON array, other characters escaped."""
    return pd.Series([None if p is None else hashlib.sha256(json.dumps(list(p), separators=(",", ":")).encode()).hexdigest() for p in parts])
