"""Sentences, tokens, normalised keys and small text helpers, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocab import (
    ARCHITECTURE_WORDS,
    CJK,
    CJK_WORD,
    CODE_NOUNS,
    HEADING_KINDS,
    INTENTS,
    PLOT_WORDS,
    RELEASE_VERBS,
    STOPWORDS,
    WORD,
)


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def tokens(text: Column) -> Column:
    """Latin words of two letters or more, then runs of 2 to 6 CJK characters, without stop words."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.concat(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), F.regexp_extract_all(low, F.lit(CJK_WORD), F.lit(0)))
    return F.filter(found, lambda w: ~w.isin(STOPWORDS))


def sentences(text: Column, least: int = 12, longest: int = 400) -> Column:
    """Sentences of ``least`` characters or more, without leading bullets; overlong ones split at commas."""
    blank = F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\x{00a0}]+", " ")
    strip = lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")
    raw = F.transform(F.split(blank, r"(?<=[.!?。！？；;])\s+|\n{2,}"), lambda s: F.regexp_replace(strip(s), r"^\s*[-•*\d.]+\s*", ""))
    long_ = lambda s: F.filter(F.transform(F.split(s, r"(?<=[,，、])\s*"), strip), lambda p: F.length(p) >= least)
    return F.flatten(F.transform(F.filter(raw, lambda s: F.length(s) >= least), lambda s: F.when(F.length(s) > longest, long_(s)).otherwise(F.array(s))))


def has_cjk(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(CJK)


def word_count(text: Column) -> Column:
    """CJK characters plus Latin words."""
    text = F.coalesce(text, F.lit(""))
    return F.regexp_count(text, F.lit(CJK)) + F.regexp_count(text, F.lit(r"[A-Za-z][A-Za-z\-]{1,}"))


def dedupe_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"(?U)\W+", "")


def short_heading(text: Column, most: int = 80) -> Column:
    return F.left(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), F.lit(most))


def condense(sentence: Column, most: int = 110) -> Column:
    """Without end marks; a longer one is cut at the last comma that fits and gets an ellipsis."""
    s = F.regexp_replace(F.trim(sentence), "[.。;；,，]+$", "")
    parts = F.split(s, r"(?<=[,，、;；])\s*")

    def step(acc, p):
        full = acc["done"] | ((F.length(acc["out"]) + F.length(p) > most) & (F.length(acc["out"]) > 0))
        return F.struct(F.when(full, acc["out"]).otherwise(F.concat(acc["out"], p)).alias("out"), full.alias("done"))

    cut = F.aggregate(parts, F.struct(F.lit("").alias("out"), F.lit(False).alias("done")), step)["out"]
    cut = F.when(F.length(cut) > 0, cut).otherwise(F.left(s, F.lit(most)))
    return F.when(F.length(s) <= most, s).otherwise(F.concat(F.regexp_replace(cut, "[ ,，、;；]+$", ""), F.lit("…")))


def heading_kind(heading: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(heading, F.lit(""))))
    out = F.when(F.contains(low, F.lit(HEADING_KINDS[0][0])), HEADING_KINDS[0][1])
    for word, kind in HEADING_KINDS[1:]:
        out = out.when(F.contains(low, F.lit(word)), kind)
    return out.otherwise("section")


def figure_kind(caption: Column) -> Column:
    low = F.lower(F.coalesce(caption, F.lit("")))
    return F.when(contains_any(low, PLOT_WORDS), "plot").when(contains_any(low, ARCHITECTURE_WORDS), "architecture").otherwise("unknown")


def algorithm_intent(caption: Column, source: Column) -> Column:
    low = F.lower(F.concat_ws("\n", caption, source))
    out = F.when(contains_any(low, INTENTS[0][1]), INTENTS[0][0])
    for intent, words in INTENTS[1:]:
        out = out.when(contains_any(low, words), intent)
    return out.otherwise("unknown")


def states_code(line: Column) -> Column:
    """Whether a line speaks of code and of releasing."""
    low = F.lower(line)
    return contains_any(low, CODE_NOUNS) & contains_any(low, RELEASE_VERBS)


def match_key(label: Column) -> Column:
    """Lower case, without bracketed text, letters, digits and CJK only."""
    low = F.regexp_replace(F.lower(F.trim(F.coalesce(label, F.lit("")))), r"[\(（\[].*?[\)）\]]", "")
    return F.regexp_replace(low, r"[^0-9a-z\x{4e00}-\x{9fff}]+", "")


def loosely_equal(a: Column, b: Column) -> Column:
    """Of two match keys: equal, or one within the other; never with an empty one."""
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def safe_id(name: Column, most: int = 72) -> Column:
    """File stem with other than word characters as underscores; long ones end in a hash."""
    stem = F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")
    s = F.regexp_replace(F.regexp_replace(stem, r"(?U)[^\w\-]+", "_"), r"^_+|_+$", "")
    return F.when(F.length(s) > most, F.concat(F.left(s, F.lit(most - 9)), F.lit("_"), F.left(F.sha1(stem), F.lit(8)))).otherwise(F.when(s == "", "paper").otherwise(s))


def valid_id(paper_id: Column) -> Column:
    """No traversal, no separators, not empty."""
    return F.coalesce(paper_id.rlike(r"(?U)^[\w\-][\w\-. ]*$") & ~F.contains(paper_id, F.lit("..")), F.lit(False))


def masked(secret: Column) -> Column:
    return F.when(F.coalesce(secret, F.lit("")) == "", "").when(F.length(secret) <= 4, "****").otherwise(F.concat(F.lit("…"), F.right(secret, F.lit(4))))


def json_block(text: Column) -> Column:
    """The JSON text of an answer: fences dropped, else the first braces or brackets; null if invalid."""
    bare = F.trim(F.regexp_replace(text, r"(?m)^\s*```[a-zA-Z]*\s*$", ""))
    inner = F.regexp_extract(bare, r"(?s)(\{.*\}|\[.*\])", 1)
    whole = lambda s: F.get_json_object(s, "$").isNotNull()
    return F.when(whole(bare), bare).when(whole(inner), inner)


def escaped(text: Column) -> Column:
    """HTML special characters as entities."""
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def clock(seconds: Column) -> Column:
    """HH:MM:SS,mmm"""
    ms = F.round(seconds * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)
