"""Who wrote a paper: names below a Markdown title, names cleaned for display, full titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words of an affiliation, beginnings of lines that end the names, marks between names.
AFFILIATIONS = ["University", "Department", "Group"]
ENDINGS = ["(dated", "the emergence"]
MARKS = r"[?*†‡§¶\|]"
MOST_LINES, MOST_NAMES, MOST_SHOWN = 4, 12, 8


def _affiliated(s: Column) -> Column:
    out = F.lit(False)
    for word in AFFILIATIONS:
        out = out | F.contains(s, F.lit(word))
    return out


def names_below_title(lines: DataFrame) -> DataFrame:
    """(key, authors) from ``lines`` (key, line_no, line); documents without names have no row.

    Below the first heading come blank lines, names and affiliations in turns. A line's state follows from what
    lies between it and the heading: names end at a heading, a comment, a date, or a blank line behind
    a name; affiliations are passed over; the first four lines of names count.
    """
    s = F.trim("line")
    heading = s.rlike(r"^#{1,3}\s+")
    order = Window.partitionBy("key").orderBy("line_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    low = F.lower("s")
    marked = lines.select("key", "line_no", s.alias("s"), F.col("line").rlike(r"^#{1,3}\s+").alias("title"), heading.alias("heading"))
    below = marked.withColumn("seen", F.coalesce(F.max(F.col("title").cast("int")).over(before), F.lit(0))).filter("seen = 1")
    ends = F.col("heading") | F.startswith("s", F.lit("<!--"))
    for e in ENDINGS:
        ends = ends | F.startswith(low, F.lit(e))
    kinds = below.withColumns({"ends": ends, "blank": F.col("s") == ""})
    kinds = kinds.withColumn("named", ~F.col("ends") & ~F.col("blank") & ~_affiliated(F.col("s")))
    kinds = kinds.withColumn("names", F.coalesce(F.sum(F.col("named").cast("int")).over(before), F.lit(0)))
    stop = F.col("ends") | (F.col("blank") & (F.col("names") > 0))
    kept = kinds.withColumn("stopped", F.max(stop.cast("int")).over(order)).filter(F.col("named") & (F.col("stopped") == 0) & (F.col("names") < MOST_LINES))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "s"))), lambda x: x["s"]), " ")
    flat = F.regexp_replace(F.regexp_replace(joined, MARKS, " "), r"\s+", " ")
    parts = F.transform(F.split(flat, r",|;|\band\b"), lambda p: F.regexp_replace(p, r"^[ .]+|[ .]+$", ""))
    good = F.filter(parts, lambda p: F.length(p).between(2, 60) & p.rlike("[A-Za-z]") & ~_affiliated(p))
    return kept.groupBy("key").agg(F.slice(good, 1, MOST_NAMES).alias("authors")).filter(F.size("authors") > 0)


def _bare(s: Column) -> Column:
    return F.regexp_replace(F.trim(s), "^[\"']+|[\"']+$", "")


def shown_authors(papers: DataFrame, authors: str = "authors", text: str = "text") -> DataFrame:
    """Adds ``shown``: names without quotes, labels and footnote digits, once each in any case, eight at most.

    One long entry with commas is several names. Without any name the first line of the text's first
    six that may be a list of names stands in; without such a line nothing does.
    """
    def pieces(a: Column) -> Column:
        clean = _bare(F.regexp_replace(_bare(a), r"(?is)\b(?:authors?|title)\s*:.*$", ""))
        several = F.contains(clean, F.lit(",")) & (F.length(clean) > 48)
        return F.when(several, F.split(clean, r"\s*,\s*")).otherwise(F.array(clean))

    names = F.flatten(F.transform(F.coalesce(authors, F.array().cast("array<string>")), pieces))
    names = F.transform(names, lambda p: F.trim(F.regexp_replace(_bare(p), r"\d+$", "")))
    names = F.filter(names, lambda p: (F.length(p) >= 2) & ~p.rlike(r"^\d"))
    once = F.filter(names, lambda p, i: ~F.exists(F.slice(names, F.lit(1), i), lambda q: F.lower(q) == F.lower(p)))
    lines = F.transform(F.slice(F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r"), 1, 6), lambda s: F.trim(s))
    bits = lambda s: F.filter(F.split(s, r"\s*,\s*"), lambda b: b != "")
    listed = F.filter(lines, lambda s: (s != "") & ~F.lower(s).rlike(r"^(title|abstract|where does)") & ~s.rlike(r"\d") & F.size(bits(s)).between(1, 8))
    instead = F.coalesce(bits(F.try_element_at(listed, F.lit(1))), F.array().cast("array<string>"))
    return papers.withColumn("shown", F.array_join(F.slice(F.when(F.size(once) > 0, once).otherwise(instead), 1, MOST_SHOWN), ", "))


def full_title(title: Column, paper_id: Column, text: Column) -> Column:
    """The title; where the id goes on after it, the id in words; without one, the text's first line."""
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    t, i = flat(title), flat(F.replace(paper_id, F.lit("_"), F.lit(" ")))
    longer = (i != "") & (t != "") & F.startswith(F.lower(i), F.lower(t)) & (F.length(i) > F.length(t) + 2)
    return F.when(longer, i).when(t != "", t).otherwise(F.trim(F.element_at(F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r"), 1)))
