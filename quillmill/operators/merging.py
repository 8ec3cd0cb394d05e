"""Merging two readings of the same papers: captions to grids, tables, titles, sections, links and authors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A table's number before its caption, numbered headings, kinds and names of academic sections.
CAPTION_NUMBER = r"^(?:table|tab\.?)\s*[sivxlcdm\d]+\s*[:.\-]?\s*"
ROMAN = r"^[IVX]+\.\s+"
ACADEMIC_KINDS = ["abstract", "introduction", "method", "experiment", "conclusion", "section"]
ACADEMIC_NAMES = r"(?i)^(?:Abstract|Introduction|Methods?|Results|Discussion|Conclusion)"
JUNK_CELL = r"^[-+]?\d[\d\s.,]*$|^\d{2}\s+\d{2}"


def caption_text(caption: Column) -> Column:
    flat = F.trim(F.regexp_replace(F.lower(F.coalesce(caption, F.lit(""))), r"(?U)\s+", " "))
    return F.left(F.regexp_replace(flat, CAPTION_NUMBER, ""), F.lit(120))


def similar(a: Column, b: Column) -> Column:
    """Of two caption texts: one holds the other, or their first 40 characters are equal; never with an empty one."""
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a) | (F.left(a, F.lit(40)) == F.left(b, F.lit(40))))


def has_grid(header: Column, rows: Column) -> Column:
    """Two columns, one row and four filled cells at least."""
    filled = F.size(F.filter(F.concat(header, F.flatten(rows)), lambda c: F.trim(c) != ""))
    return (F.size(header) >= 2) & (F.size(rows) >= 1) & (filled >= 4)


def is_junk(header: Column, rows: Column) -> Column:
    """Whether most cells of the header and the first two rows are bare numbers; also without any cell."""
    cells = F.transform(F.concat(header, F.flatten(F.slice(rows, 1, 2))), F.trim)
    numbers = F.size(F.filter(cells, lambda c: c.rlike(JUNK_CELL)))
    return (F.size(cells) == 0) | (numbers >= F.greatest(F.lit(3), F.floor(F.size(cells) * 7 / 10)))


def academic_sections(sections: DataFrame) -> DataFrame:
    """(key, n): sections (key, heading, kind) that look like a paper's own."""
    head = F.trim(F.coalesce("heading", F.lit("")))
    known = (F.col("kind").isin(ACADEMIC_KINDS) & (F.length(head) > 2)) | head.rlike(ROMAN) | head.rlike(ACADEMIC_NAMES)
    return sections.groupBy("key").agg(F.count_if(known).alias("n"))


def title_score(title: Column) -> Column:
    """Length, 20 more from seven words on, 50 less for a numbered heading; -1 without a title."""
    s = F.trim(F.coalesce(title, F.lit("")))
    blanks = F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
    score = F.length(s) + F.when(blanks >= 6, 20).otherwise(0) - F.when(s.rlike(ROMAN), 50).otherwise(0)
    return F.when((s == "") | (s == "Untitled"), -1).otherwise(score)


def best_titles(candidates: DataFrame) -> DataFrame:
    """(key, title): of ``candidates`` (key, ord, title) the best score, of equal ones the first."""
    scored = candidates.withColumn("score", title_score(F.col("title"))).filter("score >= 0")
    best = F.max_by("title", F.struct("score", (-F.col("ord")).alias("o")))
    return scored.groupBy("key").agg(best.alias("title"))


def captions_to_grids(grids: DataFrame, captions: DataFrame) -> DataFrame:
    """``grids`` (key, ord, table_id, caption, header, rows) whose nth table without a caption takes the
    nth row of ``captions`` (key, ord, table_id, caption), its id too."""
    bare = F.trim(F.coalesce("caption", F.lit(""))) == ""
    order = Window.partitionBy("key", "bare").orderBy("ord")
    numbered = grids.withColumn("bare", bare).withColumn("nth", F.when(F.col("bare"), F.row_number().over(order)))
    given = captions.select("key", F.row_number().over(Window.partitionBy("key").orderBy("ord")).alias("nth"), F.col("caption").alias("c"), F.col("table_id").alias("i"))
    both = numbered.join(given, ["key", "nth"], "left")
    return both.select("key", "ord", F.coalesce(F.when(F.col("i") != "", F.col("i")), "table_id").alias("table_id"), F.coalesce("c", "caption").alias("caption"), "header", "rows")


def merged_tables(base: DataFrame, structured: DataFrame) -> DataFrame:
    """Tables of both readings, (key, ord, table_id, caption, header, rows, source).

    All grids of the structured reading stay and, where there are any, stand for the base reading's.
    A table of the base that is a caption alone stays unless its caption resembles one of the
    structured reading, its number is within one of the grids' ids, or the grids cover it: any grid
    covers a main table, three cover supplementary ones. Papers whose merge leaves no table keep the base's.
    """
    shape = ["key", "ord", "table_id", "caption", "header", "rows"]
    grid = has_grid(F.col("header"), F.col("rows"))
    s = structured.select(*shape).withColumn("text", caption_text(F.col("caption")))
    kept = s.filter(grid)
    n = kept.groupBy("key").agg(F.count("*").alias("grids"))
    b = base.select(*shape).withColumns({"text": caption_text(F.col("caption")), "grid": grid}).join(n, "key", "left").na.fill(0, ["grids"])
    own = b.filter("grid and grids = 0")
    number = F.regexp_replace(F.upper(F.coalesce("table_id", F.lit(""))), "^T+", "")
    lone = b.filter(~F.col("grid") & (F.trim(F.coalesce("caption", F.lit(""))) != "")).withColumn("number", number)
    covered = (F.col("grids") >= 1) & F.col("caption").rlike(r"(?i)TABLE\s*(?:S?\d+|I|II|III)") & (~F.col("number").startswith("S") | (F.col("grids") >= 3))
    lone = lone.filter(~covered).alias("l")
    lone = lone.join(s.alias("s"), (F.col("l.key") == F.col("s.key")) & similar(F.col("l.text"), F.col("s.text")), "left_anti").alias("l")
    same_number = (F.col("l.number") != "") & F.contains(F.upper(F.coalesce("k.table_id", F.lit(""))), F.col("l.number"))
    lone = lone.join(kept.alias("k"), (F.col("l.key") == F.col("k.key")) & same_number, "left_anti")
    out = kept.select(*shape, F.lit("structured").alias("source")).unionByName(own.unionByName(lone.drop("number")).select(*shape, F.lit("base").alias("source")))
    return out.unionByName(base.join(out.select("key").distinct(), "key", "left_anti").select(*shape, F.lit("base").alias("source")))


def merged_links(base: DataFrame, structured: DataFrame) -> DataFrame:
    """Links of both readings (key, url, ...) by URL; the base's row stays."""
    both = base.withColumn("__s", F.lit(0)).unionByName(structured.withColumn("__s", F.lit(1)))
    first = Window.partitionBy("key", "url").orderBy("__s")
    return both.withColumn("__r", F.row_number().over(first)).filter("__r = 1").drop("__s", "__r")
