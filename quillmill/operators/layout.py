"""Page layout as relations: reading order of text blocks, titles and authors by font, hyperlinks.

A PDF reader of choice supplies the blocks, lines and links; what they mean is decided here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Hosts of repositories and of datasets.
REPOSITORY_HOSTS = ["github.com", "gitlab.com", "bitbucket.org", "gitee.com"]
DATASET_HOSTS = ["zenodo", "figshare", "huggingface.co/datasets"]
# Sizes and places in points and shares of a page.
ROW_HEIGHT, COLUMN_BLOCKS = 6.0, 3
TOP, TITLE_REACH, SIZE_SLACK = 0.22, 0.28, 0.6
AUTHORS_BELOW, AUTHORS_WITHIN, AUTHOR_SIZE, MOST_AUTHORS = 2, 90, 8, 12
AFFILIATION_WORDS = ["University", "Department"]
# Lines that are no title.
PAGE_MARK = r"(?i)^\[Page\s+\d+\]$"
TITLE_JUNK = r"(?i)^(?:arxiv|doi|http|www\.|abstract|introduction|i+\.|dated:)"


def page_texts(blocks: DataFrame) -> DataFrame:
    """(key, page, text) of ``blocks`` (key, page, x0, y0, x1, text, page_width) in reading order.

    A page with COLUMN_BLOCKS blocks on both sides of its middle reads its left column first; within
    a column blocks go by rows of ROW_HEIGHT points, then from left to right. Blank blocks are left out.
    """
    side = ((F.col("x0") + F.col("x1")) / 2 >= F.col("page_width") / 2).cast("int")
    page = Window.partitionBy("key", "page")
    placed = blocks.filter(F.trim("text") != "").withColumn("side", side)
    counted = placed.withColumns({"right": F.sum("side").over(page), "all": F.count("*").over(page)})
    two = (F.col("right") >= COLUMN_BLOCKS) & (F.col("all") - F.col("right") >= COLUMN_BLOCKS)
    order = F.struct(F.when(two, F.col("side")).otherwise(0).alias("column"), F.bround(F.col("y0") / ROW_HEIGHT).alias("row"), "x0", F.regexp_replace("text", r"\s+$", "").alias("text"))
    return counted.groupBy("key", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda b: b["text"]), "\n").alias("text"))


def title_lines(lines: DataFrame) -> DataFrame:
    """``lines`` (key, x0, y0, size, text, page_height) of first pages that may belong to a title, tidied."""
    text = F.trim(F.regexp_replace("text", r"(?U)\s+", " "))
    tidy = lines.withColumn("text", text).filter((F.length("text") >= 4) & ~F.col("text").rlike(PAGE_MARK) & ~F.col("text").rlike(TITLE_JUNK))
    return tidy.filter(~((F.col("x0") < 30) & (F.col("size") >= 14)))


def titles_and_authors(lines: DataFrame) -> DataFrame:
    """(key, title, authors) by the largest font near the top of first pages and the names right below.

    The largest size is that of the top's lines of four words or more, else of any at the top, else of any.
    """
    rows = title_lines(lines)
    whole = Window.partitionBy("key")
    at_top = F.col("y0") < F.col("page_height") * TOP
    long_ = at_top & (F.size(F.split("text", " ")) >= 4)
    largest = F.coalesce(F.max(F.when(long_, F.col("size"))).over(whole), F.max(F.when(at_top, F.col("size"))).over(whole), F.max("size").over(whole))
    sized = rows.withColumn("largest", largest)
    titled = sized.withColumn("is_title", (F.col("size") >= F.col("largest") - SIZE_SLACK) & (F.col("y0") < F.col("page_height") * TITLE_REACH))
    below = F.col("y0") - F.max(F.when(F.col("is_title"), F.col("y0"))).over(whole)
    named = F.contains("text", F.lit(",")) | F.contains("text", F.lit(" and ")) | F.col("text").rlike(r"[A-Z]\.\s+[A-Za-z]")
    plain = ~T.contains_any(F.col("text"), [*AFFILIATION_WORDS, "Dated"])
    is_author = (below > AUTHORS_BELOW) & (below < AUTHORS_WITHIN) & F.col("size").between(AUTHOR_SIZE, F.col("largest")) & named & plain
    marked = titled.withColumn("is_author", F.coalesce(is_author, F.lit(False)))

    def joined(flag):
        held = F.array_sort(F.collect_list(F.when(F.col(flag), F.struct("y0", "x0", "text"))))
        return F.array_join(F.transform(held, lambda x: x["text"]), " ")

    both = marked.groupBy("key").agg(joined("is_title").alias("title"), joined("is_author").alias("names"))
    parts = F.transform(F.split(F.regexp_replace(F.regexp_replace("names", "[∗†‡§¶*]", " "), r"\s+", " "), r",|;|\band\b"), lambda p: F.regexp_replace(p, r"^[ .]+|[ .]+$", ""))
    people = F.filter(parts, lambda p: F.length(p).between(2, 60) & p.rlike("[A-Za-z]") & ~T.contains_any(p, AFFILIATION_WORDS))
    return both.select("key", "title", F.slice(people, 1, MOST_AUTHORS).alias("authors"))


def page_links(links: DataFrame) -> DataFrame:
    """(key, url, kind, page) of ``links`` (key, page, uri): repositories and datasets, each URL's first page."""
    low = F.lower("url")
    kind = F.when(T.contains_any(low, REPOSITORY_HOSTS), "repo").when(T.contains_any(low, DATASET_HOSTS), "dataset")
    found = links.withColumn("url", F.trim("uri")).withColumn("kind", kind).filter("kind is not null")
    return found.groupBy("key", "url", "kind").agg(F.min("page").alias("page"))
