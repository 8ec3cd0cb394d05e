"""Structure of line-oriented documents: headings, sections, tables, captions, figures, code, links.

Every operator takes the lines table of many documents and keeps the documents apart by ``key``, so
one job parses them all. Order is explicit (``line_no`` from 0).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from ..functions.joins import meet
from ..functions.numbers import to_number


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(key).alias("key"), F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r")).alias("line_no", "line"))


def front_matter(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, meta, body): the ``k: v`` lines between leading ``---`` lines; unterminated: meta and the whole text."""
    rest = F.regexp_extract(text, r"(?s)\A---[ \t]*\r?\n(.*)\z", 1)
    closed = F.regexp_extract(rest, r"(?s)\A(.*?)(?:^|\n)---[ \t]*(?:\n|\z)", 1)
    has_end = rest.rlike(r"(?m)^---[ \t]*$")
    head = F.when(has_end, closed).otherwise(rest)
    pairs = F.filter(F.split(head, "\n"), lambda s: F.contains(s, F.lit(":")))
    entry = lambda s: F.struct(F.lower(F.trim(F.substring_index(s, ":", 1))).alias("k"), F.regexp_replace(F.trim(F.regexp_replace(s, "^[^:]*:", "")), "^[\"']+|[\"']+$", "").alias("v"))
    body = F.regexp_replace(text, r"(?s)\A---[ \t]*\r?\n.*?(?:^|(?<=\n))---[ \t]*(?:\n|\z)", "")
    marked = F.col(text).rlike(r"\A---[ \t]*(\r?\n|\z)")
    entries = F.transform(pairs, entry)
    later = lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["k"] == e["k"])
    meta = F.map_from_entries(F.filter(entries, later))
    marked = F.col(text).rlike(r"\A---[ \t]*(\r?\n|\z)")
    meta = F.map_from_entries(F.map_values(F.aggregate(F.transform(pairs, entry), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<struct<k:string,v:string>>")), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["k"]), F.map_from_arrays(F.array(e["k"]), F.array(e))))))
    return docs.select(F.col(key).alias("key"), F.when(marked, meta).otherwise(F.map_from_entries(F.array().cast("array<struct<k:string,v:string>>"))).alias("meta"), F.when(marked & has_end, body).otherwise(F.col(text)).alias("body"))


def authors(value) -> object:
    bare = F.regexp_replace(value, r"[\[\]{}]", "")
    return F.filter(F.transform(F.split(bare, r",|;|\band\b|、"), lambda s: F.trim(s)), lambda s: s != "")


def _by_line(*more: str):
    return Window.partitionBy("key", *more).orderBy("line_no")


def headings(rows: DataFrame) -> DataFrame:
    """(key, line_no, level, heading): ATX headings, and lines underlined by = or -."""
    nxt = F.coalesce(F.lead("line").over(_by_line()), F.lit(""))
    level = F.length(F.regexp_extract("line", V.ATX_HEADING, 1))
    under = nxt.rlike(r"^(=+|-{2,})\s*$") & (F.trim("line") != "")
    found = rows.select("key", "line_no", "line", level.alias("atx"), under.alias("under"), F.startswith(F.trim(nxt), F.lit("=")).alias("one"))
    return found.filter("atx > 0 or under").select(
        "key",
        "line_no",
        F.when(F.col("atx") > 0, F.col("atx")).when(F.col("one"), 1).otherwise(2).alias("level"),
        F.when(F.col("atx") > 0, F.regexp_extract("line", V.ATX_HEADING, 2)).otherwise(F.trim("line")).alias("heading"),
    )


def titles(found: DataFrame) -> DataFrame:
    """The first heading of level 1 that is not a page mark."""
    first = found.filter((F.col("level") == 1) & ~F.col("heading").rlike(r"(?i)^page\s+\d+$"))
    return first.groupBy("key").agg(F.min_by("heading", "line_no").alias("title"))


def section_ranges(found: DataFrame, rows: DataFrame, deepest: int = 3) -> DataFrame:
    """(key, ord, heading, level, kind, start, stop): a section ends before the next heading of its level or
    above; so sections nest. One window a document gives every level's next heading; no self-join."""
    after = _by_line().rowsBetween(1, Window.unboundedFollowing)
    ends = rows.groupBy("key").agg((F.max("line_no") + 1).alias("n_lines"))
    marked = found
    for k in range(1, deepest + 1):
        marked = marked.withColumn(f"next{k}", F.min(F.when(F.col("level") <= k, F.col("line_no"))).over(after))
    stop = F.coalesce(*[F.when(F.col("level") == k, F.col(f"next{k}")) for k in range(1, deepest + 1)], "n_lines")
    kept = meet(marked.filter(F.col("level") <= deepest), ends, "key")
    return kept.select("key", F.row_number().over(_by_line()).alias("ord"), "heading", "level", T.heading_kind(F.col("heading")).alias("kind"), (F.col("line_no") + 1).alias("start"), stop.alias("stop"))


def section_texts(ranges: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    held = docs.select(F.col(key).alias("key"), F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r").alias("all"))
    body = F.array_join(F.slice("all", F.col("start") + 1, F.greatest(F.col("stop") - F.col("start"), F.lit(0))), "\n")
    return meet(ranges, held, "key").select("key", "ord", "heading", "level", "kind", F.regexp_replace(body, r"^\s+|\s+$", "").alias("text"))


def academic_sections(rows: DataFrame) -> DataFrame:
    """Sections under headings like ``I. INTRODUCTION``; documents with fewer than two have none."""
    # Section names.
    name = (
        r"(?:ABSTRACT|INTRODUCTION|RELATED\s+WORK|BACKGROUND|THEORY|METHODS?|RESULTS?(?:\s+AND\s+DISCUSSION)?|DISCUSSION|"
        r"CONCLUSIONS?(?:\s+AND\s+OUTLOOK)?|ACKNOWLEDGMENTS?|REFERENCES|BIBLIOGRAPHY|APPENDIX|SUPPLEMENTARY(?:\s+MATERIAL)?|DATA\s+AVAILABILITY(?:\s+STATEMENT)?)"
    )
    number = r"(?:I{1,3}|IV|V|VI|VII|VIII|IX|X|[0-9]+)"
    s = F.trim("line")
    solid = rows.withColumn("s", s).filter("s <> ''")
    nxt, prev = F.lead("s").over(_by_line()), F.lag("s").over(_by_line())
    head = lambda c: (F.length(c) <= 80) & c.rlike(rf"(?i)^(?:{number}\.\s+)?{name}\s*$")
    lone = lambda c: c.rlike(rf"(?i)^{number}\.\s*$")
    both = lone(F.col("s")) & F.coalesce(head(nxt), F.lit(False))
    found = solid.withColumns({"pair": both, "taken": F.coalesce(lone(prev) & head(F.col("s")), F.lit(False)), "own": head(F.col("s")), "nxt": nxt, "to": F.lead("line_no").over(_by_line())})
    marks = found.filter("pair or (own and not taken)").select(
        "key", "line_no", F.regexp_replace(F.when(F.col("pair"), F.concat_ws(" ", "s", "nxt")).otherwise(F.col("s")), r"\s+", " ").alias("heading"), F.when(F.col("pair"), F.col("to")).otherwise(F.col("line_no")).alias("last")
    )
    ends = rows.groupBy("key").agg((F.max("line_no") + 1).alias("n_lines"))
    whole = Window.partitionBy("key")
    ranged = meet(marks.withColumn("n", F.count("*").over(whole)).filter("n >= 2"), ends, "key")
    return ranged.select("key", F.row_number().over(_by_line()).alias("ord"), "heading", F.lit(1).alias("level"), T.heading_kind(F.col("heading")).alias("kind"), (F.col("last") + 1).alias("start"), F.coalesce(F.lead("line_no").over(_by_line()), "n_lines").alias("stop"))


def _split_row(line) -> object:
    bare = F.regexp_replace(F.regexp_replace(F.trim(line), r"^\|", ""), r"\|$", "")
    return F.transform(F.split(bare, r"\|", -1), lambda c: F.trim(c))


def table_rows(rows: DataFrame) -> DataFrame:
    """(key, table_id, caption, row_idx, cells): pipe tables; row 0 is the header.

    Runs of pipe rows parted by single separator rows alternate: the last row of a first run is a
    header, the next run its body. The caption is the first one from a row above the header to three below.
    """
    by = _by_line()
    kind = F.when(F.col("line").rlike(V.SEPARATOR_ROW), 2).when(F.col("line").rlike(V.PIPE_ROW), 1).otherwise(0)
    rest = F.trim(F.regexp_extract("line", V.TABLE_CAPTION, 3))
    said = F.when(F.col("line").rlike(V.TABLE_CAPTION), F.when(rest != "", rest).otherwise(F.trim("line")))
    marked = rows.withColumns({"kind": kind, "said": said})
    near = [F.lag("said").over(by), F.col("said"), *[F.lead("said", k).over(by) for k in (1, 2, 3)]]
    marked = marked.withColumns({"before": F.coalesce(F.lag("kind").over(by), F.lit(0)), "before2": F.coalesce(F.lag("kind", 2).over(by), F.lit(0)), "after": F.coalesce(F.lead("kind").over(by), F.lit(0)), "caption": F.coalesce(*near, F.lit(""))})
    opens = (F.col("kind") == 1) & (F.col("before") != 1)
    fresh = opens & ~((F.col("before") == 2) & (F.col("before2") == 1))
    runs = marked.withColumns({"run": F.sum(opens.cast("int")).over(by), "chain": F.sum(fresh.cast("int")).over(by)}).filter("kind = 1")
    runs = runs.withColumn("nth", F.dense_rank().over(Window.partitionBy("key", "chain").orderBy("run")))
    header = (F.col("nth") % 2 == 1) & (F.col("after") == 2)
    inside = runs.withColumn("is_header", header).filter("is_header or nth % 2 = 0").withColumn("table", F.sum(F.col("is_header").cast("int")).over(by))
    return inside.select("key", F.concat(F.lit("T"), F.col("table")).alias("table_id"), F.first("caption").over(_by_line("table")).alias("caption"), (F.row_number().over(_by_line("table")) - 1).alias("row_idx"), _split_row(F.col("line")).alias("cells"))


def cells(tables: DataFrame) -> DataFrame:
    """(key, table_id, row_idx, col_idx, col_name, raw, num) from rows whose row 0 is the header.

    Short rows are padded with '', long ones cut; of columns of one name the last stands; unnamed ones are col{i}.
    """
    head = tables.filter("row_idx = 0").select("key", "table_id", F.transform("cells", lambda c, i: F.when(F.trim(c) == "", F.concat(F.lit("col"), i + 1)).otherwise(F.trim(c))).alias("names"))
    body = meet(tables.filter("row_idx > 0"), head, ["key", "table_id"])
    each = body.select("key", "table_id", (F.col("row_idx") - 1).alias("row_idx"), "cells", F.posexplode("names").alias("col_idx", "col_name"))
    each = each.withColumn("raw", F.coalesce(F.try_element_at("cells", F.col("col_idx") + 1), F.lit("")))
    first = F.min("col_idx").alias("col_idx")
    return each.groupBy("key", "table_id", "row_idx", "col_name").agg(first, F.max_by("raw", "col_idx").alias("raw")).withColumn("num", to_number(F.col("raw")))


def captioned_tables(rows: DataFrame) -> DataFrame:
    """(key, table_id, caption): captions alone, each number once, with up to three short lines after them."""
    by = _by_line()
    s = F.trim("line")
    stop = (s == "") | s.rlike(V.TABLE_CAPTION) | s.rlike(V.FIGURE_CAPTION) | (F.length(s) >= 180)
    more = rows.withColumns({"number": F.regexp_extract(s, V.TABLE_CAPTION, 2), "rest": F.trim(F.regexp_extract(s, V.TABLE_CAPTION, 3)), "bare": s, "stop": stop})
    ahead = [(F.lead("bare", k).over(by), F.coalesce(F.lead("stop", k).over(by), F.lit(True))) for k in (1, 2, 3)]
    a, b, c = (F.when(~s_, t) for t, s_ in ahead)
    extra = F.concat_ws(" ", a, F.when(a.isNotNull(), b), F.when(a.isNotNull() & b.isNotNull(), c))
    found = more.withColumn("caption", F.trim(F.concat_ws(" ", "rest", extra))).filter("number <> ''")
    first = Window.partitionBy("key", "number").orderBy("line_no")
    found = found.withColumn("r", F.row_number().over(first)).filter("r = 1")
    return found.select("key", "line_no", F.concat(F.lit("T"), "number").alias("table_id"), F.when(F.col("caption") == "", F.col("bare")).otherwise(F.col("caption")).alias("caption"))


def aligned_tables(rows: DataFrame) -> DataFrame:
    """(key, table_id, row_idx, cells): three or more lines in columns of two spaces, opened by a numeric tail."""
    by = _by_line()
    numeric = F.col("line").rlike(r"^\s*\S.*?\s{2,}[-+]?[\d.,]+\s*$")
    spaced = (F.trim("line") != "") & F.col("line").rlike(r"\s{2,}")
    marked = rows.withColumns({"numeric": numeric, "in": numeric | spaced})
    marked = marked.withColumn("block", F.sum((~F.col("in")).cast("int")).over(by)).filter("in")
    seen = F.max(F.col("numeric").cast("int")).over(_by_line("block"))
    held = marked.withColumn("seen", seen).filter("seen = 1")
    held = held.withColumn("n", F.count("*").over(Window.partitionBy("key", "block"))).filter("n >= 3")
    number = F.dense_rank().over(Window.partitionBy("key").orderBy("block"))
    return held.select("key", F.concat(F.lit("H"), number).alias("table_id"), (F.row_number().over(_by_line("block")) - 1).alias("row_idx"), F.filter(F.split(F.trim("line"), r"\s{2,}"), lambda c: c != "").alias("cells"))


def figures(rows: DataFrame) -> DataFrame:
    """(key, fig_id, caption, image_path, kind): the k-th new caption takes the next unused image seen so far.

    With I(k) images seen by caption k, images used by then are k + min(0, min over j <= k of I(j) - j), so
    the first-in-first-out pairing is a running minimum. Images left over follow as FX.
    """
    by = _by_line()
    images = F.regexp_extract_all("line", F.lit(V.IMAGE), F.lit(2))
    marked = rows.withColumns({"images": images, "number": F.regexp_extract("line", V.FIGURE_CAPTION, 2), "rest": F.trim(F.regexp_extract("line", V.FIGURE_CAPTION, 3))})
    marked = marked.withColumn("seen", F.sum(F.size("images")).over(by))
    said = marked.filter("number <> ''").withColumn("caption", F.when(F.col("rest") != "", F.col("rest")).otherwise(F.trim("line")))
    every = F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "caption"))), lambda x: x["caption"])), " ")
    first = said.groupBy("key", "number").agg(F.min("line_no").alias("line_no"), F.min_by("caption", "line_no").alias("first"), every.alias("caption"), F.min_by("seen", "line_no").alias("seen"))
    k = F.row_number().over(by)
    first = first.withColumn("k", k).withColumn("used", F.col("k") + F.least(F.lit(0), F.min(F.col("seen") - F.col("k")).over(by)))
    first = first.withColumn("takes", F.when(F.col("used") > F.coalesce(F.lag("used").over(by), F.lit(0)), F.col("used")))
    pool = marked.select("key", "line_no", F.posexplode("images").alias("i", "path")).withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("line_no", "i")))
    paired = meet(first, pool.select("key", F.col("nth").alias("takes"), "path"), ["key", "takes"], "left")
    captioned = paired.select("key", F.col("k").alias("ord"), F.concat(F.lit("F"), "number").alias("fig_id"), "caption", F.col("path").alias("image_path"), T.figure_kind(F.col("first")).alias("kind"))
    done = first.groupBy("key").agg(F.max("used").alias("used"), F.max("k").alias("k"))
    left = meet(pool, done, "key", "left").filter(F.col("nth") > F.coalesce("used", F.lit(0)))
    ord_ = F.coalesce("k", F.lit(0)) + F.col("nth") - F.coalesce("used", F.lit(0))
    return captioned.unionByName(left.select("key", ord_.cast("int").alias("ord"), F.concat(F.lit("FX"), ord_.cast("int")).alias("fig_id"), F.lit("").alias("caption"), F.col("path").alias("image_path"), F.lit("unknown").alias("kind")))


def fenced_blocks(rows: DataFrame) -> DataFrame:
    """(key, open_line, info, body): lines between fences; an open fence runs to the end."""
    fence = F.col("line").rlike(V.FENCE)
    marked = rows.withColumns({"fence": fence, "n": F.sum(fence.cast("int")).over(_by_line())})
    inside = marked.filter("n % 2 = 1")
    body = F.transform(F.array_sort(F.collect_list(F.when(~F.col("fence"), F.struct("line_no", "line")))), lambda x: x["line"])
    return inside.groupBy("key", "n").agg(F.min("line_no").alias("open_line"), F.lower(F.min_by(F.regexp_extract("line", V.FENCE, 1), "line_no")).alias("info"), body.alias("body")).drop("n")


def is_pseudocode(info, body) -> object:
    """By the info string; else two algorithm words and no line of a real language."""
    text = F.lower(F.array_join(body, "\n"))
    named = T.contains_any(info, V.PSEUDO_INFO)
    real = F.exists(body, lambda s: F.contains(s, F.lit("def ")) | F.contains(s, F.lit("import ")) | F.contains(s, F.lit("class ")))
    lines_ = F.exists(body, lambda s: s.rlike(r"^\s*(def |class |import |from )"))
    hits = F.size(F.filter(F.array(*[F.lit(w) for w in V.PSEUDO_WORDS]), lambda w: F.contains(text, w)))
    return named | (~(info.isin(V.REAL_LANGUAGES) & real) & (hits >= 2) & ~lines_)


def algorithms(rows: DataFrame) -> DataFrame:
    """(key, algorithm_id, caption, lines): pseudocode blocks; a title line inside stands before the last caption above.

    The caption is the last one outside fences since the block before, an as-of lookup by window."""
    by = _by_line()
    blocks = fenced_blocks(rows).filter(is_pseudocode(F.col("info"), F.col("body")))
    fence = F.col("line").rlike(V.FENCE)
    outside = rows.withColumn("n", F.sum(fence.cast("int")).over(by)).filter("n % 2 = 0").filter(F.col("line").rlike(V.ALGORITHM_CAPTION))
    rest = F.element_at(F.split(F.regexp_extract("line", V.ALGORITHM_CAPTION, 3), r"(?<=[.。;；])\s", 2), 1)
    said = outside.select("key", "line_no", F.regexp_replace(F.trim(F.concat(F.lit("Algorithm "), F.regexp_extract("line", V.ALGORITHM_CAPTION, 2), F.lit(". "), rest)), r"\.+$", "").alias("said"))
    events = said.select("key", "line_no", "said", F.lit(None).cast("array<string>").alias("body")).unionByName(blocks.select("key", F.col("open_line").alias("line_no"), F.lit(None).cast("string").alias("said"), "body"))
    group = F.coalesce(F.sum(F.col("body").isNotNull().cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    events = events.withColumn("group", group).withColumn("above", F.last("said", ignorenulls=True).over(_by_line("group"))).filter("body is not null")
    top = F.coalesce(F.try_element_at("body", F.lit(1)), F.lit(""))
    titled = top.rlike(V.ALGORITHM_TITLE)
    lead = F.coalesce(F.left(F.try_element_at(F.filter(F.transform("body", lambda s: F.trim(s)), lambda s: s != ""), F.lit(1)), F.lit(120)), F.lit(""))
    caption = F.when(titled, F.regexp_replace(F.trim(top), r"\.+$", "")).otherwise(F.coalesce("above", lead))
    kept = F.when(titled, F.slice("body", F.lit(2), F.size("body"))).otherwise(F.col("body"))
    return events.select("key", F.concat(F.lit("A"), F.row_number().over(by)).alias("algorithm_id"), caption.alias("caption"), kept.alias("lines"))


def links(rows: DataFrame) -> DataFrame:
    """(key, url, kind, evidence): the first placeable mention of each URL: repo, dataset or other code."""
    by = _by_line()
    context = F.lower(F.concat_ws(" ", F.lag("line").over(by), "line", F.lead("line").over(by)))
    found = rows.withColumn("context", context).select("key", "line_no", "line", "context", F.posexplode(F.regexp_extract_all("line", F.lit(V.URL), F.lit(0))).alias("i", "url"))
    found = found.withColumn("url", F.regexp_replace("url", "[.,;)]+$", ""))
    data = T.contains_any(F.col("context"), V.DATASET_WORDS) | T.contains_any(F.lower("url"), V.DATASET_HOSTS)
    kind = F.when(F.col("url").rlike(V.GITHUB), "repo").when(data, "dataset").when(T.contains_any(F.col("context"), V.CODE_WORDS), "other")
    placed = found.withColumn("kind", kind).filter("kind is not null")
    first = Window.partitionBy("key", "url").orderBy("line_no", "i")
    return placed.withColumn("r", F.row_number().over(first)).filter("r = 1").select("key", "line_no", "url", "kind", F.left(F.trim("line"), F.lit(200)).alias("evidence"))


def code_statements(rows: DataFrame) -> DataFrame:
    """Each document's first line that says code is released, up to 240 characters."""
    said = rows.filter(T.states_code(F.col("line")))
    return said.groupBy("key").agg(F.left(F.trim(F.min_by("line", "line_no")), F.lit(240)).alias("statement"))


def formulas(rows: DataFrame) -> DataFrame:
    """(key, number, expression, explanation): numbered formulas that the text mentions, up to six lines each."""
    by = _by_line()
    bare = F.trim("line")
    alone = F.regexp_extract(bare, r"^[（(]\s*(\d{1,2})\s*[)）]\s*$", 1)
    mention = r"(?i)(?:Eq(?:uation)?\.?|eq\.|公式)\s*[\(（]?\s*(\d{1,2})\s*[\)）]?"
    marked = rows.withColumns({"bare": bare, "alone": alone})
    words = F.when((F.col("alone") == "") & (F.col("bare") != ""), F.col("bare"))
    blob = F.trim(F.regexp_replace(F.concat_ws(" ", F.lag(words).over(by), words, F.lead(words).over(by), F.lead(words, 2).over(by)), r"\s+", " "))
    named = marked.withColumn("blob", blob).select("key", "line_no", "blob", F.posexplode(F.regexp_extract_all("line", F.lit(mention), F.lit(1))).alias("i", "number")).filter("blob <> ''")
    named = named.groupBy("key", "number").agg(F.left(F.min_by("blob", F.struct("line_no", "i")), F.lit(400)).alias("explanation"))
    ends = (F.col("alone") != "") | (F.col("bare").rlike(mention) & (F.length("bare") > 80)) | ((F.length("bare") > 140) & ~F.col("bare").rlike("[=∑∫√ψϕεϵ∈→←]"))
    # The body: non-blank lines upwards without a break, after blank lines next to the number.
    solid = marked.withColumn("ends", ends).filter("bare <> ''").withColumn("gap", F.col("line_no") - F.lag("line_no").over(by))
    above = F.collect_list(F.struct("line_no", "bare", "ends", "gap")).over(by.rowsBetween(-6, -1))
    own = meet(solid.withColumn("above", above).filter("alone <> ''"), named.withColumnRenamed("number", "alone"), ["key", "alone"])

    def step(acc, x):
        broken = acc["done"] | x["ends"]
        out = F.when(broken, acc["out"]).otherwise(F.concat(F.array(x["bare"]), acc["out"]))
        return F.struct(out.alias("out"), (broken | (x["gap"] > 1)).alias("done"))

    body = F.aggregate(F.reverse("above"), F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("done")), step)["out"]
    made = own.withColumn("expression", F.trim(F.regexp_replace(F.array_join(body, " "), r"\s+", " "))).filter(F.length("expression") >= 2)
    first = Window.partitionBy("key", "alone").orderBy("line_no")
    return made.withColumn("r", F.row_number().over(first)).filter("r = 1").select("key", F.col("alone").alias("number"), "expression", "explanation")
