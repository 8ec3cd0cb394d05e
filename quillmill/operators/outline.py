"""Talk outlines: closing chunks, sections of an outline's headings, slides' tables and figures, digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.joins import meet

# Numbering before a heading, headings of closing chunks, headings that end one.
NUMBERED = r"(?iU)^\s*(?:(?:section|chapter|第)\s*)?(?:(?:\d+|[ivxlcdm]+|[一二三四五六七八九十]+)[\.、.:：)]?\s+)"
CLOSING = NUMBERED + r"?(?:conclusions?(?:\s+and\s+outlook)?|discussion|limitations?|outlook|future\s+works?|结论(?:与展望)?|讨论|展望|不足|局限)\s*$"
ENDING = (
    NUMBERED + r"?(?:methods?|references?|acknowledg(?:e?ments?)?|bibliograph(?:y|ies)|appendix|supplementary(?:\s+material)?|"
    r"data\s+availability|code\s+availability|方法|参考文献|致谢|附录|数据可用性)\s*$"
)
NEXT = NUMBERED + r"[A-Za-z\x{4e00}-\x{9fff}]"
# Words of a closing heading's kind.
LIMITATION_WORDS = ["不足", "局限", "limitation"]
OUTLOOK_WORDS = ["展望", "outlook", "future"]
CONCLUSION_WORDS = ["conclusion", "结论"]
DISCUSSION_WORDS = ["讨论", "discussion"]
# Sentences that speak of what comes next and of what is missing.
OUTLOOK_SENTENCE = r"(?i)recommend|future work|in the future|outlook|we (?:will|plan)|should report|open (?:problem|question)|pave the way|opens up|new applications|建议|展望|未来|下一步|开放问题"
LIMITATION_SENTENCE = r"(?i)limitations?|bottleneck|further improved|more research|cannot|unable|not (?:be )?released|drawback|caveat|only (?:a )?single|不足|局限|未能|无法|缺点|偏差|无法公开"
# Translated headings and terms, in order.
HEADINGS_ZH = [
    ("I. INTRODUCTION", "引言：问题从哪来"),
    ("II. METHODS", "方法：模型与基组"),
    ("III. RESULTS AND DISCUSSION", "结果与讨论"),
    ("IV. CONCLUSIONS AND OUTLOOK", "结论与展望"),
    ("DATA AVAILABILITY STATEMENT", "数据可用性"),
    ("ACKNOWLEDGMENTS", "致谢"),
    ("SUPPLEMENTARY MATERIAL", "补充材料"),
]
GLOSSARY = [
    (r"wave functions?", "波函数"),
    (r"molecular orbitals?|\bMOs?\b", "分子轨道"),
    (r"Hamiltonians?", "哈密顿量"),
    (r"overlap matrices?", "重叠矩阵"),
    (r"eigenvalues?", "本征值"),
    (r"eigenvalue problem", "本征值问题"),
    (r"quasi-atomic minimal basis", "准原子最小基"),
    (r"\bQUAMBOs?\b", "QUAMBO"),
    (r"\bSchNOrb\b", "SchNOrb"),
    (r"deep (convolutional )?neural network", "深度神经网络"),
    (r"Hartree[-\s]Fock|\bHF\b", "Hartree-Fock"),
    (r"Density Functional Theory|\bDFT\b", "密度泛函理论"),
    (r"atomic orbitals?", "原子轨道"),
    (r"basis (set|representation)", "基组表示"),
]
# Outline words and the section kinds that they stand for, in order.
OUTLINE_KINDS = [
    ("研究背景", ["introduction", "background"]),
    ("引言", ["introduction", "background"]),
    ("相关工作", ["related_work"]),
    ("预备知识", ["background"]),
    ("核心方法", ["method"]),
    ("方法", ["method"]),
    ("实验", ["experiment"]),
    ("结果", ["experiment"]),
    ("结论", ["conclusion", "discussion"]),
    ("一句话", ["abstract"]),
    ("速览", ["abstract"]),
]
ABSTRACT_WORDS = ["速览", "总结"]
# Words of slides that show results or methods, and the one of formula slides.
RESULT_WORDS = ["结果", "实验", "result", "experiment", "图表", "速读", "解读"]
METHOD_WORDS = ["方法", "框架", "架构", "method", "核心", "算法"]
FORMULA_WORD = "公式"


def closing_kind(heading: Column) -> Column:
    low = F.lower(heading)
    outlook = T.contains_any(low, OUTLOOK_WORDS) & ~T.contains_any(low, CONCLUSION_WORDS)
    return F.when(T.contains_any(low, LIMITATION_WORDS), "limitation").when(outlook, "outlook").when(T.contains_any(low, DISCUSSION_WORDS), "discussion").otherwise("conclusion")


def closing_chunks(lines: DataFrame) -> DataFrame:
    """(key, kind, text) of conclusions, outlooks, limitations and discussions in ``lines`` (key, line_no, line).

    A closing heading opens a chunk, any other numbered or ending heading closes it; the last of
    them before a line says which chunk holds it. Chunks of one kind are joined.
    """
    raw = F.regexp_replace("line", r"(?U)^\s+|\s+$", "")
    closing = F.col("raw").rlike(CLOSING)
    mark = F.when(closing, closing_kind(F.col("raw"))).when(F.col("raw").rlike(NEXT) | F.col("raw").rlike(ENDING), "")
    marked = lines.select("key", "line_no", raw.alias("raw")).withColumn("mark", mark)
    held = marked.withColumn("kind", F.last("mark", ignorenulls=True).over(Window.partitionBy("key").orderBy("line_no")))
    body = held.filter(F.col("mark").isNull() & (F.col("kind") != "") & (F.col("raw") != ""))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "raw"))), lambda x: x["raw"])
    return body.groupBy("key", "kind").agg(F.array_join(ordered, " ").alias("text"))


def picked(text: Column, n: int, prefer: str | None = None, lead: bool = False, most: int = 108) -> Column:
    """At most ``n`` condensed sentences of ``text``: the first if asked for, then those that fit ``prefer``
    (all of them without one); equal ones once."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")
    every = F.when(F.length(F.trim(flat)) >= 12, T.sentences(F.trim(flat))).otherwise(F.array().cast("array<string>"))
    fit = F.filter(every, lambda s: s.rlike(prefer)) if prefer else every
    short = F.transform(F.concat(F.slice(every, 1, 1), fit) if lead else fit, lambda s: T.condense(s, most))
    return F.slice(F.array_distinct(F.filter(short, lambda s: F.length(s) >= 8)), 1, n)


def closing_points(chunks: DataFrame, tails: DataFrame, n: int = 2) -> DataFrame:
    """(key, label, points) for 结论, 展望 and 不足. A chunk shorter than 40 characters gives way to the
    discussion, then to the text's tail, of ``tails`` (key, tail)."""
    kinds = ["conclusion", "outlook", "limitation", "discussion"]
    wide = chunks.groupBy("key").agg(*[F.max(F.when(F.col("kind") == k, F.col("text"))).alias(k) for k in kinds])
    every = meet(tails, wide, "key", "left")
    instead = F.coalesce("discussion", "tail", F.lit(""))
    use = lambda k: F.when(F.length(F.coalesce(k, F.lit(""))) >= 40, F.col(k)).otherwise(instead)
    rows = [("结论", picked(use("conclusion"), n, lead=True)), ("展望", picked(use("outlook"), n, OUTLOOK_SENTENCE)), ("不足", picked(use("limitation"), n, LIMITATION_SENTENCE))]
    points = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(label).alias("label"), p.alias("points")) for i, (label, p) in enumerate(rows)])
    return every.select("key", F.inline(points)).filter(F.size("points") > 0).select("key", "ord", "label", "points")


def translated_heading(heading: Column) -> Column:
    trimmed = F.trim(F.coalesce(heading, F.lit("")))
    return reduce(lambda out, h: F.when(trimmed == h[0], F.lit(h[1])).otherwise(out), HEADINGS_ZH, trimmed)


def glossed(text: Column) -> Column:
    """Known terms translated one after the other; a text without any CJK character is introduced as a quotation."""
    out = reduce(lambda t, g: F.regexp_replace(t, "(?i)" + g[0], g[1]), GLOSSARY, F.trim(F.coalesce(text, F.lit(""))))
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    return F.when((out == "") | T.has_cjk(out), out).otherwise(F.concat(F.lit("论文指出："), out))


def outline_sections(outline: DataFrame, sections: DataFrame, abstracts: DataFrame) -> DataFrame:
    """(key, pos, heading, ord, section, text): the sections that each outline heading speaks of.

    ``outline`` (key, pos, heading), ``sections`` (key, ord, heading, kind, text), ``abstracts`` (key,
    abstract). The first rule with a section decides: the same heading, a translated heading, the
    kinds of an outline word (all such sections, by kind, then order), else the abstract for overviews.
    """
    head, own = F.trim("o.heading"), F.trim("s.heading")
    rule = lambda group, at, nth: F.struct(F.lit(group).alias("group"), F.lit(at).alias("at"), F.lit(nth).alias("nth"))
    rules = [F.when(own == head, rule(0, 0, 0))]
    rules += [F.when((own == en) & F.contains(head, F.lit(zh)), rule(1, i, 0)) for i, (en, zh) in enumerate(HEADINGS_ZH)]
    rules += [F.when((F.col("s.kind") == k) & F.contains(head, F.lit(word)), rule(2, i, j)) for i, (word, kinds) in enumerate(OUTLINE_KINDS) for j, k in enumerate(kinds)]
    met = outline.alias("o").join(sections.alias("s"), "key").select("key", "o.pos", F.col("s.ord"), F.col("s.heading").alias("section"), "s.text", F.filter(F.array(*rules), lambda r: r.isNotNull()).alias("rules"))
    # Every fitting rule is a candidate, as the first rule of one section need not be the heading's.
    met = met.select("key", "pos", "ord", "section", "text", F.explode("rules").alias("r"))
    slide = Window.partitionBy("key", "pos")
    first = met.withColumn("best", F.min(F.struct("r.group", "r.at")).over(slide)).filter((F.col("r.group") == F.col("best.group")) & (F.col("r.at") == F.col("best.at")))
    ranked = first.withColumn("n", F.row_number().over(slide.orderBy("r.nth", "ord"))).filter((F.col("r.group") == 2) | (F.col("n") == 1))
    found = outline.join(ranked.select("key", "pos", "n", "ord", "section", "text"), ["key", "pos"], "left").join(abstracts, "key", "left")
    overview = F.col("n").isNull() & T.contains_any(F.col("heading"), ABSTRACT_WORDS)
    return found.select(
        "key", "pos", "heading", F.coalesce("n", F.lit(1)).alias("ord"), F.when(overview, "Abstract").otherwise(F.col("section")).alias("section"), F.when(overview, F.coalesce("abstract", F.lit(""))).otherwise(F.col("text")).alias("text")
    ).filter(F.col("section").isNotNull())


def slide_assets(outline: DataFrame, tables: DataFrame, figures: DataFrame) -> DataFrame:
    """(key, pos, heading, kind, table_id, figure_id): tables and figures dealt to slides, each one once.

    ``outline`` (key, pos, heading), ``tables`` (key, ord, table_id), ``figures`` (key, ord, figure_id,
    kind). In slide order, result slides take the next table, else the next figure; method slides take
    the next architecture figure, else the next one. Figures of unknown kind serve only where a paper
    has no others. One fold a paper over its outline.
    """
    ids = lambda rows, name: F.transform(F.array_sort(F.collect_list(F.struct("ord", *name))), lambda x: F.struct(*[x[c].alias(c) for c in name]))
    low = F.lower("heading")
    result = T.contains_any(low, RESULT_WORDS)
    role = F.when(result, "result").when(T.contains_any(low, METHOD_WORDS), "method").otherwise("")
    slides = outline.filter(~F.contains("heading", F.lit(FORMULA_WORD))).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "heading", role.alias("role")))).alias("slides"))
    t = tables.groupBy("key").agg(F.transform(ids(tables, ["table_id"]), lambda x: x["table_id"]).alias("t"))
    known = figures.groupBy("key").agg(ids(figures, ["figure_id", "kind"]).alias("every"))
    f = known.select("key", F.filter("every", lambda x: x["kind"] != "unknown").alias("sure"), "every").select("key", F.when(F.size("sure") > 0, F.col("sure")).otherwise(F.col("every")).alias("f"))
    no_t, no_f = F.array().cast("array<string>"), F.array().cast("array<struct<figure_id:string,kind:string>>")
    papers = slides.join(t, "key", "left").join(f, "key", "left").select("key", "slides", F.coalesce("t", no_t).alias("t"), F.coalesce("f", no_f).alias("f"))
    out_type = "array<struct<pos:int,heading:string,kind:string,table_id:string,figure_id:string>>"

    def deal(state: Column, slide: Column) -> Column:
        arch = F.filter(state["f"], lambda x: x["kind"] == "architecture")
        gives_table = (slide["role"] == "result") & (F.size(state["t"]) > 0)
        wants_figure = (slide["role"] != "") & ~gives_table
        pick = F.when((slide["role"] == "method") & (F.size(arch) > 0), F.get(arch, F.lit(0))).otherwise(F.get(state["f"], F.lit(0)))
        figure = F.when(wants_figure, pick["figure_id"])
        table_id = F.when(gives_table, F.get(state["t"], F.lit(0)))
        kind = F.when(table_id.isNotNull(), "table").when(figure.isNotNull(), "figure").otherwise("content")
        made = F.struct(slide["pos"].cast("int").alias("pos"), slide["heading"].alias("heading"), kind.alias("kind"), table_id.alias("table_id"), figure.alias("figure_id"))
        return F.struct(
            F.when(gives_table, F.slice(state["t"], 2, 1 << 30)).otherwise(state["t"]).alias("t"),
            F.filter(state["f"], lambda x: figure.isNull() | (x["figure_id"] != figure)).alias("f"),
            F.concat(state["out"], F.array(made)).alias("out"),
        )

    start = F.struct(F.col("t").alias("t"), F.col("f").alias("f"), F.array().cast(out_type).alias("out"))
    return papers.select("key", F.inline(F.aggregate("slides", start, deal, lambda s: s["out"])))


def digests(heads: DataFrame, sections: DataFrame, algorithms: DataFrame, tables: DataFrame, budget: int = 9000, most_tables: int = 3, most_rows: int = 12) -> DataFrame:
    """(key, digest): title, authors, abstract, sections, pseudocode and the first tables, cut to ``budget`` characters.

    ``heads`` (key, title, authors, abstract), ``sections`` (key, ord, heading, text), ``algorithms``
    (key, ord, algorithm_id, caption, lines), ``tables`` (key, ord, table_id, caption, row_idx, cells).
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    grid = tables.withColumn("nth", F.dense_rank().over(Window.partitionBy("key").orderBy("ord"))).filter((F.col("nth") <= most_tables) & (F.col("row_idx") <= most_rows))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", F.array_join("cells", " | ").alias("row")))), lambda x: x["row"]), "\n")
    grid = grid.groupBy("key", "ord", "table_id").agg(F.first("caption").alias("caption"), rows.alias("rows"))
    parts = [
        sections.select("key", F.lit(1).alias("group"), "ord", F.concat(F.lit("# "), text("heading"), F.lit("\n"), text("text")).alias("part")),
        algorithms.select("key", F.lit(2).alias("group"), "ord", F.concat(F.lit("# 伪代码 "), "algorithm_id", F.lit("（"), text("caption"), F.lit("）\n"), F.array_join("lines", "\n")).alias("part")),
        grid.select("key", F.lit(3).alias("group"), "ord", F.concat(F.lit("# 表格 "), "table_id", F.lit("（"), text("caption"), F.lit("）\n"), "rows").alias("part")),
    ]
    # No part needs more characters than the whole digest may have.
    every = reduce(DataFrame.unionByName, parts).withColumn("part", F.left("part", F.lit(budget)))
    joined = every.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("group", "ord", "part"))), lambda x: x["part"]).alias("parts"))
    head = F.array(F.concat(F.lit("# 标题\n"), text("title")), F.concat(F.lit("# 作者\n"), F.array_join(F.coalesce("authors", F.array().cast("array<string>")), ", ")), F.concat(F.lit("# 摘要\n"), text("abstract")))
    whole = F.concat(head, F.coalesce("parts", F.array().cast("array<string>")))
    return heads.join(joined, "key", "left").select("key", F.left(F.array_join(whole, "\n\n"), F.lit(budget)).alias("digest"))


# An outline's slots by section kind with the heading where a paper has no such section, and the others.
SLOT_KINDS = [("introduction", "研究背景与要解决的问题"), ("related_work", "相关工作与本文定位"), ("background", "预备知识"), ("method", "核心方法"), ("experiment", "实验：设置、数据与指标")]
OVERVIEW, CLOSING_HEADING, LAST_HEADING = "论文速览：", "结论与局限", "复现路径与本工具的处理方式"
FORMULAS_HEADING, ALGORITHMS_HEADING = "带编号的公式（仅收录正文有解释的）", "关键算法流程（伪代码逐行精读）"
TABLES_HEADING, FIGURES_HEADING = ("重点结果解读（", " 张表格）"), ("图表速读（", " 张图）")


def trimmed(rows: DataFrame, target: int, key: str = "key", order: str = "pos") -> DataFrame:
    """Of more than ``target`` rows a key, the first ``target - 2`` (four at least) and the last two; told by a row's
    place from either end."""
    ends = Window.partitionBy(key)
    placed = rows.withColumns({"_place": F.row_number().over(ends.orderBy(order)), "_n": F.count("*").over(ends)})
    keep = max(4, target - 2)
    return placed.filter((F.col("_n") <= target) | (F.col("_place") <= keep) | (F.col("_place") > F.col("_n") - 2)).drop("_place", "_n")


def outlines(heads: DataFrame, sections: DataFrame, target: int = 12) -> DataFrame:
    """(key, pos, heading): a talk's headings. ``heads`` (key, title, n_formulas, n_algorithms, n_tables, n_figures),
    ``sections`` (key, ord, heading, kind, text).

    Slots stand in order: overview, the first section of each kind or the slot's own heading, more method and
    experiment sections, formulas, algorithms, tables, figures, conclusion, reproduction. Equal headings stay once.
    """
    body = sections.filter(~F.col("kind").isin("references", "appendix") & (F.trim("text") != "")).select("key", "ord", "heading", "kind")
    kinds = [k for k, _ in SLOT_KINDS] + ["conclusion"]
    firsts = body.groupBy("key").agg(*[F.min_by(F.when(F.col("kind") == k, F.col("heading")), F.when(F.col("kind") == k, F.col("ord"))).alias(k) for k in kinds])
    all_ = meet(heads, firsts, "key", "left")
    slot = lambda c, default: F.when(F.col(c).isNotNull(), translated_heading(F.col(c))).otherwise(default)
    counted = lambda c, words: F.when(F.col(c) > 0, F.concat(F.lit(words[0]), F.col(c).cast("string"), F.lit(words[1])))
    fixed = [
        (0, F.concat(F.lit(OVERVIEW), F.coalesce(F.nullif(T.short_heading(F.col("title")), F.lit("")), F.lit("论文")))),
        *[(i + 1, slot(k, label)) for i, (k, label) in enumerate(SLOT_KINDS)],
        (7, F.when(F.col("n_formulas") > 0, FORMULAS_HEADING)),
        (8, F.when(F.col("n_algorithms") > 0, ALGORITHMS_HEADING)),
        (9, counted("n_tables", TABLES_HEADING)),
        (10, counted("n_figures", FIGURES_HEADING)),
        (11, slot("conclusion", CLOSING_HEADING)),
        (12, F.lit(LAST_HEADING)),
    ]
    rows = all_.select("key", F.explode(F.array(*[F.struct(F.lit(i).alias("slot"), F.lit(0).alias("ord"), h.alias("heading")) for i, h in fixed])).alias("s")).select("key", "s.*").filter("heading is not null")
    more = body.filter(F.col("kind").isin("method", "experiment")).select("key", F.lit(6).alias("slot"), "ord", translated_heading(F.col("heading")).alias("heading"))
    same = rows.unionByName(more).withColumn("same", T.dedupe_key(F.col("heading"))).filter("same <> ''")
    once = same.withColumn("r", F.row_number().over(Window.partitionBy("key", "same").orderBy("slot", "ord"))).filter("r = 1")
    numbered = once.select("key", F.row_number().over(Window.partitionBy("key").orderBy("slot", "ord")).alias("pos"), "heading")
    cut = trimmed(numbered, target)
    return cut.select("key", (F.row_number().over(Window.partitionBy("key").orderBy("pos")) - 1).alias("pos"), "heading")


# The labels of closing bullets, in order.
CONCLUSION_LABEL, OUTLOOK_LABEL, LIMITATION_LABEL = "结论", "展望", "不足"
NO_CLOSING = "结论：原文末尾未抽到独立结论段，建议对照论文最后一节人工补充。"
TAIL, BULLET, LEAST_BULLETS, ENOUGH_BULLETS, MOST_BULLETS = 2200, 108, 3, 5, 6


def _bullets(sentences: Column, most: int = BULLET) -> Column:
    return F.filter(F.transform(sentences, lambda s: T.condense(s, most)), lambda b: F.length(b) >= 8)


def _first_of_each(bullets: Column) -> Column:
    """Bullets that differ from all before them but for case."""
    return F.filter(bullets, lambda b, i: ~F.exists(F.slice(bullets, F.lit(1), i), lambda c: F.lower(c) == F.lower(b)))


def closing_bullets(papers: DataFrame, chunks: DataFrame, n: int = 2) -> DataFrame:
    """(key, bullets) for the last slide of ``papers`` (key, abstract, text); ``chunks`` as of :func:`closing_chunks`.

    Each label takes sentences from two ranked sources within the budget of characters that a bullet has: those that
    fit it (the conclusion's first sentence before them), then the best of a summary of its text, for conclusion and outlook
    always and for limitations only where none fits. A label's text shorter than 40 characters gives way to
    the discussion or the text's tail. Bullets equal to an earlier one fall away; a paper left with less than
    three is filled up from its tail's summary to five, under the first label that it lacks.
    """
    from .terms import summaries

    kinds = ["conclusion", "outlook", "limitation", "discussion"]
    wide = chunks.groupBy("key").agg(*[F.max(F.when(F.col("kind") == k, F.col("text"))).alias(k) for k in kinds])
    held = papers.select("key", F.coalesce("abstract", F.lit("")).alias("abstract"), F.right(F.coalesce(F.nullif("text", F.lit("")), "abstract", F.lit("")), F.lit(TAIL)).alias("tail")).join(wide.hint("merge"), "key", "left")
    text = lambda c: F.coalesce(F.trim(F.col(c)), F.lit(""))
    instead = F.when(text("discussion") != "", text("discussion")).otherwise(F.col("tail"))
    both = F.trim(F.concat_ws(" ", text("discussion"), "tail"))
    use = lambda c, other: F.regexp_replace(F.trim(F.when(F.length(text(c)) < 40, other).otherwise(text(c))), r"\s+", " ")
    sources = [(0, use("conclusion", instead)), (1, use("outlook", instead)), (2, use("limitation", both)), (3, F.col("tail"))]
    each = held.select("key", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), t.alias("source")) for i, t in sources])).alias("e")).select(F.struct("key", "e.i").alias("id"), "e.source")
    # The best sentences of each source, in reading order; the tail's four, of the others two.
    best = summaries(each, 4, "id", "source").select("id", "pos", "sentence").unionByName(summaries(each.filter("id.i < 3"), max(n, 2), "id", "source").select("id", (F.col("pos") + 100).alias("pos"), "sentence"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"])
    summed = best.filter("(id.i = 3) = (pos <= 100)").groupBy("id").agg(listed.alias("summary"))
    none = F.array().cast("array<string>")
    found = meet(each, summed, "id", "left").withColumns({"every": F.when(F.length("source") >= 12, T.sentences(F.col("source"))).otherwise(none), "summary": F.coalesce("summary", none)})
    i = F.col("id.i")
    fit = F.when(i == 1, F.filter("every", lambda s: s.rlike(OUTLOOK_SENTENCE))).when(i == 2, F.filter("every", lambda s: s.rlike(LIMITATION_SENTENCE))).otherwise(none)
    picked = F.array_distinct(F.concat(F.when(i == 0, F.slice("every", 1, 1)).otherwise(none), fit))
    fill = (F.size("every") > 0) & (F.size(picked) < n) & ((i < 2) | (F.size(fit) == 0))
    chosen = F.slice(_first_of_each(_bullets(F.when(fill, F.array_distinct(F.concat(picked, F.col("summary")))).otherwise(picked))), 1, n)
    points = found.select(F.col("id.key").alias("key"), i.alias("i"), F.when(i == 3, _bullets(F.col("summary"))).otherwise(chosen).alias("points"))
    side = points.groupBy("key").agg(*[F.max(F.when(F.col("i") == k, F.col("points"))).alias(f"p{k}") for k in range(4)])
    labels = [CONCLUSION_LABEL, OUTLOOK_LABEL, LIMITATION_LABEL]
    under = lambda k: F.transform(F.coalesce(f"p{k}", none), lambda b: F.struct(F.lit(labels[k]).alias("label"), b.alias("bit")))
    tagged = F.concat(*[under(k) for k in range(3)])
    all_ = meet(held.select("key", "abstract", "tail"), side, "key", "left").withColumn("main", tagged)
    once = F.filter("main", lambda b, j: ~F.exists(F.slice("main", F.lit(1), j), lambda c: F.lower(c["bit"]) == F.lower(b["bit"])))
    own = F.when(F.col("abstract") != "", F.col("abstract")).otherwise(F.col("tail"))
    spare = T.condense(own, 120)
    concluded = F.exists("once", lambda b: b["label"] == CONCLUSION_LABEL)
    first = F.when(~concluded & (F.length(spare) >= 8), F.array(F.struct(F.lit(CONCLUSION_LABEL).alias("label"), spare.alias("bit")))).otherwise(F.array().cast("array<struct<label:string,bit:string>>"))
    start = all_.withColumn("once", once).withColumn("start", F.concat(first, "once"))

    def more(acc: Column, bit: Column) -> Column:
        has = lambda label: F.exists(acc, lambda b: b["label"] == label)
        label = F.when(~has(CONCLUSION_LABEL), CONCLUSION_LABEL).when(~has(OUTLOOK_LABEL), OUTLOOK_LABEL).otherwise(LIMITATION_LABEL)
        known = F.exists(acc, lambda b: F.lower(b["bit"]) == F.lower(bit))
        return F.when(known | (F.size(acc) >= ENOUGH_BULLETS), acc).otherwise(F.concat(acc, F.array(F.struct(label.alias("label"), bit.alias("bit")))))

    filled = F.when(F.size("start") < LEAST_BULLETS, F.aggregate(F.coalesce("p3", none), F.col("start"), more)).otherwise(F.col("start"))
    lines = F.slice(F.transform(filled, lambda b: F.concat(b["label"], F.lit("："), b["bit"])), 1, MOST_BULLETS)
    return start.select("key", F.when(F.size(lines) > 0, lines).otherwise(F.array(F.lit(NO_CLOSING))).alias("bullets"))
