"""Queries on papers' structure: each row of ``part`` is written as a paper, and the SQL tells from the row what
has to be found in it (or works on the same text where it can)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import vocab as V
from .functions.joins import meet
from .operators import document, merging, outline, papers, pseudocode
from .registry import dealt, literal, parts_dealt, query, table
from .sources import readers

# A paper in pieces: (when, lines). Conditions and lines are SQL that Spark and DuckDB read alike.
PIECES = [
    ("p_partkey % 4 <> 3", ["'# ' || p_name", "''"]),
    ("p_partkey % 4 = 3", ["p_name", "'====='", "''"]),
    ("true", ["'## Abstract'", "'We study ' || p_type || ' parts.'", "''", "'## 2 Method'"]),
    ("p_partkey % 5 = 0", ["'We release code at https://github.com/acme/r' || p_partkey || '.'", "''"]),
    ("p_partkey % 7 = 0", ["'Data sits at https://zenodo.org/record/' || p_partkey", "''"]),
    ("true", ["'plain text'", "''", "'### Model of ' || p_brand", "'text b'", "''"]),
    ("p_partkey % 3 <> 2", ["'Table 1. Sizes of ' || p_brand", "'| Item | Size | Price (%) |'", "'|---|---:|---:|'", "'| A | ' || p_size || ' | 41.2% |'", "'| B | 1,' || (100 + p_size) || ' | n/a |'", "''"]),
    ("p_partkey % 2 = 0", ["'## Results'", "'| Name | Score |'", "'| --- | --- |'", "'| Base | 0.' || (p_size + 10) || ' |'", "''", "'![x](figures/f' || p_partkey || '.svg)'", "'Figure 1. Accuracy curve of ' || p_name", "''"]),
    ("p_partkey % 4 = 1", ["'Algorithm 1. Select the best of ' || p_type || '. More'", "'```'"]),
    ("p_partkey % 8 = 1", ["'Algorithm 1: Top' || p_size"]),
    ("p_partkey % 4 = 1", ["'Input: list a'", "'for each x in a do'", "'  push x'", "'end for'", "'return heap'", "'```'"]),
    ("p_partkey % 6 = 0", ["'```python'", "'import os'", "'print(' || p_size || ')'", "'```'"]),
    ("true", ["'## Conclusion'", "'It works for ' || p_name || '.'"]),
]
PAPER = " || ".join(f"case when {when} then " + " || ".join(f"{line} || chr(10)" for line in lines) + " else '' end" for when, lines in PIECES)
_DOCS = f"docs as (select p_partkey as doc_id, {PAPER} as text from part)"
_LINES = f"{_DOCS}, lines as (select doc_id, unnest(l) as line, generate_subscripts(l, 1) - 1 as n from (select doc_id, string_split(text, chr(10)) as l from docs))"


def paper_docs(spark, sf_dir) -> DataFrame:
    return dealt(table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("doc_id"), F.expr(PAPER).alias("text"))


def analysed(spark, sf_dir):
    """(the papers, their analysis with its relations written once)."""
    from .plans.analysis import analyse

    part = table(spark, sf_dir, "part")
    n = parts_dealt(part)
    docs = part.repartition(n, "p_partkey").select(F.col("p_partkey").alias("doc_id"), F.expr(PAPER).alias("text"))
    return docs, analyse(docs, kept=n)


def _lines(spark, sf_dir) -> DataFrame:
    return document.lines(paper_docs(spark, sf_dir))


_HEADS = rf"""{_LINES}, marked as (select *, regexp_extract(line, '{V.ATX_HEADING}', 1) as h, lead(line) over (partition by doc_id order by n) as nx from lines),
heads as (select doc_id, n, case when h <> '' then length(h) when nx like '=%' then 1 else 2 end as level, case when h <> '' then regexp_extract(line, '{V.ATX_HEADING}', 2) else trim(line) end as heading from marked where h <> '' or (regexp_matches(coalesce(nx, ''), '^(=+|-{{2,}})\s*$') and trim(line) <> ''))"""


def kind_sql(c: str) -> str:
    return "case " + " ".join(f"when contains(lower({c}), {literal(w)}) then '{k}'" for w, k in V.HEADING_KINDS) + " else 'section' end"


@query(f"with {_HEADS} select doc_id, n::int as line_no, level::int as level, heading from heads")
def markdown_headings(spark, sf_dir):
    return document.headings(_lines(spark, sf_dir)).select(F.col("key").alias("doc_id"), "line_no", "level", "heading")


@query(f"""with {_HEADS}, ends as (select doc_id, max(n) + 1 as e from lines group by 1)
select h.doc_id, h.heading, h.level::int as level, {kind_sql('h.heading')} as kind, (h.n + 1)::int as start, coalesce((select min(g.n) from heads g where g.doc_id = h.doc_id and g.n > h.n and g.level <= h.level), e)::int as stop from heads h join ends using (doc_id) where h.level <= 3""")
def section_ranges(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    return document.section_ranges(document.headings(rows), rows).select(F.col("key").alias("doc_id"), "heading", "level", "kind", "start", "stop")


_CELL_ROWS = """select p_partkey as doc_id, 'T1' as table_id, 'Sizes of ' || p_brand as caption, unnest([0, 0, 0, 1, 1, 1]) as row_idx, unnest(['Item', 'Size', 'Price (%)', 'Item', 'Size', 'Price (%)']) as col_name,
  unnest(['A', p_size::varchar, '41.2%', 'B', '1,' || (100 + p_size), 'n/a']) as raw, unnest([null, p_size, 0.412, null, 1100 + p_size, null]::double[]) as num from part where p_partkey % 3 <> 2
union all select p_partkey, case when p_partkey % 3 <> 2 then 'T2' else 'T1' end, '', 0, unnest(['Name', 'Score']), unnest(['Base', '0.' || (p_size + 10)]), unnest([null, (p_size + 10) / 100.0]::double[]) from part where p_partkey % 2 = 0"""


@query(f"select doc_id, table_id, caption, row_idx::int as row_idx, col_name, raw, round(num, 9) as num from ({_CELL_ROWS})")
def pipe_table_cells(spark, sf_dir):
    found = document.table_rows(_lines(spark, sf_dir))
    captions = found.filter("row_idx = 0").select("key", "table_id", "caption")
    return meet(document.cells(found), captions, ["key", "table_id"]).select(F.col("key").alias("doc_id"), "table_id", "caption", "row_idx", "col_name", "raw", F.round("num", 9).alias("num"))


@query(rf"""with {_LINES}, f as (select *, regexp_matches(line, '{V.FENCE}') as fence, sum(regexp_matches(line, '{V.FENCE}')::int) over (partition by doc_id order by n) as k from lines)
select doc_id, min(n)::int as open_line, lower(min(regexp_extract(line, '{V.FENCE}', 1)) filter (fence)) as info, coalesce(array_to_string(list(line order by n) filter (not fence), chr(10)), '') as body from f where k % 2 = 1 group by doc_id, k""")
def fence_blocks(spark, sf_dir):
    found = document.fenced_blocks(_lines(spark, sf_dir))
    return found.select(F.col("key").alias("doc_id"), "open_line", "info", F.array_join("body", "\n").alias("body"))


_ALGORITHM = "case when p_partkey % 8 = 1 then 'Algorithm 1: Top' || p_size else 'Algorithm 1. Select the best of ' || p_type end"


@query(f"select p_partkey as doc_id, 'A1' as algorithm_id, {_ALGORITHM} as caption, 5 as n_lines from part where p_partkey % 4 = 1")
def algorithm_blocks(spark, sf_dir):
    return document.algorithms(_lines(spark, sf_dir)).select(F.col("key").alias("doc_id"), "algorithm_id", "caption", F.size("lines").alias("n_lines"))


@query("select p_partkey as doc_id, 'F1' as fig_id, 'Accuracy curve of ' || p_name as caption, 'figures/f' || p_partkey || '.svg' as image_path, 'plot' as kind from part where p_partkey % 2 = 0")
def figure_images(spark, sf_dir):
    return document.figures(_lines(spark, sf_dir)).select(F.col("key").alias("doc_id"), "fig_id", "caption", "image_path", "kind")


@query("select p_partkey as doc_id, 'https://github.com/acme/r' || p_partkey as url, 'repo' as kind from part where p_partkey % 5 = 0 union all select p_partkey, 'https://zenodo.org/record/' || p_partkey, 'dataset' from part where p_partkey % 7 = 0")
def url_refs(spark, sf_dir):
    return document.links(_lines(spark, sf_dir)).select(F.col("key").alias("doc_id"), "url", "kind")


def _any(column: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({column}, {literal(w)})" for w in words) + ")"


@query(f"""with l as (select doc_id, unnest(x) as line, generate_subscripts(x, 1) as n from (select doc_id, string_split(coalesce(text, ''), chr(10)) as x from documents union all select -doc_id - 1, string_split(text, chr(10)) from (with {_DOCS} select * from docs)))
select doc_id::bigint as doc_id, substr(trim(arg_min(line, n)), 1, 240) as statement from l where {_any('lower(line)', V.CODE_NOUNS)} and {_any('lower(line)', V.RELEASE_VERBS)} group by doc_id""")
def code_statement_first(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").union(paper_docs(spark, sf_dir).select(-F.col("doc_id") - 1, "text"))
    return document.code_statements(document.lines(docs)).select(F.col("key").alias("doc_id"), "statement")


_MODE = "case when p_partkey % 5 = 0 then 'open_source' when p_partkey % 4 = 1 then 'pseudocode_only' else 'no_code' end"


@query(f"select p_partkey as doc_id, {_MODE} as mode, case when p_partkey % 5 = 0 then 0.9 when p_partkey % 4 = 1 then 0.85 else 0.7 end::double as confidence from part")
def mode_decision(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    found = papers.modes(paper_docs(spark, sf_dir).select(F.col("doc_id").alias("key")), document.links(rows), document.algorithms(rows))
    return found.select(F.col("key").alias("doc_id"), "mode", F.col("confidence").cast("double").alias("confidence"))


_TARGETS = f"""select p_partkey as doc_id, 'table' as kind, 'T1' as id, 'Sizes of ' || p_brand as caption, case when p_partkey % 5 = 0 then 'benchmark' else 'input' end as role from part where p_partkey % 3 <> 2
union all select p_partkey, 'table', case when p_partkey % 3 <> 2 then 'T2' else 'T1' end, '', case when p_partkey % 5 = 0 then 'benchmark' else 'input' end from part where p_partkey % 2 = 0
union all select p_partkey, 'figure', 'F1', 'Accuracy curve of ' || p_name, 'redraw' from part where p_partkey % 2 = 0
union all select p_partkey, 'algorithm', 'A1', {_ALGORITHM}, case when p_partkey % 5 = 0 then 'cite' else 'translate' end from part where p_partkey % 4 = 1"""


@query(_TARGETS)
def plan_targets(spark, sf_dir):
    return analysed(spark, sf_dir)[1].targets.withColumnRenamed("key", "doc_id")


@query("select p_partkey as doc_id, (5 + (p_partkey % 2 = 0)::int)::int as n_sections, ((p_partkey % 3 <> 2)::int + (p_partkey % 2 = 0)::int)::int as n_tables, (p_partkey % 4 = 1)::int as n_algorithms, ((p_partkey % 5 = 0)::int + (p_partkey % 7 = 0)::int)::int as n_links from part")
def manifest_stats(spark, sf_dir):
    return analysed(spark, sf_dir)[1].manifest.select(F.col("key").alias("doc_id"), "n_sections", "n_tables", "n_algorithms", "n_links")


_ID = "lpad('' || (p_partkey % 100000), 5, '0')"
_SOURCES = f"""case p_partkey % 6 when 0 then '2301.' || {_ID} when 1 then 'arXiv:2301.' || {_ID} || 'v2' when 2 then 'https://arxiv.org/abs/2301.' || {_ID}
  when 3 then 'https://arxiv.org/pdf/2301.' || {_ID} || '.pdf' when 4 then 'hep-th/99' || {_ID} else p_name || '.md' end"""


@query(f"select p_partkey, {_SOURCES} as source, case p_partkey % 6 when 1 then '2301.' || {_ID} || 'v2' when 4 then 'hep-th/99' || {_ID} when 5 then null else '2301.' || {_ID} end as id from part")
def arxiv_ids(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(_SOURCES).alias("source")).select("p_partkey", "source", readers.arxiv_id(F.col("source")).alias("id"))




@query(f"""select p_partkey, 'A1' as algorithm_id, 'def top_' || p_size || '(stream_S, integer_k):' || chr(10) || '    H = []' || chr(10) || '    for x in S:' || chr(10) || '        if x >= ' || p_size || ':' || chr(10) || '            push(H, x)' || chr(10) || '    return H' as code from part
union all select p_partkey, 'A2', 'def algorithm_a2():' || chr(10) || '    pass' from part where p_partkey % 3 = 0""")
def pseudocode_translate(spark, sf_dir):
    part = dealt(table(spark, sf_dir, "part"), "p_partkey")
    size = F.col("p_size").cast("string")
    lines = F.array(F.concat(F.lit("Algorithm 1: TOP"), size), *[F.lit(x) for x in ("Input: stream S, integer k", "1: H ← empty min-heap", "2: for each x in S do")], F.concat(F.lit("3: if x ≥ "), size, F.lit(" then")), *[F.lit(x) for x in ("4: push(H, x)", "5: end if", "6: end for", "7: return H")])
    first = part.select(F.col("p_partkey").alias("key"), F.lit("A1").alias("algorithm_id"), F.concat(F.lit("Top-"), size).alias("caption"), lines.alias("lines"))
    second = part.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("key"), F.lit("A2").alias("algorithm_id"), F.lit(None).cast("string").alias("caption"), F.array().cast("array<string>").alias("lines"))
    return pseudocode.translate(first.union(second)).select(F.col("key").alias("p_partkey"), "algorithm_id", "code")


@query("""select p_partkey, 'conclusion' as kind, 'The ' || p_name || ' works well. It will pave the way.' as text from part
union all select p_partkey, 'limitation', 'One ' || p_type || ' alone.' from part where p_partkey % 2 = 0""")
def closing_chunks(spark, sf_dir):
    text = """'1. Introduction' || chr(10) || 'words' || chr(10) || 'Conclusion' || chr(10) || 'The ' || p_name || ' works well.' || chr(10) || chr(10) || 'It will pave the way.' || chr(10) || 'References' || chr(10) || '[1] x'
      || case when p_partkey % 2 = 0 then chr(10) || 'V. Limitations' || chr(10) || 'One ' || p_type || ' alone.' else '' end"""
    rows = document.lines(table(spark, sf_dir, "part").select("p_partkey", F.expr(text).alias("text")), "p_partkey")
    return outline.closing_chunks(rows).select(F.col("key").alias("p_partkey"), "kind", "text")


def _each(spark, sf_dir, rows: list[list[str]], schema: str, when: str = "true") -> DataFrame:
    """Each part with these rows of SQL values as (key, the columns of ``schema``)."""
    names = schema.split()
    entries = ", ".join("struct(" + ", ".join(f"{v} as {n}" for v, n in zip(r, names, strict=True)) + ")" for r in rows)
    return table(spark, sf_dir, "part").filter(when).select(F.col("p_partkey").alias("key"), F.explode(F.expr(f"array({entries})")).alias("e")).select("key", "e.*")


@query("""with p as (select *, 'Model ' || p_brand as model from part), rows as (
select p_partkey, unnest([0, 1, 1, 2, 2, 3]) as pos, unnest([1, 1, 2, 1, 2, 1]) as ord, unnest([model, model, 'More', 'End', 'Discussion', 'Abstract']) as section, unnest(['m1 ' || p_name, 'm1 ' || p_name, 'm2', 'c', 'd', 'short ' || p_type]) as text from p)
select p_partkey, pos::int as pos, ord::int as ord, section, text from rows""")
def outline_sections(spark, sf_dir):
    sections = _each(spark, sf_dir, [["2", "'Model ' || p_brand", "'method'", "'m1 ' || p_name"], ["3", "'More'", "'method'", "'m2'"], ["4", "'Discussion'", "'discussion'", "'d'"], ["5", "'End'", "'conclusion'", "'c'"]], "ord heading kind text")
    heads = _each(spark, sf_dir, [[str(i), h] for i, h in enumerate(["'Model ' || p_brand", "'核心方法'", "'结论'", "'速览'", "'复现'"])], "pos heading")
    abstracts = _each(spark, sf_dir, [["'short ' || p_type"]], "abstract")
    return outline.outline_sections(heads, sections, abstracts).select(F.col("key").alias("p_partkey"), "pos", "ord", "section", "text")


@query("""select p_partkey, unnest([0, 1, 2, 3, 4])::int as pos, unnest(['content', 'figure', 'table', 'figure', 'content']) as kind, unnest([null, null, 'T' || p_size, null, null]) as table_id, unnest([null, 'F2', null, 'F' || p_size || 'a', null]) as figure_id from part where p_partkey % 2 = 0
union all select p_partkey, unnest([0, 1, 2, 3, 4])::int, unnest(['content', 'content', 'table', 'content', 'content']), unnest([null, null, 'T' || p_size, null, null]), null from part where p_partkey % 2 = 1""")
def slide_assets(spark, sf_dir):
    heads = _each(spark, sf_dir, [[str(i), f"'{h}'"] for i, h in enumerate(["引言", "核心方法", "实验结果", "More results", "method"])], "pos heading")
    tables = _each(spark, sf_dir, [["1", "'T' || p_size"]], "ord table_id")
    figures = _each(spark, sf_dir, [["1", "'F' || p_size || 'a'", "'plot'"], ["2", "'F2'", "'architecture'"]], "ord figure_id kind", "p_partkey % 2 = 0")
    return outline.slide_assets(heads, tables, figures).select(F.col("key").alias("p_partkey"), "pos", "kind", "table_id", "figure_id")


@query("""select p_partkey, unnest(['structured', 'structured', 'base']) as source, unnest(['T5', 'T2', 'T7']) as table_id, unnest(['TABLE V. Costs of ' || p_brand, 'Table 2: Errors', 'Something else']) as caption from part""")
def merged_tables(spark, sf_dir):
    grid, none = ["array('a', 'b')", "array(array('1', '2'))"], ["cast(array() as array<string>)", "cast(array() as array<array<string>>)"]
    shape = "ord table_id caption header rows"
    structured = _each(spark, sf_dir, [["1", "'T1'", "''", *grid], ["2", "'T2'", "'Table 2: Errors'", *grid]], shape)
    captions = _each(spark, sf_dir, [["1", "'T5'", "'TABLE V. Costs of ' || p_brand"]], "ord table_id caption")
    base = _each(spark, sf_dir, [["1", "'T1'", "'junk'", *grid]], shape)
    base = base.union(_each(spark, sf_dir, [["2", "'T9'", "'errors'", *none], ["3", "'T7'", "'Something else'", *none]], shape))
    return merging.merged_tables(base, merging.captions_to_grids(structured, captions)).select(F.col("key").alias("p_partkey"), "source", "table_id", "caption")
