"""Queries on single fields and small structures: each row of ``part`` is written as the text that a function reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import numbers as N
from .functions import text as T
from .functions import vocab as V
from .operators import answers, document, layout, merging, papers
from .paper_queries import _each, paper_docs
from .registry import literal, query, table
from .sources import readers, sinks


TWO = "case when p_partkey % 3 <> 2 then 'T2' else 'T1' end"  # the second table's id where there is a first


def _part(spark, sf_dir, **made: str) -> DataFrame:
    """p_partkey and columns of SQL that DuckDB reads alike."""
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", *[F.expr(v).alias(k) for k, v in made.items()])


def _lines(*lines: str) -> str:
    return " || chr(10) || ".join(lines)


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumnRenamed("key", "p_partkey")


# ---------------------------------------------------------------- documents

_FRONT = f"""case p_partkey % 3 when 0 then 'Plain ' || p_name when 1 then {_lines("'---'", "'title: x'")} else {_lines("'---'", "'Title: ' || chr(34) || p_name || chr(34)", "'size: ' || p_size", "'no pair'", "'size: ' || (p_size + 1)", "'---'", "'Body of ' || p_brand")} end"""


@query(f"""select p_partkey, case p_partkey % 3 when 1 then 'x' when 2 then p_name end as title, case when p_partkey % 3 = 2 then (p_size + 1)::varchar end as size, case when p_partkey % 3 = 2 then 'Body of ' || p_brand else {_FRONT} end as body from part""")
def front_matter_fields(spark, sf_dir):
    found = document.front_matter(_part(spark, sf_dir, text=_FRONT), "p_partkey")
    meta = lambda k: F.try_element_at("meta", F.lit(k)).alias(k)
    return _keyed(found.select("key", meta("title"), meta("size"), "body"))


@query("select p_partkey, 'Ann|Bob|' || p_name || '|Cy|Dee' as authors from part")
def author_lists(spark, sf_dir):
    rows = _part(spark, sf_dir, value="'[Ann, Bob; ' || p_name || ' and {Cy}]、Dee'")
    return rows.select("p_partkey", F.array_join(document.authors(F.col("value")), "|").alias("authors"))


@query("""select p_partkey, unnest(['I. INTRODUCTION', 'II. METHODS', 'REFERENCES']) as heading, unnest(['introduction', 'method', 'references']) as kind, unnest([1, 4, 5 + (p_partkey % 2)])::int as start, unnest([2, 4 + (p_partkey % 2), 6 + (p_partkey % 2)])::int as stop from part""")
def academic_section_ranges(spark, sf_dir):
    text = _lines("'I. INTRODUCTION'", "p_name", "'II.'", "'METHODS'") + " || case when p_partkey % 2 = 1 then chr(10) || 'by ' || p_type else '' end || chr(10) || " + _lines("'REFERENCES'", "'[1]'")
    found = document.academic_sections(document.lines(_part(spark, sf_dir, text=text), "p_partkey"))
    return _keyed(found.select("key", "heading", "kind", "start", "stop"))


@query("select p_partkey, 'TIV' as table_id, 'Sizes of ' || p_brand || ' in short' as caption from part union all select p_partkey, 'T2', 'Table 2' from part where p_partkey % 2 = 0")
def captioned_table_rows(spark, sf_dir):
    text = _lines("'TABLE IV: Sizes of ' || p_brand", "'in short'", "''", "'text'", "case when p_partkey % 2 = 0 then 'Table 2' else 'none' end", "''", "'Table IV: again'")
    return _keyed(document.captioned_tables(document.lines(_part(spark, sf_dir, text=text), "p_partkey")).select("key", "table_id", "caption"))


@query("select p_partkey, 'H1' as table_id, unnest([0, 1, 2])::int as row_idx, unnest([p_name || '|' || p_size, 'b|2', 'c|3.5']) as cells from part")
def aligned_table_cells(spark, sf_dir):
    text = _lines("'words alone'", "p_name || '   ' || p_size", "'b   2'", "'c     3.5'", "'words alone'", "'too   1'", "'short   2'")
    found = document.aligned_tables(document.lines(_part(spark, sf_dir, text=text), "p_partkey"))
    return _keyed(found.select("key", "table_id", "row_idx", F.array_join("cells", "|").alias("cells")))


@query(f"select p_partkey, case when p_partkey % 5 = 0 then {V.DEFAULT_SCALE} else least(p_size * 1000, {V.MAX_RECORDS}) end::bigint as scale from part")
def stated_scales(spark, sf_dir):
    rows = _part(spark, sf_dir, text="case when p_partkey % 5 = 0 then 'no number' else 'with N = ' || (p_size * 1000) || ' rows, N=1 and n = 7' end")
    return _keyed(papers.scale_hints(rows, "p_partkey"))


@query("select p_partkey as doc_id, 'We study ' || p_type || ' parts.' || chr(10) || chr(10) || 'It works for ' || p_name || '.' as text from part")
def texts_of_kinds(spark, sf_dir):
    from .plans.analysis import analyse

    return answers.text_of_kinds(analyse(paper_docs(spark, sf_dir)).sections, "abstract", "conclusion").withColumnRenamed("key", "doc_id")


@query("select p_partkey, 'u' || p_size as url, 'repo' as kind from part union all select p_partkey, 'v', 'dataset' from part where p_partkey % 2 = 0")
def merged_link_kinds(spark, sf_dir):
    base = _each(spark, sf_dir, [["'u' || p_size", "'repo'"]], "url kind")
    other = _each(spark, sf_dir, [["'u' || p_size", "'other'"]], "url kind").union(_each(spark, sf_dir, [["'v'", "'dataset'"]], "url kind", "p_partkey % 2 = 0"))
    return _keyed(merging.merged_links(base, other))


# ---------------------------------------------------------------- pages

@query("select p_partkey, 1 as page, case when p_partkey % 2 = 0 then 'L1,' || p_name || ',L3,R1,R2,R3' else 'L1,R1,' || p_name || ',R2,L3' end as text from part")
def page_reading_order(spark, sf_dir):
    block = lambda x, y, t: ["1", f"{x}D", f"{y}D", f"{x + 190}D", t, "600D"]
    blocks = [block(310, 11, "'R1'"), block(10, 10, "'L1 '"), block(10, 50, "'L3'"), block(310, 30, "'R2'"), block(11, 31, "p_name"), block(10, 70, "' '")]
    rows = _each(spark, sf_dir, blocks, "page x0 y0 x1 text page_width").union(_each(spark, sf_dir, [block(310, 50, "'R3'")], "page x0 y0 x1 text page_width", "p_partkey % 2 = 0"))
    return _keyed(layout.page_texts(rows).select("key", "page", F.replace("text", F.lit("\n"), F.lit(",")).alias("text")))


@query("select p_partkey, 'A study of the ' || p_name as title, 'Ann B|Bo C|Cy D' as authors from part")
def page_titles(spark, sf_dir):
    line = lambda y, size, t: ["50D", f"{y}D", f"{size}D", t, "800D"]
    lines = [line(60, 18, "'A study of the ' || p_name"), line(20, 24, "'arXiv:1234'"), line(90, 10, "'Ann B., Bo C.* and Cy D'"), line(100, 10, "'University of X, Y'"), line(300, 10, "'body, and more of it'")]
    found = layout.titles_and_authors(_each(spark, sf_dir, lines, "x0 y0 size text page_height"))
    return _keyed(found.select("key", "title", F.array_join("authors", "|").alias("authors")))


@query("select p_partkey, 'https://github.com/a/' || p_partkey as url, 'repo' as kind, 2 as page from part union all select p_partkey, 'https://Zenodo.org/r', 'dataset', 1 from part")
def page_link_kinds(spark, sf_dir):
    links = [["3", "'https://github.com/a/' || p_partkey"], ["2", "' https://github.com/a/' || p_partkey"], ["1", "'https://Zenodo.org/r'"], ["1", "'https://example.org'"]]
    return _keyed(layout.page_links(_each(spark, sf_dir, links, "page uri")))


# ---------------------------------------------------------------- cells and fields

@query("select p_partkey, p_partkey % 2 = 0 as numeric_row, array_to_string(list_sort([p_size, 25, p_partkey % 7]), ',') as numbers from part")
def numeric_rows(spark, sf_dir):
    rows = _part(spark, sf_dir, cells="array('1', '', '2.5%', p_name)", numbers="array(p_size, null, 25, cast(p_partkey % 7 as int))")
    cells = F.when(F.col("p_partkey") % 2 == 0, F.col("cells")).otherwise(F.array(F.lit("1"), F.lit("a"), F.lit("")))
    return rows.select("p_partkey", N.is_numeric_row(cells).alias("numeric_row"), F.array_join(N.sort_numbers(F.col("numbers")), ",").alias("numbers"))


@query("select p_partkey, case when p_partkey % 3 = 0 then '' when p_partkey % 3 = 1 then '****' else '…' || right(p_name, 4) end as shown from part")
def masked_secrets(spark, sf_dir):
    rows = _part(spark, sf_dir, secret="case p_partkey % 3 when 0 then '' when 1 then left(p_name, 4) else p_name end")
    return rows.select("p_partkey", T.masked(F.col("secret")).alias("shown"))


@query("select p_partkey, case when p_partkey % 3 <> 0 then p_size end as seed from part")
def readme_seeds(spark, sf_dir):
    rows = _part(spark, sf_dir, text="case p_partkey % 3 when 0 then 'seed unknown, see page 5 or so' when 1 then 'Set the SEED: ' || p_size || '.' else '--seed=' || p_size || ' seed 9' end")
    return rows.select("p_partkey", readers.readme_seed(F.col("text")).alias("seed"))


@query("select p_partkey, replace(p_name, ' ', '_') || '_v' || p_partkey || '_tar' as id from part")
def safe_ids(spark, sf_dir):
    rows = _part(spark, sf_dir, name="'up/in/' || p_name || ' (v' || p_partkey || ').tar.pdf'")
    return rows.select("p_partkey", T.safe_id(F.col("name")).alias("id"))


_RUN = "' is fine, ' || repeat('and more of it, ', 8) || 'to the end. '"


@query("""select p_partkey, case when p_partkey % 2 = 0 then 'The ' || p_name else rtrim(p_name || ' is fine,' || repeat('and more of it,', least(8, (110 - length(p_name) - 9) // 15)::int), ',') || '…' end as short from part""")
def condensed_sentences(spark, sf_dir):
    rows = _part(spark, sf_dir, said=f"case when p_partkey % 2 = 0 then ' The ' || p_name || '.;, ' else p_name || {_RUN} end")
    return rows.select("p_partkey", T.condense(F.rtrim("said")).alias("short"))


@query("select p_partkey, left(p_name || ' ' || p_brand || ' ' || repeat('word ', 20), 80) as heading from part")
def short_headings(spark, sf_dir):
    rows = _part(spark, sf_dir, text="'  ' || p_name || chr(10) || chr(9) || p_brand || '   ' || repeat('word ', 20)")
    return rows.select("p_partkey", T.short_heading(F.col("text")).alias("heading"))


@query("""select doc_id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') as escaped from documents""")
def escaped_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.escaped(F.col("text")).alias("escaped"))


@query("""select p_partkey, case when p_partkey % 3 = 1 then null when p_partkey % 3 = 0 then p_size end as size from part""")
def json_blocks(spark, sf_dir):
    fence = "'```json'", "'{' || chr(34) || 'k' || chr(34) || ': ' || p_size || '}'", "'```'"
    rows = _part(spark, sf_dir, text=f"case p_partkey % 3 when 0 then {_lines(chr(39) + 'Sure: ' + chr(39), *fence)} when 1 then 'broken {{' || p_size else 'none' end")
    return rows.select("p_partkey", F.get_json_object(T.json_block(F.col("text")), "$.k").cast("int").alias("size"))


def _contains(c: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({c}, {literal(w)})" for w in words) + ")"


_INTENT = "case " + " ".join(f"when {_contains('low', words)} then {literal(name)}" for name, words in V.INTENTS) + " else 'unknown' end"


@query(f"select doc_id, {_INTENT} as intent from (select doc_id, lower(coalesce(source || chr(10), '') || coalesce(text, '')) as low from documents)")
def algorithm_intents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.algorithm_intent(F.col("source"), F.col("text")).alias("intent"))


@query(f"""select p_partkey as doc_id, 'T1' as table_id, '{{"columns":["Item","Size","Price (%)"],"n_rows":2}}' as schema from part where p_partkey % 3 <> 2 union all select p_partkey, {TWO}, '{{"columns":["Name","Score"],"n_rows":1}}' from part where p_partkey % 2 = 0""")
def table_schemas(spark, sf_dir):
    from .plans.analysis import analyse

    return sinks.schemas(analyse(paper_docs(spark, sf_dir)).cells).withColumnRenamed("key", "doc_id")


@query("""select p_partkey, 'E = ' || p_size || ' m' as expression, '1' as number from part""")
def numbered_formulas(spark, sf_dir):
    text = _lines("'Words of an introduction that end here and are quite long so that they close what stands above the formula itself, which is not their part at all.'", "''", "'E = ' || p_size || ' m'", "'(1)'", "''", "'As Eq. (1) shows, ' || p_name || ' rises.'")
    found = document.formulas(document.lines(_part(spark, sf_dir, text=text), "p_partkey"))
    return _keyed(found.select("key", "number", "expression"))
