"""Queries on how papers are reproduced: plans, result files, repositories, snapshots, outlines, charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import vocab as V
from .functions.joins import meet
from .operators import charts, outline, papers, reproduction
from .paper_queries import _ALGORITHM, _HEADS, _MODE, _TARGETS, analysed, kind_sql
from .registry import dealt, literal, query, table

# ---------------------------------------------------------------- plans

_STEPS = " ".join(f"when '{m}' then {literal('; '.join(steps))}" for m, steps in reproduction.STEPS.items())


@query(f"""with modes as (select p_partkey, {_MODE} as mode from part), targets as ({_TARGETS}),
ids as (select doc_id, string_agg(id, ',' order by case kind when 'table' then 0 when 'figure' then 1 else 2 end, id) as ids from targets group by 1)
select p_partkey as doc_id, mode, case mode {_STEPS} end as steps, coalesce(ids, '') as targets, case when p_partkey % 5 = 0 then 'https://github.com/acme/r' || p_partkey end as repository,
  case when p_partkey % 7 = 0 then 'https://zenodo.org/record/' || p_partkey end as dataset, '{V.DEFAULT_SCALE}' as scale, {V.MAX_RECORDS} as max_records,
  array_to_string(list_filter([case when mode = 'no_code' then 'mode to be confirmed: 0.70' end, case when p_partkey % 6 = 5 then 'no tables: only algorithms and figures can be reproduced' end,
    case when p_partkey % 6 = 5 and mode = 'no_code' then 'neither code nor tables: a plan without results' end], lambda w: w is not null), '; ') as warnings
from modes left join ids on doc_id = p_partkey""")
def reproduction_plans(spark, sf_dir):
    docs, found = analysed(spark, sf_dir)
    plans = reproduction.plans(found.modes, found.targets, found.tables, found.links, papers.scale_hints(docs))
    ids = F.array_join(F.transform("targets", lambda t: t["id"]), ",")
    inputs = [F.try_element_at("inputs", F.lit(k)).alias(k) for k in ("repository", "dataset", "scale")]
    return plans.select(F.col("key").alias("doc_id"), "mode", F.array_join("steps", "; ").alias("steps"), ids.alias("targets"), *inputs, "scale_guard.max_records", F.array_join("warnings", "; ").alias("warnings"))


# ---------------------------------------------------------------- result files


def supplier_reports(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Suppliers as papers: (reported cells by return flag, files by year, the files' cells)."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key"), F.year("l_shipdate").alias("y"), F.col("l_returnflag").alias("flag"), "l_quantity", "l_extendedprice")
    means = [F.avg("l_quantity").alias("q"), F.avg("l_extendedprice").alias("p")]

    def cells(rows: DataFrame, names: list[str], *by: str) -> DataFrame:
        placed = rows.withColumn("row_idx", F.row_number().over(Window.partitionBy(*by).orderBy("flag")) - 1)
        cell = lambda i, raw, num: F.struct(F.lit(i).alias("col_idx"), F.lit(names[i]).alias("col_name"), raw.alias("raw"), num.cast("double").alias("num"))
        each = F.explode(F.array(cell(0, F.col("label"), F.lit(None)), cell(1, F.lit(""), F.col("q")), cell(2, F.lit(""), F.col("p"))))
        return placed.select("key", "table_id", "row_idx", each.alias("c")).select("key", "table_id", "row_idx", "c.*")

    whole = lines.groupBy("key", "flag").agg(*means).withColumns({"label": F.col("flag"), "table_id": F.explode(F.array(F.lit("T1"), F.lit("P1")))})
    path = F.concat(F.when(F.col("y") % 2 == 0, "runs/table_").otherwise("runs/fig_"), F.col("y").cast("string"), F.lit(".csv"))
    files = lines.groupBy("key", "y").agg((F.count("*") * 100).alias("bytes")).select("key", path.alias("path"), "bytes")
    label = F.when(F.col("y") % 3 == 0, F.translate("flag", "ANR", "123")).otherwise(F.col("flag"))
    yearly = lines.groupBy("key", "y", "flag").agg(*means).withColumns({"label": label, "table_id": path})
    return cells(whole, ["Flag", "Quantity", "Price"], "key", "table_id"), files, cells(yearly, ["flag", "quantity", "price"], "key", "table_id")


@query("""with l as (select l_suppkey as key, year(l_shipdate) as y, l_returnflag as flag, l_quantity, l_extendedprice from lineitem),
reported as (select key, flag, avg(l_quantity) as q, avg(l_extendedprice) as p from l group by all), yearly as (select key, y, flag, avg(l_quantity) as q, avg(l_extendedprice) as p from l group by all),
files as (select key, y, case when y % 2 = 0 then 'runs/table_' else 'runs/fig_' end || y || '.csv' as path, count(*) * 100 as bytes from l group by all),
scored as (select *, 5 + case when y % 2 = 0 then 4 else -2 end + least(3, bytes // 4096) as score from files),
ranked as (select *, row_number() over (partition by key order by score desc, path) as place from scored),
pairs as (select r.key, path, y, place, flag, q, p from ranked r join reported using (key) where place <= 4 and y % 3 <> 0),
met as (select p.*, y.q as q2, y.p as p2 from pairs p left join yearly y on y.key = p.key and y.y = p.y and y.flag = p.flag),
cells as (select key, path, place, flag, unnest(['Quantity', 'Price']) as col_name, unnest([q, p]) as e, unnest([q2, p2]) as a from met where q2 is not null),
judged as (select key, path, place, flag as row_key, col_name, case when e = 0 then abs(a) else abs(a - e) / abs(e) end as d from cells)
select key, path, place::int as place, row_key, col_name, case when d <= 0.05 then 'pass' when d <= 0.2 then 'warn' else 'fail' end as status, round(d, 6) as rel_delta from judged
union all select key, path, place::int, flag, '', 'skipped', null from met m where q2 is null and exists (select 1 from cells c where c.key = m.key and c.path = m.path)""")
def judged_result_files(spark, sf_dir):
    reported, files, results = supplier_reports(spark, sf_dir)
    provided = reported.filter("table_id = 'P1'").select("key", "table_id").distinct()
    found = reproduction.judged_results(reported, provided, files, results)
    return found.select("key", F.col("source").alias("path"), "place", "row_key", "col_name", "status", F.round("rel_delta", 6).alias("rel_delta"))


# ---------------------------------------------------------------- repositories and snapshots

_TREE = """select cast(floor(p_partkey / 8) as bigint) as key, case p_partkey % 8 when 0 then case when floor(p_partkey / 8) % 4 = 0 then 'README.md' else 'docs/notes.md' end
  when 1 then case when floor(p_partkey / 8) % 3 = 0 then 'setup.cfg' else 'requirements.txt' end when 2 then 'data/in_' || p_size || '.csv' when 3 then 'results/out_' || p_size || '.csv'
  when 4 then case when floor(p_partkey / 8) % 3 = 0 then 'src/train.py' else 'src/a_' || p_size || '.py' end when 5 then 'src/b.py' when 6 then 'src/c.py' else 'LICENSE.txt' end as path,
  case p_partkey % 8 when 0 then p_name || ' with seed ' || p_size when 1 then '# pins' || chr(10) || 'numpy' || chr(10) || chr(10) || p_type when 4 then case when floor(p_partkey / 8) % 3 < 2 then 'if __name__ == "__main__": run()' else 'pass' end
  when 5 then case when floor(p_partkey / 8) % 6 = 1 then '__main__' else 'x' end else '' end as content from part"""


def _trees(spark, sf_dir) -> DataFrame:
    """Parts, eight at a time, as the files of source trees."""
    return spark.sql(_TREE.replace("from part", "from {part}"), part=table(spark, sf_dir, "part"))


@query(f"""with files as ({_TREE}), g as (select key, count(*) as n_files, string_agg(path, ',' order by path) filter (path like 'data/%') as data_files, string_agg(path, ',' order by path) filter (path like 'results/%') as result_files,
  string_agg(path, ',' order by path) filter (path = 'src/train.py') as named, string_agg(path, ',' order by path) filter (path like '%.py' and contains(content, '__main__')) as mains,
  max(content) filter (path = 'requirements.txt') as pins, max(case when path = 'README.md' then content end) as readme from files group by 1)
select key, n_files, coalesce(readme, '') as readme, coalesce('numpy,' || string_split(pins, chr(10))[4], '') as requirements, data_files, result_files, coalesce(named, mains, '') as entrypoints, case when named is not null then 'name' when mains is not null then 'main' else 'none' end as tier,
  array_to_string(list_filter([case when pins is null then 'no dependency file: the environment can''t be fixed' end, case when named is null and mains is null then 'no entry point: one has to be named' end], lambda x: x is not null), '; ') as notes from g""")
def repository_manifests(spark, sf_dir):
    found = reproduction.manifests(_trees(spark, sf_dir))
    joined = [F.array_join(c, ",").alias(c) for c in ("requirements", "data_files", "result_files", "entrypoints")]
    return found.select("key", "n_files", "readme", *joined, "tier", F.array_join("notes", "; ").alias("notes"))


@query(f"""with files as ({_TREE}), g as (select key, max(case when path = 'requirements.txt' then 1 else 0 end) as pinned, max(case when path = 'README.md' then content end) as readme, min(case when path = 'src/train.py' then path end) as named, min(case when path like '%.py' and contains(content, '__main__') then path end) as mains from files group by 1)
select key, '#!/usr/bin/env bash' || chr(10) || 'set -euo pipefail' || chr(10) || 'python -m venv .venv && . .venv/bin/activate' || chr(10) || case when pinned = 1 then 'pip install -r requirements.txt' else '# no dependency file' end || chr(10)
  || 'export PYTHONHASHSEED=' || coalesce(nullif(regexp_extract(coalesce(readme, ''), 'seed (\\d+)', 1), ''), '42') || chr(10) || 'python ' || coalesce(named, mains, '<entry point>') || chr(10) as script from g""")
def repository_run_scripts(spark, sf_dir):
    return reproduction.run_scripts(reproduction.manifests(_trees(spark, sf_dir)))


def _snapshot(changes: DataFrame, until: str) -> DataFrame:
    last = F.struct("valid_at", "seq", "change_id")
    held = changes.filter(F.col("valid_at").isNotNull() & F.col("client_id").isNotNull() & (F.col("valid_at") < F.expr(f"timestamp_ntz'{until}'")))
    rows = held.groupBy("source", "client_id").agg(F.max_by("balance", last).alias("bytes"), F.max(last)["valid_at"].alias("time"), F.max_by("op", last).alias("op")).filter("op is null or op <> 'D'")
    return rows.select(F.coalesce("source", F.lit("none")).alias("key"), F.concat(F.lit("runs/"), F.col("client_id").cast("string"), F.when(F.col("client_id") % 3 == 0, ".bin").otherwise(".csv")).alias("path"), "bytes", "time")


def _listing(until: str) -> str:
    latest = f"""select source, client_id, balance, valid_at as t, op from (select *, row_number() over (partition by source, client_id order by valid_at desc, seq desc nulls last, change_id desc nulls last) as r from client_changes
  where valid_at is not null and client_id is not null and valid_at < timestamp '{until}') where r = 1"""
    return f"select coalesce(source, 'none') as key, 'runs/' || client_id || case when client_id % 3 = 0 then '.bin' else '.csv' end as path, balance, t from ({latest}) where op is null or op <> 'D'"


_BEFORE, _AFTER = "2024-02-15 00:00:00", "2024-03-15 00:00:00"


@query(f"""with b as ({_listing(_BEFORE)}), a as ({_listing(_AFTER)})
select coalesce(a.key, b.key) as key, coalesce(a.path, b.path) as path, case when b.path is null then 'new' when a.path is null then 'gone' else 'changed' end as change from a full join b on a.key = b.key and a.path = b.path
where a.path is null or b.path is null or a.balance is distinct from b.balance or a.t is distinct from b.t""")
def snapshot_changes(spark, sf_dir):
    """Clients of each source as files, as they were on two days."""
    changes = table(spark, sf_dir, "client_changes")
    return reproduction.changed_files(_snapshot(changes, _BEFORE), _snapshot(changes, _AFTER), "key")


@query(f"with b as ({_listing(_BEFORE)}), a as ({_listing(_AFTER)}) select key, path from a anti join b using (key, path) where path like '%.csv'")
def new_artifacts(spark, sf_dir):
    changes = table(spark, sf_dir, "client_changes")
    return reproduction.new_artifacts(_snapshot(changes, _BEFORE), _snapshot(changes, _AFTER), "key")


# ---------------------------------------------------------------- outlines and charts

_SLOTS = " union all ".join(f"select p_partkey, {i + 1}, 0, coalesce((select arg_min(heading, ord) from sec s where s.doc_id = p_partkey and s.kind = '{k}'), {literal(label)}) from part" for i, (k, label) in enumerate(outline.SLOT_KINDS))


@query(f"""with {_HEADS}, sec as (select doc_id, n as ord, heading, {kind_sql("heading")} as kind from heads where level <= 3),
slots(doc_id, slot, ord, heading) as (select p_partkey, 0, 0, {literal(outline.OVERVIEW)} || p_name from part union all {_SLOTS}
  union all select doc_id, 6, ord, heading from sec where kind in ('method', 'experiment')
  union all select p_partkey, 8, 0, {literal(outline.ALGORITHMS_HEADING)} from part where p_partkey % 4 = 1
  union all select p_partkey, 9, 0, {literal(outline.TABLES_HEADING[0])} || ((p_partkey % 3 <> 2)::int + (p_partkey % 2 = 0)::int) || {literal(outline.TABLES_HEADING[1])} from part where p_partkey % 6 <> 5
  union all select p_partkey, 10, 0, {literal(outline.FIGURES_HEADING[0])} || '1' || {literal(outline.FIGURES_HEADING[1])} from part where p_partkey % 2 = 0
  union all select p_partkey, 11, 0, coalesce((select arg_min(heading, ord) from sec s where s.doc_id = p_partkey and s.kind = 'conclusion'), {literal(outline.CLOSING_HEADING)}) from part
  union all select p_partkey, 12, 0, {literal(outline.LAST_HEADING)} from part),
once as (select doc_id, slot, ord, heading from (select *, row_number() over (partition by doc_id, regexp_replace(lower(heading), '[^\\pL\\pN_]+', '', 'g') order by slot, ord) as r from slots) where r = 1),
placed as (select *, row_number() over (partition by doc_id order by slot, ord) as place, count(*) over (partition by doc_id) as n from once)
select doc_id, (row_number() over (partition by doc_id order by place) - 1)::int as pos, heading from placed where n <= 9 or place <= 7 or place > n - 2""")
def paper_outlines(spark, sf_dir):
    """Headings of a talk of nine slides at most for each paper."""
    _, found = analysed(spark, sf_dir)
    count = lambda rows, name, *by: rows.select("key", *by).distinct().groupBy("key").agg(F.count("*").alias(name))
    heads, names = found.titles, {"n_algorithms": (found.algorithms, "algorithm_id"), "n_tables": (found.tables, "table_id"), "n_figures": (found.figures, "fig_id"), "n_formulas": (found.formulas, "number")}
    for name, (rows, by) in names.items():
        heads = meet(heads, count(rows, name, by), "key", "left")
    heads = heads.na.fill(0, list(names))
    return outline.outlines(heads, found.sections, 9).withColumnRenamed("key", "doc_id")


@query("""select p_partkey as doc_id, 'bar' as kind, 2 as n_bars, 6 as n_ticks, 'A,B' as categories, printf('%.2f', p_size * 308.0 / (1100 + p_size)) || ',308.00' as heights, (p_partkey % 3 <> 2) as drawn from part where p_partkey % 3 <> 2""")
def chart_svgs(spark, sf_dir):
    """Charts of the papers' tables as SVG; their bars, ticks and labels read back from the text."""
    specs = analysed(spark, sf_dir)[1].charts
    drawn = meet(charts.svg(specs), specs.select("key", "table_id", "kind"), ["key", "table_id"])
    every = lambda pattern: F.regexp_extract_all("svg", F.lit(pattern), F.lit(1))
    heights = every(r'class="bar"[^>]* height="([^"]*)"')
    whole = F.col("svg").startswith("<svg ") & F.col("svg").endswith("</svg>")
    return drawn.select(F.col("key").alias("doc_id"), "kind", F.size(heights).alias("n_bars"), F.size(every(r'class="(tick)"')).alias("n_ticks"), F.array_join(every(r'class="category"[^>]*>([^<]*)<'), ",").alias("categories"), F.array_join(heights, ",").alias("heights"), whole.alias("drawn"))


# ---------------------------------------------------------------- authors and closing bullets

_NAME, _CITY = "coalesce(name, 'No Body')", "coalesce(city, 'No Where')"
_SIGNED = f"""'intro line' || chr(10) || '# Paper of ' || client_id || chr(10) || chr(10) || case client_id % 4 when 0 then {_NAME} || '*, ' || {_CITY} || '† and Jo Doe' || chr(10) || 'Department of Things' || chr(10) || 'Ann B.; X' || chr(10) || chr(10) || 'not, an author'
  when 1 then 'University of ' || {_CITY} || chr(10) || {_NAME} || chr(10) || '(Dated: today)' || chr(10) || 'nobody' when 2 then '## Abstract' || chr(10) || 'text' else 'A a' || chr(10) || 'B b' || chr(10) || 'C c' || chr(10) || {_NAME} || chr(10) || 'E e' end"""


@query(f"select client_id, regexp_replace(case client_id % 4 when 0 then {_NAME} || ';' || {_CITY} || ';Jo Doe Ann B' when 1 then {_NAME} else 'A a B b C c ' || {_NAME} end, '\\s+', ' ', 'g') as authors from clients where client_id % 4 <> 2")
def authors_below_titles(spark, sf_dir):
    """Clients as papers with names, affiliations and what ends them below the title."""
    from .operators import authors, document

    docs = table(spark, sf_dir, "clients").select("client_id", F.expr(_SIGNED).alias("text"))
    return authors.names_below_title(document.lines(docs, "client_id")).select(F.col("key").alias("client_id"), F.array_join("authors", ";").alias("authors"))


@query(f"""select client_id, case client_id % 3 when 0 then {_NAME} || ', Jo Doe' when 1 then 'Abe Longname the Second of Somewhere, ' || {_NAME} || ', Eve Longname the Third' else {_CITY} || ', Ann' end as shown,
  case client_id % 3 when 0 then 'On goods for ' || client_id || ' more words' when 1 then 'Plain title' else 'Title of it' end as title from clients""")
def shown_paper_authors(spark, sf_dir):
    from .operators import authors

    k = F.col("client_id") % 3
    name, city = F.expr(_NAME), F.expr(_CITY)
    listed = F.when(k == 0, F.array(F.concat(F.lit('"'), name, F.lit('"')), F.concat(F.upper(name), F.lit("12")), F.lit("Jo Doe Authors: x, y"), F.lit("7")))
    listed = listed.when(k == 1, F.array(F.concat(F.lit("Abe Longname the Second of Somewhere, "), name, F.lit(", Eve Longname the Third, '1'")))).otherwise(F.array().cast("array<string>"))
    text = F.concat(F.lit("Title of it\nsection 2\n\n"), city, F.lit(", Ann\nabstract"))
    paper_id = F.when(k == 0, F.concat(F.lit("On_goods_for_"), F.col("client_id").cast("string"), F.lit("_more_words"))).otherwise("id")
    title = F.when(k == 0, F.concat(F.lit("On goods  for "), F.col("client_id").cast("string"))).when(k == 1, "Plain title")
    docs = table(spark, sf_dir, "clients").select("client_id", "name", "city", listed.alias("authors"), text.alias("text"), authors.full_title(title, paper_id, text).alias("title"))
    return authors.shown_authors(docs).select("client_id", "shown", "title")


_ENDS = "'The ' || p_name || ' study ends here with a clear gain.'", "'It holds for all sizes tested in part ' || p_partkey || '.'"
_NEXT = "'We will test more rings of ' || p_type || ' then.'", "'The weather was fine on that very day.'"
_LACKS = "'A limitation is the single site of ' || p_brand || ' used.'", "'Nothing else is to be said about it.'"
_TAILS = "'Measured in one run of part ' || p_partkey || ' here.'", "'Costs stay low for ' || p_type || ' goods.'"


def _said(label: str, sentences) -> str:
    return "[" + ", ".join(f"'{label}：' || rtrim({s}, '.')" for s in sentences) + "]"


@query(f"""select p_partkey, array_to_string(list_concat({_said("结论", _ENDS)}, case when p_partkey % 2 = 0 then {_said("展望", _NEXT)} else {_said("展望", _TAILS)} end,
  case when p_partkey % 3 = 0 then {_said("不足", _LACKS[:1])} when p_partkey % 2 = 0 then {_said("不足", _TAILS)} else [] end), chr(10)) as bullets from part""")
def closing_slide_bullets(spark, sf_dir):
    part = dealt(table(spark, sf_dir, "part"), "p_partkey")
    both = lambda s: F.expr(" || ' ' || ".join(s))
    kinds = [("conclusion", both(_ENDS)), ("outlook", F.when(F.col("p_partkey") % 2 == 0, both(_NEXT))), ("limitation", F.when(F.col("p_partkey") % 3 == 0, both(_LACKS)))]
    chunks = part.select(F.col("p_partkey").alias("key"), F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), t.alias("text")) for k, t in kinds])).alias("c")).select("key", "c.*").filter("text is not null")
    docs = part.select(F.col("p_partkey").alias("key"), F.lit("").alias("abstract"), both(_TAILS).alias("text"))
    return outline.closing_bullets(docs, chunks).select(F.col("key").alias("p_partkey"), F.array_join("bullets", "\n").alias("bullets"))
