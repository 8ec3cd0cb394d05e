"""Queries on what goes in and out: CSV text, tables as CSV and HTML, routes of sources, results, reports, lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from .field_queries import _INTENT
from .operators import reproduction
from .paper_queries import _ALGORITHM, _MODE, analysed, paper_docs
from .plans import reports
from .registry import query, table
from .sources import readers, sinks

_CSV = """'Item,"Size, cm",Note' || chr(13) || chr(10) || p_name || ',' || p_size || ',"a ""q"" of' || chr(10) || p_brand || '"' || chr(10) || chr(10) || ',,' || chr(10) || 'last' || case when p_partkey % 2 = 0 then chr(10) else ',' end"""


@query("""select p_partkey, unnest([0, 1, 4])::bigint as n, unnest(['Item|Size, cm|Note', p_name || '|' || p_size || '|a "q" of' || chr(10) || p_brand, case when p_partkey % 2 = 0 then 'last' else 'last|' end]) as cells from part""")
def csv_record_cells(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(_CSV).alias("text"))
    return readers.csv_records(rows, "p_partkey").select("p_partkey", F.col("n").cast("long").alias("n"), F.array_join("cells", "|").alias("cells"))


_TWO = "case when p_partkey % 3 <> 2 then 'T2' else 'T1' end"


@query(f"""select p_partkey as doc_id, 'T1' as table_id, '﻿Item,Size,Price (%)' || chr(13) || chr(10) || 'A,' || p_size || ',41.2%' || chr(13) || chr(10) || 'B,"1,' || (100 + p_size) || '",n/a' || chr(13) || chr(10) as csv from part where p_partkey % 3 <> 2
union all select p_partkey, {_TWO}, '﻿Name,Score' || chr(13) || chr(10) || 'Base,0.' || (p_size + 10) || chr(13) || chr(10) from part where p_partkey % 2 = 0""")
def table_csv_texts(spark, sf_dir):
    from .plans.analysis import analyse

    return reports.csv_texts(analyse(paper_docs(spark, sf_dir)).tables).withColumnRenamed("key", "doc_id")


@query(f"""select p_partkey as doc_id, 'T1' as table_id, '<table><tr><th>Item</th><th>Size</th><th>Price (%)</th></tr><tr><td>A</td><td class="num">' || p_size || '</td><td class="num">41.2%</td></tr><tr><td>B</td><td class="num">1,' || (100 + p_size) || '</td><td>n/a</td></tr></table>' as html from part where p_partkey % 3 <> 2
union all select p_partkey, {_TWO}, '<table><tr><th>Name</th><th>Score</th></tr><tr><td>Base</td><td class="num">0.' || (p_size + 10) || '</td></tr></table>' from part where p_partkey % 2 = 0""")
def table_htmls(spark, sf_dir):
    from .plans.analysis import analyse

    return sinks.table_html(analyse(paper_docs(spark, sf_dir)).tables).withColumnRenamed("key", "doc_id")


_GIVEN = """case p_partkey % 6 when 0 then '2301.' || lpad('' || (p_partkey % 100000), 5, '0') when 1 then 'https://example.org/p' || p_partkey when 2 then 'https://arxiv.org/abs/2301.' || lpad('' || (p_partkey % 100000), 5, '0') || 'v1'
  when 3 then 'in/p ' || p_partkey || '.PDF' when 4 then 'in/dir' || p_partkey else 'in/x' || p_partkey || '.md' end"""


@query(f"""select p_partkey, {_GIVEN} as source, case p_partkey % 6 when 0 then 'arxiv' when 1 then 'url' when 2 then 'arxiv' when 3 then 'pdf' when 4 then 'bundle' else case when p_partkey % 4 = 1 then 'text' end end as route,
  case p_partkey % 6 when 0 then '2301.' || lpad('' || (p_partkey % 100000), 5, '0') when 1 then 'p' || p_partkey when 2 then '2301.' || lpad('' || (p_partkey % 100000), 5, '0') || 'v1' when 3 then 'p_' || p_partkey when 4 then 'dir' || p_partkey else case when p_partkey % 4 = 1 then 'x' || p_partkey end end as paper_id,
  case when p_partkey % 6 = 5 and p_partkey % 4 <> 1 then 'not found: in/x' || p_partkey || '.md' end as error from part""")
def dispatched_sources(spark, sf_dir):
    """Identifiers, addresses, folders and files, some of which aren't there."""
    given = table(spark, sf_dir, "part").select("p_partkey", F.expr(_GIVEN).alias("source"))
    found = given.filter("p_partkey % 6 in (3, 4) or p_partkey % 4 = 1").select(F.col("source").alias("path"), (F.col("p_partkey") % 6 == 4).alias("is_dir"))
    return readers.dispatched(given, found)


@query(f"""select p_partkey as doc_id, {_MODE} as mode, (p_partkey % 3 <> 2)::int + (p_partkey % 2 = 0)::int as n_datasets, case when p_partkey % 3 <> 2 then 'Size' else '' end as numeric_columns,
  case when {_MODE} = 'pseudocode_only' then 'A1:' || {_INTENT} || ':skipped' else '' end as algorithms, case when {_MODE} = 'no_code' then 'data,training,seeds,preprocessing' || case when p_partkey % 2 = 0 then '' else ',hardware' end else '' end as missing from (select *, lower({_ALGORITHM} || chr(10) || 'Input: list a' || chr(10) || 'for each x in a do' || chr(10) || '  push x' || chr(10) || 'end for' || chr(10) || 'return heap') as low from part)""")
def reproduction_results(spark, sf_dir):
    docs, found = analysed(spark, sf_dir)
    got = reports.results(found, docs)
    numeric = F.array_join(F.flatten(F.transform("datasets", lambda d: d["numeric_columns"])), ",")
    listed = F.array_join(F.transform("algorithms", lambda a: F.concat_ws(":", a["algorithm_id"], a["intent"], a["status"])), ",")
    return got.select(F.col("key").alias("doc_id"), "mode", F.coalesce(F.size("datasets"), F.lit(0)).alias("n_datasets"), F.coalesce(numeric, F.lit("")).alias("numeric_columns"), listed.alias("algorithms"), F.array_join("missing", ",").alias("missing"))


@query(f"""select p_partkey as doc_id, p_name as title, (p_partkey % 3 <> 2)::int + 2 * (p_partkey % 2 = 0)::int + (p_partkey % 3 <> 2)::int + (p_partkey % 2 = 0)::int + (p_partkey % 4 = 1)::int as n_rows, case {_MODE} when 'pseudocode_only' then 'Algorithms' when 'no_code' then 'Missing' else '' end as part from part""")
def report_pages(spark, sf_dir):
    """HTML reports of the papers; their titles, rows of targets and data, and own parts read back."""
    docs, found = analysed(spark, sf_dir)
    plans = reproduction.plans(found.modes, found.targets, found.tables, found.links)
    pages = reports.html_reports(reports.results(found, docs), plans, found.titles)
    upto = F.substring_index("html", "<h2>Checks</h2>", 1)
    return pages.select(F.col("key").alias("doc_id"), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("title"), F.size(F.regexp_extract_all(upto, F.lit("(<tr><td)"), F.lit(1))).alias("n_rows"), F.regexp_extract("html", "<h2>(Algorithms|Missing)</h2>", 1).alias("part"))


@query("""with i as (select client_id, max(arrived_at) as m from sales where client_id is not null and sale_id % 2 = 0 group by 1), o as (select client_id, max(sold_at) as c from sales where client_id is not null and sale_id % 2 = 1 and client_id % 3 <> 0 group by 1)
select client_id, case when i.client_id is not null and o.client_id is not null then 'ready' when o.client_id is not null then 'outputs' else 'uploaded' end as status, coalesce(c, m) as created_at from i full join o using (client_id)""")
def papers_by_time(spark, sf_dir):
    """Clients as papers: even sales as uploads, odd ones as runs."""
    sales = table(spark, sf_dir, "sales").filter("client_id is not null")
    incoming = sales.filter("sale_id % 2 = 0").select("client_id", F.col("arrived_at").alias("modified"))
    outputs = sales.filter("sale_id % 2 = 1 and client_id % 3 <> 0").select("client_id", F.col("sold_at").alias("created_at"))
    return reports.paper_list(incoming, outputs, "client_id")
