"""Every reference query against its SQL on the smallest tables, and the traps that the tables don't hold."""

import datetime
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from quillmill import queries as Q
from quillmill.functions import numbers as N
from quillmill.functions import text as T
from quillmill.operators import dialogue, document, papers, tables, terms
from quillmill.plans import analysis
from quillmill.sources import html, readers, sinks
from quillmill.streaming import incremental

from test_structure import PAPERS

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{round(v, 5):.15g}") + 0.0  # sums of doubles differ in their last bit
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return round(float(v), 5) if hasattr(v, "as_tuple") else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(Q.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=key)


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


@pytest.mark.parametrize(("cell", "number"), [("85.2%", 0.852), ("1,204", 1204.0), ("1.2±0.1", 1.2), ("n/a", None), ("-", None), (".5", 5.0), ("85.2 %", 85.2), ("85.2±1.1%", 85.2), ("1,204±3", 204.0), ("−4.5", -4.5), ("3.2e-4", 0.00032), ("\\textbf{78.3}", 78.3), ("K-Means", None), ("pop-sin-01", -1.0), (None, None)])
def test_numbers(spark, cell, number):
    got = one(spark, N.to_number(F.col("c").cast("string")), c=cell)
    assert got is None if number is None else got == pytest.approx(number)


def test_judgements(spark):
    rows = spark.createDataFrame([(100.0, 105.0), (100.0, 106.0), (100.0, 130.0), (None, 1.0), (0.0, 0.04)], "a double, b double")
    assert [r[0] for r in rows.select(N.classify(F.col("a"), F.col("b"))).collect()] == ["pass", "warn", "fail", "skipped", "pass"]


def test_text_helpers(spark):
    assert one(spark, T.dedupe_key(F.col("c")), c="größe 表1!") == "größe表1"
    assert one(spark, T.tokens(F.col("c")), c="Größe of the neural-nets 神经网络") == ["gr", "neural-nets", "神经网络"]
    assert one(spark, T.condense(F.col("c")), c="a" * 60 + ", " + "b" * 60 + ".") == "a" * 60 + "…"
    assert one(spark, T.match_key(F.col("c")), c="Balance (in %) 总计") == "balance总计"
    assert one(spark, T.safe_id(F.col("c")), c="/x/My paper: v2.pdf") == "My_paper_v2"
    assert one(spark, T.json_block(F.col("c")), c='so: {"a": 1} ok') == '{"a": 1}'
    assert not one(spark, T.valid_id(F.col("c")), c="../etc")


def test_key_terms_hold_no_other(spark):
    got = [r.term for r in terms.key_terms(spark.read.parquet(f"{SF}/documents.parquet")).orderBy("rank").collect()]
    assert len(got) == 15 and not any(a != b and a in b for a in got for b in got)


def test_upper_median(spark):
    assert one(spark, N.upper_median(F.array(*[F.lit(float(x)) for x in (4, 1, 3, 2)])), c=1) == 3.0


def test_loose_rows_prefer_exact_and_first(spark):
    def cells(rows, table_id):
        out = [(1, table_id, i, 0, "Name", name, None) for i, (name, _) in enumerate(rows)] + [(1, table_id, i, 1, "Score", "1", v) for i, (_, v) in enumerate(rows)]
        return spark.createDataFrame(out, "key int, table_id string, row_idx int, col_idx int, col_name string, raw string, num double")

    got = tables.compare(cells([("Ours", 1.0), ("Base", 2.0), ("None here", 3.0)], "T1"), cells([("Ours (v2) large", 9.0), ("ours", 1.0), ("base", 5.0), ("BASE", 2.0)], "R1"))
    assert sorted((r.row_idx, r.status, r.actual) for r in got.collect()) == [(0, "pass", 1.0), (1, "pass", 2.0), (2, "skipped", None)]


def test_structure_beyond_sql(spark):
    text = "Intro\nE = m\n  c^2\n(1)\nas Eq. 1 says\n\nTable IV. Long\nmore\n\nname  value\nalpha  1.5\nbeta  2.5\n"
    rows = document.lines(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    f = document.formulas(rows).first()
    assert (f.number, f.expression) == ("1", "Intro E = m c^2") and "Eq. 1" in f.explanation
    assert document.captioned_tables(rows).first().caption == "Long more"
    assert document.aligned_tables(rows.union(spark.createDataFrame([(1, 20, "gamma  3.5"), (1, 21, "delta  4.5"), (1, 22, "eps  5.5")], "key int, line_no int, line string"))).count() >= 3
    meta = document.front_matter(spark.createDataFrame([(1, '---\ntitle: "A b"\nauthors: X and Y\n---\nbody')], "doc_id int, text string")).first()
    assert meta.meta == {"title": "A b", "authors": "X and Y"} and meta.body == "body"
    academic = "I. INTRODUCTION\ntext\nII.\n\nMETHODS\nmore"
    got = document.academic_sections(document.lines(spark.createDataFrame([(1, academic)], "doc_id int, text string"))).collect()
    assert [(r.heading, r.start, r.stop) for r in got] == [("I. INTRODUCTION", 1, 2), ("II. METHODS", 5, 6)]


def test_pages():
    title, lines, grids = html.read_page("<title>A&amp;B</title><nav>no</nav><p>before<h2>Head</h2>after</p><table><tr><th>x</th><th>y</th></tr><tr><td>1</td><td>2</td></tr></table>")
    assert title == "A&B" and lines == ["## Head", "beforeafter"] and grids == [[["x", "y"], ["1", "2"]]]


def test_subtitles(spark):
    turns = spark.createDataFrame([(1, 1, "A", "x" * 61), (1, 2, "B", "  "), (1, 3, "B", "short")], "key int, turn int, speaker string, text string")
    got = dialogue.srt_files(turns).first()
    assert got.srt.startswith("1\n00:00:00,000 --> 00:00:13,261\n【主持人】") and "3\n00:00:13,611 --> 00:00:15,211\n【讲解人】short" in got.srt
    back = dialogue.parse_script(document.lines(dialogue.scripts(turns), "key", "script")).collect()
    assert [(r.speaker, r.text) for r in back] == [("A", "x" * 61), ("B", ""), ("B", "short")]


def test_bundle_end_to_end(spark, tmp_path):
    root = tmp_path / "bundles" / "demo"
    (root / "data").mkdir(parents=True)
    (root / "code").mkdir()
    (root / "paper.md").write_text(PAPERS[1])
    (root / "code" / "train.py").write_text("print(1)")
    (root / "data" / "m.csv").write_text('﻿Method,Accuracy\n"Ours, full",0.83\nBase,0.70\n\n')
    found = readers.bundles(spark, str(tmp_path / "bundles")).first()
    assert found.key == "demo" and found.paper_path.endswith("paper.md") and found.code_folder == "code" and len(found.data_files) == 1
    docs = readers.papers(spark, str(root / "paper.md")).select(F.lit("demo").alias("doc_id"), "text")
    attached = readers.csv_tables(spark, str(tmp_path / "bundles"))
    assert [r.cells for r in attached.orderBy("row_idx").collect()] == [["Method", "Accuracy"], ["Ours, full", "0.83"], ["Base", "0.70"]]
    whole = analysis.analyse(docs.withColumn("has_code", F.lit(True)), attached=attached)
    assert whole.modes.first().mode == "open_source"
    results = document.cells(attached)
    deltas = analysis.reproduce(whole, results)
    summary = tables.check_summary(deltas, "key").first()
    assert summary.verdict in {"consistent", "issues_found"} and summary.n_pass >= 3
    assert "Verdict" in sinks.report(tables.check_summary(deltas, "key"), deltas).first().report
    assert whole.charts.filter("table_id = 'T2'").first().kind == "bar"
    roles = {r.path.rsplit("/", 1)[-1]: r.role for r in readers.repository(spark, str(root)).collect()}
    assert roles["train.py"] == "entrypoint" and roles["m.csv"] == "data"
    sinks.write_tables(attached, str(tmp_path / "out"))
    assert "Ours" in "".join(p.read_text() for p in (tmp_path / "out").rglob("part-*"))


def test_stream_upserts(spark, tmp_path):
    schema = "paper_id string, created_at long, v int"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in ([("a", 1, 1), ("b", 1, 1)], [("a", 2, 2), ("c", 1, 1)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        run = incremental.upserts(incremental.documents(spark, source, schema), out, lambda df: df).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        run.awaitTermination()
    got = spark.read.parquet(f"{out}/v=1").collect()
    assert sorted((r.paper_id, r.v) for r in got) == [("a", 2), ("b", 1), ("c", 1)]


def test_small_decisions(spark):
    rows = spark.createDataFrame([(1, "we use N = 1,500 items and n=20"), (2, "none")], "doc_id int, text string")
    assert sorted(r.scale for r in papers.scale_hints(rows).collect()) == [400, 1500]
    assert "seeds" in papers.missing_elements(rows).first().missing
    assert readers.synthetic(spark, 10, "str_list", 3).filter("length(value) = 6").count() == 10


def test_scale_behind_a_texts_head(spark):
    rows = spark.createDataFrame([(1, "n = 20 " + "word " * 10_000 + "and N = 1,500 items"), (2, "word " * 10_000), (3, None)], "doc_id int, text string")
    assert {r.key: r.scale for r in papers.scale_hints(rows).collect()} == {1: 1500, 2: 400, 3: 400}


def documents(spark, folder, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_number_beyond_a_texts_head(spark, tmp_path):
    sf = documents(spark, tmp_path, ["word " * 60 + "42 and 7", "word " * 60 + "85.2%", "word " * 60, None])
    got = {r.id: r.num for r in Q.number_parse(spark, sf).collect() if r.id >= 0}
    assert got == {0: 42.0, 1: 0.852, 2: None, 3: None}


def test_extract_numbers_keeps_every_document(spark, tmp_path):
    texts = ["card 4111111111111111 and 2", "50% of 1,204", "no digits", "", None, "7 " * 300]
    got = {r.doc_id: (r.n, r.total) for r in Q.extract_numbers(spark, documents(spark, tmp_path, texts)).collect()}
    want = {0: (2, 4111111111111113.0), 1: (2, 1204.5), 2: (0, 0.0), 3: (0, 0.0), 4: (0, 0.0), 5: (200, 1400.0)}
    assert got.keys() == want.keys()
    assert all(got[i][0] == n and got[i][1] == pytest.approx(total, rel=1e-12) for i, (n, total) in want.items())


def test_paper_status_of_all_documents_and_labels(spark, tmp_path):
    sf = documents(spark, tmp_path, ["a"] * 7)
    spark.createDataFrame([(i, 1, 0) for i in (3, 4, 4, 9, 10)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    got = sorted((r.doc_id, r.status) for r in Q.paper_status(spark, sf).collect())
    assert got == [(i, "ready" if i in (3, 4) else "uploaded") for i in range(7)] + [(9, "outputs"), (10, "outputs")]
