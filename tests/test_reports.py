"""CSV in and out, routes of sources, branches by mode, result records, reports and the list's order."""

import csv
import io
import json

import pytest
from pyspark.sql import functions as F

from quillmill.operators import reproduction
from quillmill.plans import analysis, reports
from quillmill.sources import readers, sinks

TEXTS = [
    "a,b\n1,2\n",
    'a,"b, c"\r\n"x ""y"" z","line one\nline two"\r\n\r\n,,\r\nlast',
    '"open, quote\n1,2',
    'a "b" c,"d"e,f\n',
    "",
    ",\n",
    "one\rtwo\r",
    '"","x"\n',
    'a,"' + "long, " * 20000 + 'end"\n',
]


@pytest.mark.parametrize("i", range(len(TEXTS)))
def test_records_as_the_csv_module_reads_them(spark, i):
    rows = spark.createDataFrame([(0, TEXTS[i])], "key int, text string")
    got = [list(r.cells) for r in readers.csv_records(rows, "key").orderBy("n").collect()]
    if i == 2:  # an unclosed quote is an ordinary character, so the rest isn't swallowed
        want = [['"open', "quote"], ["1", "2"]]
    elif i == 3:  # neither are quotes inside a bare cell
        want = [['a "b" c', '"d"e', "f"]]
    else:
        want = [[c.strip() for c in r] for r in csv.reader(io.StringIO(TEXTS[i], newline="")) if any(c.strip() for c in r)]
    assert got == want


def test_tables_come_back_from_their_csv(spark):
    rows = [("k", "T1", 0, ["a", "", "a"]), ("k", "T1", 1, ["1", "x,y", "3", "more"]), ("k", "T1", 2, ['q"q']), ("k", "T2", 0, ["only"])]
    tables = spark.createDataFrame(rows, "key string, table_id string, row_idx int, cells array<string>")
    got = {r.table_id: r.csv for r in reports.csv_texts(tables).collect()}
    assert got["T1"].startswith("﻿") and got["T2"] == "﻿only\r\n"
    read = list(csv.reader(io.StringIO(got["T1"][1:], newline="")))
    assert read == [["a", "col2", "col4"], ["3", "x,y", "more"], ["", "", ""]]


def test_sources_are_routed(spark):
    given = ["2301.00001", " https://arxiv.org/pdf/2301.00001v2.pdf ", "http://x.org/a.pdf", "d/p.PDF", "d/p.htm", "d/p.tex", "d", "gone.md", None]
    sources = spark.createDataFrame([(s,) for s in given], "source string")
    found = spark.createDataFrame([("d/p.PDF", False), ("d/p.htm", False), ("d/p.tex", False), ("d", True), ("d", True)], "path string, is_dir boolean")
    got = {r.source: (r.route, r.paper_id, r.error) for r in readers.dispatched(sources, found).collect()}
    assert len(got) == len(given)
    assert [got[s][0] for s in given] == ["arxiv", "arxiv", "url", "pdf", "html", "text", "bundle", None, None]
    assert got[given[1]][1] == "2301.00001v2" and got["gone.md"] == (None, None, "not found: gone.md")


PAPERS = [
    (1, "# A & B\n\n## Method\nwe use a dataset and a seed\n\nTable 1: Shares\n| Group | Share (%) |\n|---|---|\n| a | 40% |\n| b | 58% |\n"),
    (2, "# Sort\n\nAlgorithm 1. Sort it\n```\nInput: list\nfor each x in list do\nend for\nreturn list\n```\n"),
    (3, "nothing"),
    (4, "# Code\nsee https://github.com/a/b\n"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(PAPERS, "doc_id int, text string")


def test_branches_follow_the_mode(spark, docs):
    found = analysis.analyse(docs)
    got = {r.key: r for r in reports.branches(found, docs).collect()}
    assert {k: r.mode for k, r in got.items()} == {1: "no_code", 2: "pseudocode_only", 3: "no_code", 4: "open_source"}
    assert got[1].missing == ["training", "preprocessing", "hardware"] and got[3].missing == ["data", "training", "seeds", "preprocessing", "hardware"]
    assert [a.status for a in got[2].algorithms] == ["skipped"] and got[2].missing == [] and got[4].warnings == []
    assert got[3].warnings[-1] == "no tables to check"
    ran = spark.createDataFrame([(2, "A1", "pass")], "key int, algorithm_id string, status string")
    assert next(r for r in reports.branches(found, docs, ran).collect() if r.key == 2).algorithms[0].status == "ok"


def test_branches_hold_all_algorithms_and_read_all_text(spark):
    """Twelve algorithms in order of their numbers; a word of the method section far behind its first 6,000 characters."""
    many = "# Many\n\n" + "\n".join(f"Algorithm {i}. Sort list {i}\n```\nInput: list\nreturn list\n```\n" for i in range(1, 13))
    far = "# Far\n\n## Method\n" + "plain words here\n" * 2000 + "one gpu and a random seed\n"
    docs = spark.createDataFrame([(1, many), (2, far)], "doc_id int, text string")
    got = {r.key: r for r in reports.branches(analysis.analyse(docs), docs).collect()}
    assert [a.algorithm_id for a in got[1].algorithms] == [f"A{i}" for i in range(1, 13)]
    assert got[2].missing == ["data", "training", "preprocessing"]


def test_records_and_reports(spark, docs):
    found = analysis.analyse(docs)
    records = reports.results(found, docs)
    held = {r.key: json.loads(r.json) for r in reports.result_json(records).collect()}
    assert held[1]["checks"]["n_pass"] == 1 and held[1]["deltas"][0]["name"] == "share_sum" and held[1]["deltas_summary"]["pass_rate"] == 1.0
    assert held[1]["datasets"] == [{"table_id": "T1", "n_rows": 2, "n_cols": 2, "numeric_columns": ["Share (%)"], "truncated": False}]
    assert "datasets" not in held[3]
    plans = reproduction.plans(found.modes, found.targets, found.tables, found.links)
    pages = {r.key: r.html for r in reports.html_reports(records, plans, found.manifest.select("key", "title")).collect()}
    assert len(pages) == 4 and "<h1>A &amp; B</h1>" in pages[1] and "share_sum" in pages[1] and "<li>training</li>" in pages[1]
    assert "A1 · " in pages[2] and "<h1>3</h1>" in pages[3] and "<h2>Missing</h2>" not in pages[4]


def test_numbers_are_marked_in_html(spark):
    tables = spark.createDataFrame([("k", "T1", 0, ["1", "2"]), ("k", "T1", 1, ["3", "<4%"]), ("k", "T1", 2, ["x", "n/a"])], "key string, table_id string, row_idx int, cells array<string>")
    assert sinks.table_html(tables).first().html == '<table><tr><th>1</th><th>2</th></tr><tr><td>3</td><td class="num">&lt;4%</td></tr><tr><td>x</td><td>n/a</td></tr></table>'


def test_the_newest_papers_come_first(spark):
    incoming = spark.createDataFrame([("a", "2024-01-05"), ("a", "2024-01-01"), ("b", "2024-01-02"), ("d", None)], "paper_id string, modified string")
    outputs = spark.createDataFrame([("a", "2024-01-03"), ("c", "2024-01-09"), ("e", None)], "paper_id string, created_at string")
    got = [(r.paper_id, r.status, r.created_at) for r in reports.paper_list(incoming, outputs).collect()]
    assert got == [("c", "outputs", "2024-01-09"), ("a", "ready", "2024-01-03"), ("b", "uploaded", "2024-01-02"), ("d", "uploaded", None), ("e", "outputs", None)]
