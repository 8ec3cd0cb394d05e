"""Structure found in hand-written papers that hold the traps: nested tables, open fences, underlined headings, images before captions."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quillmill.operators import document, papers
from quillmill.plans.analysis import analyse

PAPERS = {
    1: "# Topic study\n\n## Abstract\nWe study topics.\n\n## 2 Method\ntext a\n\n### Model details\ntext b\n\nTable 1. Data sets used\n| Dataset | Documents | Share (%) |\n|---|---:|---:|\n| A | 1,200 | 41.2% |\n| B | 900 | 58.8% |\n\n## Results\n| Method | Accuracy |\n| --- | --- |\n| Base | 0.71 |\n| Ours | 0.83 |\nTable 2: Main results\n\n![x](figures/f1.svg)\nFigure 1. Accuracy curve by epoch\n\n## Conclusion\nThe code is available at https://github.com/acme/topics.\nData: https://zenodo.org/record/12 (dataset)\n",
    2: "Title line\n==========\n\nIntroduction\n---\nsome text https://example.org/x, nothing else\n\nAlgorithm 1. Select the largest k. More text\n```\nAlgorithm 1: TopK\nInput: list a\nfor each x in a do\n  push x\nend for\nreturn heap\n```\n```python\nimport os\nprint(1)\n```\n\nFig. 2 Overview of the pipeline\n![a](p.png) ![b](q.png)\nFigure 3: other\n",
    3: "no structure at all",
    4: "| a | b |\n|--|--|\n| 1 | 2 |\n|--|--|\n| c | d |\n|--|--|\n| 3 | 4 | 5 |\n| 6 |\n```algo\nx <- 1\n",
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(PAPERS.items()), "doc_id int, text string")


@pytest.fixture(scope="module")
def rows(docs):
    return document.lines(docs)


def same(df, sql):
    """The rows of ``df`` are those of the values in ``sql``, with its columns."""
    want = duckdb.connect().sql(sql)
    plain = lambda r: tuple(round(float(v), 6) if isinstance(v, float) or hasattr(v, "as_tuple") else v for v in r)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    got = df.select(*want.columns).collect()
    assert sorted(map(plain, got), key=key) == sorted(map(plain, want.fetchall()), key=key)


def test_pipe_table_cells(docs, rows):
    found = document.table_rows(rows)
    captions = found.filter("row_idx = 0").select("key", "table_id", "caption")
    got = document.cells(found).join(captions, ["key", "table_id"]).withColumnRenamed("key", "doc_id")
    same(
        got,
        """select * from (values (1, 'T1', 'Data sets used', 0, 'Dataset', 'A', null::double), (1, 'T1', 'Data sets used', 0, 'Documents', '1,200', 1200.0), (1, 'T1', 'Data sets used', 0, 'Share (%)', '41.2%', 0.412),
(1, 'T1', 'Data sets used', 1, 'Dataset', 'B', null), (1, 'T1', 'Data sets used', 1, 'Documents', '900', 900.0), (1, 'T1', 'Data sets used', 1, 'Share (%)', '58.8%', 0.588),
(1, 'T2', '', 0, 'Method', 'Base', null), (1, 'T2', '', 0, 'Accuracy', '0.71', 0.71), (1, 'T2', '', 1, 'Method', 'Ours', null), (1, 'T2', '', 1, 'Accuracy', '0.83', 0.83),
(4, 'T1', '', 0, 'a', '1', 1.0), (4, 'T1', '', 0, 'b', '2', 2.0), (4, 'T2', '', 0, 'c', '3', 3.0), (4, 'T2', '', 0, 'd', '4', 4.0), (4, 'T2', '', 1, 'c', '6', 6.0), (4, 'T2', '', 1, 'd', '', null)) t(doc_id, table_id, caption, row_idx, col_name, raw, num)""",
    )


def test_algorithm_blocks(docs, rows):
    got = document.algorithms(rows).select(F.col("key").alias("doc_id"), "algorithm_id", "caption", F.size("lines").alias("n_lines"))
    same(
        got,
        "select * from (values (2, 'A1', 'Algorithm 1: TopK', 5), (4, 'A1', 'x <- 1', 2)) t(doc_id, algorithm_id, caption, n_lines)",
    )


def test_figure_images(docs, rows):
    got = document.figures(rows).withColumnRenamed("key", "doc_id")
    same(
        got,
        "select * from (values (1, 'F1', 'Accuracy curve by epoch', 'figures/f1.svg', 'plot'), (2, 'F2', 'Overview of the pipeline', null, 'architecture'), (2, 'F3', 'other', 'p.png', 'unknown'), (2, 'FX3', '', 'q.png', 'unknown')) t(doc_id, fig_id, caption, image_path, kind)",
    )


def test_url_refs(docs, rows):
    got = document.links(rows).withColumnRenamed("key", "doc_id")
    same(
        got,
        "select * from (values (1, 'https://github.com/acme/topics', 'repo'), (1, 'https://zenodo.org/record/12', 'dataset')) t(doc_id, url, kind)",
    )


def test_mode_decision(docs, rows):
    got = papers.modes(docs.select(F.col("doc_id").alias("key")), document.links(rows), document.algorithms(rows)).withColumnRenamed("key", "doc_id")
    same(
        got,
        "select * from (values (1, 'open_source', 0.9), (2, 'pseudocode_only', 0.85), (3, 'no_code', 0.7), (4, 'pseudocode_only', 0.85)) t(doc_id, mode, confidence)",
    )


def test_plan_targets(docs, rows):
    got = analyse(docs).targets.withColumnRenamed("key", "doc_id")
    same(
        got,
        """select * from (values (1, 'table', 'T1', 'Data sets used', 'benchmark'), (1, 'table', 'T2', '', 'benchmark'), (1, 'figure', 'F1', 'Accuracy curve by epoch', 'redraw'), (2, 'figure', 'F2', 'Overview of the pipeline', 'cite'), (2, 'figure', 'F3', 'other', 'cite'),
(2, 'algorithm', 'A1', 'Algorithm 1: TopK', 'translate'), (4, 'algorithm', 'A1', 'x <- 1', 'translate'), (4, 'table', 'T1', '', 'input'), (4, 'table', 'T2', '', 'input')) t(doc_id, kind, id, caption, role)""",
    )


def test_manifest_stats(docs, rows):
    got = analyse(docs).manifest.withColumnRenamed("key", "doc_id")
    same(
        got,
        "select * from (values (1, 6, 2, 0, 2), (2, 2, 0, 1, 0), (3, 0, 0, 0, 0), (4, 0, 2, 1, 0)) t(doc_id, n_sections, n_tables, n_algorithms, n_links)",
    )
