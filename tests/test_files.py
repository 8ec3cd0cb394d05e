"""Readers and writers on folders: result files, indexes, code counts, HTML papers, chart specs, dialogues."""

import json

from quillmill.operators import tables
from quillmill.sources import readers, sinks


def written(folder, files):
    for path, text in files.items():
        at = folder / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    return str(folder)


def test_results_stop_after_the_limit(spark, tmp_path):
    path = written(tmp_path / "r", {"results.csv": "Method,F1\n" + "".join(f"m{i},{i}\n" for i in range(50))})
    assert readers.result_rows(spark, path, limit=10).count() == 11
    assert readers.result_rows(spark, path).columns == ["Method", "F1"]


def test_code_files_are_counted_up_to_a_bound(spark, tmp_path):
    path = written(tmp_path / "code", {"a.py": "x", "b/c.JL": "x", "d.md": "x", "e.ipynb": "{}"})
    found = readers.repository(spark, path)
    assert readers.code_files(found).first().n == 3 and readers.code_files(found, most=2).first().n == 2


SCHEMA = "paper_id string, created_at string"


def test_a_missing_index_is_empty_and_a_broken_one_loses_its_bad_rows(spark, tmp_path):
    assert readers.run_index(spark, str(tmp_path / "none.json"), SCHEMA).collect() == []
    path = written(tmp_path / "i", {"index.json": json.dumps([{"paper_id": "a", "created_at": "1"}])})
    assert [r.paper_id for r in readers.run_index(spark, path, SCHEMA).collect()] == ["a"]


def test_the_index_takes_the_newest_run(spark, tmp_path):
    index = spark.createDataFrame([("a", "1"), ("b", "5")], SCHEMA)
    runs = spark.createDataFrame([("a", "2"), ("b", "5"), ("c", "0")], SCHEMA)
    merged = sinks.upsert_index(index, runs, str(tmp_path / "v1"))
    assert sorted(map(tuple, merged.collect())) == [("a", "2"), ("b", "5"), ("c", "0")]
    assert spark.read.schema(SCHEMA).json(str(tmp_path / "v1")).count() == 3


def test_html_papers_are_read_as_lines(spark, tmp_path):
    path = written(tmp_path / "h", {"p.html": "<html><title>T</title><body><h1>Head</h1><p>words</p></body></html>", "q.md": "# no"})
    found = readers.html_papers(readers.papers(spark, path)).collect()
    assert len(found) == 1 and found[0].title == "T" and "words" in found[0].text


def test_chart_specs_as_json(spark):
    rows = [("k", "T1", i, j, n, raw, num) for i, (a, b) in enumerate([("x", 1.0), ("y", 2.0)]) for j, n, raw, num in ((0, "Method", a, None), (1, "F1", "", b))]
    cells = spark.createDataFrame(rows, "key string, table_id string, row_idx int, col_idx int, col_name string, raw string, num double")
    spec = json.loads(sinks.chart_json(tables.chart_specs(cells)).first().spec)
    assert spec == {"kind": "bar", "categories": ["x", "y"], "series": [{"name": "F1", "values": [1.0, 2.0]}]}


def test_dialogues_are_written(spark, tmp_path):
    turns = spark.createDataFrame([("k", 1, "A", "Hello there"), ("k", 2, "B", "Good day")], "key string, turn long, speaker string, text string")
    sinks.write_dialogues(turns, str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d/srt")).first().srt.startswith("1\n00:00:00,000 --> ")
    assert spark.read.parquet(str(tmp_path / "d/scripts")).count() == 1
