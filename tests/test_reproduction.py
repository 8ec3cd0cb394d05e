"""Plans, judged result files, source trees, snapshots, outlines and charts on small tables with their traps."""

import re

import pytest
from pyspark.sql import functions as F

from quillmill.operators import charts, outline, reproduction
from quillmill.sources import readers

CELLS = "key string, table_id string, row_idx int, col_idx int, col_name string, raw string, num double"


def grid(key, name, header, rows):
    return [(key, name, i, j, h, str(c), c if isinstance(c, float) else None) for i, r in enumerate(rows) for j, (h, c) in enumerate(zip(header, r, strict=True))]


def test_files_without_a_judged_cell_leave_nothing(spark):
    reported = grid("p", "T1", ["Method", "Accuracy"], [["Base", 0.7], ["Ours", 0.8]]) + grid("p", "P1", ["Method", "Accuracy"], [["Base", 0.7]]) + grid("q", "T1", ["Method", "F1"], [["Base", 0.5]])
    results = grid("p", "out/main.csv", ["method", "accuracy"], [["base", 0.7], ["other", 0.1]])
    results += grid("p", "out/rest.csv", ["method", "accuracy"], [["other", 0.1]]) + grid("p", "out/late.csv", ["method", "accuracy"], [["ours", 0.8]])
    results += grid("q", "a.csv", ["method", "recall"], [["base", 0.5]])
    files = [("p", "out/main.csv", 9000), ("p", "out/rest.csv", 9000), ("p", "out/late.csv", 10), ("p", "out/fig.csv", 9000), ("q", "a.csv", 1)]
    run = lambda most: {(r.key, r.source, r.row_key, r.status) for r in reproduction.judged_results(*[spark.createDataFrame(x, s) for x, s in ((reported, CELLS), ([("p", "P1")], "key string, table_id string"), (files, "key string, path string, bytes long"), (results, CELLS))], most).collect()}
    # The row without a partner stays with its judged neighbour; the file without any judged cell goes; q shares no column.
    assert run(2) == {("p", "out/main.csv", "Base", "pass"), ("p", "out/main.csv", "Ours", "skipped")}
    assert ("p", "out/late.csv", "Ours", "pass") in run(4)


def test_ranks_follow_the_score(spark):
    files = spark.createDataFrame([("k", "a/x.json", 10**6), ("k", "a/table.csv", 0), ("k", "a/fig.csv", 0), ("k", "a/b.csv", 8192), ("k", "a/a.csv", 8192)], "key string, path string, bytes long")
    got = reproduction.ranked_files(files, 4, "key").orderBy("place").collect()
    assert [(r.path, r.score) for r in got] == [("a/table.csv", 9), ("a/a.csv", 7), ("a/b.csv", 7), ("a/fig.csv", 3)]


def test_plan_of_a_paper_with_nothing(spark):
    decisions = spark.createDataFrame([("a", "no_code", 0.7), ("b", "open_source", 0.9)], "key string, mode string, confidence double")
    targets = spark.createDataFrame([("b", "algorithm", "A1", "", "cite"), ("b", "table", "T10", "", "benchmark"), ("b", "table", "T2", "x", "benchmark")], "key string, kind string, id string, caption string, role string")
    tables = spark.createDataFrame([("b", "T2")], "key string, table_id string")
    links = spark.createDataFrame([("b", 5, "https://github.com/x/late", "repo"), ("b", 2, "https://github.com/x/y", "repo")], "key string, line_no int, url string, kind string")
    got = {r.key: r for r in reproduction.plans(decisions, targets, tables, links).collect()}
    assert got["a"].targets == [] and len(got["a"].warnings) == 3 and got["a"].inputs == {"scale": "400"}
    assert [t.id for t in got["b"].targets] == ["T2", "T10", "A1"] and got["b"].warnings == []
    assert got["b"].inputs["repository"] == "https://github.com/x/y" and got["b"].steps == reproduction.STEPS["open_source"]
    assert got["b"].scale_guard.asDict() == reproduction.GUARD


def tree(spark, files):
    return spark.createDataFrame([("k", p, c) for p, c in files], "key string, path string, content string")


@pytest.mark.parametrize(
    ("files", "lone", "entries", "tier"),
    [
        ([("b/Main.py", ""), ("a/train.py", ""), ("c.py", "__main__")], False, ["a/train.py", "b/Main.py"], "name"),
        ([(f"s{i}.py", "if __name__ == '__main__': pass") for i in range(9)] + [("x.py", None)], False, [f"s{i}.py" for i in range(6)], "main"),
        ([("only.py", "pass"), ("data.csv", "")], False, [], "none"),
        ([("only.py", "pass"), ("data.csv", "")], True, ["only.py"], "lone"),
        ([("one.py", "pass"), ("two.py", "pass")], True, [], "none"),
        ([(f"d{i}/run.py", "") for i in range(12)], False, sorted(f"d{i}/run.py" for i in range(12))[:10], "name"),
    ],
)
def test_entry_points_fall_back(spark, files, lone, entries, tier):
    got = reproduction.manifests(tree(spark, files), lone).first()
    assert (got.entrypoints, got.tier) == (entries, tier)


def test_manifest_sorts_files_and_caps_them(spark):
    files = [(f"data/{i:03}.csv", "") for i in range(90)] + [("out/results/r.json", ""), ("requirements.txt", "# pins\nnumpy==1\n\n pandas "), ("LICENSE.txt", ""), ("README.md", "Set seed: 7"), ("Dockerfile", "")]
    got = reproduction.manifests(tree(spark, files)).first()
    assert got.data_files == [f"data/{i:03}.csv" for i in range(80)] and got.result_files == ["out/results/r.json"]
    assert got.requirements == ["numpy==1", "pandas"] and got.has_dockerfile and got.notes == ["no entry point: one has to be named"]
    script = reproduction.run_scripts(reproduction.manifests(tree(spark, files))).first().script
    assert "pip install -r requirements.txt" in script and "PYTHONHASHSEED=7" in script and "python <entry point>" in script


def test_trees_are_read_from_folders(spark, tmp_path):
    for path, text in {"a/src/run.py": "x", "a/data/d.csv": "1", "b/tool.py": "__main__", "b/README.md": "seed 3"}.items():
        at = tmp_path / "trees" / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    got = {r.key: r for r in readers.repositories(spark, str(tmp_path / "trees")).collect()}
    assert got["a"].entrypoints == ["src/run.py"] and got["a"].data_files == ["data/d.csv"]
    assert got["b"].entrypoints == ["tool.py"] and got["b"].readme == "seed 3"


def test_snapshots(spark):
    listing = lambda rows: spark.createDataFrame(rows, "key string, path string, bytes long, time string")
    before = listing([("k", "a.csv", 1, "t"), ("k", "b.csv", 1, "t"), ("k", "c.csv", None, "t"), ("j", "a.csv", 1, "t")])
    after = listing([("k", "a.csv", 1, "t"), ("k", "b.csv", 2, "t"), ("k", "c.csv", None, "t"), ("k", "d.PNG", 1, "u"), ("k", "e.exe", 1, "u")])
    assert {tuple(r) for r in reproduction.changed_files(before, after, "key").collect()} == {("k", "b.csv", "changed"), ("k", "d.PNG", "new"), ("k", "e.exe", "new"), ("j", "a.csv", "gone")}
    assert [tuple(r) for r in reproduction.new_artifacts(before, after, "key").collect()] == [("k", "d.PNG")]


def test_outline_keeps_head_and_tail(spark):
    heads = spark.createDataFrame([("p", "A  long\n title", 1, 1, 2, 0), ("q", None, 0, 0, 0, 0)], "key string, title string, n_formulas int, n_algorithms int, n_tables int, n_figures int")
    sections = [("p", 1, "Intro", "introduction", "x"), ("p", 2, "II. METHODS", "method", "x"), ("p", 3, "More method", "method", "x"), ("p", 4, "Empty", "experiment", " "), ("p", 5, "Results!", "experiment", "x"), ("p", 6, "results", "experiment", "x"), ("p", 7, "Refs", "references", "x"), ("p", 8, "The end", "conclusion", "x")]
    held = spark.createDataFrame(sections, "key string, ord int, heading string, kind string, text string")
    got = {k: [r.heading for r in outline.outlines(heads, held, n).filter(F.col("key") == k).orderBy("pos").collect()] for k, n in (("p", 20), ("q", 12))}
    assert got["p"] == ["论文速览：A long title", "Intro", "相关工作与本文定位", "预备知识", "方法：模型与基组", "Results!", "More method", outline.FORMULAS_HEADING, outline.ALGORITHMS_HEADING, "重点结果解读（2 张表格）", "The end", outline.LAST_HEADING]
    assert got["q"] == ["论文速览：论文", *[h for _, h in outline.SLOT_KINDS], outline.CLOSING_HEADING, outline.LAST_HEADING]
    for n in (3, 6, 8):
        cut = [r.heading for r in outline.outlines(heads, held, n).filter("key = 'p'").orderBy("pos").collect()]
        assert cut == got["p"][: max(4, n - 2)] + got["p"][-2:]


SPEC = "key string, table_id string, kind string, categories array<string>, series array<struct<name:string,values:array<double>>>"


def drawn(spark, *rows):
    return [r.svg for r in charts.svg(spark.createDataFrame([("k", *r) for r in rows], SPEC)).orderBy("table_id").collect()]


def test_bars_have_the_heights_of_their_values(spark):
    svg = drawn(spark, ("T<1>", "grouped_bar", ["a", "b & c"], [("x", [1.0, 4.0]), ("y", [None, -4.0])]))[0]
    bars = re.findall(r'class="bar" x="([\d.]+)" y="([\d.]+)" width="([\d.]+)" height="([\d.]+)"', svg)
    assert [float(b[3]) for b in bars] == pytest.approx([308 / 8, 308 / 2, 308 / 2])
    zero = charts.TOP + 308 / 2  # values go from -4 to 4
    assert float(bars[0][1]) + float(bars[0][3]) == pytest.approx(zero) and float(bars[2][1]) == pytest.approx(zero)
    lefts = [float(b[0]) for b in bars]
    assert lefts == sorted(lefts) and lefts[0] >= charts.LEFT and lefts[-1] + float(bars[-1][2]) <= charts.WIDTH - charts.RIGHT
    assert "T&lt;1&gt;" in svg and "b &amp; c" in svg and svg.count('class="legend"') == 2 and svg.count('class="tick"') == 6


def test_lines_and_flat_charts(spark):
    names = [f"c{i}" for i in range(8)]
    line, flat, empty = drawn(spark, ("T1", "line", names, [("s", [float(i) for i in range(7)] + [None])]), ("T2", "bar", ["a"], [("s", [0.0])]), ("T3", "bar", [], []))
    points = [tuple(map(float, p.split(","))) for p in re.search(r'points="([^"]*)"', line)[1].split()]
    assert len(points) == 7 == line.count("<circle") and points[0][1] == charts.TOP + 308 and points[-1][1] == charts.TOP
    assert [b[0] - a[0] for a, b in zip(points, points[1:], strict=False)] == pytest.approx([720 / 8] * 6, abs=0.02)
    assert line.count("rotate(-28") == 8 and "legend" not in line
    assert 'height="0.00"' in flat and ">1<" in flat and empty.startswith("<svg") and "bar" not in empty
