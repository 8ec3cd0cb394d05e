"""Pseudocode, outlines and merged readings against values worked out by hand."""

import ast

from quillmill.operators import merging, outline, pseudocode


def translated(spark, caption, *lines):
    rows = spark.createDataFrame([("p", "A1", caption, list(lines))], "key string, algorithm_id string, caption string, lines array<string>")
    return pseudocode.translate(rows).first().code


def test_wrapped_algorithm(spark):
    code = translated(
        spark, "Top-K", "Algorithm 1: TOPK over a stream", "Input: stream S, integer k", "Output: H", "1: H ← empty min-heap", "2: for each x in S do",
        "3:   if |H| < k then", "4:     push(H, x) ▷ room left", "5:   else if x ≥ H[0] then", "6:     H[0] := x", "7:   end if", "8: end for", "9: return H",
    )
    assert code.split("\n") == [
        "def top_k(stream_S, integer_k):", "    H = []", "    for x in S:", "        if |H| < k:", "            push(H, x)", "        elif x >= H[0]:", "            H[0] = x", "    return H",
    ]


def test_headers_loops_and_odd_lines(spark):
    code = translated(
        spark, None, "Input: a, 2b", "Output: r, s", "function f()", "repeat", "x = a = true", "until x ∈ {nil}", "for i = 1 to n - 1 by 2 do", "while NOT done do", "▷ why", "break;", "end while", "end for", "otherwise", "continue", "end", "end", "end", "return",
    )
    assert code.split("\n") == [
        "def f(a, a_2b):", "    # returns: r", "    # returns: s", "    while True:", "        x = a == True", "        if x in {None}:", "            break", "    for i in range(1, (n - 1) + 1, 2):", "        while not done:",
        "            # why", "            break", "else:", "    continue", "return",
    ]
    assert translated(spark, "", "1: ", "") == "def algorithm_a1():\n    pass"
    assert translated(spark, "算法") == "def 算法():\n    pass" and translated(spark, "!!", "Input: x") == "def run():\n    pass"
    ast.parse(translated(spark, "Sum", "s ← 0", "for i = 1 to n do", "s ← s + i", "end for", "return s"))


def test_closing_chunks_and_points(spark):
    text = "Intro\n1. Introduction\nwords\nConclusion\nWe found a thing, and it is good enough for all of us.\n\nIt will pave the way.\nReferences\n[1] x\nV. Limitations\nThe method cannot see the dark side of any moon at all.\n6 Next steps\nno\n局限\n数据偏差"
    rows = spark.createDataFrame([("p", i, x) for i, x in enumerate(text.split("\n"))] + [("q", 0, "nothing")], "key string, line_no int, line string")
    chunks = outline.closing_chunks(rows)
    got = {(r.key, r.kind): r.text for r in chunks.collect()}
    assert got == {
        ("p", "conclusion"): "We found a thing, and it is good enough for all of us. It will pave the way.",
        ("p", "limitation"): "The method cannot see the dark side of any moon at all. 数据偏差",
    }
    tails = spark.createDataFrame([("p", text), ("q", "")], "key string, tail string")
    points = {(r.key, r.label): r.points for r in outline.closing_points(chunks, tails).collect()}
    assert points["p", "结论"] == ["We found a thing, and it is good enough for all of us", "It will pave the way"]
    assert points["p", "不足"][0].startswith("The method cannot see") and not any(k == "q" for k, _ in points)


def test_outline_headings_meet_sections(spark):
    sections = [(1, "I. INTRODUCTION", "introduction", "i"), (2, "Model", "method", "m1"), (3, "More", "method", "m2"), (4, "Discussion", "discussion", "d"), (5, "End", "conclusion", "c")]
    rows = spark.createDataFrame([("p", *s) for s in sections], "key string, ord int, heading string, kind string, text string")
    heads = spark.createDataFrame([("p", i, h) for i, h in enumerate(["Model", "引言：问题从哪来", "核心方法", "结论", "速览", "复现"])], "key string, pos int, heading string")
    abstracts = spark.createDataFrame([("p", "short")], "key string, abstract string")
    got = {}
    for r in outline.outline_sections(heads, rows, abstracts).orderBy("pos", "ord").collect():
        got.setdefault(r.heading, []).append(r.text)
    assert got == {"Model": ["m1"], "引言：问题从哪来": ["i"], "核心方法": ["m1", "m2"], "结论": ["c", "d"], "速览": ["short"]}


def test_each_table_and_figure_serves_once(spark):
    heads = spark.createDataFrame([("p", i, h) for i, h in enumerate(["引言", "核心方法", "公式", "实验结果", "More results", "方法细节", "method"])] + [("q", 0, "结果")], "key string, pos int, heading string")
    tables = spark.createDataFrame([("p", 1, "T1")], "key string, ord int, table_id string")
    figures = spark.createDataFrame([("p", 1, "F1", "plot"), ("p", 2, "F2", "architecture"), ("p", 3, "F3", "unknown"), ("p", 4, "F4", "plot")], "key string, ord int, figure_id string, kind string")
    got = [(r.key, r.pos, r.kind, r.table_id, r.figure_id) for r in outline.slide_assets(heads, tables, figures).orderBy("key", "pos").collect()]
    assert got == [("p", 0, "content", None, None), ("p", 1, "figure", None, "F2"), ("p", 3, "table", "T1", None), ("p", 4, "figure", None, "F1"), ("p", 5, "figure", None, "F4"), ("p", 6, "content", None, None), ("q", 0, "content", None, None)]


def test_glossary_and_headings(spark):
    rows = spark.createDataFrame([("The  HF wave function",), ("plain words",), ("",), (None,), ("DATA AVAILABILITY STATEMENT",)], "t string")
    got = [tuple(r) for r in rows.select(outline.glossed(rows.t), outline.translated_heading(rows.t)).collect()]
    assert got[:4] == [("The Hartree-Fock 波函数", "The  HF wave function"), ("论文指出：plain words", "plain words"), ("", ""), ("", "")] and got[4][1] == "数据可用性"


def test_digest_is_cut_to_its_budget(spark):
    heads = spark.createDataFrame([("p", "T", ["A", "B"], "abs"), ("q", "U", None, None)], "key string, title string, authors array<string>, abstract string")
    sections = spark.createDataFrame([("p", 1, "H", "body")], "key string, ord int, heading string, text string")
    algorithms = spark.createDataFrame([("p", 1, "A1", "cap", ["x", "y"])], "key string, ord int, algorithm_id string, caption string, lines array<string>")
    tables = spark.createDataFrame([("p", o, f"T{o}", "c", i, [str(i), "v"]) for o in range(1, 5) for i in range(20)], "key string, ord int, table_id string, caption string, row_idx int, cells array<string>")
    full = {r.key: r.digest for r in outline.digests(heads, sections, algorithms, tables).collect()}
    assert full["p"].startswith("# 标题\nT\n\n# 作者\nA, B\n\n# 摘要\nabs\n\n# H\nbody\n\n# 伪代码 A1（cap）\nx\ny\n\n# 表格 T1（c）\n0 | v\n1 | v") and "T4" not in full["p"] and "13 | v" not in full["p"]
    assert full["q"] == "# 标题\nU\n\n# 作者\n\n\n# 摘要\n"
    assert [r.digest for r in outline.digests(heads, sections, algorithms, tables, budget=7).collect() if r.key == "p"] == ["# 标题\nT\n"]


GRID = (["a", "b"], [["1", "2"]])
TABLES = "key string, ord int, table_id string, caption string, header array<string>, rows array<array<string>>"


def test_merged_tables(spark):
    s = spark.createDataFrame([("p", 1, "T1", "", *GRID), ("p", 2, "T2", "Table 2: Errors of all", *GRID), ("p", 3, "T3", "note", ["x"], [])], TABLES)
    captions = spark.createDataFrame([("p", 1, "T5", "TABLE V. Costs"), ("p", 2, "T6", "unused")], "key string, ord int, table_id string, caption string")
    filled = merging.captions_to_grids(s, captions)
    assert {(r.ord, r.table_id, r.caption) for r in filled.collect()} == {(1, "T5", "TABLE V. Costs"), (2, "T2", "Table 2: Errors of all"), (3, "T3", "note")}
    b = spark.createDataFrame([("p", 1, "T1", "junk", *GRID), ("p", 2, "T9", "errors of ALL", [], []), ("p", 3, "TS1", "TABLE S1 extra", [], []), ("p", 4, "T8", "TABLE II main", [], []), ("p", 5, "T7", "Something else", [], []), ("q", 1, "T1", "own", *GRID), ("r", 1, "T1", "", [], [])], TABLES)
    got = {(r.key, r.source, r.table_id) for r in merging.merged_tables(b, filled).collect()}
    assert got == {("p", "structured", "T5"), ("p", "structured", "T2"), ("p", "base", "TS1"), ("p", "base", "T7"), ("q", "base", "T1"), ("r", "base", "T1")}


def test_titles_sections_and_junk(spark):
    titles = spark.createDataFrame([("p", 1, "Untitled"), ("p", 2, "I. INTRODUCTION"), ("p", 3, "A short title"), ("p", 4, "A small title"), ("q", 1, "")], "key string, ord int, title string")
    assert [tuple(r) for r in merging.best_titles(titles).collect()] == [("p", "A short title")]
    sections = spark.createDataFrame([("p", "Results and more", "other"), ("p", "II. X", "other"), ("p", "Foo", "method"), ("p", "Bar", "other")], "key string, heading string, kind string")
    assert merging.academic_sections(sections).first().n == 3
    rows = spark.createDataFrame([(["1", "2", "3"], [["4", "x", "6"]]), (["a", "b"], [["1", "2"]]), ([], [])], "header array<string>, rows array<array<string>>")
    assert [r[0] for r in rows.select(merging.is_junk(rows.header, rows.rows)).collect()] == [True, False, True]
    links = spark.createDataFrame([("p", "u", 1)], "key string, url string, n int")
    assert sorted(r.n for r in merging.merged_links(links, spark.createDataFrame([("p", "u", 2), ("p", "v", 3)], links.schema)).collect()) == [1, 3]
