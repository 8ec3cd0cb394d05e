"""Tables in words, section text, entry points, printed results and identifiers, with the traps the tables don't hold."""

import pytest
from pyspark.sql import functions as F

from quillmill.operators import answers


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("x", [0.0, 1.0, 85.25, 0.85249, 1234.6, 12346.0, 0.000123456, 0.0000123456, -7.5, 9999.7, 100000.0, 1e300, 120.0])
def test_four_digits(spark, x):
    assert one(spark, answers.four_digits(F.lit(x))) == f"{x:.4g}"


def test_tables_in_words(spark):
    rows = [(1, "T1", r, c, n, v) for r, vs in enumerate([(None, 3.0, 5.0), (7.0, 3.0, 6.0), (9.0, None, 4.0)]) for c, (n, v) in enumerate(zip(["", "x", "x"], vs, strict=True), 1)]
    rows += [(1, "T1", 0, 0, "name", None), (2, "T2", 0, 0, "name", None), (2, "T2", 0, 1, "note", None)]
    cells = spark.createDataFrame(rows, "key int, table_id string, row_idx int, col_idx int, col_name string, num double")
    got = {r.key: r.explanation for r in answers.explain_tables(cells).collect()}
    assert got == {1: "表 T1：3 行 × 4 列；col1 最优 9（第 2 行）；x 最优 6（第 2 行）。", 2: "表 T2：1 行，以描述性内容为主。"}


def test_text_of_kinds(spark):
    rows = [(1, 2, "method", "b"), (1, 1, "method", "a"), (1, 3, "results", "c"), (2, 1, "results", "d"), (3, 1, "method", None)]
    got = answers.text_of_kinds(spark.createDataFrame(rows, "key int, ord int, kind string, text string"), "method", "experiment")
    assert {r.key: r.text for r in got.collect()} == {1: "a\n\nb", 2: "", 3: ""}


@pytest.mark.parametrize(("caption", "source", "kind"), [("Matrix sort", "", "matrix"), ("sort", "of tokens", "str_list"), ("", "排序", "int_vec"), ("print", "x", "vec"), (None, None, "vec")])
def test_input_kind(spark, caption, source, kind):
    assert one(spark, answers.input_kind(F.lit(caption).cast("string"), F.lit(source).cast("string"))) == kind


@pytest.mark.parametrize(("code", "name"), [("def pop(a):\n  def top_k (x, k):\n", "top_k"), ("x = def f(", "run"), ("def sort(a): pass", "run"), (None, "run"), ("\n\ndef _a1(): 0", "_a1")])
def test_function_name(spark, code, name):
    assert one(spark, answers.function_name(F.lit(code).cast("string"))) == name


@pytest.mark.parametrize(("out", "json"), [('M{"a": 1}\nM{"a": 2}\nend', '{"a": 2}'), ('M{"a": 1}\nM{bad', None), ('x M{"a": 1}', None), (None, None), ("M[1]\r\n", "[1]")])
def test_printed_result(spark, out, json):
    assert one(spark, answers.printed_result(F.lit(out).cast("string"), "M")) == json


def test_allocated_ids(spark):
    names = ["a.md", "a.md", "x/a.pdf", "a_2.md", "b", "a_2", "é!"]
    incoming = spark.createDataFrame(list(enumerate(names)), "at int, name string")
    got = answers.allocated_ids(incoming, spark.createDataFrame([("a",), ("a_4",), ("a_04",), ("c",)], "paper_id string"), "at")
    assert [r.paper_id for r in got.orderBy("at").collect()] == ["a_3", "a_5", "a_6", "a_2", "b", "a_2_2", "é"]
    empty = answers.allocated_ids(incoming, spark.createDataFrame([], "paper_id string"), "at")
    assert [r.paper_id for r in empty.orderBy("at").collect()] == ["a", "a_3", "a_4", "a_2", "b", "a_2_2", "é"]
