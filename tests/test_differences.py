"""Rows on which queries once differed from their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillmill.operators import answers


@pytest.mark.parametrize("name", ["html_title", "html_headings"])
def test_cut_references_equal_sql(spark, tmp_path, name):
    """A title cut within &amp; keeps what is left of it."""
    words = "The&amp; of&amp;&amp"
    spark.createDataFrame([(1, f"<title>{words}</title><h1>{words}</h1><p>x &lt;y</p>"), (2, "<title>a &lt; b&lt</title><h1>R&amp;D &amp;lt; &am</h1>")], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect()}
    sql = entry.oracle_sql()[name].replace("from pages", f"from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert got == set(duckdb.execute(sql).fetchall())


@pytest.mark.parametrize("x", [0.15625, 0.23875, 0.09375, 0.00015625, 1.0005, 2.0625, 1.00049999, -0.15625, 123450.0, 123350.0, 9999.5, 1e-7, 0.99995, 1e300])
def test_four_digits_round_as_c_does(spark, x):
    made = spark.createDataFrame([(x,)], "x double").select(answers.four_digits(F.col("x")))
    assert made.first()[0] == f"{x:.4g}"
