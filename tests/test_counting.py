"""Terms and sentences counted by pieces: whole results however small the pieces, and no row a token in Spark."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillmill.operators import terms
from quillmill.sources import html

SF = "/root/testdata/sf0.001"
TEXTS = [(1, "alpha beta alpha gamma"), (1, "beta delta alpha"), (2, "alpha"), (None, "delta delta"), (None, "delta beta"), (3, None), (4, "")]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("at_once", [1, 3, 1_000_000])
def test_terms_of_keys_in_several_rows(spark, monkeypatch, at_once):
    """Rows of one key are one document, also where a piece ends within it."""
    held = spark.createDataFrame(TEXTS, "doc_id long, text string").coalesce(1).sortWithinPartitions("doc_id").select(F.col("doc_id").alias("key"), terms.T.tokens(F.col("text")).alias("tokens"))
    monkeypatch.setattr(terms, "TOKENS_AT_ONCE", at_once)
    monkeypatch.setattr(terms._few, "__defaults__", (1,))
    tf, df = {}, {}
    for batch in terms._counted(iter(held.toArrow().to_batches())):
        for r in batch.to_pylist():
            tf[r["term"]] = tf.get(r["term"], 0) + r["tf"]
            df[r["term"]] = df.get(r["term"], 0) + r["df"]
    assert tf == {"alpha": 4, "beta": 3, "gamma": 1, "delta": 4} and df == {"alpha": 2, "beta": 2, "gamma": 1, "delta": 2}
    scored = terms.term_scores(spark.createDataFrame(TEXTS, "doc_id long, text string"))
    assert {r.term: (r.tf, r.df) for r in scored.collect()} == {t: (tf[t], df[t]) for t in tf}


@pytest.mark.parametrize("name", ["term_tfidf_topk"])
def test_no_row_a_token(spark, name):
    assert "Generate" not in plan(entry.queries()[name](spark, SF))


@pytest.mark.parametrize("name", ["sentence_rank", "summary_ordered"])
def test_documents_stay_where_they_are_read(spark, name):
    found = plan(entry.queries()[name](spark, SF))
    assert "Exchange" not in found and "Sort" not in found


def test_text_is_lowered_once(spark):
    assert plan(entry.queries()["missing_elements"](spark, SF)).count("lower(") == 1


def test_pages_are_read_by_few():
    """A batch of many pages is written out piece by piece."""
    pages = pa.RecordBatch.from_pydict({"key": list(range(100)), "html": [f"<h1>t{i}</h1>" for i in range(100)]})
    pieces = list(html.read_batches(iter([pages]), closed=False))
    assert max(p.num_rows for p in pieces) <= html.PAGES_AT_ONCE < 100
    assert [r["text"] for p in pieces for r in p.to_pylist()] == [f"# t{i}" for i in range(100)]
