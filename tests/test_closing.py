"""Closing bullets and authors on hand-made papers: each fall-back once."""

import pytest
from pyspark.sql import functions as F

from quillmill.operators import authors, document, outline

CHUNKS = "key string, kind string, text string"


def bullets(spark, abstract, text, **chunks):
    papers = spark.createDataFrame([("p", abstract, text)], "key string, abstract string, text string")
    held = spark.createDataFrame([("p", k, t) for k, t in chunks.items()], CHUNKS)
    return outline.closing_bullets(papers, held).first().bullets


LONG = "The first finding holds for all of it. The second finding is stronger yet."
TAIL = "Alpha beta gamma delta epsilon. Zeta eta theta iota kappa lambda. Limitations remain in one site alone. We will test more sites soon."


def test_sentences_that_fit_come_before_the_summary(spark):
    got = bullets(spark, "", TAIL, conclusion=LONG, outlook="Nothing said here at all today. In the future we will measure more of it.")
    assert got[:2] == ["结论：The first finding holds for all of it", "结论：The second finding is stronger yet"]
    assert got[2:4] == ["展望：In the future we will measure more of it", "展望：Nothing said here at all today"]
    # Limitations: the tail's sentence that fits, no filling up.
    assert got[4:] == ["不足：Limitations remain in one site alone"]


def test_the_discussion_stands_in_for_short_chunks(spark):
    got = bullets(spark, "", TAIL, conclusion="Short.", discussion="We discuss the gain at some length here. Future work may follow from it.")
    assert got[0] == "结论：We discuss the gain at some length here"
    assert not [b for b in got if b.startswith("展望")]  # what fits is said already, and so is the rest
    assert "不足：Limitations remain in one site alone" in got


def test_few_bullets_are_filled_up_from_the_tail(spark):
    got = bullets(spark, "", "Only one sentence is in here. A second one is here too.")
    assert got == ["结论：Only one sentence is in here", "结论：A second one is here too"]


def test_a_paper_with_nothing(spark):
    assert bullets(spark, "", "") == [outline.NO_CLOSING]
    assert bullets(spark, "Ten chars", None) == ["结论：Ten chars"]


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("x\n# T\n\nAnn A*, Bob B† and Cy C\nUniversity of X\nDora D.\n\nEve E", ["Ann A", "Bob B", "Cy C Dora D"]),
        ("## T\nAnn A\n(dated May)\nBob B", ["Ann A"]),
        ("# T\nAnn A\n## Abstract\nBob", ["Ann A"]),
        ("# T\n<!-- image -->\nAnn A", None),
        ("no heading\nAnn A", None),
        ("# T\nA1\nB2\nC3\nD4\nE5", ["A1 B2 C3 D4"]),
        ("# T\nAnn A; x; " + "y" * 61 + ", 12, Bo", ["Ann A", "Bo"]),
        ("# T", None),
    ],
)
def test_names_below_the_title(spark, text, names):
    lines = document.lines(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    got = authors.names_below_title(lines).collect()
    assert [r.authors for r in got] == ([names] if names else [])


def test_shown_authors(spark):
    rows = [(["'Ann A'", "ann a2", "B", "3x", "Cy Title: y"], None), (["One Longer Name Here, Two Longer Name Here, Three Longer Name Here"], None), ([], "Title\n2 in it\nAnn, Bob"), (None, None), ([f"Name {chr(97 + i)}" for i in range(12)], "")]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, authors array<string>, text string")
    got = [r.shown for r in authors.shown_authors(docs).orderBy("i").collect()]
    assert got == ["Ann A, Cy", "One Longer Name Here, Two Longer Name Here, Three Longer Name Here", "Ann, Bob", "", ", ".join(f"Name {c}" for c in "abcdefgh")]


def test_full_titles(spark):
    rows = [("A  study", "A_study_of_it", "t"), ("A study", "A_study", "t"), (None, "x", " first line \nsecond"), ("", "x", None), ("Other", "A_b_c", "t")]
    docs = spark.createDataFrame(rows, "title string, id string, text string")
    assert [r[0] for r in docs.select(authors.full_title(F.col("title"), F.col("id"), F.col("text"))).collect()] == ["A study of it", "A study", "first line", "", "Other"]
