"""Page layout against values worked out by hand."""

from quillmill.operators import layout


def test_two_columns_read_left_first(spark):
    def block(key, page, x, y, text):
        return (key, page, float(x), float(y), float(x + 100), text, 600.0)

    two = [block("p", 1, x, y, f"{c}{i} ") for c, x in (("R", 400), ("L", 50)) for i, y in enumerate((10, 50, 90))]
    one = [block("p", 2, 300, 10, "b"), block("p", 2, 50, 11, "a"), block("p", 2, 50, 40, "c"), block("p", 2, 50, 5, "  ")]
    rows = spark.createDataFrame(two + one, "key string, page int, x0 double, y0 double, x1 double, text string, page_width double")
    got = {r.page: r.text for r in layout.page_texts(rows).collect()}
    assert got == {1: "L0\nL1\nL2\nR0\nR1\nR2", 2: "a\nb\nc"}


def test_titles_by_font(spark):
    lines = [(60.0, 20.0, 9.0, "arXiv:1234.5678 something long here"), (10.0, 40.0, 30.0, "side mark of a page"), (60.0, 60.0, 18.0, "A long title of"), (60.0, 80.0, 17.8, "two lines"),
             (60.0, 100.0, 11.0, "Ann Bee*, C. Dee and Eve Eff"), (60.0, 120.0, 10.0, "University of X, Y"), (60.0, 400.0, 18.0, "Not a title at all, and so on")]
    rows = spark.createDataFrame([("p", *x, 800.0) for x in lines], "key string, x0 double, y0 double, size double, text string, page_height double")
    r = layout.titles_and_authors(rows).first()
    assert (r.title, r.authors) == ("A long title of two lines", ["Ann Bee", "C. Dee", "Eve Eff"])


def test_links_by_host(spark):
    rows = spark.createDataFrame([("p", 2, "https://GitHub.com/a/b"), ("p", 1, " https://GitHub.com/a/b "), ("p", 1, "https://zenodo.org/1"), ("p", 1, "https://x.org"), ("p", 1, None)], "key string, page int, uri string")
    assert {(r.url, r.kind, r.page) for r in layout.page_links(rows).collect()} == {("https://GitHub.com/a/b", "repo", 1), ("https://zenodo.org/1", "dataset", 1)}
