"""From raw documents to checks, summaries and plans: one job for any number of papers."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import meet
from ..functions.shared import bucketed
from ..operators import document as D
from ..operators import papers as P
from ..operators import tables as B
from ..operators import terms


class Analysis:
    """Lazy relations over all papers, each made when it is first asked for.

    ``kept``: what is parsed from the lines, and what several others are made of, is written to the shared folder once
    (headings, sections, tables, cells, figures, algorithms, formulas, links, modes, checks, charts), in that many buckets of the
    key. Without it a query's plan holds the lines' parsing as often as its relations are used, all of it planned,
    compiled and tracked by the driver at once.
    """

    def __init__(self, docs: DataFrame, key: str, text: str, attached: DataFrame | None, kept: int | None):
        self._docs, self._key, self._text, self._attached, self._kept = docs, key, text, attached, kept

    def _once(self, rows: DataFrame) -> DataFrame:
        return rows if self._kept is None else bucketed(rows, self._kept, "key")

    @cached_property
    def lines(self) -> DataFrame:
        return D.lines(self._docs, self._key, self._text)

    @cached_property
    def headings(self) -> DataFrame:
        return self._once(D.headings(self.lines))

    @cached_property
    def sections(self) -> DataFrame:
        return self._once(D.section_texts(D.section_ranges(self.headings, self.lines), self._docs, self._key, self._text))

    @cached_property
    def tables(self) -> DataFrame:
        found = D.table_rows(self.lines)
        return self._once(found if self._attached is None else found.unionByName(self._attached))

    @cached_property
    def cells(self) -> DataFrame:
        return self._once(D.cells(self.tables))

    @cached_property
    def figures(self) -> DataFrame:
        return self._once(D.figures(self.lines))

    @cached_property
    def algorithms(self) -> DataFrame:
        return self._once(D.algorithms(self.lines))

    @cached_property
    def formulas(self) -> DataFrame:
        return self._once(D.formulas(self.lines))

    @cached_property
    def links(self) -> DataFrame:
        return self._once(D.links(self.lines))

    @cached_property
    def papers(self) -> DataFrame:
        docs = self._docs
        return docs.select(F.col(self._key).alias("key"), *(["has_code"] if "has_code" in docs.columns else [])).distinct()

    @cached_property
    def titles(self) -> DataFrame:
        return meet(self.papers.select("key"), D.titles(self.headings), "key", "left")

    @cached_property
    def modes(self) -> DataFrame:
        return self._once(P.modes(self.papers, self.links, self.algorithms))

    @cached_property
    def targets(self) -> DataFrame:
        return P.plan_targets(self.modes, self.tables, self.figures, self.algorithms)

    @cached_property
    def checks(self) -> DataFrame:
        return self._once(B.table_checks(self.cells))

    @cached_property
    def charts(self) -> DataFrame:
        return self._once(B.chart_specs(self.cells))

    @cached_property
    def summary(self) -> DataFrame:
        return meet(self.papers.select("key"), B.check_summary(self.checks, "key"), "key", "left").na.fill({"total": 0, "n_pass": 0, "n_warn": 0, "n_fail": 0, "n_skipped": 0, "score": 0.0, "verdict": "not_verifiable"})

    @cached_property
    def manifest(self) -> DataFrame:
        return P.nested_papers(self.titles, self.sections, self.tables, self.algorithms, self.links)


def analyse(docs: DataFrame, key: str = "doc_id", text: str = "text", attached: DataFrame | None = None, kept: int | None = None) -> Analysis:
    """``attached``: more tables (key, table_id, caption, row_idx, cells), as from CSV files or HTML. ``kept``: relations are
    written once, in so many buckets; ``docs`` (and ``attached``) should lie in as many parts by ``key``."""
    return Analysis(docs, key, text, attached, kept)


def explain(docs: DataFrame, key: str = "doc_id", text: str = "text", sentences: int = 5) -> DataFrame:
    """Slides' bullets: each paper's best sentences in reading order, condensed."""
    from ..functions.text import condense

    found = terms.summaries(docs, sentences, key, text)
    return found.select(key, "pos", condense(F.col("sentence")).alias("bullet"))


def reproduce(analysis: Analysis, results: DataFrame) -> DataFrame:
    """Deltas of the papers' tables against reproduced cells, with the papers' own checks first."""
    told = analysis.tables.filter(~F.startswith("table_id", F.lit("P"))).select("key", "table_id").distinct()
    deltas = B.compare(analysis.cells.join(told, ["key", "table_id"], "left_semi"), results)
    as_checks = deltas.select("key", "table_id", F.lit("metric").alias("name"), F.concat_ws("/", F.concat_ws(":", "table_id", F.left("row_key", F.lit(20))), F.left("col_name", F.lit(18))).alias("scope"), "status", "expected", "actual", "rel_delta")
    return analysis.checks.unionByName(as_checks)
