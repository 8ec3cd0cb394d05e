"""Queries whose work has to stay on the executors, however small their files look."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# reproduction_results, report_pages and reproduction_plans may send the three rules of plans, which are no table's rows.
@pytest.mark.parametrize("name, rules", [("texts_of_kinds", 0), ("manifest_stats", 0), ("paper_outlines", 0), ("reproduction_results", 0), ("report_pages", 1), ("reproduction_plans", 1), ("chart_svgs", 0), ("plan_targets", 0)])
def test_papers_are_not_broadcast(spark, name, rules):
    found = plan(entry.queries()[name](spark, SF))
    assert found.count("BroadcastExchange") <= rules


@pytest.mark.parametrize("name", ["reproduction_results", "paper_outlines", "report_pages", "manifest_stats", "reproduction_plans", "chart_svgs", "plan_targets"])
def test_papers_are_parsed_once(spark, name):
    """What is parsed from the lines is written once: the query's last plan, which the driver holds whole, parses no line."""
    assert "posexplode" not in plan(entry.queries()[name](spark, SF))


def test_kept_relations_are_the_same(spark):
    from quillmill.paper_queries import analysed, paper_docs
    from quillmill.plans.analysis import analyse

    kept, lazy = analysed(spark, SF)[1], analyse(paper_docs(spark, SF))
    for name in ("sections", "tables", "cells", "figures", "algorithms", "formulas", "links", "modes", "checks", "charts"):
        rows = lambda found: sorted(map(str, getattr(found, name).collect()))  # noqa: B023, E731
        assert rows(kept) == rows(lazy), name


def test_lines_are_not_shuffled(spark):
    found = plan(entry.queries()["texts_of_kinds"](spark, SF))
    assert "REPARTITION_BY_NUM" in found and "ENSURE_REQUIREMENTS" not in found


def test_normalize_property_gathers_no_group(spark, tmp_path):
    """No array of a group's rows; a null group is one, as in the SQL."""
    import duckdb

    assert "collect_list" not in plan(entry.queries()["normalize_property"](spark, SF))
    spark.createDataFrame([(1, "a", 2.0), (2, "a", 6.0), (3, None, 1.0), (4, "b", -1.0), (5, "c", 1e300), (6, "c", 1e-300)], "event_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = {tuple(r) for r in entry.queries()["normalize_property"](spark, str(tmp_path)).collect()}
    assert got == set(duckdb.execute(entry.oracle_sql()["normalize_property"].replace("from events", f"from read_parquet('{tmp_path}/events.parquet/*.parquet')")).fetchall())


@pytest.mark.parametrize("name", ["pseudocode_translate", "closing_slide_bullets"])
def test_texts_are_made_where_rows_are_dealt(spark, name):
    """A small file is one task's; what is written out of its rows is not."""
    assert "REPARTITION_BY_NUM" in plan(entry.queries()[name](spark, SF))


def test_parts_do_not_grow_with_the_table(spark, monkeypatch):
    from quillmill import registry

    monkeypatch.setattr(registry, "ROWS_DEALT", 10, raising=False)
    assert registry.dealt(spark.range(1005), "id").rdd.getNumPartitions() == 101
    assert registry.dealt(spark.range(5), "id").rdd.getNumPartitions() == 4  # the session's
