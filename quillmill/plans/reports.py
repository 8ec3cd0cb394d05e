"""The whole output of a reproduction: data sets, branch by mode, result record, report; and the papers' list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from ..functions.joins import meet
from ..functions.text import escaped
from ..operators import papers as P
from ..operators import tables as B
from .analysis import Analysis

MOST_TARGETS, MOST_CHECKS = 40, 200


def _in_order(rows: DataFrame, order: Column, columns: list[str], name: str) -> DataFrame:
    """(key, name): the rows of each key as an array of records."""
    held = F.array_sort(F.collect_list(F.struct(order.alias("_o"), *columns)))
    return rows.groupBy("key").agg(F.transform(held, lambda x: F.struct(*[x[c].alias(c) for c in columns])).alias(name))


def datasets(cells: DataFrame, most: int = V.MAX_RECORDS) -> DataFrame:
    """(key, table_id, n_rows, n_cols, numeric_columns, truncated): what each table gives as data."""
    shape = cells.groupBy(*B.TABLE).agg(F.count_distinct("row_idx").alias("n_rows"), F.count_distinct("col_name").alias("n_cols"))
    named = F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "col_name"))), lambda x: x["col_name"])
    numeric = B.numeric_columns(cells).groupBy(*B.TABLE).agg(named.alias("numeric_columns"))
    none = F.array().cast("array<string>")
    return meet(shape, numeric, B.TABLE, "left").select(*B.TABLE, F.least("n_rows", F.lit(most)).alias("n_rows"), "n_cols", F.coalesce("numeric_columns", none).alias("numeric_columns"), (F.col("n_rows") > most).alias("truncated"))


def csv_texts(tables: DataFrame) -> DataFrame:
    """(key, table_id, csv): every table (key, table_id, row_idx, cells) as CSV text with a byte order mark.

    Columns are the union of all rows' columns: rows longer than the header add col1, col2, ... by place, as an
    unnamed header cell does; short rows end in empty cells. Of columns of one name the last value stands in the first place.
    """
    head = tables.filter("row_idx = 0").select(*B.TABLE, F.transform("cells", lambda c: F.trim(c)).alias("names"))
    width = tables.groupBy(*B.TABLE).agg(F.max(F.size("cells")).alias("width"))
    name = lambda i: F.coalesce(F.nullif(F.try_element_at("names", i), F.lit("")), F.concat(F.lit("col"), i.cast("string")))
    fields = F.transform(F.sequence(F.lit(1), F.greatest("width", F.lit(1))), name)
    quoted = lambda c: F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    shaped = meet(meet(tables, head, B.TABLE), width, B.TABLE).withColumn("fields", fields)
    once = F.array_distinct("fields")
    last = lambda f: F.size("fields") - F.array_position(F.reverse("fields"), f) + 1
    value = lambda f: F.when(F.col("row_idx") == 0, f).otherwise(F.coalesce(F.try_element_at("cells", last(f).cast("int")), F.lit("")))
    line = F.array_join(F.transform(once, lambda f: quoted(value(f))), ",")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("row_idx", line.alias("line")))), lambda x: x["line"])
    return shaped.groupBy(*B.TABLE).agg(F.concat(F.lit("﻿"), F.array_join(lines, "\r\n"), F.lit("\r\n")).alias("csv"))


def branches(found: Analysis, docs: DataFrame, properties: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, mode, algorithms, missing, warnings): what each mode's branch leaves beside deltas.

    Pseudocode: all algorithms with intent and state, which ``properties`` (key, algorithm_id, status, ...),
    checks of outputs, make ok; without any they are skipped. No code: the elements that the experiment
    and method sections, read to their end, don't name.
    """
    number = F.regexp_extract("algorithm_id", r"(\d+)", 1).cast("int")
    every = found.algorithms
    if properties is None:
        states = every.withColumn("status", F.lit("skipped"))
    else:
        ran = properties.groupBy("key", "algorithm_id").agg(F.lit("ok").alias("ran"))
        states = meet(every, ran, ["key", "algorithm_id"], "left").withColumn("status", F.coalesce("ran", F.lit("failed")))
    intent = T.algorithm_intent(F.col("caption"), F.array_join("lines", "\n"))
    listed = _in_order(states.withColumns({"intent": intent, "caption": F.left("caption", F.lit(120))}), number, ["algorithm_id", "caption", "intent", "status"], "algorithms")
    told = found.sections.filter(F.col("kind").isin("experiment", "method"))
    body = told.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n\n").alias("body"))
    told = meet(docs.select(F.col(key).alias("key")).distinct(), body, "key", "left")
    missing = P.missing_elements(told.withColumnRenamed("key", "id"), "id", "body", head=None)
    tables = found.tables.select("key").distinct().withColumn("has_tables", F.lit(True))
    out = found.modes.select("key", "mode")
    for part in (listed, missing, tables):
        out = meet(out, part, "key", "left")
    pseudo, bare = F.col("mode") == "pseudocode_only", F.col("mode") == "no_code"
    no_algorithm = F.array().cast("array<struct<algorithm_id:string,caption:string,intent:string,status:string>>")
    no_text = F.array().cast("array<string>")
    missed = F.when(bare, F.coalesce("missing", no_text)).otherwise(no_text)
    warnings = F.array(
        F.when(pseudo & F.col("algorithms").isNull(), "no pseudocode to translate"),
        F.when(pseudo & F.col("algorithms").isNotNull(), "logic alone: properties of outputs are checked, no numbers of the paper"),
        F.when(bare & (F.size(missed) > 0), F.concat(F.lit("not stated: "), F.array_join(missed, ", "))),
        F.when(bare & F.col("has_tables").isNull(), "no tables to check"),
    )
    return out.select("key", "mode", F.when(pseudo, F.coalesce("algorithms", no_algorithm)).otherwise(no_algorithm).alias("algorithms"), missed.alias("missing"), F.filter(warnings, lambda w: w.isNotNull()).alias("warnings"))


def results(found: Analysis, docs: DataFrame, deltas: DataFrame | None = None, properties: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One record a paper: mode, summaries of checks and deltas, data sets, branch output, deltas in order.

    ``deltas`` has the columns of checks; a paper's own checks come first.
    """
    checks = found.checks.withColumn("src", F.lit(0))
    every = checks if deltas is None else checks.unionByName(deltas.select(*B.CHECK).withColumn("src", F.lit(1)))
    held = _in_order(every, F.struct("src", "table_id", "name", "scope"), ["name", "scope", "status", "expected", "actual", "rel_delta"], "deltas")
    sums = B.check_summary(every, "key")
    sums = sums.select("key", F.struct(*[c for c in sums.columns if c != "key"]).alias("checks"))
    judged = B.delta_summary(every, "key")
    judged = judged.select("key", F.struct(*[c for c in judged.columns if c != "key"]).alias("deltas_summary"))
    data = _in_order(datasets(found.cells), F.col("table_id"), ["table_id", "n_rows", "n_cols", "numeric_columns", "truncated"], "datasets")
    out = branches(found, docs, properties, key, text)
    for part in (sums, judged, data, held):
        out = meet(out, part, "key", "left")
    return out


def result_json(records: DataFrame) -> DataFrame:
    """(key, json): each record of :func:`results` or of plans as JSON text."""
    return records.select("key", F.to_json(F.struct(*[c for c in records.columns if c != "key"])).alias("json"))


def _cells(row: list[Column], numeric: set[int] = frozenset()) -> Column:
    cell = lambda i, c: F.concat(F.lit('<td class="num">' if i in numeric else "<td>"), escaped(F.coalesce(c.cast("string"), F.lit("—"))), F.lit("</td>"))
    return F.concat(F.lit("<tr>"), *[cell(i, c) for i, c in enumerate(row)], F.lit("</tr>"))


def _table(title: str, heads: list[str], rows: Column) -> Column:
    top = "".join(f"<th>{h}</th>" for h in heads)
    return F.concat(F.lit(f"<h2>{title}</h2><table><thead><tr>{top}</tr></thead><tbody>"), F.array_join(rows, ""), F.lit("</tbody></table>"))


def html_reports(records: DataFrame, plans: DataFrame, titles: DataFrame) -> DataFrame:
    """(key, html): title, key figures, targets, data sets, checks and the mode's own part of each paper.

    ``records`` of :func:`results`, ``plans`` (key, targets, strategy, warnings), ``titles`` (key, title).
    """
    all_ = meet(meet(records, plans.select("key", "targets", "strategy", F.col("warnings").alias("plan_warnings")), "key", "left"), titles, "key", "left")
    list_of = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind))
    figure = lambda label, c: F.concat(F.lit("<li><b>"), F.coalesce(c.cast("string"), F.lit("0")), F.lit(f"</b> {label}</li>"))
    figures = F.concat(F.lit("<ul>"), figure("passed", F.col("checks.n_pass")), figure("warned", F.col("checks.n_warn")), figure("failed", F.col("checks.n_fail")), F.when(F.col("deltas_summary.n_judged") > 0, figure("pass rate", F.col("deltas_summary.pass_rate"))).otherwise(""), F.lit("</ul>"))
    targets = F.transform(F.slice(list_of("targets", "array<struct<kind:string,id:string,caption:string,role:string>>"), 1, MOST_TARGETS), lambda t: _cells([t["kind"], t["id"], F.left(t["caption"], F.lit(90)), t["role"]]))
    data = F.transform(list_of("datasets", "array<struct<table_id:string,n_rows:bigint,n_cols:bigint,numeric_columns:array<string>,truncated:boolean>>"), lambda d: _cells([d["table_id"], d["n_rows"], d["n_cols"], F.array_join(F.slice(d["numeric_columns"], 1, 6), ", ")], {1, 2}))
    checks = F.transform(F.slice(list_of("deltas", "array<struct<name:string,scope:string,status:string,expected:double,actual:double,rel_delta:double>>"), 1, MOST_CHECKS), lambda d: _cells([d["status"], d["name"], d["scope"], F.format_string("%.4g", d["rel_delta"])], {3}))
    item = lambda s: F.concat(F.lit("<li>"), escaped(s), F.lit("</li>"))
    algorithms = F.transform("algorithms", lambda a: item(F.concat_ws(" · ", a["algorithm_id"], a["caption"], a["intent"], a["status"])))
    own = F.when(F.col("mode") == "pseudocode_only", F.concat(F.lit("<h2>Algorithms</h2><ul>"), F.array_join(algorithms, ""), F.lit("</ul>")))
    own = own.when(F.col("mode") == "no_code", F.concat(F.lit("<h2>Missing</h2><ul>"), F.array_join(F.transform("missing", item), ""), F.lit("</ul>"))).otherwise("")
    notes = F.array_distinct(F.concat("warnings", F.coalesce("plan_warnings", F.array().cast("array<string>"))))
    told = F.when(F.size(notes) > 0, F.concat(F.lit("<h2>Notes</h2><ul>"), F.array_join(F.transform(notes, item), ""), F.lit("</ul>"))).otherwise("")
    name = escaped(F.coalesce("title", F.col("key").cast("string")))
    html = F.concat(F.lit("<!doctype html><html><head><meta charset=\"utf-8\"><title>"), name, F.lit("</title></head><body><h1>"), name, F.lit("</h1><p>"), F.col("mode"), F.lit(": "), escaped(F.coalesce("strategy", F.lit(""))), F.lit("</p>"), figures,
                    _table("Targets", ["kind", "id", "caption", "role"], targets), _table("Data", ["table", "rows", "columns", "numeric"], data), _table("Checks", ["status", "check", "scope", "delta"], checks), own, told, F.lit("</body></html>"))
    return all_.select("key", html.alias("html"))


def paper_list(incoming: DataFrame, outputs: DataFrame, key: str = "paper_id") -> DataFrame:
    """(key, status, created_at, place): papers of both listings, the newest first.

    ``incoming`` (key, modified), ``outputs`` (key, created_at), both times; a paper's time is its latest run's, else its
    folder's; papers without any come last, equal ones by id.
    """
    i = incoming.groupBy(key).agg(F.max("modified").alias("modified"), F.lit(True).alias("i"))
    o = outputs.groupBy(key).agg(F.max("created_at").alias("created"), F.lit(True).alias("o"))
    both = i.join(o, key, "full").withColumn("created_at", F.coalesce("created", "modified"))
    status = F.when(F.col("i") & F.col("o"), "ready").when(F.col("o"), "outputs").otherwise("uploaded")
    ranged = both.orderBy(F.desc_nulls_last("created_at"), key)
    return ranged.select(key, status.alias("status"), "created_at")
