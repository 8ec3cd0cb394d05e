"""Writers: nested records, tables, schemas, subtitles, chart specs, reports and the run index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import to_number
from ..functions.text import escaped
from ..operators.dialogue import scripts, srt_files
from ..operators.papers import latest


def markdown(sections: DataFrame, heads: DataFrame) -> DataFrame:
    """(key, markdown): title, abstract and all other sections; headings at most six deep."""
    part = F.concat(F.repeat(F.lit("#"), F.least(F.lit(6), F.col("level") + 1)), F.lit(" "), F.col("heading"), F.lit("\n\n"), F.col("text"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") != "abstract", F.struct("ord", part.alias("part"))))), lambda x: x["part"]), "\n\n")
    joined = heads.join(sections.groupBy("key").agg(body.alias("body")), "key", "left")
    return joined.select("key", F.concat_ws("\n\n", F.concat(F.lit("# "), F.coalesce("title", F.lit("Untitled"))), "body").alias("markdown"))


def write_tables(tables: DataFrame, path: str) -> None:
    """CSV, a folder a table: cells as JSON-free text lines in row order, with a byte order mark on none."""
    quoted = F.transform("cells", lambda c: F.when(c.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c))
    rows = tables.select("key", "table_id", "row_idx", F.array_join(quoted, ",").alias("value"))
    rows.repartition("key", "table_id").sortWithinPartitions("key", "table_id", "row_idx").select("key", "table_id", "value").write.mode("overwrite").partitionBy("key", "table_id").text(path)


def schemas(cells: DataFrame) -> DataFrame:
    """(key, table_id, schema): column names in order and the number of rows, as JSON."""
    names = F.transform(F.array_sort(F.collect_set(F.struct("col_idx", "col_name"))), lambda x: x["col_name"])
    return cells.groupBy("key", "table_id").agg(F.to_json(F.struct(names.alias("columns"), F.count_distinct("row_idx").alias("n_rows"))).alias("schema"))


def chart_json(specs: DataFrame) -> DataFrame:
    return specs.select("key", "table_id", F.to_json(F.struct("kind", "categories", "series")).alias("spec"))


def table_html(tables: DataFrame, most: int = 14) -> DataFrame:
    """(key, table_id, html): the header and the first rows; numbers right of the first column are marked."""
    cell = F.when(F.col("row_idx") == 0, "th").otherwise("td")
    marked = lambda c, i: F.when((F.col("row_idx") > 0) & (i > 0) & to_number(c).isNotNull(), ' class="num"').otherwise("")
    line = F.concat(F.lit("<tr>"), F.array_join(F.transform("cells", lambda c, i: F.concat(F.lit("<"), cell, marked(c, i), F.lit(">"), escaped(c), F.lit("</"), cell, F.lit(">"))), ""), F.lit("</tr>"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("row_idx", line.alias("line")))), lambda x: x["line"])
    return tables.filter(F.col("row_idx") <= most).groupBy("key", "table_id").agg(F.concat(F.lit("<table>"), F.array_join(rows, ""), F.lit("</table>")).alias("html"))


def report(summary: DataFrame, checks: DataFrame, most: int = 200) -> DataFrame:
    """(key, report): verdict, score and the checks, as Markdown."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "name", "scope", "status", F.format_string("%.4g", "rel_delta")), F.lit(" |"))
    rows = F.slice(F.array_sort(F.collect_list(F.struct("name", "scope", line.alias("line")))), F.lit(1), F.lit(most))
    listed = checks.groupBy("key").agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("rows"))
    head = F.concat(F.lit("# Reproduction report: "), F.col("key").cast("string"), F.lit("\n\nVerdict: "), "verdict", F.lit(", score "), F.col("score").cast("string"))
    return summary.join(listed, "key", "left").select("key", F.concat_ws("\n\n", head, "rows").alias("report"))


def write_dialogues(turns: DataFrame, path: str) -> None:
    srt_files(turns).select("key", "srt").write.mode("overwrite").parquet(f"{path}/srt")
    scripts(turns).write.mode("overwrite").parquet(f"{path}/scripts")


def upsert_index(index: DataFrame, runs: DataFrame, path: str) -> DataFrame:
    """The merged index, written as a new version folder; readers switch by path, so none sees half of it."""
    merged = latest(index, runs)
    merged.write.mode("errorifexists").json(path)
    return merged
