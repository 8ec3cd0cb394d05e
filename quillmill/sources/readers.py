"""Readers: papers in Markdown, text and HTML, CSV attachments, bundles, repositories, run indexes.

Folders are listed and read by Spark's own readers, so a path may lie in any store that Spark knows.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import safe_id
from ..functions.vocab import MAX_RECORDS
from ..operators.reproduction import ENTRY_NAMES, README_NAMES, REQUIREMENT_NAMES, RESULT_FOLDERS, manifests
from .html import parse_pages

# Names by which a bundle's parts are found.
PAPER_NAMES = ["paper.md", "paper.markdown", "paper.html", "paper.htm", "paper.pdf", "paper.txt"]
DATA_FOLDERS = ["data", "datasets", "tables"]
CODE_FOLDERS = ["code", "repo", "source"]
CODE_SUFFIXES = [".py", ".ipynb", ".sh", ".r", ".jl", ".cpp", ".cc", ".java", ".js", ".ts", ".yaml", ".yml", ".toml"]


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, content) of every file under ``path``; content is read only where it is used."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return found.select("path", F.col("length").alias("bytes"), "modificationTime", "content")


def utf8(content: Column) -> Column:
    """Text of bytes: UTF-8 without its mark; bytes that aren't valid are dropped."""
    return F.regexp_replace(F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit("")), "^﻿", "")


def utf8_or_gbk(content: Column) -> Column:
    return F.when(F.is_valid_utf8(content.cast("string")), utf8(content)).otherwise(F.decode(content, "GBK"))


def papers(spark: SparkSession, path: str) -> DataFrame:
    """(paper_id, kind, text, warning) of every paper file; PDF needs an optional library and only warns here."""
    found = files(spark, path)
    low = F.lower("path")
    kind = F.when(low.rlike(r"\.html?$"), "html").when(low.rlike(r"\.pdf$"), "pdf").otherwise("md")
    rows = found.withColumns({"kind": kind, "paper_id": safe_id(F.regexp_replace("path", "%20", " "))})
    text = F.when(F.col("kind") != "pdf", utf8(F.col("content")))
    return rows.select("paper_id", "path", "kind", text.alias("text"), F.when(F.col("kind") == "pdf", "PDF backend not available").alias("warning"))


def html_papers(rows: DataFrame) -> DataFrame:
    """HTML rows of :func:`papers` as lines of text, with a number as key."""
    return parse_pages(rows.filter("kind = 'html'").withColumn("page_id", F.xxhash64("paper_id")), "page_id", "text")


# A cell, quoted by RFC 4180 or bare, and what ends it; possessive, so each character is looked at once.
_CELL = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^,\r\n]*+)(?:,|\r?\n|\r|\z)'


def csv_cells(text: Column) -> Column:
    """All cells of a CSV text in order, each with what ends it."""
    ended = F.when(text.rlike(r"[\r\n]\z"), text).otherwise(F.concat(text, F.lit("\n")))
    return F.regexp_extract_all(ended, F.lit(_CELL), F.lit(0))


def csv_records(rows: DataFrame, *by: str) -> DataFrame:
    """(by, n, cells): the records of ``rows`` (by, text), numbered from 0; blank ones are left out.

    A record's number is the count of line ends outside quotes before it, a running sum over the cells.
    """
    place = Window.partitionBy(*by).orderBy("pos")
    each = rows.select(*by, F.posexplode(csv_cells(F.col("text"))).alias("pos", "token"))
    ends = F.coalesce(F.sum(F.col("token").rlike(r"[\r\n]\z").cast("int")).over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bare = F.trim(F.regexp_replace("token", r"(?:,|\r?\n|\r)\z", ""))
    quoted = bare.rlike(r'(?s)^".*"$') & (F.length(bare) > 1)
    cell = F.when(quoted, F.replace(F.substring(bare, F.lit(2), F.length(bare) - 2), F.lit('""'), F.lit('"'))).otherwise(bare)
    held = F.transform(F.array_sort(F.collect_list(F.struct("pos", "cell"))), lambda x: x["cell"])
    got = each.withColumns({"n": ends, "cell": cell}).groupBy(*by, "n").agg(held.alias("cells"))
    return got.filter(F.exists("cells", lambda c: c != ""))


def csv_tables(spark: SparkSession, path: str) -> DataFrame:
    """(key, table_id, caption, row_idx, cells): all CSV files below ``path``; all cells are strings.

    Quoted cells follow RFC 4180; blank rows are dropped; the first row is the header. Tables are P1.. by path.
    """
    rows = files(spark, path, "*.csv").withColumn("text", utf8_or_gbk(F.col("content")))
    number = F.row_number().over(Window.partitionBy("key").orderBy("path"))
    keyed = rows.withColumn("key", F.regexp_extract("path", r"([^/]+)/(?:data|datasets|tables)/[^/]*$", 1)).withColumn("table_id", F.concat(F.lit("P"), number))
    named = keyed.select("key", "table_id", F.regexp_replace("path", r"^.*/", "").alias("caption"), "text")
    order = Window.partitionBy("key", "table_id").orderBy("n")
    return csv_records(named, "key", "table_id", "caption").select("key", "table_id", "caption", (F.row_number().over(order) - 1).alias("row_idx"), "cells")


def dispatched(sources: DataFrame, found: DataFrame, column: str = "source") -> DataFrame:
    """Adds route, paper_id and error to ``sources``, each a path, an address or an identifier, by ``found`` (path, is_dir).

    Identifiers and addresses are routed but not fetched; a folder is a bundle; files go by suffix, unknown ones as text; a
    path that isn't there gives an error and no route.
    """
    s = F.trim(column)
    low = F.lower(s)
    arxiv = arxiv_id(s).isNotNull() & (F.contains(low, F.lit("arxiv.org")) | s.rlike(r"^\d{4}\.\d{4,5}(v\d+)?$"))
    web = low.rlike("^https?://")
    kind = F.when(low.rlike(r"\.pdf$"), "pdf").when(low.rlike(r"\.html?$"), "html").otherwise("text")
    held = sources.join(found.select(F.col("path").alias("_path"), "is_dir").distinct(), s == F.col("_path"), "left")
    local = F.when(F.col("is_dir"), "bundle").when(F.col("_path").isNotNull(), kind)
    route = F.when(arxiv, "arxiv").when(web, "url").otherwise(local)
    paper_id = F.when(arxiv, arxiv_id(s)).otherwise(safe_id(s))
    error = F.when(route.isNull(), F.concat(F.lit("not found: "), F.coalesce(s, F.lit(""))))
    return held.select(*sources.columns, route.alias("route"), F.when(route.isNotNull(), paper_id).alias("paper_id"), error.alias("error"))


def result_rows(spark: SparkSession, path: str, limit: int = 5000) -> DataFrame:
    """A results CSV by its header; stops after ``limit`` + 1 rows."""
    return spark.read.csv(path, header=True, inferSchema=False).limit(limit + 1)


def bundles(spark: SparkSession, path: str) -> DataFrame:
    """One row a bundle folder: its paper file by priority, data files in order, code folder."""
    found = files(spark, path).drop("content")
    rel = found.withColumn("rel", F.regexp_replace("path", "^.*?" + path.rstrip("/").rsplit("/", 1)[-1] + "/", ""))
    rel = rel.withColumns({"key": F.substring_index("rel", "/", 1), "inner": F.regexp_replace("rel", "^[^/]*/", "")})
    rank = functools.reduce(lambda e, kv: e.when(F.lower("inner") == kv[1], kv[0]), enumerate(PAPER_NAMES), F.when(F.lit(False), -1))
    top = F.lower(F.substring_index("inner", "/", 1))
    code = functools.reduce(lambda e, kv: e.when(top == kv[1], F.struct(F.lit(kv[0]).alias("i"), F.lit(kv[1]).alias("name"))), enumerate(CODE_FOLDERS), F.when(F.lit(False), F.struct(F.lit(-1).alias("i"), F.lit("").alias("name"))))
    data = F.when(top.isin(DATA_FOLDERS) & F.lower("inner").rlike(r"\.csv$"), F.col("path"))
    rows = rel.withColumns({"rank": rank, "code": code, "data": data})
    return rows.groupBy("key").agg(F.min_by("path", F.coalesce("rank", F.lit(99))).alias("first"), F.min("rank").alias("rank"), F.array_sort(F.collect_list("data")).alias("data_files"), F.min("code").alias("code")).select(
        "key", F.when(F.col("rank").isNotNull(), F.col("first")).alias("paper_path"), "data_files", F.col("code.name").alias("code_folder"), F.col("code").isNotNull().alias("has_code")
    )


def repository(spark: SparkSession, path: str) -> DataFrame:
    """(path, role, bytes): readme, requirements, data, results, entry points and code of a source tree."""
    found = files(spark, path).drop("content")
    name, low = F.lower(F.regexp_replace("path", r"^.*/", "")), F.lower("path")
    in_results = functools.reduce(lambda a, b: a | b, [F.contains(low, F.lit(f"/{h}/")) for h in RESULT_FOLDERS])
    suffix = F.regexp_extract(name, r"(\.[a-z0-9]+)$", 1)
    role = (
        F.when(name.isin(README_NAMES), "readme")
        .when(name.isin(REQUIREMENT_NAMES), "requirements")
        .when(name.isin(ENTRY_NAMES), "entrypoint")
        .when(in_results & suffix.isin(".csv", ".json", ".tsv", ".txt", ".png", ".svg"), "result")
        .when(suffix.isin(".csv", ".tsv", ".json", ".jsonl", ".parquet", ".npz", ".npy"), "data")
        .when(suffix.isin(CODE_SUFFIXES), "code")
        .otherwise("other")
    )
    return found.select("path", role.alias("role"), "bytes")


def repositories(spark: SparkSession, path: str) -> DataFrame:
    """A manifest for each folder right below ``path``; contents are read only of scripts, readmes and requirements."""
    found = files(spark, path)
    rel = F.regexp_replace("path", "^.*?" + path.rstrip("/").rsplit("/", 1)[-1] + "/", "")
    name = F.lower(F.regexp_replace("path", r"^.*/", ""))
    told = F.endswith(name, F.lit(".py")) | name.isin(README_NAMES + REQUIREMENT_NAMES)
    rows = found.select(F.substring_index(rel, "/", 1).alias("key"), F.regexp_replace(rel, "^[^/]*/", "").alias("path"), F.when(told, utf8(F.col("content"))).alias("content"))
    return manifests(rows)


def code_files(found: DataFrame, most: int = 500) -> DataFrame:
    suffix = F.regexp_extract(F.lower("path"), r"(\.[a-z0-9]+)$", 1)
    return found.agg(F.least(F.count_if(suffix.isin(CODE_SUFFIXES)), F.lit(most)).alias("n"))


def run_index(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The run index; a missing or broken one is empty."""
    try:
        return spark.read.schema(schema).option("multiLine", "true").option("mode", "DROPMALFORMED").json(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def arxiv_id(source: Column) -> Column:
    """The identifier in an id, ``arXiv:`` name or URL; null without one."""
    got = F.regexp_extract(F.trim(source), r"(?i)(?:^|arxiv:|arxiv\.org/(?:abs|pdf|html)/)\s*(\d{4}\.\d{4,5}(?:v\d+)?|[a-z\-]+(?:\.[A-Z]{2})?/\d{7})(?:\.pdf)?$", 1)
    return F.when(got != "", got)


def readme_seed(text: Column) -> Column:
    got = F.regexp_extract(text, r"(?i)seed\D{0,12}(\d{1,6})", 1).try_cast("int")
    return F.when(got != 0, got)


def synthetic(spark: SparkSession, n: int, kind: str = "vec", seed: int = 0, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(i, value): n seeded values, at most MAX_RECORDS: floats, whole numbers, rows of 5 floats or words of 6 letters."""
    rows = spark.range(max(1, min(n, MAX_RECORDS))).withColumnRenamed("id", "i")
    draw = lambda j=0: F.lit(low) + F.rand(seed + j) * (high - low)
    if kind == "int_vec":
        return rows.withColumn("value", F.floor(F.lit(low) + F.rand(seed) * (high - low + 1)))
    if kind == "matrix":
        return rows.withColumn("value", F.array(*[draw(j) for j in range(5)]))
    if kind == "str_list":
        return rows.withColumn("value", F.concat(*[F.char((F.rand(seed + j) * 26 + 97).cast("int")) for j in range(6)]))
    return rows.withColumn("value", draw())
