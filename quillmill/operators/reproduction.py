"""How papers are reproduced: whole plans, result files met with reported tables, repositories, new artifacts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.joins import meet
from . import tables as B

# The rules of a plan: what each mode does, in order, and what it can show.
STEPS = {
    "open_source": ["locate the repository", "scan scripts, requirements, data and results", "write a run script with fixed seeds", "run the entry points and collect results", "compare results with the paper's tables cell by cell", "redraw charts"],
    "pseudocode_only": ["extract algorithms with their inputs and outputs", "translate pseudocode to Python", "make small inputs of the stated size", "run in a sandbox", "check properties of the outputs", "state that the logic alone is reproduced"],
    "no_code": ["collect tables and attached data as tidy rows", "check the tables for consistency", "redraw charts", "list what is missing"],
}
STRATEGIES = {
    "open_source": "reuse: the repository's own scripts and data, numbers within the threshold",
    "pseudocode_only": "logic: translated pseudocode holds its properties on small inputs",
    "no_code": "consistency: tables agree with themselves and charts can be redrawn",
}
GUARD = {"max_records": V.MAX_RECORDS, "exec_timeout": 120, "allow_network": False, "random_seed": 42}
SURE = 0.8  # below this confidence a mode is to be confirmed


def rules(spark) -> DataFrame:
    """(mode, strategy, steps): a row a mode."""
    return spark.createDataFrame([(m, STRATEGIES[m], STEPS[m]) for m in STEPS], "mode string, strategy string, steps array<string>")


def plans(decisions: DataFrame, targets: DataFrame, tables: DataFrame, links: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """One nested record a paper: mode, strategy, steps, targets, inputs, scale guard and warnings.

    ``decisions`` (key, mode, confidence), ``targets`` (key, kind, id, caption, role), ``tables`` (key, table_id, ...),
    ``links`` (key, line_no, url, kind), ``hints`` (key, scale). Papers without targets have an empty list.
    """
    order = F.when(F.col("kind") == "table", 0).when(F.col("kind") == "figure", 1).otherwise(2)
    number = F.coalesce(F.regexp_extract("id", r"(\d+)", 1).try_cast("int"), F.lit(0))
    held = F.array_sort(F.collect_list(F.struct(order.alias("o"), number.alias("n"), "kind", "id", "caption", "role")))
    listed = targets.groupBy("key").agg(F.transform(held, lambda x: F.struct(*[x[c].alias(c) for c in ("kind", "id", "caption", "role")])).alias("targets"))
    any_table = tables.select("key").distinct().withColumn("has_tables", F.lit(True))
    first = links.groupBy("key").agg(*[F.min_by(F.when(F.col("kind") == k, F.col("url")), F.when(F.col("kind") == k, F.col("line_no"))).alias(k) for k in ("repo", "dataset")])
    out = decisions.join(F.broadcast(rules(decisions.sparkSession)), "mode")  # three rows
    for part in (listed, any_table, first, *([hints] if hints is not None else [])):
        out = meet(out, part, "key", "left")
    scale = F.coalesce("scale", F.lit(V.DEFAULT_SCALE)) if hints is not None else F.lit(V.DEFAULT_SCALE)
    inputs = F.map_filter(F.create_map(F.lit("repository"), F.col("repo"), F.lit("dataset"), F.col("dataset"), F.lit("scale"), scale.cast("string")), lambda _, v: v.isNotNull())
    bare = F.col("has_tables").isNull()
    warnings = F.filter(
        F.array(
            F.when(F.col("confidence") < SURE, F.concat(F.lit("mode to be confirmed: "), F.format_number(F.col("confidence"), 2))),
            F.when(bare, "no tables: only algorithms and figures can be reproduced"),
            F.when(bare & (F.col("mode") == "no_code"), "neither code nor tables: a plan without results"),
        ),
        lambda w: w.isNotNull(),
    )
    empty = F.array().cast("array<struct<kind:string,id:string,caption:string,role:string>>")
    guard = F.struct(*[F.lit(v).alias(k) for k, v in GUARD.items()])
    return out.select("key", "mode", "confidence", "strategy", "steps", F.coalesce("targets", empty).alias("targets"), inputs.alias("inputs"), guard.alias("scale_guard"), warnings.alias("warnings"))


# ---------------------------------------------------------------- result files


def result_score(path: Column, size: Column) -> Column:
    """How likely a file holds a table of results: CSV 5, a telling name 4, figures -2, size up to 3."""
    name = F.lower(F.regexp_replace(path, r"^.*/", ""))
    telling = reduce(lambda a, b: a | b, [F.contains(name, F.lit(w)) for w in ("table", "main", "result", "eval", "metric")])
    return F.when(F.endswith(name, F.lit(".csv")), 5).otherwise(0) + F.when(telling, 4).otherwise(0) - F.when(F.contains(name, F.lit("fig")), 2).otherwise(0) + F.least(F.lit(3), F.floor(size / 4096))


def ranked_files(files: DataFrame, most: int, *by: str) -> DataFrame:
    """The ``most`` best result files (by, path, bytes) of each group, of equal ones by path."""
    scored = files.withColumn("score", result_score(F.col("path"), F.col("bytes")))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "path"))
    return scored.withColumn("place", place).filter(F.col("place") <= most)


def judged_results(reported: DataFrame, provided: DataFrame, files: DataFrame, results: DataFrame, most: int = 4) -> DataFrame:
    """The ``most`` best result files of each paper against its reported tables; a file and a table that share no
    judged cell leave nothing, else all their cells stay, skipped rows too.

    ``reported`` and ``results`` are cells tables, the latter's table_id the file's path; ``provided`` (key,
    table_id) are attached data, which are inputs and no benchmark; ``files`` (key, path, bytes).
    """
    chosen = ranked_files(files, most, "key").select("key", F.col("path").alias("table_id"), "place")
    told = reported.join(provided, B.TABLE, "left_anti")
    cells = B.compare(told, results.join(chosen.select("key", "table_id"), B.TABLE, "left_semi"))
    pair = Window.partitionBy("key", "table_id", "source")
    judged = F.max(F.col("status").isin("pass", "warn", "fail").cast("int")).over(pair)
    kept = cells.withColumn("judged", judged).filter("judged = 1").drop("judged")
    return kept.join(chosen.withColumnRenamed("table_id", "source"), ["key", "source"])


# ---------------------------------------------------------------- repositories

# Names of entry scripts, dependency files, folders of results; suffixes of data; files that aren't data.
ENTRY_NAMES = ["main.py", "train.py", "run.py", "eval.py", "evaluate.py", "demo.py", "experiment.py", "reproduce.py", "repro.py"]
REQUIREMENT_NAMES = ["requirements.txt", "environment.yml", "environment.yaml", "pyproject.toml", "setup.py", "poetry.lock"]
README_NAMES = ["readme.md", "readme.rst", "readme.txt", "readme"]
RESULT_FOLDERS = ["result", "results", "output", "outputs", "exp", "experiments", "tables", "figures", "logs"]
DATA_SUFFIXES = [".csv", ".tsv", ".json", ".jsonl", ".parquet", ".npz", ".npy", ".txt"]
CAPS = {"data_files": 80, "result_files": 80, "entrypoints": 10}
FALLBACK_SCRIPTS = 6


def manifests(files: DataFrame, lone_script: bool = False) -> DataFrame:
    """(key, n_files, readme, requirements_files, requirements, data_files, result_files, entrypoints, tier, has_dockerfile, notes)
    of every source tree in ``files`` (key, path, content), in one pass over them.

    Entry points are scripts with a telling name; where a tree has none, the first scripts that hold
    ``__main__``; where there is none of these either and ``lone_script`` says so, its only script.
    """
    name = F.lower(F.regexp_replace("path", r"^.*/", ""))
    suffix = F.regexp_extract(name, r"(\.[a-z0-9]+)$", 1)
    meta = name.isin(README_NAMES + REQUIREMENT_NAMES) | name.startswith("license")
    data = suffix.isin(DATA_SUFFIXES) & ~meta
    low = F.lower("path")
    in_results = reduce(lambda a, b: a | b, [F.contains(low, F.lit(h)) for h in RESULT_FOLDERS])
    script = suffix == ".py"
    main = F.contains(F.coalesce("content", F.lit("")), F.lit("__main__"))
    own = lambda when: F.array_sort(F.collect_list(F.when(when, F.col("path"))))
    is_requirements = name == "requirements.txt"
    grouped = files.groupBy("key").agg(
        F.count("*").alias("n_files"),
        F.left(F.min_by("content", F.when(name.isin(README_NAMES), F.col("path"))), F.lit(4000)).alias("readme"),
        own(name.isin(REQUIREMENT_NAMES)).alias("requirements_files"),
        F.array_sort(F.collect_list(F.when(is_requirements, F.struct("path", "content")))).alias("texts"),
        own(data & ~in_results).alias("data_files"),
        own(data & in_results).alias("result_files"),
        own(script & name.isin(ENTRY_NAMES)).alias("named"),
        own(script & main).alias("mains"),
        own(script).alias("scripts"),
        F.max((name == "dockerfile").cast("int")).alias("docker"),
    )
    by_name, by_main = F.size("named") > 0, F.size("mains") > 0
    alone = (F.size("scripts") == 1) if lone_script else F.lit(False)
    entry = F.when(by_name, F.col("named")).when(by_main, F.slice("mains", 1, FALLBACK_SCRIPTS)).when(alone, F.col("scripts")).otherwise(F.array().cast("array<string>"))
    tier = F.when(by_name, "name").when(by_main, "main").when(alone, "lone").otherwise("none")
    wanted = F.filter(F.transform(F.flatten(F.transform("texts", lambda t: F.split(t["content"], r"\r\n|\n|\r"))), lambda s: F.trim(s)), lambda s: (s != "") & ~s.startswith("#"))
    notes = F.array(F.when(F.size("requirements_files") == 0, "no dependency file: the environment can't be fixed"), F.when(F.size(entry) == 0, "no entry point: one has to be named"))
    capped = {"data_files": F.slice("data_files", 1, CAPS["data_files"]), "result_files": F.slice("result_files", 1, CAPS["result_files"]), "entrypoints": F.slice(entry, 1, CAPS["entrypoints"])}
    return grouped.select(
        "key", "n_files", F.coalesce("readme", F.lit("")).alias("readme"), "requirements_files", wanted.alias("requirements"),
        *[c.alias(k) for k, c in capped.items()], tier.alias("tier"), (F.col("docker") == 1).alias("has_dockerfile"), F.filter(notes, lambda n: n.isNotNull()).alias("notes"),
    )


def run_scripts(found: DataFrame, seed: int = 42) -> DataFrame:
    """(key, script): shell text that reruns a tree of :func:`manifests`; it is written, never executed."""
    entry, req = F.coalesce(F.try_element_at("entrypoints", F.lit(1)), F.lit("<entry point>")), F.try_element_at("requirements_files", F.lit(1))
    install = F.when(req.isNotNull(), F.concat(F.lit("pip install -r "), req)).otherwise("# no dependency file")
    seeded = F.regexp_extract("readme", r"(?i)seed\D{0,12}(\d{1,6})", 1).try_cast("int")
    number = F.coalesce(F.when(seeded != 0, seeded), F.lit(seed)).cast("string")
    lines = ["#!/usr/bin/env bash", "set -euo pipefail", "python -m venv .venv && . .venv/bin/activate"]
    return found.select("key", F.concat_ws("\n", *[F.lit(x) for x in lines], install, F.concat(F.lit("export PYTHONHASHSEED="), number), F.concat(F.lit("python "), entry, F.lit("\n"))).alias("script"))


# ---------------------------------------------------------------- snapshots

ARTIFACT_SUFFIXES = [".csv", ".json", ".txt", ".png", ".svg", ".md", ".npz", ".npy", ".parquet"]


def changed_files(before: DataFrame, after: DataFrame, *by: str) -> DataFrame:
    """(by, path, change): new, changed (another size or time) and gone paths between two listings (by, path, bytes, time)."""
    keys = [*by, "path"]
    old = before.select(*keys, F.struct("bytes", "time").alias("old")).dropDuplicates(keys)
    new = after.select(*keys, F.struct("bytes", "time").alias("new")).dropDuplicates(keys)
    change = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "gone").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return old.join(new, keys, "full").select(*keys, change.alias("change")).filter("change is not null")


def new_artifacts(before: DataFrame, after: DataFrame, *by: str) -> DataFrame:
    """(by, path): files of a run's kinds that weren't there before."""
    suffix = F.regexp_extract(F.lower("path"), r"(\.[a-z0-9]+)$", 1)
    fresh = after.join(before.select(*by, "path"), [*by, "path"], "left_anti")
    return fresh.filter(suffix.isin(ARTIFACT_SUFFIXES)).select(*by, "path").distinct()
