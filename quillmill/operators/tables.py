"""Checks, comparison and charts over the long cells table (key, table_id, row_idx, col_idx, col_name, raw, num).

One long table of cells makes every check a group-by on (key, table_id, col_name), whatever the
headers of the tables are, and ``num`` is parsed once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from ..functions.joins import meet
from ..functions.numbers import classify, judge, rel_delta, upper_median_of

TABLE = ["key", "table_id"]
COLUMN = [*TABLE, "col_idx", "col_name"]
CHECK = ["key", "table_id", "name", "scope", "status", "expected", "actual", "rel_delta"]


def _check(rows: DataFrame, name: str, scope=None) -> DataFrame:
    scope = F.concat_ws(".", "table_id", "col_name") if scope is None else scope
    have = rows.columns
    null = lambda c: F.col(c).cast("double").alias(c) if c in have else F.lit(None).cast("double").alias(c)
    return rows.select("key", "table_id", F.lit(name).alias("name"), scope.alias("scope"), "status", null("expected"), null("actual"), null("rel_delta"))


def numeric_columns(cells: DataFrame) -> DataFrame:
    """Columns at least half of whose cells, and two, hold numbers."""
    least = F.greatest(F.lit(2), F.floor(0.5 * F.col("n")))
    return cells.groupBy(*COLUMN).agg(F.count("*").alias("n"), F.count("num").alias("n_num")).filter(F.col("n_num") >= least)


def column_numbers(cells: DataFrame) -> DataFrame:
    """Each column's numbers in row order; columns without any are left out."""
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("num").isNotNull(), F.struct("row_idx", "num")))), lambda x: x["num"])
    return cells.groupBy(*COLUMN).agg(listed.alias("numbers")).filter(F.size("numbers") > 0)


def summaries(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*COLUMN).agg(F.count("num").alias("n"), F.min("num").alias("min"), F.max("num").alias("max"), F.avg("num").alias("mean"))


def share_sums(cells: DataFrame) -> DataFrame:
    """Columns whose header speaks of shares sum to 1."""
    sums = cells.filter(F.col("col_name").rlike(V.SHARE_COLUMN)).groupBy(*COLUMN).agg(F.sum("num").alias("actual"), F.count("num").alias("n"), (F.max("num") - F.min("num")).alias("spread"))
    found = sums.filter("n >= 2 and spread >= 1e-9").withColumns({"expected": F.lit(1.0), "rel_delta": F.abs(F.col("actual") - 1.0)})
    return _check(found.withColumn("status", judge(F.col("rel_delta"))), "share_sum")


def total_rows(cells: DataFrame) -> DataFrame:
    """A row labelled as total or average meets the sum or the mean of the others, whichever is nearer."""
    column = Window.partitionBy("key", "table_id", "col_name")
    shape = cells.groupBy(*TABLE).agg(F.count_distinct("row_idx").alias("n_rows"), F.count_distinct("col_name").alias("n_cols")).filter("n_rows >= 3 and n_cols >= 3")
    labels = cells.filter("col_idx = 0").filter(F.col("raw").rlike(V.TOTAL_ROW)).select(*TABLE, "row_idx")
    wide = cells.filter("col_idx > 0").withColumns({"sum": F.sum("num").over(column) - F.col("num"), "others": F.count("num").over(column) - 1})
    found = meet(meet(wide.filter("num is not null and others >= 2"), labels, [*TABLE, "row_idx"], "left_semi"), shape, TABLE, "left_semi")
    scale = F.greatest(F.abs("num"), F.lit(1e-9))
    found = found.withColumn("mean", F.col("sum") / F.col("others"))
    found = found.withColumns({"by_sum": F.abs(F.col("num") - F.col("sum")) / scale, "by_mean": F.abs(F.col("num") - F.col("mean")) / scale})
    near = F.col("by_sum") <= F.col("by_mean")
    found = found.withColumns({"expected": F.when(near, F.col("sum")).otherwise(F.col("mean")), "actual": F.col("num"), "rel_delta": F.least("by_sum", "by_mean")})
    return _check(found.withColumn("status", judge(F.col("rel_delta"))), "total_row")


def best_row(cells: DataFrame) -> DataFrame:
    """The first row labelled as the authors' own: pass where it is the maximum, fail where the minimum."""
    ours = cells.filter("col_idx = 0").filter(F.col("raw").rlike(V.OURS_ROW)).groupBy(*TABLE).agg(F.min("row_idx").alias("ours"))
    rest = meet(cells.filter("col_idx > 0"), ours, TABLE)
    ends = rest.groupBy("key", "table_id", "col_idx", "col_name").agg(F.max("num").alias("top"), F.min("num").alias("low"), F.count("num").alias("n"), F.max(F.when(F.col("row_idx") == F.col("ours"), F.col("num"))).alias("actual"))
    found = ends.filter((F.col("n") >= 2) & F.col("actual").isNotNull() & (F.col("top") - F.col("low") >= 1e-12))
    status = F.when(F.col("top") - F.col("actual") < 1e-9, "pass").when(F.col("actual") - F.col("low") < 1e-9, "fail").otherwise("warn")
    return _check(found.withColumns({"status": status, "expected": F.col("top"), "rel_delta": rel_delta(F.col("top"), F.col("actual"))}), "best_row")


def rank_columns(cells: DataFrame) -> DataFrame:
    """The first rank column with two numbers is a permutation of 1..n."""
    named = cells.filter(F.contains(F.lower("col_name"), F.lit("rank")) | F.contains("col_name", F.lit("排名")))
    sums = named.groupBy(*COLUMN).agg(F.count("num").alias("n"), F.min("num").alias("lo"), F.max("num").alias("hi"), F.count_distinct("num").alias("kinds"), F.max(F.abs(F.col("num") - F.round("num"))).alias("part")).filter("n >= 2")
    first = sums.withColumn("r", F.row_number().over(Window.partitionBy(*TABLE).orderBy("col_idx"))).filter("r = 1")
    ok = (F.col("lo") == 1) & (F.col("hi") == F.col("n")) & (F.col("kinds") == F.col("n")) & (F.col("part") == 0)
    return _check(first.withColumn("status", F.when(ok, "pass").otherwise("warn")), "rank_column")


def non_negative_counts(cells: DataFrame) -> DataFrame:
    found = cells.filter(F.col("col_name").rlike(V.COUNT_COLUMN)).groupBy(*COLUMN).agg(F.count("num").alias("n"), F.min("num").alias("lo")).filter("n > 0")
    return _check(found.withColumn("status", F.when(F.col("lo") < 0, "fail").otherwise("pass")), "non_negative")


def table_checks(cells: DataFrame) -> DataFrame:
    out = share_sums(cells)
    for check in (total_rows, best_row, rank_columns, non_negative_counts):
        out = out.unionByName(check(cells))
    return out


def check_summary(checks: DataFrame, *by: str) -> DataFrame:
    """Counts by status, score (pass + warn / 2) / judged and verdict, for each ``by``."""
    n = lambda s: F.count_if(F.col("status") == s)
    sums = checks.groupBy(*by).agg(F.count("*").alias("total"), *[n(s).alias(f"n_{s}") for s in ("pass", "warn", "fail", "skipped")])
    judged = F.col("n_pass") + F.col("n_warn") + F.col("n_fail")
    score = F.coalesce(F.try_divide(F.col("n_pass") + 0.5 * F.col("n_warn"), judged.cast("double")), F.lit(0.0))
    verdict = F.when(judged == 0, "not_verifiable").when(F.col("n_fail") > 0, "issues_found").otherwise("consistent")
    return sums.select(*by, "total", "n_pass", "n_warn", "n_fail", "n_skipped", F.round(score, 4).alias("score"), verdict.alias("verdict"))


def delta_summary(checks: DataFrame, *by: str) -> DataFrame:
    """Judged checks' pass rate, upper median and largest relative delta; deltas count to five digits."""
    judged = checks.filter(F.col("status").isin("pass", "warn", "fail")).withColumn("d", F.round("rel_delta", 5))
    n = lambda s: F.count_if(F.col("status") == s)
    return judged.groupBy(*by).agg(
        F.count("*").alias("n_judged"),
        *[n(s).alias(f"n_{s}") for s in ("pass", "warn", "fail")],
        F.round(n("pass") / F.count("*"), 4).alias("pass_rate"),
        F.round(upper_median_of("d"), 6).alias("median_rel_delta"),
        F.round(F.max("d"), 6).alias("max_rel_delta"),
    )


def compare(reported: DataFrame, reproduced: DataFrame, max_cells: int = V.MAX_CELLS) -> DataFrame:
    """Each reported cell against the reproduced one: (key, table_id, row_idx, col_idx, row_key, col_name, status, ...).

    Both are cells tables; ``reproduced`` has the same ``key``. Rows match by the normalised first
    column: exactly (of equal keys the last one's values), else the first one that contains or is
    contained. Exact hits go first through a hash join; only what is left meets the loose condition, within
    its ``key``. Columns match the same loose way. Rows without a match are ``skipped``; after
    ``max_cells`` judged cells of a table no further row starts.
    """
    paper_rows = reported.filter("col_idx = 0").select(*TABLE, "row_idx", F.col("raw").alias("row_key"), T.match_key(F.col("raw")).alias("m"))
    repro_rows = reproduced.filter("col_idx = 0 and raw <> ''").select("key", F.col("table_id").alias("source"), F.col("row_idx").alias("pos"), T.match_key(F.col("raw")).alias("m"))
    entry = repro_rows.groupBy("key", "source", "m").agg(F.min("pos").alias("pos"), F.max("pos").alias("last"))
    exact = paper_rows.join(entry, ["key", "m"]).select(*TABLE, "row_idx", "source", "last")
    sources = repro_rows.select("key", "source").distinct()
    open_ = paper_rows.join(sources, "key").join(exact.select(*TABLE, "row_idx", "source"), [*TABLE, "row_idx", "source"], "left_anti")
    e = entry.withColumnRenamed("m", "em")
    loose = open_.join(e, ["key", "source"]).filter(T.loosely_equal(F.col("m"), F.col("em"))).groupBy(*TABLE, "row_idx", "source").agg(F.min_by("last", "pos").alias("last"))
    rows = paper_rows.join(sources, "key").select(*TABLE, "row_idx", "row_key", "source").join(exact.union(loose), [*TABLE, "row_idx", "source"], "left")
    names = reported.filter("col_idx > 0").select(*TABLE, "col_idx", "col_name", T.match_key(F.col("col_name")).alias("cm")).distinct()
    targets = reproduced.select("key", F.col("table_id").alias("source"), F.col("col_idx").alias("to"), T.match_key(F.col("col_name")).alias("tm")).distinct()
    columns = names.join(targets, "key").filter(T.loosely_equal(F.col("cm"), F.col("tm"))).groupBy(*TABLE, "col_idx", "source").agg(F.min("to").alias("to"))
    values = reproduced.select("key", F.col("table_id").alias("source"), F.col("row_idx").alias("last"), F.col("col_idx").alias("to"), F.col("num").alias("actual"))
    left = reported.filter("col_idx > 0 and num is not null").select(*TABLE, "row_idx", "col_idx", "col_name", F.col("num").alias("expected"))
    met = left.join(rows.filter("last is not null"), [*TABLE, "row_idx"]).join(columns, [*TABLE, "col_idx", "source"]).join(values.filter("actual is not null"), ["key", "source", "last", "to"])
    by_row = met.groupBy(*TABLE, "source", "row_idx").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*TABLE, "source").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, -1)
    kept = by_row.withColumn("done", F.coalesce(F.sum("n").over(before), F.lit(0))).filter(F.col("done") < max_cells).select(*TABLE, "source", "row_idx")
    met = met.join(kept, [*TABLE, "source", "row_idx"], "left_semi")
    e_, a_ = F.col("expected"), F.col("actual")
    cells = met.select(*TABLE, "source", "row_idx", "col_idx", "row_key", "col_name", classify(e_, a_).alias("status"), "expected", "actual", rel_delta(e_, a_).alias("rel_delta"))
    missed = rows.filter("last is null").select(*TABLE, "source", "row_idx", F.lit(0).alias("col_idx"), "row_key", F.lit("").alias("col_name"), F.lit("skipped").alias("status"), *[F.lit(None).cast("double").alias(c) for c in ("expected", "actual", "rel_delta")])
    return cells.unionByName(missed)


def zip_series(rows: DataFrame, order: str, side: str, value: str, key: str = "key") -> DataFrame:
    """(key, pos, status, rel_delta, ...): of rows (key, ``order``, ``side``, ``value``) those where ``side`` is
    "reported" meet the ones where it is "reproduced" place by place; the shorter series ends it."""
    place = Window.partitionBy(key, side).orderBy(order)
    placed = rows.select(key, side, F.col(value).alias("value"), (F.row_number().over(place) - 1).alias("pos"))
    one = lambda name, of: placed.filter(F.col(side) == of).select(key, "pos", F.col("value").alias(name))
    each = one("expected", "reported").join(one("actual", "reproduced"), [key, "pos"])
    return each.withColumns({"status": classify(F.col("expected"), F.col("actual")), "rel_delta": rel_delta(F.col("expected"), F.col("actual"))})


# Headers that name the category column.
CATEGORY_WORDS = ["method", "model", "approach", "name", "方法", "模型", "system", "dataset", "variant", "type"]


def short(text, most: int = 18):
    t = F.trim(text)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.left(t, F.lit(most - 1)), F.lit("…")))


def comparable_series(series: DataFrame, by: list[str], factor: float = 100.0) -> DataFrame:
    """Of rows (by, scale): those within ``factor`` of the group's upper median scale; all if that is 0 or none is."""
    median = series.groupBy(*by).agg(upper_median_of("scale").alias("median"), F.count("*").alias("n_series"))
    joined = meet(series, median, by)
    near = (F.col("n_series") == 1) | (F.col("median") <= 0) | F.col("scale").between(F.col("median") / factor, F.col("median") * factor)
    some = F.max(near.cast("int")).over(Window.partitionBy(*by))
    return joined.withColumns({"near": near, "some": some}).filter("near or some = 0").drop("near", "some", "median", "n_series")


def chart_specs(cells: DataFrame, max_series: int = 4, max_categories: int = 12) -> DataFrame:
    """(key, table_id, kind, categories, series): up to four comparable numeric columns over the category column."""
    hinted = T.contains_any(F.lower("col_name"), CATEGORY_WORDS)
    axis = cells.groupBy(*TABLE).agg(F.coalesce(F.min(F.when(hinted, F.col("col_idx"))), F.lit(0)).alias("axis"))
    size = cells.groupBy(*TABLE).agg(F.count_distinct("row_idx").alias("n_rows"))
    wide = meet(meet(cells, axis, TABLE), size, TABLE)
    good = wide.filter("col_idx <> axis").groupBy(*COLUMN, "n_rows").agg(F.count("num").alias("n")).filter(F.col("n") >= F.greatest(F.lit(2), F.floor(0.6 * F.col("n_rows"))))
    good = good.withColumn("r", F.row_number().over(Window.partitionBy(*TABLE).orderBy("col_idx"))).filter(F.col("r") <= max_series)
    shown = wide.filter(F.col("row_idx") < max_categories)
    values = F.transform(F.array_sort(F.collect_list(F.struct("row_idx", F.coalesce("num", F.lit(0.0)).alias("v")))), lambda x: x["v"])
    series = meet(shown, good.select(*TABLE, "col_idx"), [*TABLE, "col_idx"], "left_semi").groupBy(*COLUMN).agg(values.alias("values"), F.count("num").alias("n"), F.coalesce(F.max(F.abs("num")), F.lit(0.0)).alias("scale"), F.min(F.when(F.col("num") != 0, F.abs("num"))).alias("least")).filter("n > 0")
    kept = comparable_series(series, TABLE)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("col_idx", short(F.col("col_name")).alias("name"), "values"))), lambda x: F.struct(x["name"].alias("name"), x["values"].alias("values")))
    charts = kept.groupBy(*TABLE).agg(listed.alias("series"), F.max("scale").alias("top"), F.min("least").alias("least")).filter("least is null or top / least <= 1e4")
    label = F.when(F.trim("raw") == "", F.concat(F.lit("row"), F.col("row_idx") + 1)).otherwise(F.col("raw"))
    categories = F.transform(F.array_sort(F.collect_list(F.struct("row_idx", short(label).alias("c")))), lambda x: x["c"])
    cats = shown.filter("col_idx = axis").groupBy(*TABLE).agg(categories.alias("categories"))
    kind = F.when((F.size("categories") >= 7) & (F.size("series") == 1), "line").when(F.size("series") > 1, "grouped_bar").otherwise("bar")
    return meet(charts, cats, TABLE).select(*TABLE, kind.alias("kind"), "categories", "series")


def seeded_sample(rows: DataFrame, key: str, most: int = V.MAX_RECORDS, seed: int = 42) -> DataFrame:
    """At most ``most`` rows, chosen by a hash of ``key`` and ``seed``: the same ones each time."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(most)
