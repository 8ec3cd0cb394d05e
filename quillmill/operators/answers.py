"""What a report says of tables and sections, and what a translated algorithm takes, is called and prints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.joins import meet

# Input kinds by contained words, the first rule with one decides; names that are helpers.
INPUT_KINDS = [
    ("matrix", ["matrix", "矩阵", "2-d", "two-dimensional"]),
    ("str_list", ["string", "字符串", "token", "word", "text"]),
    ("int_vec", ["integer", "int ", "整数", "count", "index", "排序", "sort"]),
]
HELPERS = [
    "push", "pop", "size", "length", "is_empty", "sort_ascending", "sort_descending",
    "sort", "empty_min_heap", "empty_max_heap", "swap", "abs_val", "max_val", "min_val",
    "heappush", "heappop", "heapify",
]


def four_digits(x: Column) -> Column:
    """Four significant digits without trailing zeros; an exponent below 0.0001 and from 10,000 on.

    The binary value is rounded, of exact halves to the even digit, as C does; %e rounds its shortest decimal form up.
    """
    # The formatter takes exact halves of whole numbers for inexact ones, so these are rounded by division.
    m = F.when((F.abs(x) >= 1e4) & (F.abs(x) < 1e15) & (x == F.floor(x)), F.abs(x).cast("long"))
    unit = F.pow(F.lit(10.0), F.length(m.cast("string")) - 4).cast("long")
    rest = m % unit
    q = (m - rest) / unit
    near = (q + F.when((2 * rest > unit) | ((2 * rest == unit) & (q % 2 == 1)), 1).otherwise(0)) * unit
    bare_e = F.call_function("format_number", F.coalesce(near.cast("double") * F.sign(x), x), F.lit("0.000E0"))
    power = F.substring_index(bare_e, "E", -1).cast("int")
    sign = F.when(power < 0, "e-").otherwise("e+")
    e = F.concat(F.substring_index(bare_e, "E", 1), sign, F.format_string("%02d", F.abs(power)))
    bare = lambda s: F.when(F.contains(s, F.lit(".")), F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)
    fixed = bare(e.cast("decimal(20,8)").cast("string"))
    return F.when(x.isNull() | F.isnan(x), F.lit(None)).when(x == 0, "0").when(power.between(-4, 3), fixed).otherwise(F.concat(bare(F.substring_index(e, "e", 1)), F.lit("e"), F.substring_index(e, "e", -1)))


def explain_tables(cells: DataFrame) -> DataFrame:
    """(key, table_id, explanation): size and the best value of the first three columns with numbers.

    The best value's place counts a column's numbers only. Columns of one name are one: it stands where the
    first does and holds the last one's numbers. A table without numbers is called descriptive.
    """
    table = ["key", "table_id"]
    shape = cells.groupBy(*table).agg(F.count_distinct("row_idx").alias("n_rows"), F.count_distinct("col_idx").alias("n_cols"))
    name = F.when(F.coalesce("col_name", F.lit("")) == "", F.concat(F.lit("col"), F.col("col_idx").cast("string"))).otherwise(F.col("col_name"))
    numbers = cells.filter("col_idx > 0 and num is not null").withColumn("name", name)
    counted = numbers.withColumn("at", F.row_number().over(Window.partitionBy(*table, "col_idx").orderBy("row_idx")))
    columns = counted.groupBy(*table, "col_idx", "name").agg(F.max_by(F.struct("num", "at"), F.struct("num", -F.col("at"))).alias("best"))
    named = columns.groupBy(*table, "name").agg(F.min("col_idx").alias("col_idx"), F.max_by("best", "col_idx").alias("best"))
    first = named.withColumn("r", F.row_number().over(Window.partitionBy(*table).orderBy("col_idx"))).filter("r <= 3")
    part = F.concat("name", F.lit(" 最优 "), four_digits(F.col("best.num")), F.lit("（第 "), F.col("best.at").cast("string"), F.lit(" 行）"))
    parts = first.groupBy(*table).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", part.alias("part")))), lambda x: x["part"]).alias("parts"))
    head = F.concat(F.lit("表 "), "table_id", F.lit("："), F.col("n_rows").cast("string"), F.lit(" 行"))
    full = F.concat(head, F.lit(" × "), F.col("n_cols").cast("string"), F.lit(" 列；"), F.array_join("parts", "；"), F.lit("。"))
    said = F.when(F.col("parts").isNull(), F.concat(head, F.lit("，以描述性内容为主。"))).otherwise(full)
    return meet(shape, parts, table, "left").select(*table, said.alias("explanation"))


def text_of_kinds(sections: DataFrame, *kinds: str) -> DataFrame:
    """(key, text): each paper's sections of ``kinds`` in order, a blank line between; empty without any."""
    wanted = F.when(F.col("kind").isin(*kinds), F.struct("ord", F.coalesce("text", F.lit("")).alias("text")))
    listed = sections.groupBy("key").agg(F.array_sort(F.collect_list(wanted)).alias("found"))
    return listed.select("key", F.array_join(F.transform("found", lambda x: x["text"]), "\n\n").alias("text"))


def input_kind(caption: Column, source: Column) -> Column:
    """Of an algorithm: matrix, str_list, int_vec or, without a known word, vec."""
    low = F.lower(F.concat(F.coalesce(caption, F.lit("")), F.lit("\n"), F.coalesce(source, F.lit(""))))
    rules = [F.when(T.contains_any(low, words), F.lit(kind)) for kind, words in INPUT_KINDS]
    return F.coalesce(*rules, F.lit("vec"))


def function_name(code: Column) -> Column:
    """The first function defined that is no helper, else ``run``."""
    defined = F.regexp_extract_all(F.coalesce(code, F.lit("")), F.lit(r"(?mdU)^\s*def\s+([A-Za-z_]\w*)\s*\("), F.lit(1))
    return F.coalesce(F.get(F.filter(defined, lambda d: ~d.isin(*HELPERS)), F.lit(0)), F.lit("run"))


def printed_result(stdout: Column, marker: str) -> Column:
    """The JSON text of the last line that begins with ``marker``; null without one or if it is no JSON."""
    marked = F.filter(F.split(F.coalesce(stdout, F.lit("")), r"\r\n|\n|\r"), lambda s: F.startswith(s, F.lit(marker)))
    said = F.substr(F.try_element_at(marked, F.lit(-1)), F.lit(len(marker) + 1))
    return F.when(F.get_json_object(said, "$").isNotNull(), said)


def allocated_ids(incoming: DataFrame, existing: DataFrame, order: str) -> DataFrame:
    """``incoming`` (name and others) with ``paper_id``: the name's safe id, with _2, _3 on if that is taken.

    Rows that share a safe id get the free numbers in ``order``, which must tell rows apart. Every id of ``existing``
    (paper_id) is taken, as is every incoming safe id for rows of another one, so ids never meet. Only windows
    within one safe id: the k-th new row takes the number k plus the taken numbers of fewer than k free ones before them.
    """
    new = incoming.withColumn("__base", T.safe_id(F.col("name")))
    bases = new.select("__base").distinct()
    suffixed = lambda ids: ids.select(F.regexp_extract("id", r"(?s)^(.*)_([1-9][0-9]{0,8})$", 1).alias("__base"), F.regexp_extract("id", r"(?s)^(.*)_([1-9][0-9]{0,8})$", 2).try_cast("int").alias("__n")).filter("__n >= 2")
    old = existing.select(F.col("paper_id").alias("id"))
    taken = old.select(F.col("id").alias("__base"), F.lit(1).alias("__n")).union(suffixed(old)).union(suffixed(bases.select(F.col("__base").alias("id"))))
    taken = taken.distinct().join(bases, "__base", "left_semi")
    number = Window.partitionBy("__base")
    gaps = taken.select("__base", (F.col("__n") - F.row_number().over(number.orderBy("__n"))).alias("__at"), F.lit(1).alias("__taken"), F.lit(None).cast(new.schema[order].dataType).alias(order))
    wanted = new.select("__base", F.row_number().over(number.orderBy(order)).alias("__at"), F.lit(0).alias("__taken"), order)
    before = number.orderBy("__at", "__taken").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = gaps.union(wanted).withColumn("__n", F.col("__at") + F.sum("__taken").over(before)).filter("__taken = 0")
    paper_id = F.when(F.col("__n") == 1, F.col("__base")).otherwise(F.concat("__base", F.lit("_"), F.col("__n").cast("string")))
    return new.join(placed.select("__base", order, paper_id.alias("paper_id")), ["__base", order]).drop("__base")
