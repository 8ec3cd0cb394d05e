"""Numbers in messy cells, and how far two numbers are apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocab import NUMBER, PASS_DELTA, PLACEHOLDERS, PLUS_MINUS, WARN_DELTA


def _plain(token: Column) -> Column:
    number = F.regexp_replace(token, "[%,]", "").try_cast("double")
    return F.when(F.endswith(token, F.lit("%")), number / 100).otherwise(number)


def to_number(cell: Column) -> Column:
    """The first number of a cell: placeholders give null, ``a±b`` gives a, ``x%`` gives x / 100.

    Unicode minus signs count as minus; LaTeX macros, ``$`` and the backslash of ``\\%`` are dropped.
    """
    s = F.regexp_replace(cell, r"(?U)^\s+|\s+$", "")
    pair = F.regexp_extract(s, PLUS_MINUS, 1)
    t = F.regexp_replace(F.translate(s, "−–—", "---"), r"\\[a-zA-Z]+", " ")
    t = F.replace(F.translate(t, "$", ""), F.lit("\\%"), F.lit("%"))
    token = F.regexp_extract(t, NUMBER, 0)
    return F.when(s.isNull() | F.lower(s).isin(PLACEHOLDERS), None).when(pair != "", pair.try_cast("double")).when(token != "", _plain(token))


def extract_numbers(text: Column, limit: int = 200) -> Column:
    """The first ``limit`` numbers of a free text."""
    tokens = F.slice(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0)), 1, limit)
    return F.transform(tokens, _plain)


def rel_delta(reported: Column, reproduced: Column) -> Column:
    gap = F.abs(reproduced - reported)
    return F.when(reported == 0, F.abs(reproduced)).otherwise(F.try_divide(gap, F.abs(reported)))


def judge(delta: Column, passes: float = PASS_DELTA, warns: float = WARN_DELTA) -> Column:
    return F.when(delta.isNull(), "skipped").when(delta <= passes, "pass").when(delta <= warns, "warn").otherwise("fail")


def classify(reported: Column, reproduced: Column, passes: float = PASS_DELTA, warns: float = WARN_DELTA) -> Column:
    return judge(rel_delta(reported, reproduced), passes, warns)


def numeric_share(cells: Column) -> Column:
    """Of an array's non-blank cells, the share that holds a number; null without any."""
    filled = F.filter(cells, lambda c: F.trim(c) != "")
    return F.try_divide(F.size(F.filter(filled, lambda c: to_number(c).isNotNull())).cast("double"), F.size(filled))


def is_numeric_row(cells: Column, least: float = 0.6) -> Column:
    return F.coalesce(numeric_share(cells) >= least, F.lit(False))


def sort_numbers(values: Column) -> Column:
    return F.array_sort(F.filter(values, lambda v: v.isNotNull()))


def upper_median(values: Column) -> Column:
    """The element at floor(n / 2) of the sorted array; not the average of the middle ones."""
    ordered = sort_numbers(values)
    return F.try_element_at(ordered, (F.floor(F.size(ordered) / 2) + 1).cast("int"))


def upper_median_of(column: str) -> Column:
    """The upper median as an aggregate: counts of values merge, no list of them is gathered."""
    return F.expr(f"percentile_disc(0.5) within group (order by `{column}` desc)")
