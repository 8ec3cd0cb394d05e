"""Joins of derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def meet(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join by sorting, however small ``right`` looks: what is derived from a small file (papers' lines, arrays of
    them) outgrows the size that Spark reckons from the file, and a broadcast takes all of it through the driver."""
    return left.join(right.hint("merge"), on, how)
