"""The named queries and the SQL that says the same, filled by the query modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries named {f.__name__}")
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ROWS_DEALT = 5_000  # rows, at most, that a part of :func:`dealt` has on average


def parts_dealt(rows: DataFrame) -> int:
    """The session's shuffle partitions, or more where a part would get over ROWS_DEALT of ``rows``."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-rows.count() // ROWS_DEALT))


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` by ``key`` over the session's shuffle partitions, or more where a part would get over ROWS_DEALT rows: a small file
    is read by one task, which would write out and parse all papers made of its rows, and a task's memory must not grow with
    the table. What groups by ``key`` later stays where it is, so lines aren't shuffled."""
    return rows.repartition(parts_dealt(rows), key)


def literal(word: str) -> str:
    return "'" + word.replace("'", "''") + "'"
