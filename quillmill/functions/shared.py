"""Tables kept in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. A temporary one is made only where none is set and master and
    executors are one process on one machine (tests); anything else is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quillmill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def saved(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillmill-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillmill_path = path
    return out


def bucketed(df: DataFrame, n: int, key: str) -> DataFrame:
    """:func:`saved` in ``n`` buckets of ``key``: what groups or joins by it later shuffles nothing. ``df`` should lie in
    ``n`` parts by ``key`` already, so that each task writes one bucket."""
    spark, name = df.sparkSession, f"quillmill_{uuid.uuid4().hex}"
    df.write.bucketBy(n, key).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)
