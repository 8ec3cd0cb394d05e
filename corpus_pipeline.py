"""Raw documents to token ids: language, near duplicates, personal data, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. Null and empty
texts go at the first stage, as they are of no language; a text of any length passes whole; of rows that
share a doc_id one stays, rows of equal texts or sets leave the smallest doc_id; null doc_ids stay, whatever
their text; extra columns pass all stages but the last; an empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import bpe, jaccard, langid, mixing, pii
from quillmill.llm.common import fold, saved, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no known language."""
    model = langid.train(docs.select("doc_id", "lang", "text").filter(fold("doc_id", 4) != 2))
    return langid.identified(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that five-word shingles link at 0.8."""
    return jaccard.without_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Generalises personal data and disclosing terms in the texts; n_chars follows."""
    clean = pii.sanitise(docs, generalise=True)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")) if "n_chars" in docs.columns else clean


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents towards the target weights."""
    return mixing.sample(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every remaining text, and the digest of what they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_documents(docs.select("doc_id", "lang", "source", "text"), path, public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


# Models, set joins and tokenizers are beyond SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None
