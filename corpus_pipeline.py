"""Corpus pipeline: toxicity, near copies, repeated passages, benchmark leaks, mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() applies
them in order. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.llm import decontaminate, mixing, shingles, substring, toxicity
from barloom.llm.common import read, whole_row


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts hold nothing
    toxic and are scored like any text; equal rows fare alike. Without labels, or with
    those of one class only, all documents count as of that class (clean if there are
    none). Columns of any name stay as they are."""
    return toxicity.keep_clean(docs, read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest
    doc_id. Near: five-word shingles with a Jaccard similarity of 0.8 and more. Null and empty
    texts are near each other; a null doc_id sorts last; equal rows stay together."""
    return shingles.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words and more that start earlier in the corpus are cut from
    the texts. A text that loses nothing stays as it is, white space included; one
    that loses all its words goes. Null and empty texts lose nothing and stay; equal
    rows fare alike; columns of any name stay as they are."""
    found = substring.dedup_texts(docs.select("doc_id", "text", whole_row(docs).alias("row")))
    touched = F.col("n_removed") > 0
    text = F.when(touched, F.col("kept_text")).otherwise(F.col("text"))
    found = found.where(~touched | (F.col("n_removed") < F.col("n_words"))).select("row", touched.alias("touched"), text.alias("text"))
    own = {"text": F.col("text"), "n_chars": F.when(F.col("touched"), F.length("text").cast("long")).otherwise(F.col("row")["n_chars"])}
    return found.select(*[own.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a passage with the benchmark go; null and empty texts
    share none, and an empty benchmark keeps all. Columns of any name stay as they are."""
    return decontaminate.keep_uncontaminated(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the number of copies of each."""
    return mixing.take_mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("mixing", mix),
]
#: The classifier and the cube sample can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
