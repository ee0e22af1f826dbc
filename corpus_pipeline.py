"""Corpus pipeline: quality, near-duplicates, decontamination, secrets, token ids.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; what it returns is written as Parquet and read again.  All but
the last return the columns of ``docs``, whatever other columns these have.  A
null text counts as empty, but stays null; a null id is an id of its own; empty
tables give empty tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.llm import bpe, chosen_path, convnet, secrets, winnow
from provena.llm.support import release, tables, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose quality score is at least 0.3; rows that repeat share their score, and an empty text has one too.  The classifier learns from all labelled documents of ``sf_dir`` but the held-out fold."""
    network = convnet.learn(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return convnet.accepted(docs, network)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, that of the least doc_id; rows without words all stay."""
    return chosen_path.distinct_rows(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no window of a benchmark item; rows without words hold none."""
    return winnow.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with every secret found in the text replaced, and n_chars counted again where there is such a column; a row of null text stays as it is."""
    out = secrets.redacted(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return out.select(docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row: its text's ids, of which decoding gives back its bytes; none for a null or empty text."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), encoding="ascii") as f:
        encoded = bpe.encode_documents(docs.select("doc_id", "text"), f.read(), public_tokenizers.PATTERN)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("secret scans", hide_secrets),
    ("byte-level BPE encoding and decoding", token_ids),
]

#: A classifier and a tokenizer have no SQL: the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with tables():
        for name, stage in STAGES:
            docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
            release(spark, docs)  # what the stage has written on its way, and its input
    return docs
