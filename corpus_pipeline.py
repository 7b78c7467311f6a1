"""Corpus preparation: reject toxic documents, remove boilerplate lines and near
duplicates, redact secrets, and pack what is left into training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents.  `run` writes what each stage returns and hands the table to
the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalspark.llm import queries as q
from signalspark.llm._shared import materialize
from signalspark.llm.line_dedup import line_dedup
from signalspark.llm.near_copies import drop_near_copies
from signalspark.llm.packing import pack_documents
from signalspark.llm.secret_scan import redact, scan_secrets
from signalspark.llm.toxicity import toxicity_scores

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _counted(docs: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier calls toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity_scores(docs, labels).where("predicted = 0").select(*COLUMNS)


def boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove the lines that many sites share; the document with the smallest id keeps its own."""
    return _counted(line_dedup(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by five-word Jaccard similarity 0.8 or more."""
    return drop_near_copies(docs).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret found by a mask."""
    found, _ = scan_secrets(docs)
    return _counted(redact(found))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place the tokens of every document in sequences of 4096."""
    return pack_documents(docs, q.tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", boilerplate),
    ("simhash_near_dedup", near_duplicates),
    ("secret_scan", secrets),
    ("best_fit_packing", packing),
]

#: SQL expresses neither the fingerprints nor the tokenizer; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
