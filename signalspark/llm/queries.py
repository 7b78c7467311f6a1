"""Registered queries of the corpus operators: each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sentence_pieces
from .ann import nearest
from .bitsliced import exact_topk
from .importance import importance_resample
from .lexical import ranked_search
from .license_scan import scan_licenses
from .line_dedup import line_dedup
from .packing import pack_documents
from .secret_scan import KINDS, scan_secrets
from .simhash import simhash_components
from .substring_dedup import remove_repeats
from .toxicity import toxicity_scores
from .url_filters import filter_urls

#: Stated URL rules: verdict, host, path (fixed values).
URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines removed per document and a digest of the cleaned text."""
    out = line_dedup(_documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = simhash_components(_documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices of every document with coverage and span."""
    return scan_licenses(_documents(spark, sf_dir))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every document, counted and digested by kind."""
    found, _ = scan_secrets(_documents(spark, sf_dir), columns=["doc_id"])

    def written(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    def of(*kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    base = of(*KINDS)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op5_approximate_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors found of every hundredth vector."""
    return nearest(_embeddings(spark, sf_dir), F.col("id") % 100 == 0, k=10)


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 largest quantised inner products of every fiftieth vector."""
    return exact_topk(_embeddings(spark, sf_dir), F.col("id") % 50 == 0, k=5)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 4096 tokens."""
    return pack_documents(_documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity_scores(docs.select("doc_id", "text"), labels).select("doc_id", "held_out", "score", "predicted")


def op9_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, counted and digested, and a digest of the decoded text."""
    model = tokenizer_file("piece_bpe_32k.model")
    out = sentence_pieces.round_trip(_documents(spark, sf_dir).select("doc_id", "text"), model)
    return out.select("doc_id", "n_ids", "ids_crc32", F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words kept of every document once repeated passages are removed."""
    out = remove_repeats(_documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the URL of every page."""
    pages, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "labels"))
    return filter_urls(pages, labels, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight and score of every document, and the rank of those drawn."""
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return importance_resample(_documents(spark, sf_dir), target).select("doc_id", "n_features", "weight", "score", "rank")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest-scoring documents of every benchmark item."""
    return ranked_search(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_license_scan": op3_license_scan,
    "op4_secret_scan": op4_secret_scan,
    "op5_approximate_neighbours": op5_approximate_neighbours,
    "op6_exact_topk": op6_exact_topk,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_toxicity": op8_toxicity,
    "op9_sentence_pieces": op9_sentence_pieces,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_url_filters": op11_url_filters,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_ranked_search": op13_ranked_search,
}
