"""Registered queries of this subpackage: op<N>_<name>(spark, sf_dir), and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekgrain.llm import backoff, decontamination, divergence, fingerprint, license_scan, ngram_join, piece_sampling, prefix_trie, quality, rans_store, repeats, toxicity, url_filter
from weekgrain.llm.common import table


def tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans_store.store_documents(table(spark, sf_dir, "documents"), tokenizer(), end_id=2)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.judged(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), threshold=0.8)
    return found.select("doc_id", "contaminated", "coverage", "item_id", "item_ids")


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"), size=4, percent=85)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removed(table(spark, sf_dir, "documents"), length=200)


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per text and sample, four where the text has so many segmentations: sample 0 has the best perturbed value."""
    found = piece_sampling.sampled(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), k=4, seed=1, with_ids=False)
    return found.select("doc_id", "n_samples", F.posexplode_outer("samples").alias("sample", "s")).select("doc_id", "n_samples", "sample", "s.*")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "quality", "keep")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), min_docs=10, ranks=10)


def op12_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores at six decimals, so that the order of a sum cannot show."""
    found = backoff.scored(table(spark, sf_dir, "documents"), order=2)
    return found.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_store, op2_decontamination, op3_url_rules, op4_license_scan, op5_ngram_join, op6_toxicity, op7_repeats, op8_pieces, op9_fingerprints, op10_quality, op11_divergence, op12_lm_scores, op13_prefix_trie)
}
SQL: dict[str, str] = {"op3_url_rules": url_filter.sql(), "op11_divergence": divergence.sql(), "op12_lm_scores": backoff.sql(), "op13_prefix_trie": prefix_trie.sql()}
