"""The registered queries of this folder, with their SQL checks where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dialoom.llm import decontamination, html_main, language_id, mixing, near_dedup, ngram_join, pii, prefix_trie, quality_rules, secret_scan, token_output, url_filter, whitening
from dialoom.llm.common import read


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the fixed rules and the listed URLs."""
    pages = read(spark, sf_dir, "pages")
    listed = url_filter.listed_pages(pages)
    return url_filter.judge_urls(pages, "page_id", "url", url_filter.RULES, listed)


def op2_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by pseudonyms of the same format."""
    return pii.digest(read(spark, sf_dir, "documents"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    return secret_scan.digest(read(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_main.digest(read(spark, sf_dir, "pages"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, source targets and the words that the mix takes from every document."""
    return mixing.digest(read(spark, sf_dir, "documents"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate documents."""
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that every document holds."""
    return decontamination.digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids, written as ORC and read back."""
    return token_output.digest(read(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of every document, with its host's verdict."""
    return quality_rules.judge_quality(read(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    return language_id.digest(read(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations' shared prefixes."""
    return prefix_trie.digest(read(spark, sf_dir, "conversations"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose word trigrams are alike."""
    return ngram_join.digest(read(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding's leading whitened components."""
    return whitening.digest(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filters, op2_pii_pseudonyms, op3_secret_scans, op4_html_extraction, op5_source_mixing, op6_near_dedup,
        op7_decontamination, op8_token_output, op9_quality_rules, op10_language_id, op11_prefix_trie, op12_ngram_join,
        op13_embedding_whitening,
    )
}
SQL = {"op1_url_filters": url_filter.SQL, "op5_source_mixing": mixing.SQL, "op9_quality_rules": quality_rules.SQL, "op11_prefix_trie": prefix_trie.SQL}
