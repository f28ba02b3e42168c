"""Registered queries of the training-data operators.

Each takes (spark, sf_dir), applies one operator with production parameters
to its whole table and returns the digest columns of its result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from crawlq.llm import (
    collocations, decontaminate, html_extract, mix, near_dup, quality, spelling, suffix_dedup, tokens, topk, toxicity, url_lists, warc)
from crawlq.llm.common import scratch_path, table

Builder = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records in ZIP packages, then range-read."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_ball_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best inner products of every 50th id's vector against all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents by fast similarity sketches."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best window of each document and benchmark item of similarity 0.75 or more."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by a linear-chain CRF over its lines."""
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_dated_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the dated list entries active on its day of fetching."""
    pages = table(spark, sf_dir, "pages")
    return url_lists.judge(url_lists.captures_of(pages), url_lists.entries_of(pages))


def op7_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents by Pareto order sampling."""
    return mix.mix_documents(table(spark, sf_dir, "documents"))


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token-id Parquet files, then read back."""
    out = scratch_path(spark, "token-ids")
    tokens.write_tokens(table(spark, sf_dir, "documents"), out, tokenizer_path())
    return tokens.token_digest(tokens.read_tokens(spark, out))


def op9_toxicity_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a bidirectional GRU over all its windows."""
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes that 400-byte strings cover which also start elsewhere."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op11_min_cut_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, by minimum cuts of its blocks."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op12_fm_index_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, forms and roots of all words of all documents."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_stripes_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of 2 to 4 words of each language, from merged stripes."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


# ---- stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame --------

def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model, keep=True).where(f"score >= {quality.THRESHOLD}").select("doc.*")


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    return near_dup.one_of_each(docs)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mix.mix_documents(docs, keep=True)


def stage_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id files of the mix, read back as their digest."""
    out = scratch_path(spark, "pipeline-token-ids")
    tokens.write_tokens(docs, out, tokenizer_path())
    return tokens.token_digest(tokens.read_tokens(spark, out))


QUERIES: dict[str, Builder] = {f.__name__: f for f in (
    op1_warc_zip, op2_ball_tree_top_k, op3_minhash_near_dedup, op4_benchmark_decontamination, op5_quality_crf,
    op6_dated_url_lists, op7_pareto_mix, op8_token_ids, op9_toxicity_gru, op10_suffix_array_dedup,
    op11_min_cut_html, op12_fm_index_spelling, op13_stripes_collocations)}

ORACLES: dict[str, str] = {
    "op6_dated_url_lists": url_lists.ORACLE, "op1_warc_zip": warc.ORACLE, "op2_ball_tree_top_k": topk.ORACLE,
    "op7_pareto_mix": mix.ORACLE, "op13_stripes_collocations": collocations.ORACLE}
