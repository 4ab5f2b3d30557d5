"""The registered queries: each operator over its whole intended table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fanscope.llm import bit_search, decontam, license_scan, line_spread, merkle, ngram_join, quality, token_files, toxicity
from fanscope.llm.common import read_table
from fanscope.llm.fingerprint import fingerprint_report
from fanscope.llm.html_crf import main_text
from fanscope.llm.mixing import mix_report
from fanscope.llm.whitening import whitening_report


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read_table(spark, sf_dir, "documents"))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_report(read_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(read_table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read_table(spark, sf_dir, "pages"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.written_and_read(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(read_table(spark, sf_dir, "documents"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.document_classes(read_table(spark, sf_dir, "documents"))


def op9_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_spread.without_boilerplate(read_table(spark, sf_dir, "documents"))


def op10_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening_report(read_table(spark, sf_dir, "embeddings"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle_report(read_table(spark, sf_dir, "documents"))


def op13_bit_code_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_search.nearest(read_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_license_scan, op2_document_fingerprints, op3_toxicity, op4_source_mix, op5_html_extraction, op6_token_files, op7_quality, op8_ngram_jaccard_join, op9_line_spread,
    op10_benchmark_leaks, op11_embedding_whitening, op12_merkle_manifest, op13_bit_code_search, pipeline,
)}

#: DuckDB SQL for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {"op9_line_spread": line_spread.oracle(), "op12_merkle_manifest": merkle.oracle(),
                              "op13_bit_code_search": bit_search.oracle()}
