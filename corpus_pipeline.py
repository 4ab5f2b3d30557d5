"""A training corpus from raw documents, in stages.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written as Parquet and read again
as the next stage's documents. All but the last return the columns of documents:

1. quality: documents that the classifier rejects go.
2. near duplicates: of each class of near copies the document with the smallest doc_id stays.
3. decontamination: documents that hold a benchmark passage go.
4. mix: documents are repeated or left out so that sources come near their target weights.
5. token ids: texts become files of coded token ids, and what is returned is read from these.

The tables between stages are in the folder that spark.checkpoint.dir names.

Defined cases: a null text counts as empty, and texts without words get a bad vote in the first stage; rows without a doc_id or source
are documents like others; a repeated row is a copy of the first, of which the second stage keeps one;
of near copies that tie in doc_id one stays; columns beside doc_id, text and source, whatever their names,
are carried along to the last stage; a table without rows gives none at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fanscope.llm import decontam, mixing, ngram_join, quality, token_files
from fanscope.llm.common import read_table, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier keeps."""
    return quality.without_rejected(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that with the smallest doc_id."""
    return ngram_join.one_of_each_class(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no passage of a benchmark item."""
    return decontam.without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (0 to 3 times)."""
    return mixing.mixed(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the token files say of each document: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    return token_files.written_and_read(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_good),
    ("near duplicates", keep_one_of_each),
    ("decontamination", drop_leaks),
    ("mix", mix_sources),
    ("token ids", write_token_ids),
]

#: SQL can't express the first stage; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the result is that of the last."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
