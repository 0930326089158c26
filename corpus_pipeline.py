"""From raw documents to token files: five stages, each over all that the stage before kept.

Each stage is called with (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the
shared scratch folder and reads it back as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from brookline.llm import decontamination, mixing, near_copies, token_files, toxicity
from brookline.llm.common import table, written
from brookline.llm.queries import in_fold


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that the network scores 0.5 or more go."""
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"), in_fold(0, 5), per_class=1500)
    return toxicity.drop_toxic(docs, net, least=0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies, the pipeline's form of operator 4: of documents that five-word shingles of Jaccard similarity 0.8 or more link the one with the smallest doc_id stays."""
    return near_copies.one_of_each(docs, width=5, least=0.8)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that hold a passage of a test item go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), least=0.5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: each document as many times as the mix takes it."""
    return mixing.apply_mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: token files of the mix, in ascending order of doc_id, read back. Executors come here with the memory that four stages
    took, so the memories of words are half of the operator's."""
    return token_files.tokenise(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, most=40_000_000, most_bases=50_000_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mix_sources", mix_sources),
    ("token_files", write_tokens),
]

#: Networks, fingerprints and token ids can't be said in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
