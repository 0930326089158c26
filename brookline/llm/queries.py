"""The queries of this subpackage and the SQL to hold them against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brookline.llm.common import table


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brookline.llm.exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"), keep="max", fold_ascii=True)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brookline.llm.mixing import mix

    m = mix(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", "taken", "copies", "expected")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brookline.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), length=200)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brookline.llm.decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), least=0.5)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brookline.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=4, seed=42, radius=4)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from brookline.llm.token_files import tokenise

    return tokenise(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def in_fold(k: int, n: int) -> Callable[[Column], Column]:
    """Whether the crc32 of an id as text leaves k when divided by n."""
    return lambda i: F.pmod(F.crc32(i.cast("string")), F.lit(n)) == k


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brookline.llm import language

    docs, held_out = table(spark, sf_dir, "documents"), in_fold(1, 3)
    found = language.identify(docs, language.fit(docs, held_out, per_class=1000))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brookline.llm import quality

    docs, held_out = table(spark, sf_dir, "documents"), in_fold(0, 5)
    graded = quality.grade(docs, quality.fit(docs, table(spark, sf_dir, "labels"), held_out, per_grade=1500))
    return graded.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_grade", "tail_probability", (F.col("tail_probability") >= 0.5).alias("selected"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brookline.llm import toxicity

    docs, held_out = table(spark, sf_dir, "documents"), in_fold(0, 5)
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"), held_out, per_class=1500)
    scored = toxicity.score(docs, net)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's path is its source, as a directory, and its id."""
    from brookline.llm.licenses import scan

    docs = table(spark, sf_dir, "documents")
    files = docs.select("doc_id", F.concat(F.lit("/"), F.coalesce("source", F.lit("unknown")), F.lit("/"), F.col("doc_id").cast("string")).alias("path"), "text")
    return scan(files, id_col="doc_id")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language": op1_language,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_decontamination": op3_decontamination,
        "op4_simhash_near_dedup": op4_simhash_near_dedup,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_quality": op6_quality,
        "op7_toxicity": op7_toxicity,
        "op8_mix_sources": op8_mix_sources,
        "op9_licenses": op9_licenses,
        "op10_token_files": op10_token_files,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": OP5_SQL}
