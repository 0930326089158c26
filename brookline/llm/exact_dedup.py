"""Exact deduplication by 128-bit content hash, with a comparison of bytes inside groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookline.llm.common import ascii_lower, written


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", fold_ascii: bool = True) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same bytes (after lower-casing A-Z if fold_ascii). keep is
    "max" or "min": which id of a group stays. Null text counts as empty; an empty table gives no
    rows. Null ids count in group_size and stay only where the whole group has none. Repeated ids
    with one text form one group; every row that bears the kept id is marked. Extra columns are
    ignored, whatever they are called.

    Plan: only ids and hashes are shuffled for the groups (pre-aggregated by task). Texts move only
    where two rows share a hash, and grouping on (hash, text) compares their bytes; exact copies
    combine before that shuffle, so a hot group moves one text per task. Texts that share a hash and
    differ get classes of their own.
    """
    if keep not in ("max", "min"):
        raise ValueError("keep is 'max' or 'min'")
    best = F.max if keep == "max" else F.min
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    text = ascii_lower(text) if fold_ascii else text
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t"))
    keyed = written(rows.select("id", F.unhex(F.md5("t")).alias("h"), F.unhex(F.sha2("t", 256)).alias("sha")), "exact-keys")
    groups = keyed.groupBy("h").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    shared = written(groups.filter("n > 1"), "exact-shared")

    # The bytes: classes of equal texts among rows that share a hash.
    hashed = rows.withColumn("k", F.md5("t"))
    among = hashed.join(shared.select(F.lower(F.hex("h")).alias("k")), "k", "left_semi")
    classes = among.groupBy("k", "t").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    several = F.count(F.lit(1)).over(_by("k")) > 1
    odd = written(classes.select("k", F.sha2("t", 256).alias("s"), "t", "keep_id", "n", several.alias("several")).filter("several"), "exact-collisions")

    out = keyed.join(shared.select(F.col("h"), "keep_id", "n"), "h", "left")
    if odd.isEmpty():
        keep_id, size = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id")), F.coalesce("n", F.lit(1))
        out = out.select("id", keep_id.alias("keep_id"), size.cast("long").alias("n"), "sha")
    else:  # texts that differ under one 128-bit hash
        bad = odd.select("k").distinct()
        kept_rows = out.withColumn("k", F.lower(F.hex("h"))).join(bad, "k", "left_anti")
        kept_rows = kept_rows.select("id", F.coalesce("keep_id", "id").alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("n"), "sha")
        split = hashed.join(odd.select("k", "t", "keep_id", "n"), ["k", "t"]).select("id", "keep_id", F.col("n").cast("long"), F.unhex(F.sha2("t", 256)).alias("sha"))
        out = kept_rows.unionByName(split)
    kept = F.col("id").eqNullSafe(F.col("keep_id"))
    return out.select(F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def _by(key: str):
    from pyspark.sql import Window

    return Window.partitionBy(key)
