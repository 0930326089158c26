"""Bounded, repeatable samples of labelled rows for fitting a model on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brookline.llm.common import discard, written


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int, id_col: str, text_col: str, label_col: str, held_out, seed: int = 7, most_chars: int = 6_000_000) -> list[tuple[str, str]]:
    """(text, label as text) of about per_class rows of each label value, without those that held_out(id column) marks.

    A row is in the sample if a hash of its id falls below per_class / rows of its label, so the sample is bounded
    whatever the size of the tables and the same in each run. Of each label rows are taken in the order of a hash for as long as all
    texts so far have no more than most_chars characters together (the first row always), so long texts take part like any
    other. The chosen ids (a bounded number) are broadcast. An id on several rows of docs gives each of its different texts.
    """
    lab = labels.select(F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("string").alias("y")).dropna().dropDuplicates(["i"])
    lab = lab.filter(~held_out(F.col("i")))
    counts = {r["y"]: r["n"] for r in lab.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    u = F.pmod(F.xxhash64("i", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    rate = F.lit(0.0)
    for y, n in counts.items():
        rate = F.when(F.col("y") == y, F.lit(min(1.0, per_class / n))).otherwise(rate)
    chosen = F.broadcast(lab.filter(u < rate))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("i"), text.alias("t")).join(chosen, "i").dropDuplicates(["i", "t"])
    rows = written(rows.withColumn("h", F.xxhash64("i", F.lit(seed + 1))), "labelled-sample")
    size = rows.select("y", "h", "i", F.xxhash64("t").alias("x"), F.length("t").alias("c"))
    size = size.withColumn("upto", F.sum("c").over(Window.partitionBy("y").orderBy("h", "i", "x").rowsBetween(Window.unboundedPreceding, 0)))
    few = F.broadcast(size.filter((F.col("upto") <= most_chars) | (F.col("upto") == F.col("c"))).select("i", "x").distinct())
    out = rows.withColumn("x", F.xxhash64("t")).join(few, ["i", "x"]).orderBy("h", "i", "x").select("t", "y").collect()
    discard(rows)
    return [(r["t"], r["y"]) for r in out]
