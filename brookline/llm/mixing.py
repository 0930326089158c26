"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brookline.llm.common import WORD, written

#: Bins of the ranking variable, which lies in 0..1. The cut falls into one bin of a source; only that bin is sorted.
BINS = 16384


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """sk, source, source_size, target for each source. sizes: sk, source, source_size.

    Sources in order of code points (null last) take the weights in turn and share `share` times all
    sizes by weight; a target stops at `cap` times its source's size and the excess is shared again
    by weight until none is above. Closed form: sort by cap per weight; the capped sources are the
    first of that order. One row per source meets in one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", weight).withColumn("most", F.col("source_size") * float(cap))
    everything = Window.partitionBy()
    order = Window.orderBy((F.col("most") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = (
        s.withColumn("all", F.sum("source_size").over(everything) * float(share)).withColumn("all_w", F.sum("w").over(everything))
        .withColumn("capped", F.coalesce(F.sum("most").over(before), F.lit(0.0))).withColumn("capped_w", F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    )
    # The level if all sources before this one are capped; it holds from the first source that stays below its cap.
    level = (F.col("all") - F.col("capped")) / (F.col("all_w") - F.col("capped_w"))
    s = s.withColumn("fits", F.when(level * F.col("w") <= F.col("most"), F.struct(F.row_number().over(order).alias("at"), level.alias("level"))))
    s = s.withColumn("level", F.min("fits").over(everything)["level"])
    return s.select("sk", "source", "source_size", F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least("most", F.col("level") * F.col("w"))).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17, length_preference: float = 1.0) -> DataFrame:
    """One row per input row: id, row (a hash of id and text), size, source, source_size, target, expected, copies, taken.

    Each document's expected copies are min(cap, level * preference), where the preference is
    1 + length_preference * log2 class of its size and the level makes a source's expected words
    its target. Whole expected copies are certain. The rest is an inclusion probability p: documents
    are ranked by random odds over inclusion odds, u/(1-u) : p/(1-p), and the first ones are taken,
    as many as bring the source's words nearest to its target (within half a document). u is a hash of id, text
    and seed, so reruns agree and rows without an id differ by their texts. Null text has size 0 and takes nothing; a null source is a source;
    equal rows rank alike and are cut in any order, with the same result. A very long text is one document like any other. Empty
    table: no rows; extra columns are not read.

    Scale: sizes are written once. A source's ranking is summed in 16384 bins (pre-aggregated), and
    only the bin that holds the cut is sorted, so no task gets a source's rows. The cut lies near even odds, where a bin has at most about
    1/16384 of a source's different rows, whatever the inclusion probabilities are.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), key.alias("sk"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.col(id_col), F.col(text_col).cast("string")).alias("row"))
    rows = written(rows.withColumn("class", F.when(F.col("size") > 0, F.floor(F.log2("size"))).otherwise(0).cast("int")), "mix-sizes")
    classes = written(rows.groupBy("sk", "class").agg(F.first("source").alias("source"), F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")), "mix-classes")
    goal = targets(classes.groupBy("sk").agg(F.first("source").alias("source"), F.sum("words").alias("source_size")), weights, share, cap)

    # A source's level over its classes (64 at most): the classes of greatest preference reach the cap first.
    c = classes.select("sk", "class", "words").join(goal, "sk").withColumn("g", F.lit(1.0) + F.lit(float(length_preference)) * F.col("class"))
    own = Window.partitionBy("sk")
    before = own.orderBy(F.col("g").desc()).rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("full", F.coalesce(F.sum("words").over(before), F.lit(0)) * float(cap)).withColumn("rest", F.sum(F.col("words") * F.col("g")).over(own.orderBy(F.col("g").desc()).rowsBetween(0, Window.unboundedFollowing)))
    level = (F.col("target") - F.col("full")) / F.col("rest")
    fits = F.when((F.col("rest") > 0) & (level * F.col("g") <= float(cap)), F.struct((-F.col("g")).alias("at"), level.alias("level")))
    c = c.withColumn("level", F.min(fits).over(own)["level"])
    c = c.withColumn("expected", F.when(F.col("level").isNull(), float(cap)).otherwise(F.least(F.lit(float(cap)), F.greatest(F.lit(0.0), F.col("level") * F.col("g")))))
    # A hair below a whole number is that number: the level is a quotient of doubles.
    c = c.withColumn("sure", F.floor(F.col("expected") + 1e-9).cast("long")).withColumn("p", F.greatest(F.lit(0.0), F.col("expected") - F.col("sure")))
    left = F.col("target") - F.sum(F.col("words") * F.col("sure")).over(own)
    plan = written(c.select("sk", "class", "source_size", "target", "expected", "sure", "p", left.alias("left")), "mix-plan")

    u = (F.shiftrightunsigned(F.xxhash64(F.col("row"), F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    odds = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    d = rows.join(plan, ["sk", "class"])
    d = d.withColumn("z", F.when((F.col("size") > 0) & (F.col("p") > 0), odds / (1 + odds))).withColumn("bin", F.least(F.lit(BINS - 1), F.floor(F.col("z") * BINS)).cast("int"))
    bins = d.filter("z is not null").groupBy("sk", "bin").agg(F.sum("size").alias("words"), F.first("left").alias("left"))
    upto = own.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("upto", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    # The first bin whose words pass the target; where none does, every bin is taken.
    cut = bins.filter(F.col("upto") + F.col("words") > F.col("left")).groupBy("sk").agg(F.min_by(F.struct("bin", "upto"), "bin").alias("c"))
    cut = written(cut.select("sk", F.col("c.bin").alias("cut"), F.col("c.upto").alias("upto")), "mix-cut")
    d = d.join(cut, "sk", "left")
    at = d.filter(F.col("bin") == F.col("cut"))
    so_far = F.sum("size").over(own.orderBy("z", "row", "size").rowsBetween(Window.unboundedPreceding, 0)) + F.col("upto")
    # Taken if at least half of it lies below the target.
    at = at.withColumn("more", ((so_far - F.col("size") / 2.0) <= F.col("left")).cast("long"))
    rest = d.filter(F.col("bin").isNull() | F.col("cut").isNull() | (F.col("bin") != F.col("cut")))
    rest = rest.withColumn("more", F.when(F.col("z").isNull(), 0).when(F.col("cut").isNull() | (F.col("bin") < F.col("cut")), 1).otherwise(0).cast("long"))
    copies = F.when(F.col("size") > 0, F.col("sure") + F.col("more")).otherwise(F.lit(0)).cast("long")
    out = rest.unionByName(at).withColumn("copies", copies)
    return out.select(F.col("id").alias(id_col), "row", "size", "source", "source_size", "target", "expected", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of docs, each as many times as mix() takes it (none included), with all their columns. Of rows with the same id, text and
    source, one stands for all, as often as they are taken together."""
    taken = mix(docs, id_col, text_col, source_col, **options)
    taken = taken.groupBy(F.col("row").alias("__h"), F.col("source").alias("__s")).agg(F.sum("copies").alias("__c"), F.count(F.lit(1)).alias("__n")).filter("__c > 0")
    taken = written(taken, "mix-copies")
    keyed = docs.withColumn("__r", F.xxhash64(F.col(id_col), F.col(text_col).cast("string")))

    def rows(of: DataFrame) -> DataFrame:
        return keyed.join(of, (keyed["__r"] == of["__h"]) & keyed[source_col].cast("string").eqNullSafe(of["__s"]))

    out = rows(taken.filter("__n = 1"))
    several = taken.filter("__n > 1")
    if not several.isEmpty():
        out = out.unionByName(rows(several).dropDuplicates(["__h", "__s"]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.array_repeat(F.lit(1), F.col("__c").cast("int"))).alias("__copy")).drop("__copy")
