"""Aggregations over all events or by key, sorting and top-k."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brookline.operators.filters import strict_number
from brookline.operators.registry import UsageError, arg, operator, words
from brookline.plans.frame import SEQ, Events, running

_CACHE = arg("-c", "--cache-size", type=int)


def _result(ev: Events, df, order: Column | None = None) -> Events:
    """Rows of an aggregation in a given order, or in that of the first column, the key."""
    return Events(df.withColumn(SEQ, F.col(f"`{df.columns[0]}`") if order is None else order), SEQ)


def _key(ev: Events, path: str | None) -> Column:
    return ev.key(path) if path else F.lit("total")


@operator("sum", args=(words("path"), arg("-k", "--key"), arg("-s", "--sum-label", default="count"), arg("-l", "--key-label", default="key"), _CACHE))
def sum_(ev: Events, a) -> Events:
    """Sum of the numbers of each key."""
    x, k = strict_number(ev.path(a.path)), _key(ev, a.key)
    df = ev.df.select(k.alias(a.key_label), x.alias("__x")).filter(F.col("__x").isNotNull() & F.col(a.key_label).isNotNull())
    return _result(ev, df.groupBy(a.key_label).agg(F.sum("__x").alias(a.sum_label)))


@operator("keycounttotal", "key_count_total", args=(words("path"), arg("-k", "--key-label", default="key"), arg("-c", "--count-label", default="keycount"), arg("-m", "--max-keys", type=int), arg("-r", "--representative")))
def keycounttotal(ev: Events, a) -> Events:
    """Number of events of each key, with its first event under the -r label."""
    df = ev.df.withColumn("__k", ev.key(a.path)).filter("__k is not null")
    more = [F.min_by(ev.event(), ev.seq()).alias(a.representative)] if a.representative else []
    return _result(ev, df.groupBy(F.col("__k").alias(a.key_label)).agg(F.count(F.lit(1)).alias(a.count_label), *more))


def ranked_counts(df: DataFrame, key: str = "key", x: str = "x") -> DataFrame:
    """Distinct values of each key: key, x, c (rows), n (rows of the key), before (rows of the key that are less), place (distinct
    values of the key that are less) and places (distinct values of the key).

    Counts are made before the shuffle. Keys and values are numbered in one order over ranges of it, so neither a hot key nor a hot
    value is one task's, and no task holds a key's values.
    """
    order = F.struct(key, x)
    counts = df.groupBy(key, x).agg(F.count(F.lit(1)).alias("c")).withColumn(SEQ, order)
    run = running(Events(counts, SEQ), {"upto": (F.col("c"), 1), "place": (F.lit(1).cast("long"), 1)}, df.select(order.alias("s"))).drop(SEQ)
    ends = run.groupBy(F.col(key).alias("__key")).agg(F.sum("c").alias("n"), F.max("upto").alias("__top"), F.count(F.lit(1)).alias("places"), F.max("place").alias("__last"))
    run = run.join(ends, F.col(key) == F.col("__key"))
    return run.select(key, x, "c", "n", "places", (F.col("upto") - F.col("c") - F.col("__top") + F.col("n")).alias("before"), (F.col("place") - 1 - F.col("__last") + F.col("places")).alias("place"))


def quantiles(ranked: DataFrame, shares: Sequence[float], key: str = "key", x: str = "x") -> DataFrame:
    """Exact quantiles of each key with linear interpolation, as an array `q`. ranked: see ranked_counts."""
    found = []
    for p in shares:
        at = F.lit(p) * (F.col("n") - 1)
        for rank in (F.floor(at), F.ceil(at)):
            found.append(F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("c")), F.col(x))).alias(f"r{len(found)}"))
    out = ranked.groupBy(key).agg(F.max("n").alias("n"), *found)

    def between(k: int, p: float) -> Column:
        at, low, high = F.lit(p) * (F.col("n") - 1), F.col(f"r{2 * k}"), F.col(f"r{2 * k + 1}")
        part = at - F.floor(at)
        return F.when(low == high, low).otherwise((1 - part) * low + part * high)

    return out.select(key, F.array(*[between(k, p) for k, p in enumerate(shares)]).alias("q"))


@operator("keypercentile", "key_percentile", "percentile", args=(words("path"), arg("-k", "--key"), arg("-l", "--key-label", default="key"), arg("-s", "--label", default="percentiles"), _CACHE))
def percentile(ev: Events, a) -> Events:
    """min, p50, p90, p99 and p100 of each key, exact, with linear interpolation."""
    df = ev.df.select(_key(ev, a.key).alias("key"), strict_number(ev.path(a.path)).alias("x")).filter("x is not null and key is not null")
    df = quantiles(ranked_counts(df), (0.0, 0.5, 0.9, 0.99, 1.0))
    p = F.struct(*[F.col("q")[k].alias(n) for k, n in enumerate(("min", "p50", "p90", "p99", "p100"))])
    return _result(ev, df.select(F.col("key").alias(a.key_label), p.alias(a.label)))


def _label(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e16 else repr(x)


def boundaries(spec: str) -> list[float] | int:
    """Bucket bounds of a specification, or the number of quantile buckets."""
    if spec.startswith("quantile:"):
        return int(spec.split(":")[1])
    if spec.startswith("log:"):
        _, low, high, base = spec.split(":")
        low, high, base = float(low), float(high), float(base)
        if low <= 0 or base <= 1 or high <= low:
            raise UsageError(f"histogram: {spec!r}")
        out = [low]
        while out[-1] * base <= high * (1 + 1e-12):
            out.append(out[-1] * base)
        return out if out[-1] >= high * (1 - 1e-12) else [*out, high]
    if ":" in spec:
        low, high, width = map(float, spec.split(":"))
        if width <= 0 or high <= low:
            raise UsageError(f"histogram: {spec!r}")
        out = [low]
        while out[-1] + width < high - 1e-12:
            out.append(out[-1] + width)
        return [*out, high]
    out = [float(x) for x in spec.split(",")]
    if len(out) < 2 or out != sorted(set(out)):
        raise UsageError(f"histogram: {spec!r}")
    return out


@operator("histogram", args=(arg("path"), arg("-k", "--key"), arg("-b", "--buckets", default="0:100:10"), arg("-l", "--label", default="histogram"), arg("--cumulative", action="store_true"), arg("--normalize", action="store_true"), _CACHE))
def histogram(ev: Events, a) -> Events:
    """Counts by bucket (map of bucket name to count) with total, min, max, mean and median of each key."""
    df = ev.df.select(_key(ev, a.key).alias("key"), strict_number(ev.path(a.path)).alias("x")).filter("x is not null and key is not null")
    spec = boundaries(a.buckets)
    facts = [F.count(F.lit(1)).alias("total"), F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean")]
    ranked = ranked_counts(df)
    if isinstance(spec, int):
        # Bounds are the values at ranks i * n / N.
        at = F.transform(F.sequence(F.lit(0), F.lit(spec)), lambda i: F.least(F.floor(i * F.col("n") / spec), F.col("n") - 1))
        hit = F.exists(at, lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("c")))
        bounds = ranked.filter(hit).groupBy("key").agg(F.array_sort(F.collect_set("x")).alias("b"))
        df = df.join(bounds, "key") if a.key else df.crossJoin(F.broadcast(bounds.select("b")))  # one row
        many = F.size("b")
        place = F.size(F.filter("b", lambda y: y <= F.col("x")))
        place = F.when((many > 1) & (F.col("x") == F.element_at("b", -1)), many - 1).when(many <= 1, 0).otherwise(place)
        name = F.when(place == 0, F.concat(F.lit("<"), F.col("b")[0].cast("string"))).otherwise(F.concat(F.lit("["), F.get("b", place - 1).cast("string"), F.lit("-"), F.get("b", place).cast("string"), F.lit(")")))
        counts = df.groupBy("key", place.alias("i"), name.alias("bucket")).agg(F.count(F.lit(1)).alias("c"))
    else:
        place = F.lit(0)
        for b in spec:
            place = place + (F.col("x") >= b).cast("int")
        last = len(spec) - 1
        place = F.when(F.col("x") == spec[-1], last).otherwise(place)
        names = [f"<{_label(spec[0])}", *(f"[{_label(x)}-{_label(y)}{']' if k == last - 1 else ')'}" for k, (x, y) in enumerate(zip(spec, spec[1:], strict=False))), f">{_label(spec[-1])}"]
        counts = df.groupBy("key", place.alias("i")).agg(F.count(F.lit(1)).alias("c"))
        # Every bucket is there, empty ones too: a short list for each key.
        rows = counts.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("i", "c"))).alias("m"))
        counts = rows.select("key", F.posexplode(F.array(*[F.lit(n) for n in names])).alias("i", "bucket"), "m").select("key", "i", "bucket", F.coalesce(F.col("m")[F.col("i")], F.lit(0)).alias("c"))
    own = Window.partitionBy("key")
    if a.cumulative:
        counts = counts.withColumn("c", F.sum("c").over(own.orderBy("i")))
    if a.normalize:
        total = F.max("c").over(own) if a.cumulative else F.sum("c").over(own)
        counts = counts.withColumn("c", F.col("c") / total)
    lists = counts.groupBy("key").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("i", "bucket", "c"))), lambda r: F.struct(r["bucket"], r["c"]))).alias("buckets"))
    stats = df.groupBy("key").agg(*facts).join(quantiles(ranked, (0.5,)).select("key", F.col("q")[0].alias("median")), "key")
    out = stats.join(lists, "key").select("key", F.struct("buckets", "total", "min", "max", "mean", "median").alias(a.label))
    return _result(ev, out)


@operator("pivot", "crosstab", args=(arg("-k", "--key", required=True), arg("-c", "--column", required=True), arg("-v", "--value", required=True), arg("-a", "--aggregate", default="max", choices=["max", "min", "avg", "sum", "count"]), arg("--fill"), arg("--cache-size", type=int)))
def pivot(ev: Events, a) -> Events:
    """Long to wide: a row for each key, a column for each value of the column path."""
    value = a.value if isinstance(a.value, str) else " ".join(a.value)
    df = ev.df.select(ev.key(a.key).alias("__k"), ev.key(a.column).alias("__c"), strict_number(ev.path(value)).alias("__v")).dropna()
    out = df.groupBy("__k").pivot("__c").agg(getattr(F, a.aggregate)("__v"))
    if a.fill is not None:
        out = out.fillna(json.loads(a.fill), [c for c in out.columns if c != "__k"])
    return _result(ev, out.withColumnRenamed("__k", a.key))


def _grouped(ev: Events, df, keys: list[str], label: str, least: int) -> Events:
    rows = F.transform(F.array_sort(F.collect_list(F.struct(ev.seq().alias("__s"), ev.event().alias("e")))), lambda r: r["e"])
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_length"), rows.alias(label), F.min(ev.seq()).alias("__first")).filter(F.col("group_length") >= least)
    return Events(out.select("group_length", label, F.col("__first").alias(SEQ)), SEQ)


@operator("groupevents", args=(words("path"), arg("-m", "--max", type=int, default=100), arg("-o", "--min", type=int, default=1), _CACHE))
def groupevents(ev: Events, a) -> Events:
    """Events of a key in lists of at most -m; the rest of a key is a list if it has -o or more. A list is bounded by -m."""
    df = ev.df.withColumn("__k", ev.key(a.path)).filter("__k is not null")
    df = df.withColumn("__chunk", F.floor((F.row_number().over(ev.by(F.col("__k"))) - 1) / a.max))
    return _grouped(ev, df, ["__k", "__chunk"], "group", min(a.min, a.max))


@operator("lastn", args=(words("path"), arg("-m", "--max", type=int, default=1), arg("-o", "--min", type=int, default=1), _CACHE, arg("-g", "--group-label", default="group")))
def lastn(ev: Events, a) -> Events:
    """The last events of each key, newest first; a single one as it is, more as a group."""
    k = ev.key(a.path)
    df = ev.df.withColumn("__k", k).filter("__k is not null")
    back = Window.partitionBy("__k").orderBy(ev.seq().desc())
    df = df.withColumn("__r", F.row_number().over(back)).filter(F.col("__r") <= a.max)
    if a.max == 1:
        return ev.with_df(df.drop("__k", "__r"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("__r", ev.event().alias("e")))), lambda r: r["e"])
    out = df.groupBy("__k").agg(F.count(F.lit(1)).alias("group_length"), rows.alias(a.group_label), F.max(ev.seq()).alias(SEQ)).filter(F.col("group_length") >= a.min)
    return Events(out.drop("__k"), SEQ)


@operator("keycorrelate", "key_correlate", "correlate", args=(words("path"), arg("-k", "--key", required=True), arg("-t", "--threshold", type=float), arg("-n", "--top", type=int, default=10), arg("--min-support", type=int, default=2), arg("-s", "--score"), _CACHE))
def keycorrelate(ev: Events, a) -> Events:
    """Values that occur together under one key: the top pairs by number of keys. Ties go to the pair that sorts first."""
    df = ev.df.select(ev.key(a.key).alias("k"), ev.key(a.path).alias("v"), *([strict_number(ev.path(a.score)).alias("s")] if a.score else [])).filter("k is not null and v is not null")
    if a.score and a.threshold is not None:
        df = df.filter(F.col("s") >= a.threshold)
    df = df.select("k", "v").distinct()
    total = df.select("k").distinct().count()
    # A pair is under no more keys than either of its values is.
    common = df.groupBy("v").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= a.min_support)
    often = df.join(common.drop("__n"), "v", "left_semi")
    pairs = often.alias("a").join(often.alias("b"), (F.col("a.k") == F.col("b.k")) & (F.col("a.v") < F.col("b.v")))
    out = pairs.groupBy(F.col("a.v").alias("x"), F.col("b.v").alias("y")).agg(F.count(F.lit(1)).alias("co_occurrence_count"))
    out = out.filter(F.col("co_occurrence_count") >= a.min_support).orderBy(F.desc("co_occurrence_count"), "x", "y").limit(a.top)
    # Keys are gathered for the -n pairs that are left; so many rows are broadcast.
    first = df.join(F.broadcast(out), F.col("v") == F.col("x")).select("x", "y", "co_occurrence_count", "k")
    second = df.select(F.col("k").alias("k2"), "v").join(F.broadcast(out.select(F.col("y").alias("y2")).distinct()), F.col("v") == F.col("y2"), "left_semi")
    both = first.join(second, (F.col("k") == F.col("k2")) & (F.col("y") == F.col("v")))
    out = both.groupBy("x", "y", "co_occurrence_count").agg(F.array_sort(F.collect_list("k")).alias("keys"))
    out = out.select(F.array("x", "y").alias("pair"), "co_occurrence_count", (F.col("co_occurrence_count") / F.lit(max(total, 1))).alias("support"), "keys")
    return _result(ev, out, F.struct(-F.col("co_occurrence_count"), "pair"))


@operator("anomaly", args=(words("path"), arg("-k", "--key"), arg("--method", default="zscore", choices=["zscore", "iqr"]), arg("--threshold", type=float, default=3.0), arg("--multiplier", type=float, default=1.5), _CACHE))
def anomaly(ev: Events, a) -> Events:
    """Add is_anomaly and anomaly_score by z-score (population deviation) or by distance outside the quartile fence.

    Statistics are aggregated by key (pre-aggregated by task) and joined back, so a hot key is never one task's rows."""
    df = ev.df.withColumn("__x", strict_number(ev.path(a.path))).withColumn("__k", _key(ev, a.key)).filter("__x is not null and __k is not null")
    stats = df.groupBy("__k").agg(F.count(F.lit(1)).alias("__n"), F.avg("__x").alias("__m"), F.stddev_pop("__x").alias("__d"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
    if a.method == "iqr":
        stats = stats.join(quantiles(ranked_counts(df.select("__k", "__x"), "__k", "__x"), (0.25, 0.75), "__k", "__x").withColumnRenamed("q", "__q"), "__k")
    df = df.join(stats, "__k") if a.key else df.crossJoin(F.broadcast(stats.drop("__k")))  # one row
    x = F.col("__x")
    if a.method == "zscore":
        score = F.when((F.col("__n") < 2) | (F.col("__lo") == F.col("__hi")), 0.0).otherwise(F.abs(x - F.col("__m")) / F.col("__d"))
        odd = score > a.threshold
    else:
        q1, q3 = F.col("__q")[0], F.col("__q")[1]
        low, high = q1 - a.multiplier * (q3 - q1), q3 + a.multiplier * (q3 - q1)
        score = F.when(F.col("__n") < 4, 0.0).when(x < low, low - x).when(x > high, x - high).otherwise(0.0)
        odd = score > 0
    return ev.with_df(df.withColumn("is_anomaly", odd).withColumn("anomaly_score", score).drop("__x", "__k", "__n", "__m", "__d", "__lo", "__hi", "__q"))


@operator("rank", args=(words("path"), arg("-k", "--key"), arg("-g", "--global", dest="everything", action="store_true"), arg("--desc", action="store_true"), arg("--asc", action="store_true"), arg("-p", "--percentile", action="store_true"), arg("-d", "--dense", action="store_true"), arg("--rank-label", default="rank"), arg("--percentile-label", default="percentile"), _CACHE))
def rank(ev: Events, a) -> Events:
    """Rank within a key, or over all events, by descending value unless --asc; equal values share a rank. Ranks come from counts of distinct
    values and are joined back, so a key is never one task's rows."""
    df = ev.df.withColumn("__x", strict_number(ev.path(a.path))).withColumn("__k", _key(ev, a.key)).filter("__x is not null and __k is not null")
    ranks = ranked_counts(df.select("__k", "__x"), "__k", "__x")
    if a.dense:
        r = F.col("place") + 1 if a.asc else F.col("places") - F.col("place")
    else:
        r = F.col("before") + 1 if a.asc else F.col("n") - F.col("before") - F.col("c") + 1
    df = df.join(ranks.select("__k", "__x", r.alias("__r"), F.col("n").alias("__n")), ["__k", "__x"])
    r, n = F.col("__r"), F.col("__n")
    share = ((r - 1) if a.asc else (n - r)) / (n - 1) * 100
    df = df.withColumn(a.rank_label, r.cast("long"))
    if a.percentile:
        df = df.withColumn(a.percentile_label, F.when(n == 1, 0.0 if a.asc else 100.0).otherwise(F.round(share, 2)))
    return ev.with_df(df.drop("__x", "__k", "__r", "__n"))


@operator("sort", args=(words("path"), arg("-m", "--max", type=int), arg("-r", "--reverse", action="store_true")))
def sort(ev: Events, a) -> Events:
    """All events in the order of the key's text."""
    # Text in descending order: the hexadecimal digits of its bytes turned round, with an end that is above them all.
    back = F.concat(F.translate(F.hex(F.encode("__k", "UTF-8")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))
    return _sorted(ev, ev.key(a.path), a.reverse, back)


@operator("numsort", args=(words("path"), arg("-m", "--max", type=int), arg("-r", "--reverse", action="store_true")))
def numsort(ev: Events, a) -> Events:
    """All events in the order of a number; others are dropped."""
    # NaN is above all numbers, so in descending order it is first.
    return _sorted(ev, strict_number(ev.path(a.path)), a.reverse, F.struct(~F.isnan("__k"), -F.col("__k")))


def _sorted(ev: Events, k: Column, reverse: bool, back: Column) -> Events:
    """Sorted events whose order is made of values (`back` for a descending key __k): a number of the row would depend on how a run of the
    plan dealt the rows out, and a running number runs it more than once."""
    df = ev.df.withColumn("__k", k).filter("__k is not null").withColumn("__s", F.struct(back if reverse else F.col("__k"), ev.seq()))
    return Events(df.orderBy("__s").drop("__k", SEQ).withColumnRenamed("__s", SEQ), SEQ)


@operator("top", args=(words("path"), arg("-n", "--count", type=int, default=10), arg("-r", "--reverse", action="store_true")))
def top(ev: Events, a) -> Events:
    """The N largest, or with -r smallest, in order; of equal ones the earlier."""
    k = strict_number(ev.path(a.path))
    df = ev.df.withColumn("__k", k).filter("__k is not null").withColumn("__s", ev.seq())
    df = df.orderBy(F.col("__k").asc() if a.reverse else F.col("__k").desc(), "__s").limit(a.count).drop(SEQ)
    return Events(df.withColumn(SEQ, F.struct(F.col("__k") if a.reverse else -F.col("__k"), "__s")).drop("__k", "__s"), SEQ)
