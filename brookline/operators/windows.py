"""Time windows: tumbling, sliding and session, with late events dropped as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brookline.functions.times import duration_ms, rfc3339, window_ms
from brookline.operators.filters import strict_number
from brookline.operators.registry import UsageError, arg, operator, words
from brookline.plans.frame import SEQ, Events, in_ranges, numbered


def running_max(ev: Events, label: str) -> Events:
    """Add the latest __ts among all events before each one, null for the first.

    The running maximum over all events is made without one task for all: events are dealt into ranges of the order, each range
    gets the maximum of the ranges before it from a table with one row per range.
    """
    ranged = in_ranges(ev)
    own = Window.partitionBy("__p").orderBy(ev.seq()).rowsBetween(Window.unboundedPreceding, -1)
    tops = ranged.groupBy("__p").agg(F.max("__ts").alias("__t"))
    tops = tops.select("__p", F.max("__t").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)).alias("__b"))
    df = ranged.withColumn("__m", F.max("__ts").over(own)).join(F.broadcast(tops), "__p")
    return ev.with_df(df.withColumn(label, F.greatest("__m", "__b")).drop("__p", "__m", "__b"))


def drop_late(ev: Events, lateness: int) -> Events:
    """Events (with __ts) that are not behind the latest time seen before them by more than `lateness` ms."""
    ev = running_max(ev, "__seen")
    seen = F.greatest(F.coalesce("__seen", F.lit(0)), F.lit(0))
    return ev.with_df(ev.df.filter(F.col("__ts") >= seen - lateness).drop("__seen"))


def _measures(a) -> dict:
    x = F.col("__x")
    out = {"count": F.count(F.lit(1))}
    if a.aggregate in ("sum", "avg"):
        out["sum"] = F.sum(x)
    if a.aggregate != "count":
        out[a.aggregate] = getattr(F, a.aggregate)(x)
    return out


def _aggregates(a) -> list:
    return [m.alias(n) for n, m in _measures(a).items()]


def _output(df: DataFrame, a, start, end) -> Events:
    names = [c for c in ("count", "sum", "avg", "min", "max") if c in df.columns]
    key = [F.col("__k").alias("key")] if a.key else []
    cols = [rfc3339(start).alias("window_start"), rfc3339(end).alias("window_end"), F.floor((end - start) / 1000).cast("long").alias("duration"), *key, *names]
    order = F.struct(F.col(SEQ), start.alias("__st")) if SEQ in df.columns else F.struct(start.alias("__st"), F.col("__k").alias("__kk"))
    return Events(df.select(*cols, order.alias(SEQ)), SEQ)


def starts(ts, size: int, slide: int):
    """The starts of the windows that hold a time: multiples of `slide`, none below 0."""
    last = F.floor(ts / slide) * slide
    first = F.greatest(F.lit(0), (F.floor((ts - size) / slide) + 1) * slide)
    return F.when(last >= first, F.sequence(first.cast("long"), last.cast("long"), F.lit(slide).cast("long")))


@operator(
    "window", "timeseries",
    args=(words("path"), arg("-w", "--size", default="1h"), arg("-s", "--slide"), arg("-k", "--key"), arg("-a", "--aggregate", default="count", choices=["count", "sum", "avg", "min", "max"]), arg("-f", "--field"), arg("--emit", default="on-close", choices=["on-close", "on-update", "on-flush"]), arg("--session-gap"), arg("--time-format"), arg("--allowed-lateness", default="0s"), arg("--max-windows", type=int)),
)
def window(ev: Events, a) -> Events:
    """Aggregates by time window. on-close and on-flush give each window once; on-update gives its state at each event."""
    if a.aggregate != "count" and not a.field:
        raise UsageError(f"window: {a.aggregate} needs --field")
    x = strict_number(ev.path(a.field)) if a.field else F.lit(None).cast("double")
    k = ev.key(a.key) if a.key else F.lit("total")
    ev = ev.add("__ts", window_ms(ev.path(a.path), a.time_format)).add("__k", k).add("__x", x)
    ev = drop_late(ev.filter(F.col("__ts").isNotNull() & F.col("__k").isNotNull()), duration_ms(a.allowed_lateness))
    if a.session_gap:
        return _session(ev, a, duration_ms(a.session_gap))
    size = duration_ms(a.size)
    slide = duration_ms(a.slide) if a.slide else size
    if slide == size:
        df = ev.df.withColumn("__w", F.floor(F.col("__ts") / size) * size)
    else:
        df = ev.df.withColumn("__w", F.explode(starts(F.col("__ts"), size, slide)))
    if a.emit == "on-update":
        w = Window.partitionBy("__k", "__w").orderBy(ev.seq()).rowsBetween(Window.unboundedPreceding, 0)
        df = df.select("__k", "__w", ev.seq().alias(SEQ), *[m.over(w).alias(c) for c, m in _measures(a).items()])
    else:
        df = df.groupBy("__k", "__w").agg(*_aggregates(a))
    return _output(df, a, F.col("__w"), F.col("__w") + size)


def _session(ev: Events, a, gap: int) -> Events:
    new = F.coalesce((F.col("__ts") - F.col("__before") >= gap).cast("int"), F.lit(0))
    if a.key:
        own = ev.by(F.col("__k"))
        ev = ev.add("__before", F.max("__ts").over(own.rowsBetween(Window.unboundedPreceding, -1)))
        ev = ev.add("__new", new).add("__n", F.sum("__new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    else:  # one session for all keys at a time: running values over ranges of the order
        ev = running_max(ev, "__before")
        ev = ev.with_df(numbered(ev, "__n", 1, new))
    if a.emit == "on-update":
        w = Window.partitionBy("__k", "__n").orderBy(ev.seq()).rowsBetween(Window.unboundedPreceding, 0)
        df = ev.df.select("__k", "__n", ev.seq().alias(SEQ), F.first("__ts").over(w).alias("__w"), F.max("__ts").over(w).alias("__e"), *[m.over(w).alias(c) for c, m in _measures(a).items()])
    else:
        df = ev.df.groupBy("__k", "__n").agg(*_aggregates(a), F.min_by("__ts", ev.seq()).alias("__w"), F.max("__ts").alias("__e"))
    return _output(df, a, F.col("__w"), F.col("__e"))
