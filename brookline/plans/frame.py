"""A stream of events: a DataFrame and the column that gives the order of arrival."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brookline.functions.jmespath import Compiler, Parser, Value, text

SEQ = "_seq"


@dataclass(frozen=True)
class Events:
    """Operators take and give Events. `order` names a column (it need not be among an event's fields: SEQ is hidden)."""

    df: DataFrame
    order: str = SEQ

    @property
    def fields(self) -> list[str]:
        return [c for c in self.df.columns if c != SEQ]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([f for f in self.df.schema.fields if f.name != SEQ])

    def path(self, path: str) -> Value:
        return Compiler().compile(Parser(path).parse(), self.schema)

    def key(self, path: str) -> Column:
        return text(self.path(path))

    def seq(self) -> Column:
        return F.col(f"`{self.order}`")

    def with_df(self, df: DataFrame) -> Events:
        return Events(df, self.order)

    def filter(self, condition: Column) -> Events:
        return self.with_df(self.df.filter(condition))

    def add(self, label: str, c: Column) -> Events:
        return self.with_df(self.df.withColumn(label, c))

    def event(self) -> Column:
        return F.struct(*[F.col(f"`{c}`") for c in self.fields])

    def select(self, *cols: Column) -> Events:
        """New fields in place of the old ones; the order stays."""
        names = self.df.select(*cols).columns
        if self.order in names:
            return self.with_df(self.df.select(*cols))
        return Events(self.df.select(*cols, self.seq().alias(SEQ)), SEQ)

    def by(self, key: Column | None = None) -> WindowSpec:
        """Arrival order within a key. Only calls with a key scale; see numbered() for all events."""
        return (Window.partitionBy(key) if key is not None else Window.partitionBy()).orderBy(self.seq())

    def frame(self) -> DataFrame:
        return self.df.select(*[F.col(f"`{c}`") for c in self.fields])

    def apply(self, name: str, *args, **options) -> Events:
        from brookline.operators.registry import call

        return call(self, name, *args, **options)


def events(df: DataFrame, order: str | None = None) -> Events:
    """Events of a table. Without an order column the order of the scan is taken, before any shuffle."""
    if order:
        return Events(df, order)
    return Events(df.withColumn(SEQ, F.monotonically_increasing_id()), SEQ)


def _literal(value, t: T.DataType) -> Column:
    if value is None:
        return F.lit(None).cast(t)
    if isinstance(t, T.StructType):
        return F.struct(*[_literal(v, f.dataType).alias(f.name) for v, f in zip(value, t.fields, strict=True)])
    return F.lit(value).cast(t)


def in_ranges(ev: Events, label: str = "__p", sample: DataFrame | None = None) -> DataFrame:
    """Number the ranges of the order: events of a higher range come after those of a lower one.

    The bounds are values of a small sample of the order column (twenty for each shuffle partition), put into the plan as literals, so
    every part of a plan and every rerun of a task agrees on them. They affect balance only, so a cheaper table with a column s of
    such values may be sampled instead.
    """
    n = int(ev.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ev.df.select(ev.seq().alias("s"))
    t = order.schema["s"].dataType
    found = sorted((r["s"] for r in (sample or order).filter("s is not null").orderBy(F.rand(7)).limit(20 * n).collect()), key=_sortable)
    bounds = [found[k] for k in range(20, len(found), 20)]
    if not bounds:
        return ev.df.withColumn(label, F.lit(0))
    lits = [_literal(b, t) for b in bounds]

    def upto(low: int, high: int) -> Column:
        """How many bounds are not above an event, by halving: a few comparisons for each event, not one for each bound."""
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(lits[mid] <= ev.seq(), upto(mid + 1, high)).otherwise(upto(low, mid))

    return ev.df.withColumn(label, upto(0, len(lits)))


def _sortable(value):
    """Nulls inside an order come first and NaN last, as in Spark."""
    if isinstance(value, (tuple, list)):
        return tuple(_sortable(v) for v in value)
    return (value is not None, value != value, None if value != value else value)


def numbered(ev: Events, label: str, start: int, value: Column | None = None, sample: DataFrame | None = None) -> DataFrame:
    """A running total over all events in order (of 1, or of `value`), without bringing them to one task."""
    return running(ev, {label: (F.lit(1).cast("long") if value is None else value, start)}, sample)


def running(ev: Events, totals: dict[str, tuple[Column, int]], sample: DataFrame | None = None) -> DataFrame:
    """Running totals over all events in order: by label the value and, less one, what the total starts from.

    Events are dealt into ranges of the order and sorted there; each range gets what lies before it from a small table of the
    ranges' sums (one row per range).
    """
    ranged = in_ranges(ev, sample=sample).withColumns({f"__v{k}": v for k, (v, _) in enumerate(totals.values())})
    own = Window.partitionBy("__p").orderBy(ev.seq()).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns({f"__run{k}": F.sum(f"__v{k}").over(own) for k in range(len(totals))})
    sums = ranged.groupBy("__p").agg(*[F.sum(f"__v{k}").alias(f"__s{k}") for k in range(len(totals))])
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__p", *[F.coalesce(F.sum(f"__s{k}").over(before), F.lit(0)).alias(f"__b{k}") for k in range(len(totals))])
    # One row per range, so its size is bounded by the number of partitions.
    out = local.join(F.broadcast(sums), "__p")
    out = out.withColumns({label: F.col(f"__run{k}") + F.col(f"__b{k}") + (start - 1) for k, (label, (_, start)) in enumerate(totals.items())})
    return out.drop("__p", *[f"{c}{k}" for k in range(len(totals)) for c in ("__v", "__run", "__s", "__b")])
