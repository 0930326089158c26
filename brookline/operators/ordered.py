"""Operators over the order of arrival within a key."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from brookline.functions.times import event_ms
from brookline.operators.aggregate import _grouped
from brookline.operators.filters import strict_number
from brookline.operators.registry import UsageError, arg, operator, words
from brookline.plans.frame import Events

_CACHE = arg("-c", "--cache-size", type=int)


@operator("keycount", "key_count", args=(words("path"), arg("-o", "--label", default="count"), _CACHE))
def keycount(ev: Events, a) -> Events:
    """Add the running count of the event's key; events without a key pass."""
    k = ev.key(a.path)
    n = F.count(F.lit(1)).over(ev.by(k).rowsBetween(Window.unboundedPreceding, 0))
    # Events without a key don't meet: each is dealt by a random number, and its count is dropped.
    keyed, other = ev.filter(k.isNotNull()).add(a.label, n), ev.filter(k.isNull()).add(a.label, F.lit(None).cast("long"))
    return ev.with_df(keyed.df.unionByName(other.df))


@operator("timedelta", "time_delta", args=(words("path"), arg("-t", "--timestamp", default="timestamp"), arg("-f", "--format"), arg("-d", "--label", default="time_delta_milliseconds"), arg("-e", "--emit-first", action="store_true"), _CACHE))
def timedelta(ev: Events, a) -> Events:
    """Milliseconds between an event and the one before it of the same key; first events are dropped, or get 0 with -e."""
    ev = ev.add("__k", ev.key(a.path)).add("__ts", event_ms(ev.path(a.timestamp), a.format)).filter(F.col("__k").isNotNull() & F.col("__ts").isNotNull())
    out = ev.add(a.label, F.abs(F.col("__ts") - F.lag("__ts").over(ev.by(F.col("__k")))))
    out = out.add(a.label, F.coalesce(a.label, F.lit(0))) if a.emit_first else out.filter(F.col(a.label).isNotNull())
    return out.with_df(out.df.drop("__k", "__ts"))


@operator("statetransitiondelta", "state_delta", args=(words("path"), arg("-s", "--state", required=True), arg("-t", "--timestamp", default="timestamp"), arg("-f", "--format"), arg("-d", "--label", default="state_transition_delta_milliseconds"), arg("--previous-state-label", default="previous_state"), arg("--current-state-label", default="current_state"), _CACHE))
def state_delta(ev: Events, a) -> Events:
    """Events that change the state of their key, with both states and the time since the event before."""
    ev = ev.add("__k", ev.key(a.path)).add("__ts", event_ms(ev.path(a.timestamp), a.format)).add("__st", ev.key(a.state))
    ev = ev.filter(F.col("__k").isNotNull() & F.col("__ts").isNotNull() & F.col("__st").isNotNull())
    w = ev.by(F.col("__k"))
    out = ev.add("__ps", F.lag("__st").over(w)).add("__pt", F.lag("__ts").over(w)).filter(F.col("__ps") != F.col("__st"))
    out = out.add(a.label, F.abs(F.col("__ts") - F.col("__pt"))).add(a.previous_state_label, F.col("__ps")).add(a.current_state_label, F.col("__st"))
    return out.with_df(out.df.drop("__k", "__ts", "__st", "__ps", "__pt"))


@operator("threshold", args=(words("path"), arg("-v", "--value-path"), arg("-t", "--threshold", type=float, required=True), arg("-l", "--label", default="threshold_value"), _CACHE, arg("-r", "--reset", action="store_true")))
def threshold(ev: Events, a) -> Events:
    """Events from which the key's running sum (or count) is at least the threshold; -r starts again after each."""
    x = strict_number(ev.path(a.value_path)) if a.value_path else F.lit(1.0)
    ev = ev.add("__k", ev.key(a.path)).add("__x", x).filter(F.col("__k").isNotNull() & F.col("__x").isNotNull())
    if not a.reset:
        run = F.sum("__x").over(ev.by(F.col("__k")).rowsBetween(Window.unboundedPreceding, 0))
        out = ev.add(a.label, run).filter(F.col(a.label) >= a.threshold)
        return out.with_df(out.df.drop("__k", "__x"))
    df = ev.df.withColumn("__o", F.row_number().over(ev.by(F.col("__k"))))
    reach = a.threshold
    schema = df.schema.add(a.label, "double")

    def fold(batches):
        """Rows come sorted by key and order; only the running sum of the current key is held."""
        import pyarrow as pa

        key, total = None, 0.0
        for batch in batches:
            ks, xs = batch.column(at_k).to_pylist(), batch.column(at_x).to_pylist()
            sums, keep = [], []
            for k, v in zip(ks, xs, strict=True):
                if k != key:
                    key, total = k, 0.0
                total += v
                sums.append(total)
                keep.append(total >= reach)
                if total >= reach:
                    total = 0.0
            whole = pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.float64())], [*batch.schema.names, "__sum"])
            whole = whole.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays(whole.columns, names)

    names, at_k, at_x = schema.names, df.columns.index("__k"), df.columns.index("__x")
    out = df.repartition("__k").sortWithinPartitions("__k", "__o").mapInArrow(fold, schema)
    return ev.with_df(out.drop("__k", "__x", "__o"))


@operator("diff", args=(arg("-k", "--key", required=True), arg("-f", "--field", required=True), arg("--previous", action="store_true"), arg("--baseline"), arg("--value", dest="constant", type=float), arg("--cache-size", type=int)))
def diff(ev: Events, a) -> Events:
    """Add <field>_diff and <field>_pct_change against the key's value before, a baseline file by key, or a constant."""
    if sum((a.previous, a.baseline is not None, a.constant is not None)) != 1:
        raise UsageError("diff takes one of --previous, --baseline, --value")
    x, k, leaf = strict_number(ev.path(a.field)), ev.key(a.key), a.field.split(".")[-1]
    df = ev.df.withColumn("__x", x).withColumn("__k", k)
    if a.previous:
        w = Window.partitionBy("__k").orderBy(ev.seq()).rowsBetween(Window.unboundedPreceding, -1)
        df = df.withColumn("__ref", F.when(F.col("__k").isNotNull(), F.last("__x", ignorenulls=True).over(w)))
    elif a.baseline:
        with open(a.baseline, encoding="utf-8") as f:
            base = json.load(f)
        rows = [(str(n), float(v)) for n, v in base.items() if isinstance(v, (int, float)) and not isinstance(v, bool)]
        table = df.sparkSession.createDataFrame(rows, "__k string, __ref double")
        df = df.join(table, "__k", "left")
    else:
        df = df.withColumn("__ref", F.lit(a.constant))
    ref, ok = F.col("__ref"), F.col("__k").isNotNull()
    df = df.withColumn(f"{leaf}_diff", F.when(ok, F.col("__x") - ref)).withColumn(f"{leaf}_pct_change", F.when(ok & (ref != 0), (F.col("__x") - ref) / ref * 100))
    return ev.with_df(df.drop("__x", "__k", "__ref"))


@operator("burstgroup", args=(words("path"), arg("-t", "--timestamp"), arg("-g", "--gap", type=int, default=300), arg("-m", "--max", type=int, default=100), arg("-o", "--min", type=int, default=2), _CACHE))
def burstgroup(ev: Events, a) -> Events:
    """Events of a key in groups without a pause of more than -g seconds, in lists of at most -m."""
    stamp = F.floor(event_ms(ev.path(a.timestamp)) / 1000) if a.timestamp else F.unix_timestamp(F.current_timestamp())
    ev = ev.add("__k", ev.key(a.path)).add("__t", stamp).filter(F.col("__k").isNotNull() & F.col("__t").isNotNull())
    latest = F.max("__t").over(ev.by(F.col("__k")).rowsBetween(Window.unboundedPreceding, -1))
    ev = ev.add("__new", F.coalesce((F.col("__t") - latest > a.gap).cast("int"), F.lit(0)))
    ev = ev.add("__burst", F.sum("__new").over(ev.by(F.col("__k")).rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy("__k", "__burst").orderBy(ev.seq())
    df = ev.df.withColumn("__chunk", F.floor((F.row_number().over(own) - 1) / a.max))
    hidden = ["__k", "__t", "__new", "__burst", "__chunk"]
    clean = ev.with_df(ev.df.drop(*hidden))
    out = _grouped(clean, df, ["__k", "__burst", "__chunk"], "group", a.min)
    return out
