"""Streaming forms of keyed operators. Streams have no end, so operators that answer at the end are not here (see README)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from brookline.functions.times import duration_ms, event_ms, rfc3339, window_ms
from brookline.operators.filters import strict_number
from brookline.plans.frame import Events


def uniq(df: DataFrame, path: str, time: str | None = None, within: str | None = None) -> DataFrame:
    """First event of each key. With a time column and a duration the state is forgotten behind the watermark."""
    keyed = df.withColumn("__k", Events(df).key(path)).filter("__k is not null")
    if time and within:
        return keyed.withWatermark(time, f"{duration_ms(within)} milliseconds").dropDuplicatesWithinWatermark(["__k"]).drop("__k")
    return keyed.dropDuplicates(["__k"]).drop("__k")


def window(df: DataFrame, path: str, size: str = "1h", slide: str | None = None, key: str | None = None, aggregate: str = "count", field: str | None = None, lateness: str = "0s", time_format: str | None = None) -> DataFrame:
    """Tumbling or sliding windows with Spark's watermark: windows close when it passes them (append mode)."""
    ev = Events(df)
    k = ev.key(key) if key else F.lit("total")
    x = strict_number(ev.path(field)) if field else F.lit(None).cast("double")
    rows = df.select(F.timestamp_millis(window_ms(ev.path(path), time_format)).alias("ts"), k.alias("key"), x.alias("x")).filter("ts is not null and key is not null")
    ms = lambda d: f"{duration_ms(d)} milliseconds"
    w = F.window("ts", ms(size), ms(slide or size))
    measures = [F.count(F.lit(1)).alias("count")] + ([getattr(F, aggregate)("x").alias(aggregate)] if aggregate != "count" else [])
    out = rows.withWatermark("ts", ms(lateness)).groupBy(w.alias("w"), "key").agg(*measures)
    names = [c for c in out.columns if c not in ("w", "key")]
    start, end = F.unix_millis("w.start"), F.unix_millis("w.end")
    return out.select(rfc3339(start).alias("window_start"), rfc3339(end).alias("window_end"), F.floor((end - start) / 1000).alias("duration"), *(["key"] if key else []), *names)


def threshold(df: DataFrame, key: str, limit: float, value: str | None = None, label: str = "threshold_value", reset: bool = False) -> DataFrame:
    """Events from which a key's running sum (or count) reaches the limit; the sum is kept as state by key."""
    ev = Events(df)
    x = strict_number(ev.path(value)) if value else F.lit(1.0)
    keyed = df.withColumn("__k", ev.key(key)).withColumn("__x", x).filter("__k is not null and __x is not null")
    names = [*df.columns, label]
    schema = df.schema.add(label, "double")

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total = state.get[0] if state.exists else 0.0
        for pdf in batches:
            sums = []
            for v in pdf["__x"]:
                total += v
                sums.append(total)
                if reset and total >= limit:
                    total = 0.0
            pdf[label] = sums
            yield pdf.loc[pdf[label] >= limit, names]
        state.update((total,))

    return keyed.groupBy("__k").applyInPandasWithState(step, schema, "total double", "append", GroupStateTimeout.NoTimeout)


def _folded(df: DataFrame, key: str, inputs: dict[str, Column], outputs: str, state_ddl: str, fold, order: str | None) -> DataFrame:
    """fold(state, inputs of one event) gives a new state and the values of the new fields, or None to drop the event. One state for each
    key is kept; the rows of a micro-batch come a piece at a time, each in the order of `order` if it is given."""
    keyed = df.withColumns({"__k": Events(df).key(key), **inputs}).filter("__k is not null")
    added = T._parse_datatype_string(outputs)
    schema = T.StructType([*df.schema.fields, *added.fields])
    columns, names, new = list(inputs), [*df.columns, *added.names], added.names

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else None
        for pdf in batches:
            pdf = pdf.sort_values(order, kind="stable") if order else pdf
            kept, values = [], []
            for at, row in enumerate(zip(*(pdf[c] for c in columns), strict=True) if columns else ((),) * len(pdf)):
                now, found = fold(now, *(None if pd.isna(x) else x for x in row))
                if found is not None:
                    kept.append(at)
                    values.append(found)
            out = pdf.iloc[kept].reset_index(drop=True)
            for j, name in enumerate(new):
                out[name] = [v[j] for v in values]
            yield out[names]
        if now is not None:
            state.update(now)

    return keyed.groupBy("__k").applyInPandasWithState(step, schema, state_ddl, "append", GroupStateTimeout.NoTimeout)


def keycount(df: DataFrame, path: str, label: str = "count", order: str | None = None) -> DataFrame:
    """Add the running count of the event's key; events without a key are dropped."""

    def fold(state, *_):
        n = (state[0] if state else 0) + 1
        return (n,), (n,)

    return _folded(df, path, {}, f"`{label}` long", "n long", fold, order)


def timedelta(df: DataFrame, path: str, timestamp: str, label: str = "time_delta_milliseconds", order: str | None = None, time_format: str | None = None) -> DataFrame:
    """Milliseconds between an event and the one before it of the same key; first events are dropped."""

    def fold(state, ts):
        if ts is None:
            return state, None
        return (int(ts),), ((abs(int(ts) - state[0]),) if state else None)

    return _folded(df, path, {"__ts": event_ms(Events(df).path(timestamp), time_format)}, f"`{label}` long", "ts long", fold, order)


def state_delta(df: DataFrame, path: str, state: str, timestamp: str, order: str | None = None, time_format: str | None = None) -> DataFrame:
    """Events that change the state of their key, with both states and the time since the event before."""
    ev = Events(df)

    def fold(before, ts, now):
        if ts is None or now is None:
            return before, None
        changed = before and before[1] != now
        return (int(ts), now), ((abs(int(ts) - before[0]), before[1], now) if changed else None)

    fields = "state_transition_delta_milliseconds long, previous_state string, current_state string"
    return _folded(df, path, {"__ts": event_ms(ev.path(timestamp), time_format), "__st": ev.key(state)}, fields, "ts long, st string", fold, order)


def diff(df: DataFrame, path: str, field: str, order: str | None = None) -> DataFrame:
    """Add <field>_diff and <field>_pct_change against the key's last number before."""
    leaf = field.split(".")[-1]

    def fold(before, x):
        ref = before[0] if before else None
        if x is None or ref is None:
            return (before if x is None else (x,)), (None, None)
        return (x,), (x - ref, (x - ref) / ref * 100 if ref else None)

    return _folded(df, path, {"__x": strict_number(Events(df).path(field))}, f"`{leaf}_diff` double, `{leaf}_pct_change` double", "x double", fold, order)


def sessions(df: DataFrame, path: str, gap: str, key: str | None = None, aggregate: str = "count", field: str | None = None, lateness: str = "0s", time_format: str | None = None) -> DataFrame:
    """Sessions of each key by Spark's session windows: one closes when the watermark passes its last event by the gap. window_end is
    the time of the last event."""
    ev = Events(df)
    x = strict_number(ev.path(field)) if field else F.lit(None).cast("double")
    rows = df.select(F.timestamp_millis(window_ms(ev.path(path), time_format)).alias("ts"), (ev.key(key) if key else F.lit("total")).alias("key"), x.alias("x")).filter("ts is not null and key is not null")
    measures = [F.count(F.lit(1)).alias("count")] + ([getattr(F, aggregate)("x").alias(aggregate)] if aggregate != "count" else [])
    w = F.session_window("ts", f"{duration_ms(gap)} milliseconds").alias("w")
    out = rows.withWatermark("ts", f"{duration_ms(lateness)} milliseconds").groupBy(w, "key").agg(*measures)
    start, end = F.unix_millis("w.start"), F.unix_millis("w.end") - duration_ms(gap)
    names = [c for c in out.columns if c not in ("w", "key")]
    return out.select(rfc3339(start).alias("window_start"), rfc3339(end).alias("window_end"), F.floor((end - start) / 1000).alias("duration"), *(["key"] if key else []), *names)


def total(df: DataFrame, value: str, key: str | None = None, label: str = "count") -> DataFrame:
    """Sums so far by key (complete or update mode)."""
    ev = Events(df)
    k = ev.key(key) if key else F.lit("total")
    rows = df.select(k.alias("key"), strict_number(ev.path(value)).alias("__x")).filter("key is not null and __x is not null")
    return rows.groupBy("key").agg(F.sum("__x").alias(label))


def each_batch(operators):
    """A foreachBatch function that runs a batch pipeline (Events to Events) and a writer on every micro-batch."""

    def run(df: DataFrame, batch_id: int) -> None:
        from brookline.plans.frame import events

        operators(events(df))

    return run
