"""Arrays to events and back, nested operators, connected components inside an event."""

from __future__ import annotations

from collections.abc import Callable
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brookline.functions.jmespath import Value
from brookline.operators.filters import at
from brookline.operators.registry import UsageError, arg, find, operator, parse, words
from brookline.plans.frame import SEQ, Events


def _dotted(path: str) -> str:
    return ".".join(f'"{p}"' for p in path.split("."))


def _explode(ev: Events, v: Value, keep: Value | None) -> Events:
    cols = [F.posexplode(v.c).alias("__at", "__e"), ev.seq().alias("__s")]
    if keep is not None:
        cols.append(keep.c.alias("__k"))
    df = ev.df.select(*cols).withColumn(SEQ, F.struct("__s", "__at"))
    return Events(df, SEQ)


def _merged(ev: Events, element: T.DataType, keep: Value | None, label: str, parent_wins: bool) -> Events:
    own = {f.name: F.col("__e").getField(f.name) for f in element.fields} if isinstance(element, T.StructType) else {label: F.col("__e")}
    kept = {f.name: (F.col("__k").getField(f.name), f.dataType) for f in keep.t.fields} if keep is not None and isinstance(keep.t, T.StructType) else {}
    types = {f.name: f.dataType for f in element.fields} if isinstance(element, T.StructType) else {label: element}
    cols = []
    for name in [*kept, *(n for n in own if n not in kept)]:
        if name in own and name in kept:
            a, b = own[name], kept[name][0].cast(types[name])
            cols.append((F.coalesce(b, a) if parent_wins else F.coalesce(a, b)).alias(name))
        else:
            cols.append((own[name] if name in own else kept[name][0]).alias(name))
    return Events(ev.df.select(*cols, SEQ), SEQ)


@operator("flatten", args=(words("path"), arg("-k", "--keep"), arg("-p", "--keep-parent", action="store_true"), arg("--preserve-parent", action="store_true"), arg("-e", "--element-label", default="value")))
def flatten(ev: Events, a) -> Events:
    """One event for each element that is not null, with the parent's fields (-p) or a path's (-k). The element's fields win
    unless --preserve-parent."""
    v = ev.path(a.path)
    if not isinstance(v.t, T.ArrayType):
        return ev.filter(F.lit(False))
    keep = ev.path(a.keep) if a.keep else None
    if keep is None and (a.keep_parent or a.preserve_parent):
        top = a.path.split(".")[0].strip('"')
        names = [c for c in ev.fields if c != top]
        keep = Value(F.struct(*[F.col(f"`{c}`") for c in names]), T.StructType([ev.df.schema[c] for c in names]))
    out = _explode(ev, v, keep).filter(F.col("__e").isNotNull())
    return _merged(out, v.t.elementType, keep, a.element_label, a.preserve_parent)


@operator("split_array", "splitarray", args=(words("path"), arg("-k", "--keep")))
def split_array(ev: Events, a) -> Events:
    """One event for each element; kept fields overwrite those of object elements."""
    v = ev.path(a.path)
    if not isinstance(v.t, T.ArrayType):
        return ev.filter(F.lit(False))
    keep = ev.path(a.keep) if a.keep and isinstance(v.t.elementType, T.StructType) else None
    return _merged(_explode(ev, v, keep), v.t.elementType, keep, "value", True)


def _nested(tokens: list[str]) -> tuple[object, SimpleNamespace]:
    op = find(tokens[0])
    if op.predicate is None and op.scalar is None:
        raise UsageError(f"{tokens[0]} can't run inside a value")
    return op, parse(op, tokens[1:])


def _with(x: Column, t: T.StructType, label: str, v: Value) -> Value:
    names = [n for n in t.names if n != label]
    c = F.struct(*[x.getField(n).alias(n) for n in names], v.c.alias(label))
    return Value(F.when(x.isNotNull(), c), T.StructType([*[t[n] for n in names], T.StructField(label, v.t)]))


def _replace(ev: Events, path: list[str], new: Callable[[Value], Value | None]) -> Events:
    """The event with the value at a dotted path replaced; None removes it."""

    def rebuild(v: Value, rest: list[str]) -> Value | None:
        if not rest:
            return new(v)
        if not isinstance(v.t, T.StructType) or rest[0] not in v.t.names:
            return v
        parts = {n: Value(v.c.getField(n), v.t[n].dataType) for n in v.t.names}
        parts[rest[0]] = rebuild(parts[rest[0]], rest[1:])
        left = {n: p for n, p in parts.items() if p is not None}
        return Value(F.when(v.c.isNotNull(), F.struct(*[p.c.alias(n) for n, p in left.items()])), T.StructType([T.StructField(n, p.t) for n, p in left.items()]))

    if path[0] not in ev.fields:
        return ev
    out = rebuild(Value(F.col(f"`{path[0]}`"), ev.df.schema[path[0]].dataType), path[1:])
    return ev.with_df(ev.df.drop(path[0])) if out is None else ev.add(path[0], out.c)


@operator("apply", args=(arg("path"), arg("pairs", nargs="...")))
def apply(ev: Events, a) -> Events:
    """Run an operator on the object, or on each element of the array, at a dotted path."""
    op, inner = _nested(a.pairs)

    def one(x: Column, t: T.DataType) -> Value:
        if op.predicate:
            return Value(F.when(op.predicate(Value(x, t), inner), x), t)
        label, v = op.scalar(Value(x, t), inner)
        return _with(x, t, label, v) if isinstance(t, T.StructType) else Value(x, t)

    def new(v: Value) -> Value:
        if isinstance(v.t, T.ArrayType):
            kind: list[T.DataType] = []

            def each(x: Column) -> Column:
                y = one(x, v.t.elementType)
                kind.append(y.t)
                return y.c

            c = F.transform(v.c, each)
            c = F.filter(c, lambda x: x.isNotNull())
            return Value(F.when(F.size(c) > 0, c), T.ArrayType(kind[0]))
        return one(v.c, v.t)

    return _replace(ev, a.path.split("."), new)


@operator("filterarray", "filter_array", args=(arg("path"), arg("pairs", nargs="...")))
def filterarray(ev: Events, a) -> Events:
    """Keep the elements of an array for which a filter holds. A field that is no array is removed."""
    op, inner = _nested(a.pairs)
    if not op.predicate:
        raise UsageError("filterarray takes a filter")

    def new(v: Value) -> Value | None:
        if not isinstance(v.t, T.ArrayType):
            return None
        return Value(F.filter(v.c, lambda x: op.predicate(Value(x, v.t.elementType), inner)), v.t)

    return _replace(ev, a.path.split("."), new)


@operator("components", args=(words("path"), arg("-c", "--child", default="child"), arg("-p", "--parent", default="parent")))
def components(ev: Events, a) -> Events:
    """Connected components of an array of edges inside an event: component_count and components."""
    v = at(ev.schema, a.path)

    @F.pandas_udf("array<struct<component: int, members: array<string>>>")
    def groups(parents: pd.Series, children: pd.Series) -> pd.Series:
        def one(ps, cs):
            if ps is None or cs is None:
                return None
            root: dict[str, str] = {}

            def find_root(x: str) -> str:
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            for p, c in zip(ps, cs, strict=True):
                if p is None or c is None:
                    continue
                p, c = find_root(root.setdefault(p, p) and p), find_root(root.setdefault(c, c) and c)
                if p != c:
                    root[max(p, c)] = min(p, c)
            found: dict[str, list[str]] = {}
            for x in sorted(root):
                found.setdefault(find_root(x), []).append(x)
            return [{"component": k, "members": m} for k, m in enumerate(found.values())]

        return pd.Series([one(p, c) for p, c in zip(parents, children, strict=True)])

    if not isinstance(v.t, T.ArrayType) or not isinstance(v.t.elementType, T.StructType):
        return ev
    side = lambda name: F.transform(v.c, lambda e: e[name].cast("string"))
    out = ev.add("components", groups(side(a.parent), side(a.child)))
    return out.add("component_count", F.size("components"))
