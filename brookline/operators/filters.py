"""Filters. Each is a condition on a scope, so it also works inside arrays (see reshape.apply and filterarray)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brookline.functions.jmespath import Compiler, Parser, Value, boolean_of, is_number, is_open, number_of, string_of, text
from brookline.operators.registry import UsageError, arg, operator, words
from brookline.plans.frame import Events, numbered

EPSILON = 2.220446049250313e-16


def at(scope, path: str) -> Value:
    return Compiler().compile(Parser(path).parse(), scope)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def as_number(v: Value) -> Column:
    """Numbers as doubles, and numeric strings; null for all else."""
    if is_open(v):
        return F.coalesce(number_of(v), string_of(v).try_cast("double"))
    if is_number(v.t):
        return v.c.cast("double")
    return v.c.try_cast("double") if isinstance(v.t, T.StringType) else F.lit(None).cast("double")


def strict_number(v: Value) -> Column:
    return number_of(v)


def filter_operator(*names: str, args: tuple):
    def register(condition):
        def run(ev: Events, a) -> Events:
            return ev.filter(condition(ev.schema, a))

        run.__doc__ = condition.__doc__
        operator(*names, args=args, predicate=condition)(run)
        return condition

    return register


@filter_operator("match", args=(words("path"),))
def match(scope, a) -> Column:
    """Keep events where the path is the boolean true."""
    return yes(boolean_of(at(scope, a.path)))


@filter_operator("has_field", "hasfield", "haslabel", args=(words("path"),))
def has_field(scope, a) -> Column:
    """Keep events where the path is not null."""
    return at(scope, a.path).c.isNotNull()


def _needles(a) -> list[str]:
    found = list(a.match or [])
    if getattr(a, "file", None):
        with open(a.file, encoding="utf-8") as f:
            found += [x for x in f.read().splitlines() if x]
    if not found:
        raise UsageError("at least one string to look for is needed")
    return found


@filter_operator("contains", args=(words("path"), arg("-m", "--match", nargs="+"), arg("-f", "--file"), arg("-n", "--pass-on-null", action="store_true")))
def contains(scope, a) -> Column:
    """Keep events whose value holds one of the strings. Strings with quotes or backslashes are also looked for in the value's JSON text."""
    v, needles = at(scope, a.path), _needles(a)
    if len(needles) > 16:
        found = text(v).rlike("|".join(_quoted(n) for n in needles))
    else:
        found = any_of([F.contains(text(v), F.lit(n)) for n in needles])
    if isinstance(v.t, T.StringType) and (odd := [n for n in needles if '"' in n or "\\" in n]):
        inner = F.to_json(F.struct(v.c.alias("v")))
        quoted = F.substring(inner, F.lit(6), F.length(inner) - 6)
        found = found | any_of([F.contains(quoted, F.lit(n)) for n in odd])
    return F.coalesce(found, F.lit(bool(a.pass_on_null)))


def _quoted(n: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}\-])", r"\\\1", n)


def _edges(scope, a, test) -> Column:
    v, needles = at(scope, a.path), _needles(a)
    if isinstance(v.t, T.ArrayType):
        found = F.exists(v.c, lambda x: yes(any_of([test(text(Value(x, v.t.elementType)), F.lit(n)) for n in needles])))
    else:
        found = any_of([test(text(v), F.lit(n)) for n in needles])
    return F.coalesce(found, F.lit(bool(a.pass_on_null)))


_EDGE_ARGS = (words("path"), arg("-m", "--match", nargs="+"), arg("-n", "--pass-on-null", action="store_true"))


@filter_operator("starts_with", "starts", args=_EDGE_ARGS)
def starts_with(scope, a) -> Column:
    """Keep events whose value, or an element of it, starts with one of the strings."""
    return _edges(scope, a, F.startswith)


@filter_operator("ends_with", "ends", args=_EDGE_ARGS)
def ends_with(scope, a) -> Column:
    """Keep events whose value, or an element of it, ends with one of the strings."""
    return _edges(scope, a, F.endswith)


@filter_operator(
    "nummatch", "num_match",
    args=(words("path"), arg("-v", "--value", nargs="+", type=float, required=True), arg("-g", "--greater", action="store_true"), arg("-l", "--less", action="store_true"), arg("-e", "--equal", action="store_true"), arg("-n", "--not-equal", action="store_true")),
)
def nummatch(scope, a) -> Column:
    """Keep events whose number equals one of the values, or is above all (-g), below all (-l), or none of them (-n)."""
    x = strict_number(at(scope, a.path))
    if a.greater:
        return yes(x > max(a.value))
    if a.less:
        return yes(x < min(a.value))
    if a.not_equal and not a.equal:
        return F.coalesce(~x.isin(a.value), F.lit(True))
    return yes(x.isin(a.value))


@filter_operator("numfilter", "num_filter", args=(arg("path"), arg("op", choices=[">", ">=", "<", "<=", "==", "!=", "between", "outside"]), arg("low", type=float), arg("high", type=float, nargs="?"), arg("-n", "--pass-on-null", action="store_true")))
def numfilter(scope, a) -> Column:
    """Compare a number or a numeric string; between and outside take two bounds."""
    x = as_number(at(scope, a.path))
    if a.op in ("between", "outside") and a.high is None:
        raise UsageError(f"{a.op} needs two values")
    same = F.abs(x - a.low) < EPSILON
    c = {">": x > a.low, ">=": x >= a.low, "<": x < a.low, "<=": x <= a.low, "==": same, "!=": ~same}.get(a.op)
    if c is None:
        inside = (x >= a.low) & (x <= a.high)
        c = inside if a.op == "between" else ~inside
    return F.coalesce(c, F.lit(bool(a.pass_on_null)))


@filter_operator("regexmatcher", "regex_matcher", "regex_match", args=(words("path"), arg("-p", "--pattern", nargs="+", required=True)))
def regexmatcher(scope, a) -> Column:
    """Keep events where one of the patterns is found."""
    s = text(at(scope, a.path))
    return yes((s != "") & any_of([s.rlike(f"(?U){p}") for p in a.pattern]))


@operator("jmespath", args=(words("path"), arg("-l", "--label", default="jmespath"), arg("-p", "--pass-through", action="store_true")))
def jmespath(ev: Events, a) -> Events:
    """Add the result of a path; events without one are dropped. -p keeps events where it is true and adds nothing."""
    v = ev.path(a.path)
    if a.pass_through:
        return ev.filter(match(ev.schema, a))
    return ev.filter(v.c.isNotNull()).add(a.label, v.c)


def row_in_key(ev: Events, key: Column) -> Events:
    return ev.add("__rn", F.row_number().over(ev.by(key)))


def _upto(ev: Events, a, keep) -> Events:
    k = ev.key(a.path)
    out = row_in_key(ev.filter(k.isNotNull()), k).filter(keep(F.col("__rn")))
    return out.with_df(out.df.drop("__rn"))


_COUNT = arg("-c", "--cache-size", type=int)


@operator("uniq", args=(words("path"), _COUNT))
def uniq(ev: Events, a) -> Events:
    """The first event of each key."""
    return _upto(ev, a, lambda r: r == 1)


@operator("firstn", "first_n", args=(words("path"), arg("-n", "--count", type=int, default=10), _COUNT))
def firstn(ev: Events, a) -> Events:
    """The first N events of each key."""
    return _upto(ev, a, lambda r: r <= a.count)


@operator("aftern", "after_n", args=(words("path"), arg("-n", "--count", type=int, default=10), _COUNT))
def aftern(ev: Events, a) -> Events:
    """All but the first N events of each key."""
    return _upto(ev, a, lambda r: r > a.count)


@operator("head", args=(arg("-n", "--count", type=int, default=10), arg("-f", "--finish", action="store_true")))
def head(ev: Events, a) -> Events:
    """The first N events."""
    return ev.with_df(ev.df.orderBy(ev.seq()).limit(a.count))


@operator("sample", "sampling", args=(arg("-r", "--rate", type=float), arg("-n", "--count", type=int), arg("--reservoir", type=int), arg("-k", "--key"), arg("--seed", type=int), _COUNT))
def sample(ev: Events, a) -> Events:
    """Bernoulli (-r), the first N (-n), N at random (--reservoir), or the first N of each key (-n -k)."""
    modes = [a.rate is not None, a.count is not None, a.reservoir is not None]
    if sum(modes) != 1 or (a.key and a.count is None):
        raise UsageError("sample takes one of -r, -n, --reservoir, -n with -k")
    if a.rate is not None:
        return ev.filter(F.rand(a.seed) < a.rate)
    if a.reservoir is not None:
        return ev.with_df(ev.df.orderBy(F.rand(a.seed)).limit(a.reservoir))
    if a.key:
        a.path = a.key
        return firstn(ev, a)
    return head(ev, a)


@operator("enumerate", args=(arg("-l", "--label", default="enumeration"), arg("-f", "--file"), arg("-m", "--position", nargs="+", type=int)))
def enumerate_(ev: Events, a) -> Events:
    """Add each event's position from 0; keep only the listed positions if there are any."""
    wanted = list(a.position or [])
    if a.file:
        with open(a.file, encoding="utf-8") as f:
            wanted += [int(x) for x in f.read().split()]
    out = ev.with_df(numbered(ev, a.label, 0))
    return out.filter(F.col(a.label).isin(wanted)) if wanted else out


@operator("dynamodbdedup", "dynamodb_dedup", args=(arg("table"), arg("-k", "--key", required=True), arg("--key-attribute-name", default="key"), arg("--ttl-seconds", type=int), arg("--ttl-attribute-name", default="ttl"), arg("--retry-backoff-ms", type=int), arg("-r", "--region"), arg("--batch-size", type=int), arg("--local-cache-size", type=int), arg("--create-table", action="store_true")))
def persistent_dedup(ev: Events, a) -> Events:
    """First occurrences against a persistent key table: keys of earlier runs are left out, new keys are added to it."""
    from brookline.sources.tables import key_table

    k = ev.key(a.key)
    store = key_table(ev.df.sparkSession, a.table, a.key_attribute_name, a.ttl_attribute_name)
    first = row_in_key(ev.filter(k.isNotNull()), k).filter("__rn = 1").add("__k", k)
    new = first.df.drop("__rn").join(store.live().withColumnRenamed(a.key_attribute_name, "__k"), "__k", "left_anti")
    new = store.claim(new, "__k", a.ttl_seconds)
    return ev.with_df(new.drop("__k"))
