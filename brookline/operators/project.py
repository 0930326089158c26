"""Projection, strings and other row-wise functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brookline.functions.jmespath import Value, text
from brookline.functions.jsons import json_schema
from brookline.operators.filters import EPSILON, as_number, at, yes
from brookline.operators.registry import UsageError, arg, operator, words
from brookline.plans.frame import SEQ, Events, numbered

STRING = T.StringType()


def adding(*names: str, args: tuple):
    """An operator that adds one field; the function gives (label, Value). It also works inside arrays and objects."""

    def register(make):
        def run(ev: Events, a) -> Events:
            label, v = make(ev.schema, a)
            return ev.add(label, v.c)

        run.__doc__ = make.__doc__
        operator(*names, args=args, scalar=make)(run)
        return make

    return register


@operator("select", args=(words("path"), arg("-u", "--unwind", action="store_true")))
def select(ev: Events, a) -> Events:
    """Replace the event by the path's result; null drops it. -u gives one event for each element of an array."""
    v = ev.path(a.path)
    if a.unwind and isinstance(v.t, T.ArrayType):
        df = ev.df.select(F.posexplode(v.c).alias("__at", "__e"), ev.seq().alias("__s"))
        df = df.filter("__e is not null").withColumn(SEQ, F.struct("__s", "__at"))
        return _as_event(Events(df.select("__e", SEQ), SEQ), Value(F.col("__e"), v.t.elementType))
    return _as_event(ev.filter(v.c.isNotNull()), v)


def _as_event(ev: Events, v: Value) -> Events:
    if isinstance(v.t, T.StructType):
        out = ev.df.select(ev.seq().alias(SEQ), v.c.alias("__e"))
        return Events(out.select(*[F.col("__e").getField(n).alias(n) for n in v.t.names], SEQ), SEQ)
    return Events(ev.df.select(v.c.alias("value"), ev.seq().alias(SEQ)), SEQ)


@operator("annotate", args=(words("text", optional=True), arg("-l", "--label", default="annotation"), arg("-t", "--timestamp", action="store_true")))
def annotate(ev: Events, a) -> Events:
    """Add a constant, and with -t the time now."""
    out = ev.add(a.label, F.lit(a.text)) if a.text else ev
    return out.add("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")) if a.timestamp else out


@operator("remove", args=(arg("keys", nargs="+"),))
def remove(ev: Events, a) -> Events:
    """Drop top-level fields; an event left empty is dropped."""
    left = [c for c in ev.fields if c not in a.keys]
    out = ev.select(*[F.col(f"`{c}`") for c in left])
    return out if left else out.filter(F.lit(False))


@operator("denest", args=(arg("keys", nargs="+"), arg("-i", "--label")))
def denest(ev: Events, a) -> Events:
    """A new event of the fields at dotted paths, by their last names. None found: dropped, or kept as it was with -i."""
    found = {}
    for k in a.keys:
        v = at(ev.schema, ".".join(f'"{p}"' for p in k.split(".")))
        if not isinstance(v.t, T.NullType):
            found[k.split(".")[-1]] = v
    some = F.lit(False)
    for v in found.values():
        some = some | v.c.isNotNull()
    cols = [v.c.alias(n) for n, v in found.items()]
    if a.label:
        return ev.add(a.label, F.when(some, F.struct(*cols))) if cols else ev
    return ev.filter(some).select(*cols)


@operator("nest", args=(words("path", optional=True), arg("-i", "--label", default="nest")))
def nest(ev: Events, a) -> Events:
    """Put the event, or a path's result, under a label."""
    c = ev.path(a.path).c if a.path else ev.event()
    return Events(ev.df.select(c.alias(a.label), ev.seq().alias(SEQ)), SEQ)


@adding("substring", args=(words("path"), arg("-d", "--depth", type=int, required=True), arg("-o", "--offset", type=int, default=0), arg("-l", "--label", default="substring"), arg("-f", "--from-end", action="store_true")))
def substring(scope, a) -> tuple[str, Value]:
    """Characters from the start, or with -f from the end. Beyond the text: no field."""
    s = text(at(scope, a.path))
    n = F.char_length(s)
    start = F.greatest(F.lit(0), n - a.offset - a.depth) if a.from_end else F.lit(a.offset)
    size = F.least(F.lit(a.depth), n - a.offset)
    c = F.when(n > a.offset, F.substring(s, start + 1, size))
    return a.label, Value(F.nullif(c, F.lit("")), STRING)


def _unescape(s: str) -> str:
    known = {"n": "\n", "r": "\r", "t": "\t", "0": "\0", "\\": "\\", '"': '"'}
    return re.sub(r"\\(.)", lambda m: known.get(m[1], m[0]), s)


def change_case(s: Column, a) -> Column:
    if a.uppercase:
        s = F.upper(s)
    elif a.lowercase:
        s = F.lower(s)
    if a.from_ is not None:
        old, new = _unescape(a.from_), _unescape(a.to or "")
        if new:
            new = new[: len(old)] + new[-1] * max(0, len(old) - len(new))
        s = F.translate(s, old, new)
    return s


_CASE = (words("path"), arg("-u", "--uppercase", action="store_true"), arg("-l", "--lowercase", action="store_true"), arg("-f", "--from", dest="from_"), arg("-t", "--to"), arg("--label", default="transformed"))


def transformed(scope, a) -> tuple[str, Value]:
    """Change case, then map characters: a short target repeats its last character, an empty one deletes. Arrays element by element."""
    v = at(scope, a.path)
    if isinstance(v.t, T.ArrayType):
        return a.label, Value(F.transform(v.c, lambda x: change_case(text(Value(x, v.t.elementType)), a)), T.ArrayType(STRING))
    return a.label, Value(change_case(text(v), a), STRING)


adding("stringtransformer", "string_transformer", "transform", args=_CASE)(transformed)


def _fixed(**options):
    def make(scope, a) -> tuple[str, Value]:
        vars(a).update(options)
        return transformed(scope, a)

    make.__doc__ = transformed.__doc__
    return make


adding("upper", args=_CASE)(_fixed(uppercase=True))
adding("lower", args=_CASE)(_fixed(lowercase=True, uppercase=False))

#: The alphabet of base 32 in order; a fixed value of the standard.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


@adding("stringdecoder", "stringdecode", "string_decode", "decode", args=(words("path"), arg("-m", "--mode", default="base64", choices=["base64", "base64url", "base32", "hex"]), arg("-l", "--label", default="decoded")))
def decode(scope, a) -> tuple[str, Value]:
    """Decode to text; what is not well-formed gives no field."""
    s = F.trim(text(at(scope, a.path)))
    if a.mode == "hex":
        raw = F.when(s.rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(s))
    elif a.mode == "base32":
        body = F.rtrim(s, F.lit("="))
        well = s.rlike("^([A-Z2-7]{8})*([A-Z2-7]{2}={6}|[A-Z2-7]{4}={4}|[A-Z2-7]{5}={3}|[A-Z2-7]{7}=)?$")
        # Each letter is five bits; whole bytes of the joined bits are the text.
        bits = F.array_join(F.transform(F.split(body, ""), lambda c: F.lpad(F.conv((F.position(c, F.lit(BASE32)) - 1).cast("string"), 10, 2), 5, "0")), "")
        count = F.floor(F.length(bits) / 8)
        hexes = F.transform(F.when(count > 0, F.sequence(F.lit(0), count - 1)), lambda k: F.lpad(F.conv(F.substring(bits, (k * 8 + 1).cast("int"), F.lit(8)), 2, 16), 2, "0"))
        raw = F.when(well, F.unhex(F.coalesce(F.array_join(hexes, ""), F.lit(""))))
    else:
        plain = F.translate(s, "-_", "+/") if a.mode == "base64url" else s
        if a.mode == "base64url":
            plain = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("="))
        shape = "^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"
        raw = F.when(plain.rlike(shape), F.try_to_binary(plain, F.lit("base64")))
    return a.label, Value(F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")), STRING)


@adding("stringsplitter", "string_splitter", "split", "split_string", args=(words("path"), arg("-d", "--delimiter", required=True), arg("-l", "--label", default="split"), arg("-r", "--regex", action="store_true")))
def split(scope, a) -> tuple[str, Value]:
    """Split a text at a string or a pattern."""
    return a.label, Value(F.split(text(at(scope, a.path)), a.delimiter if a.regex else re.escape(_unescape(a.delimiter))), T.ArrayType(STRING))


@operator("arrayjoiner", "array_joiner", "join_array", args=(words("path"), arg("-s", "--separator", default=" "), arg("-l", "--label", default="joined"), arg("-p", "--pass-through", action="store_true")))
def arrayjoiner(ev: Events, a) -> Events:
    """Join an array of strings; anything else drops the event, or passes it unchanged with -p."""
    v = ev.path(a.path)
    good = isinstance(v.t, T.ArrayType) and isinstance(v.t.elementType, T.StringType)
    whole = yes((F.size(v.c) > 0) & F.forall(v.c, lambda x: x.isNotNull())) if good else F.lit(False)
    joined = F.when(whole, F.array_join(v.c, a.separator)) if good else F.lit(None).cast("string")
    return ev.add(a.label, joined) if a.pass_through else ev.filter(whole).add(a.label, joined)


#: Schemes and what stands for them; fixed values.
SCHEMES = {"https": "hxxps", "http": "hxxp", "ftp": "fxp"}


def defanged(s: Column) -> Column:
    """Cut at URLs; in each the scheme is replaced and the dots of the host are bracketed."""
    parts = F.split(s, r"(?=(?:https?|ftp)://)")

    def one(p: Column) -> Column:
        host = F.regexp_extract(p, r"^(?:https?|ftp)://([^/\s\"'<>?#]*)", 1)
        scheme = F.regexp_extract(p, r"^(https?|ftp)://", 1)
        new = F.when(scheme == "https", SCHEMES["https"]).when(scheme == "http", SCHEMES["http"]).otherwise(SCHEMES["ftp"])
        rest = F.substring(p, F.length(scheme) + 4 + F.length(host), F.length(p))
        return F.when(scheme != "", F.concat(new, F.lit("://"), F.replace(host, F.lit("."), F.lit("[.]")), rest)).otherwise(p)

    return F.when(s.isNotNull(), F.array_join(F.transform(parts, one), ""))


@adding("defang", args=(words("path"), arg("-l", "--label", default="defang")))
def defang(scope, a) -> tuple[str, Value]:
    """Make URLs unclickable."""
    return a.label, Value(defanged(text(at(scope, a.path))), STRING)


@adding("regexextractor", "regex_extractor", "regex_extract", "regex", args=(words("path"), arg("-p", "--pattern", required=True), arg("-t", "--label", default="regex_extract"), arg("-c", "--group", type=int, default=0)))
def regexextract(scope, a) -> tuple[str, Value]:
    """The first match of a pattern, or a group of it; none gives no field."""
    pattern = a.pattern if isinstance(a.pattern, str) else " ".join(a.pattern)
    return a.label, Value(F.nullif(F.regexp_extract(text(at(scope, a.path)), f"(?U){pattern}", a.group), F.lit("")), STRING)


@operator("jsondecode", "json_decode", "decodejson", args=(words("path", optional=True), arg("-l", "--label"), arg("--schema"), arg("--variant", action="store_true")))
def jsondecode(ev: Events, a) -> Events:
    """Parse JSON text: its fields join the event (new ones win), or go under a label. Bad JSON passes unchanged. Give the
    schema as DDL; without one it is inferred from the data, which costs a pass over that column. --variant (with -l) needs no schema:
    see the source `json`."""
    path = a.path or "value"
    s = text(ev.path(path))
    if a.variant:
        if not a.label:
            raise UsageError("jsondecode: --variant needs -l")
        return ev.add(a.label, F.try_parse_json(s))
    parsed = F.from_json(s, a.schema or json_schema(ev.df, s))
    if a.label:
        return ev.add(a.label, parsed)
    df = ev.df.withColumn("__j", parsed)
    for f in df.schema["__j"].dataType.fields:
        new = F.col("__j").getField(f.name)
        df = df.withColumn(f.name, F.coalesce(new, F.col(f"`{f.name}`").cast(f.dataType)) if f.name in ev.fields else new)
    return ev.with_df(df.drop("__j"))


@adding("kvmap", args=(words("path"), arg("-k", "--key-label", default="label"), arg("-v", "--value-label", default="value"), arg("-o", "--output", default="transformed")))
def kvmap(scope, a) -> tuple[str, Value]:
    """An array of {label, value} to an object; the last of equal labels wins, items without either are skipped."""
    v = at(scope, a.path)
    if isinstance(v.t, T.StructType):
        v = Value(F.array(v.c), T.ArrayType(v.t))
    t = v.t.elementType if isinstance(v.t, T.ArrayType) else None
    if not isinstance(t, T.StructType) or a.key_label not in t.names or a.value_label not in t.names:
        return a.output, Value(F.lit(None).cast("map<string,string>"), T.MapType(STRING, STRING))
    kept = F.filter(v.c, lambda x: x[a.key_label].isNotNull() & x[a.value_label].isNotNull())
    later = F.filter(F.transform(kept, lambda x, i: F.struct(x[a.key_label].cast("string").alias("k"), x[a.value_label].alias("v"), i.alias("i"))), lambda x: F.lit(True))
    last = F.filter(later, lambda x: ~F.exists(later, lambda y: (y["k"] == x["k"]) & (y["i"] > x["i"])))
    return a.output, Value(F.map_from_entries(F.transform(last, lambda x: F.struct(x["k"], x["v"]))), T.MapType(STRING, t[a.value_label].dataType))


@operator("count", args=(arg("-l", "--label", default="count"), arg("-s", "--silent", action="store_true")))
def count(ev: Events, a) -> Events:
    """Add a running count of all events."""
    return ev.with_df(numbered(ev, a.label, 1))


_RULE = re.compile(r"^(.*?)\s*(>=|<=|==|!=|>|<|contains|matches|starts_with|ends_with)\s+(.+?)\s*->\s*(.+?)$")


@adding("classify", args=(arg("output"), arg("-f", "--field", required=True), arg("--rules", nargs="+", required=True), arg("--default")))
def classify(scope, a) -> tuple[str, Value]:
    """The label of the first rule that holds: `field op value -> label`."""
    v = at(scope, a.field)
    s, x, out = text(v), as_number(v), None
    for rule in a.rules:
        m = _RULE.match(rule)
        if not m:
            raise UsageError(f"classify: {rule!r} is not a rule")
        op, raw, label = m[2], m[3].strip("'\""), m[4].strip("'\"")
        try:
            n = float(raw)
        except ValueError:
            n = None
        if op in (">", ">=", "<", "<="):
            if n is None:
                raise UsageError(f"classify: {raw!r} is not a number")
            c = {">": x > n, ">=": x >= n, "<": x < n, "<=": x <= n}[op]
        elif op in ("==", "!="):
            c = (F.abs(x - n) < EPSILON) if n is not None else (s == raw)
            c = ~c if op == "!=" else c
        else:
            c = {"contains": F.contains(s, F.lit(raw)), "matches": s.rlike(f"(?U){raw}"), "starts_with": F.startswith(s, F.lit(raw)), "ends_with": F.endswith(s, F.lit(raw))}[op]
        out = F.when(c, label) if out is None else out.when(c, label)
    return a.output, Value(out.otherwise(a.default), STRING)
