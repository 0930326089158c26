"""JMESPath over typed columns: a parser, and a compiler from paths to Column expressions.

The compiler follows the schema, so Catalyst sees plain field access, higher-order functions and comparisons, and prunes
the columns that a path does not touch. Objects are structs or maps; a field that the schema lacks is null.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(
    r"""\s*(?:(?P<lit>`(?:\\`|[^`])*`)|(?P<raw>'(?:\\'|[^'])*')|(?P<quoted>"(?:\\.|[^"\\])*")|(?P<num>-?\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>\|\||&&|==|!=|<=|>=|\[\?|\[\]|[][.*<>!(){}|&,:@]))"""
)
_BIND = {"|": 1, "||": 2, "&&": 3, "==": 5, "!=": 5, "<": 5, "<=": 5, ">": 5, ">=": 5, "[]": 9, "*": 20, "[?": 21, ".": 40, "[": 55, "{": 50, "(": 60}


class PathError(ValueError):
    pass


@dataclass
class Node:
    kind: str
    args: tuple = ()


class Parser:
    """Top-down operator precedence, after the grammar of the public specification."""

    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise PathError(f"{text!r}: unexpected {text[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.tokens.append(("end", ""))
        self.at, self.text = 0, text

    @property
    def now(self) -> tuple[str, str]:
        return self.tokens[self.at]

    def take(self, value: str | None = None) -> tuple[str, str]:
        t = self.now
        if value is not None and t[1] != value:
            raise PathError(f"{self.text!r}: expected {value!r}, found {t[1]!r}")
        self.at += 1
        return t

    def parse(self) -> Node:
        if self.now[0] == "end":
            raise PathError("empty path")
        node = self.expression(0)
        if self.now[0] != "end":
            raise PathError(f"{self.text!r}: unexpected {self.now[1]!r}")
        return node

    def expression(self, power: int) -> Node:
        left = self.prefix()
        while self.now[0] == "op" and power < _BIND.get(self.now[1], 0):
            left = self.infix(left)
        return left

    def prefix(self) -> Node:
        kind, value = self.take()
        if kind == "lit":
            body = value[1:-1].replace("\\`", "`")
            try:
                return Node("literal", (json.loads(body),))
            except ValueError:
                return Node("literal", (body.strip(),))
        if kind == "raw":
            return Node("literal", (value[1:-1].replace("\\'", "'"),))
        if kind == "quoted":
            return Node("field", (json.loads(value),))
        if kind == "name":
            if self.now[1] == "(":
                return self.call(value)
            return Node("field", (value,))
        if value == "@":
            return Node("current")
        if value == "!":
            return Node("not", (self.expression(45),))
        if value == "(":
            inner = self.expression(0)
            self.take(")")
            return inner
        if value == "&":
            return Node("reference", (self.expression(0),))
        if value == "*":
            return Node("values", (Node("current"), self.right(20)))
        if value == "[]":
            return Node("project", (Node("flatten", (Node("current"),)), self.right(9)))
        if value == "[?":
            return self.filter(Node("current"))
        if value == "{":
            return self.hash()
        if value == "[":
            if self.now[0] == "num" or self.now[1] in (":", "*"):
                if self.now[1] != "*" or self.tokens[self.at + 1][1] == "]":
                    return self.bracket(Node("current"))
            return self.list()
        raise PathError(f"{self.text!r}: unexpected {value!r}")

    def infix(self, left: Node) -> Node:
        op = self.take()[1]
        if op == ".":
            if self.now[1] == "*":
                self.take()
                return Node("values", (left, self.right(20)))
            return Node("sub", (left, self.after_dot(40)))
        if op == "|":
            return Node("sub", (left, self.expression(1)))
        if op in ("||", "&&"):
            return Node(op, (left, self.expression(_BIND[op])))
        if op in ("==", "!=", "<", "<=", ">", ">="):
            return Node("compare", (op, left, self.expression(5)))
        if op == "[]":
            return Node("project", (Node("flatten", (left,)), self.right(9)))
        if op == "[?":
            return self.filter(left)
        if op == "[":
            return self.bracket(left)
        raise PathError(f"{self.text!r}: unexpected {op!r}")

    def after_dot(self, power: int) -> Node:
        value = self.now[1]
        if self.now[0] in ("name", "quoted"):
            return self.expression(power)
        if value == "{":
            self.take()
            return self.hash()
        if value == "[":
            self.take()
            return self.list()
        raise PathError(f"{self.text!r}: unexpected {value!r} after a dot")

    def right(self, power: int) -> Node:
        """What a projection applies to each element."""
        value = self.now[1]
        if _BIND.get(value, 0) < 10 or self.now[0] == "end":
            return Node("current")
        if value == ".":
            self.take()
            if self.now[1] == "*":
                self.take()
                return Node("values", (Node("current"), self.right(20)))
            return self.after_dot(power)
        if value in ("[", "[?"):
            return self.expression(power)
        raise PathError(f"{self.text!r}: unexpected {value!r} after a projection")

    def filter(self, left: Node) -> Node:
        condition = self.expression(0)
        self.take("]")
        return Node("project", (Node("filter", (left, condition)), self.right(21)))

    def bracket(self, left: Node) -> Node:
        if self.now[1] == "*":
            self.take()
            self.take("]")
            return Node("project", (left, self.right(20)))
        parts: list[int | None] = [None]
        while self.now[1] != "]":
            kind, value = self.take()
            if value == ":":
                parts.append(None)
            elif kind == "num":
                parts[-1] = int(value)
            else:
                raise PathError(f"{self.text!r}: unexpected {value!r} in brackets")
        self.take("]")
        if len(parts) == 1:
            return Node("index", (left, parts[0]))
        return Node("project", (Node("slice", (left, *(parts + [None])[:3])), self.right(20)))

    def list(self) -> Node:
        items = [self.expression(0)]
        while self.now[1] == ",":
            self.take()
            items.append(self.expression(0))
        self.take("]")
        return Node("list", tuple(items))

    def hash(self) -> Node:
        items = []
        while True:
            kind, key = self.take()
            if kind not in ("name", "quoted"):
                raise PathError(f"{self.text!r}: {key!r} can't be a key")
            self.take(":")
            items.append((json.loads(key) if kind == "quoted" else key, self.expression(0)))
            if self.take()[1] == "}":
                return Node("hash", tuple(items))

    def call(self, name: str) -> Node:
        self.take("(")
        args = []
        while self.now[1] != ")":
            args.append(self.expression(0))
            if self.now[1] == ",":
                self.take()
        self.take(")")
        return Node("call", (name, *args))


@dataclass
class Value:
    """A column and its type. Literal null has the void type."""

    c: Column
    t: T.DataType


NULL = T.NullType()
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _null() -> Value:
    return Value(F.lit(None), NULL)


def is_number(t: T.DataType) -> bool:
    return isinstance(t, NUMERIC)


VARIANT = T.VariantType()


def is_open(v: Value) -> bool:
    """Whether the type is known only from value to value."""
    return isinstance(v.t, T.VariantType)


def _kind(c: Column) -> Column:
    """The type name of a variant, without what is inside it."""
    return F.regexp_extract(F.schema_of_variant(c), r"^[A-Z]+", 0)


def part(c: Column, path: str) -> Value:
    """A part of a variant; null where it is absent, and where it is null in the JSON text."""
    found = F.try_variant_get(c, path, "variant")
    return Value(F.when(~F.is_variant_null(found), found), VARIANT)


def array_of(v: Value) -> Value:
    """A variant as an array of variants where it is an array; other values as they are."""
    return Value(F.try_variant_get(v.c, "$", "array<variant>"), T.ArrayType(VARIANT)) if is_open(v) else v


def object_of(v: Value) -> Value:
    return Value(F.try_variant_get(v.c, "$", "map<string, variant>"), T.MapType(T.StringType(), VARIANT)) if is_open(v) else v


def number_of(v: Value) -> Column:
    """The number that a value is (not a text of one) as a double, else null."""
    if is_open(v):
        return F.when(_kind(v.c).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "TINYINT", "SMALLINT", "INT"), F.try_variant_get(v.c, "$", "double"))
    return v.c.cast("double") if is_number(v.t) else F.lit(None).cast("double")


def string_of(v: Value) -> Column:
    """The string that a value is, else null."""
    if is_open(v):
        return F.when(_kind(v.c) == "STRING", F.try_variant_get(v.c, "$", "string"))
    return v.c if isinstance(v.t, T.StringType) else F.lit(None).cast("string")


def boolean_of(v: Value) -> Column:
    if is_open(v):
        return F.when(_kind(v.c) == "BOOLEAN", F.try_variant_get(v.c, "$", "boolean"))
    return v.c if isinstance(v.t, T.BooleanType) else F.lit(None).cast("boolean")


def truthy(v: Value) -> Column:
    """JMESPath truth: null, false, empty strings, arrays and objects are false."""
    if is_open(v):
        kind = _kind(v.c)
        some = F.when(kind == "BOOLEAN", boolean_of(v)).when(kind == "STRING", string_of(v) != "").when(kind == "ARRAY", F.size(array_of(v).c) > 0).when(kind == "OBJECT", F.size(object_of(v).c) > 0).otherwise(v.c.isNotNull())
        return F.coalesce(some, F.lit(False))
    if isinstance(v.t, T.BooleanType):
        return F.coalesce(v.c, F.lit(False))
    if isinstance(v.t, T.StringType):
        return F.coalesce(v.c != "", F.lit(False))
    if isinstance(v.t, (T.ArrayType, T.MapType)):
        return F.coalesce(F.size(v.c) > 0, F.lit(False))
    return F.lit(False) if isinstance(v.t, T.NullType) else v.c.isNotNull()


def text(v: Value) -> Column:
    """Strings as they are, all else as JSON text."""
    if isinstance(v.t, T.StringType):
        return v.c
    if isinstance(v.t, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(v.c)
    if isinstance(v.t, (T.DoubleType, T.FloatType)):
        return number_text(v.c)
    return v.c.cast("string")


def number_text(c: Column) -> Column:
    """Text of a double or float as SQL has it: plain digits from 0.0001 to below 1e16 (Spark's own cast changes to E outside of 0.001 to 1e7),
    else a signed exponent of two digits. The digits are those of the cast; Java 17 gives very few numbers one digit more than they need."""
    s, size = c.cast("string"), F.abs(c)
    plain = F.regexp_replace(F.regexp_replace(s.try_cast("decimal(38,21)").cast("string"), "0+$", ""), r"\.$", ".0")
    power = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"(\.0)?E", "e"), r"e(\d)", "e+$1"), r"([+-])(\d)$", "$10$2")
    return F.when(~F.contains(s, F.lit("E")), s).when((size >= 1e-4) & (size < 1e16), plain).otherwise(power)


class Compiler:
    """Compiles nodes against a root. `root` is a struct type whose fields are columns, or any value."""

    def compile(self, node: Node, at: Value | T.StructType) -> Value:
        return getattr(self, "_" + {"||": "or", "&&": "and"}.get(node.kind, node.kind))(at, *node.args)

    def _literal(self, at, value) -> Value:
        if value is None:
            return _null()
        if isinstance(value, bool):
            return Value(F.lit(value), T.BooleanType())
        if isinstance(value, int):
            return Value(F.lit(value).cast("long"), T.LongType())
        if isinstance(value, float):
            return Value(F.lit(value), T.DoubleType())
        if isinstance(value, str):
            return Value(F.lit(value), T.StringType())
        if isinstance(value, list):
            return self._join_list([self._literal(at, x) for x in value])
        return self._struct([(k, self._literal(at, x)) for k, x in value.items()])

    def _current(self, at) -> Value:
        if isinstance(at, T.StructType):
            return Value(F.struct(*[F.col(f"`{f.name}`") for f in at.fields]), at)
        return at

    def _field(self, at, name) -> Value:
        if isinstance(at, T.StructType):
            if name in at.names:
                return Value(F.col(f"`{name}`"), at[name].dataType)
            return _null()
        if isinstance(at.t, T.StructType) and name in at.t.names:
            return Value(at.c.getField(name), at.t[name].dataType)
        if isinstance(at.t, T.MapType):
            return Value(F.try_element_at(at.c, F.lit(name)), at.t.valueType)
        if is_open(at) and "'" not in name:
            return part(at.c, f"$['{name}']")
        return self._field(object_of(at), name) if is_open(at) else _null()

    def _sub(self, at, left, right) -> Value:
        return self.compile(right, self.compile(left, at))

    def _index(self, at, left, k) -> Value:
        v = array_of(self.compile(left, at))
        if not isinstance(v.t, T.ArrayType):
            return _null()
        return Value(F.try_element_at(v.c, F.lit(k + 1 if k >= 0 else k)), v.t.elementType)

    def _slice(self, at, left, a, b, step) -> Value:
        v = array_of(self.compile(left, at))
        if not isinstance(v.t, T.ArrayType):
            return _null()
        step = 1 if step is None else step
        if step == 0:
            raise PathError("a slice's step can't be 0")
        n = F.size(v.c)

        def bound(x: int | None, low: Column, high: Column, default: Column) -> Column:
            if x is None:
                return default
            return F.greatest(low, F.least(high, F.lit(x) if x >= 0 else n + x))

        zero, minus = F.lit(0), F.lit(-1)
        if step > 0:
            first, last = bound(a, zero, n, zero), bound(b, zero, n, n)
            places = F.when(first < last, F.sequence(first, last - 1, F.lit(step)))
        else:
            first, last = bound(a, minus, n - 1, n - 1), bound(b, minus, n - 1, minus)
            places = F.when(first > last, F.sequence(first, last + 1, F.lit(step)))
        none = F.array().cast(v.t)
        return Value(F.when(v.c.isNotNull(), F.coalesce(F.transform(places, lambda i: F.get(v.c, i)), none)), v.t)

    def _project(self, at, left, right) -> Value:
        v = array_of(self.compile(left, at))
        if not isinstance(v.t, T.ArrayType):
            return _null()
        kind: list[T.DataType] = []

        def each(x: Column) -> Column:
            y = self.compile(right, Value(x, v.t.elementType))
            kind.append(y.t)
            return y.c

        c = v.c if right.kind == "current" else F.transform(v.c, each)
        t = kind[0] if kind else v.t.elementType
        return Value(F.filter(c, lambda x: x.isNotNull()), T.ArrayType(t))

    def _values(self, at, left, right) -> Value:
        v = object_of(self.compile(left, at))
        if isinstance(v.t, T.MapType):
            items = Value(F.map_values(v.c), T.ArrayType(v.t.valueType))
        elif isinstance(v.t, T.StructType) and v.t.fields:
            items = self._join_list([Value(v.c.getField(f.name), f.dataType) for f in v.t.fields])
        else:
            return _null()
        return self._project(items, Node("current"), right)

    def _flatten(self, at, left) -> Value:
        v = array_of(self.compile(left, at))
        if not isinstance(v.t, T.ArrayType):
            return _null()
        if isinstance(v.t.elementType, T.VariantType):  # elements that are no arrays stay
            inner = F.transform(F.filter(v.c, lambda x: x.isNotNull()), lambda x: F.coalesce(array_of(Value(x, VARIANT)).c, F.array(x)))
            return Value(F.flatten(inner), v.t)
        if isinstance(v.t.elementType, T.ArrayType):
            return Value(F.flatten(F.filter(v.c, lambda x: x.isNotNull())), v.t.elementType)
        return v

    def _filter(self, at, left, condition) -> Value:
        v = array_of(self.compile(left, at))
        if not isinstance(v.t, T.ArrayType):
            return _null()
        return Value(F.filter(v.c, lambda x: truthy(self.compile(condition, Value(x, v.t.elementType)))), v.t)

    def _list(self, at, *items) -> Value:
        found = [self.compile(i, at) for i in items]
        whole = self._current(at).c
        out = self._join_list(found)
        return Value(F.when(whole.isNotNull(), out.c), out.t)

    def _hash(self, at, *items) -> Value:
        whole = self._current(at).c
        out = self._struct([(k, self.compile(n, at)) for k, n in items])
        return Value(F.when(whole.isNotNull(), out.c), out.t)

    def _struct(self, items: list[tuple[str, Value]]) -> Value:
        items = [(k, v if not isinstance(v.t, T.NullType) else Value(F.lit(None).cast("string"), T.StringType())) for k, v in items]
        return Value(F.struct(*[v.c.alias(k) for k, v in items]), T.StructType([T.StructField(k, v.t) for k, v in items]))

    def _join_list(self, found: list[Value]) -> Value:
        """An array of one type: numbers as doubles, mixed types as text."""
        kinds = {v.t.simpleString() for v in found if not isinstance(v.t, T.NullType)}
        if not kinds:
            return Value(F.array(*[F.lit(None).cast("string") for _ in found]), T.ArrayType(T.StringType()))
        if len(kinds) == 1:
            t = next(v.t for v in found if not isinstance(v.t, T.NullType))
            return Value(F.array(*[v.c.cast(t) if isinstance(v.t, T.NullType) else v.c for v in found]), T.ArrayType(t))
        if all(is_number(v.t) or isinstance(v.t, T.NullType) for v in found):
            return Value(F.array(*[v.c.cast("double") for v in found]), T.ArrayType(T.DoubleType()))
        return Value(F.array(*[text(v) if not isinstance(v.t, T.NullType) else v.c.cast("string") for v in found]), T.ArrayType(T.StringType()))

    def _not(self, at, node) -> Value:
        return Value(~truthy(self.compile(node, at)), T.BooleanType())

    def _same(self, a: Value, b: Value, of_a: Column, of_b: Column) -> Value:
        t = a.t if not isinstance(a.t, T.NullType) else b.t
        if a.t != b.t and not isinstance(a.t, T.NullType) and not isinstance(b.t, T.NullType):
            both = is_number(a.t) and is_number(b.t)
            return Value(F.coalesce(of_a.cast("double"), of_b.cast("double")) if both else F.coalesce(of_a.cast("string"), of_b.cast("string")), T.DoubleType() if both else T.StringType())
        return Value(F.coalesce(of_a, of_b), t)

    def _or(self, at, left, right) -> Value:
        a, b = self.compile(left, at), self.compile(right, at)
        return self._same(a, b, F.when(truthy(a), a.c), F.when(~truthy(a), b.c))

    def _and(self, at, left, right) -> Value:
        a, b = self.compile(left, at), self.compile(right, at)
        return self._same(a, b, F.when(~truthy(a), a.c), F.when(truthy(a), b.c))

    def _compare(self, at, op, left, right) -> Value:
        a, b = self.compile(left, at), self.compile(right, at)
        boolean = T.BooleanType()
        if is_open(a) or is_open(b):
            return Value(self._compare_open(op, a, b), boolean)
        if op in ("==", "!="):
            if isinstance(a.t, T.NullType) or isinstance(b.t, T.NullType):
                same = (a if isinstance(b.t, T.NullType) else b).c.isNull()
            elif is_number(a.t) and is_number(b.t):
                same = a.c.cast("double").eqNullSafe(b.c.cast("double"))
            elif type(a.t) is type(b.t):
                same = a.c.eqNullSafe(b.c) if not isinstance(a.t, (T.StructType, T.MapType, T.ArrayType)) else F.to_json(a.c).eqNullSafe(F.to_json(b.c))
            else:  # values of different types are equal only where both are null
                same = a.c.isNull() & b.c.isNull()
            return Value(same if op == "==" else ~same, boolean)
        if not (is_number(a.t) and is_number(b.t)):
            return Value(F.lit(None).cast("boolean"), boolean)
        x, y = a.c.cast("double"), b.c.cast("double")
        return Value({"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], boolean)

    def _compare_open(self, op: str, a: Value, b: Value) -> Column:
        x, y = number_of(a), number_of(b)
        if op not in ("==", "!="):
            return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        if isinstance(a.t, T.NullType) or isinstance(b.t, T.NullType):
            same = (a if isinstance(b.t, T.NullType) else b).c.isNull()
        else:  # numbers by value, all else by kind and JSON text
            same = F.when(a.c.isNull() | b.c.isNull(), a.c.isNull() & b.c.isNull()).when(x.isNotNull() | y.isNotNull(), F.coalesce(x == y, F.lit(False)))
            same = same.otherwise(string_of(a).isNull().eqNullSafe(string_of(b).isNull()) & (text(a) == text(b)))
        return same if op == "==" else ~same

    def _reference(self, at, node) -> Value:
        raise PathError("an expression reference stands only in a function's arguments")

    def _call(self, at, name, *args) -> Value:
        if name in ("map", "sort_by", "max_by", "min_by"):
            ref, over = (args[0], args[1]) if name == "map" else (args[1], args[0])
            v, ref = array_of(self.compile(over, at)), ref.args[0]
            if not isinstance(v.t, T.ArrayType):
                return _null()
            if name == "map":
                kind: list[T.DataType] = []

                def each(x: Column) -> Column:
                    y = self.compile(ref, Value(x, v.t.elementType))
                    kind.append(y.t)
                    return y.c

                c = F.transform(v.c, each)
                return Value(c, T.ArrayType(kind[0]))
            key = lambda x: self.compile(ref, Value(x, v.t.elementType)).c
            rows = F.array_sort(F.transform(v.c, lambda x, i: F.struct(key(x).alias("k"), (i if name != "max_by" else -i).alias("i"), x.alias("x"))))
            if name == "sort_by":
                return Value(F.transform(rows, lambda r: r["x"]), v.t)
            return Value(F.try_element_at(rows, F.lit(1 if name == "min_by" else -1))["x"], v.t.elementType)
        v = [self.compile(a, at) for a in args]
        d, s, b = T.DoubleType(), T.StringType(), T.BooleanType()
        x = v[0] if v else _null()
        if is_open(x):
            if name == "length":
                return Value(F.coalesce(F.char_length(string_of(x)), F.size(array_of(x).c), F.size(object_of(x).c)).cast("long"), T.LongType())
            if name == "type":
                kind = F.when(string_of(x).isNotNull(), "string").when(number_of(x).isNotNull(), "number").when(boolean_of(x).isNotNull(), "boolean").when(_kind(x.c) == "ARRAY", "array").otherwise("object")
                return Value(F.when(x.c.isNull(), "null").otherwise(kind), s)
            if name == "to_number":
                return Value(F.coalesce(number_of(x), string_of(x).try_cast("double")), d)
            if name == "contains":
                return Value(F.coalesce(F.contains(string_of(x), text(v[1])), F.exists(array_of(x).c, lambda y: self._compare_open("==", Value(y, VARIANT), v[1]))), b)
            if name in ("starts_with", "ends_with"):
                x = Value(string_of(x), s)
            elif name in ("abs", "ceil", "floor"):
                x = Value(number_of(x), d)
            elif name in ("keys", "values", "merge"):
                x = object_of(x)
            elif name not in ("to_string", "not_null", "to_array", "join"):
                x = array_of(x)
        arr = isinstance(x.t, T.ArrayType)
        if arr and isinstance(x.t.elementType, T.VariantType) and name in ("sum", "avg", "max", "min", "sort"):
            x = Value(F.filter(F.transform(x.c, lambda y: number_of(Value(y, VARIANT))), lambda y: y.isNotNull()), T.ArrayType(d))
        if name in ("abs", "ceil", "floor"):
            return Value(getattr(F, name)(x.c.cast("double")), d) if is_number(x.t) else _null()
        if name in ("sum", "avg"):
            if not arr:
                return _null()
            total = F.aggregate(x.c, F.lit(0.0), lambda a, y: a + y.cast("double"))
            return Value(total if name == "sum" else F.when(F.size(x.c) > 0, total / F.size(x.c)), d)
        if name in ("max", "min"):
            return Value((F.array_max if name == "max" else F.array_min)(x.c), x.t.elementType) if arr else _null()
        if name == "length":
            if isinstance(x.t, T.StringType):
                return Value(F.char_length(x.c).cast("long"), T.LongType())
            if isinstance(x.t, T.StructType):
                return Value(F.lit(len(x.t.fields)).cast("long"), T.LongType())
            return Value(F.when(x.c.isNotNull(), F.size(x.c)).cast("long"), T.LongType()) if isinstance(x.t, (T.ArrayType, T.MapType)) else _null()
        if name == "contains":
            if isinstance(x.t, T.StringType):
                return Value(F.contains(x.c, text(v[1])), b)
            return Value(F.array_contains(x.c, v[1].c.cast(x.t.elementType)), b) if arr else _null()
        if name in ("starts_with", "ends_with"):
            return Value((F.startswith if name == "starts_with" else F.endswith)(x.c, v[1].c), b) if isinstance(x.t, T.StringType) else _null()
        if name == "join":
            return Value(F.array_join(v[1].c, args[0].args[0]), s) if isinstance(v[1].t, T.ArrayType) else _null()
        if name == "reverse":
            return Value(F.reverse(x.c), x.t)
        if name == "sort":
            return Value(F.array_sort(x.c), x.t) if arr else _null()
        if name in ("keys", "values"):
            if isinstance(x.t, T.MapType):
                return Value(F.map_keys(x.c), T.ArrayType(s)) if name == "keys" else Value(F.map_values(x.c), T.ArrayType(x.t.valueType))
            if isinstance(x.t, T.StructType):
                return Value(F.array(*[F.lit(n) for n in x.t.names]), T.ArrayType(s)) if name == "keys" else self._join_list([Value(x.c.getField(f.name), f.dataType) for f in x.t.fields])
            return _null()
        if name == "merge":
            fields: dict[str, Value] = {}
            for o in v:
                fields |= {f.name: Value(o.c.getField(f.name), f.dataType) for f in (o.t.fields if isinstance(o.t, T.StructType) else [])}
            return self._struct(list(fields.items()))
        if name == "not_null":
            out = v[0]
            for o in v[1:]:
                out = self._same(out, o, out.c, o.c)
            return out
        if name == "to_array":
            return x if arr else Value(F.array(x.c), T.ArrayType(x.t))
        if name == "to_number":
            return Value(x.c.try_cast("double"), d) if is_number(x.t) or isinstance(x.t, T.StringType) else _null()
        if name == "to_string":
            return Value(text(x), s)
        if name == "type":
            kind = "number" if is_number(x.t) else {T.StringType: "string", T.BooleanType: "boolean", T.ArrayType: "array", T.StructType: "object", T.MapType: "object"}.get(type(x.t), "string")
            return Value(F.when(x.c.isNull(), "null").otherwise(kind), s)
        raise PathError(f"no function {name}")


def compile_path(path: str, schema: T.StructType) -> Value:
    return Compiler().compile(Parser(path).parse(), schema)
