"""The pipeline language: `source | op args | op args ; $var | op ...` to a graph, and the graph to DataFrames.

Nothing runs while a graph is built. Pipes that end in one variable are united there; a variable that several
pipes read is planned into each of them, so that each reads only the columns and rows that it needs; sinks run one Spark action each.
"""

from __future__ import annotations

import os
import re
import textwrap
from dataclasses import dataclass, field
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import brookline.operators.load  # noqa: F401  registers all operators
from brookline.operators.registry import UsageError, find, parse
from brookline.plans.frame import SEQ, Events, events
from brookline.sources.clients import acknowledge

_TOKEN = re.compile(r"""[^\S\n]*(?:(?P<comment>\#[^\n;]*)|(?P<pipe>\|)|(?P<end>;|\n)|(?P<single>'[^']*')|(?P<double>"(?:\\.|[^"\\])*")|(?P<var>\$[A-Za-z_]\w*)|(?P<word>[^\s|;'"]+))""")


@dataclass
class Stage:
    name: str
    args: list[str]
    number: int
    inputs: list[Stage] = field(default_factory=list)
    outputs: list[Stage] = field(default_factory=list)

    @property
    def variable(self) -> bool:
        return self.name.startswith("$")


def substitute(text: str, env: dict[str, str] | None = None) -> str:
    """${NAME} from the environment; missing names are empty."""
    env = os.environ if env is None else env
    return re.sub(r"\$\{([A-Za-z_]\w*)\}", lambda m: env.get(m[1], ""), text)


def read_file(path: str) -> str:
    """Pipelines of a file: comment lines and blank ones go, a backslash at a line's end continues it."""
    with open(path, encoding="utf-8") as f:
        lines = [x.strip() for x in f]
    lines = [x for x in lines if x and not x.startswith(("#", "//"))]
    return ";".join("\n".join(lines).replace("\\\n", " ").split("\n"))


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            if not text[at:].strip():
                break
            raise UsageError(f"can't read {text[at:]!r}")
        at, kind = m.end(), m.lastgroup
        value = m[kind]
        if kind == "single":
            value, kind = value[1:-1], "word"
        elif kind == "double":
            value, kind = re.sub(r'\\(["\\])', r"\1", value[1:-1]), "word"
        if kind != "comment":
            out.append((kind, value))
    return out


def graph(text: str) -> list[Stage]:
    """All stages, connected; variables are stages without an operator."""
    stages: list[Stage] = []
    variables: dict[str, Stage] = {}
    line: list[Stage] = []
    now: list[tuple[str, str]] = []

    def close() -> None:
        if not now:
            raise UsageError("an empty stage")
        (kind, name), args = now[0], [v for _, v in now[1:]]
        if kind == "var":
            if args:
                raise UsageError(f"{name} takes no arguments")
            if name not in variables:
                variables[name] = Stage(name, [], len(stages))
                stages.append(variables[name])
            stage = variables[name]
        else:
            stage = Stage(name, args, len(stages))
            stages.append(stage)
        if line:
            line[-1].outputs.append(stage)
            stage.inputs.append(line[-1])
        line.append(stage)
        now.clear()

    for kind, value in [*tokens(text), ("end", ";")]:
        if kind == "pipe":
            close()
        elif kind == "end":
            if now:
                close()
            elif line:
                raise UsageError("a pipe leads nowhere")
            line.clear()
        else:
            now.append((kind, value))
    _no_cycles(stages)
    for s in stages:
        if s.variable and not s.inputs:
            raise UsageError(f"{s.name} is read and never written")
    return stages


def _no_cycles(stages: list[Stage]) -> None:
    state: dict[int, int] = {}

    def visit(s: Stage) -> None:
        if state.get(s.number) == 1:
            raise UsageError(f"{s.name} leads back to itself")
        if s.number not in state:
            state[s.number] = 1
            for o in s.outputs:
                visit(o)
            state[s.number] = 2

    for s in stages:
        visit(s)


def dot(text: str) -> str:
    """The graph in DOT, without variables."""
    stages = graph(text)

    def targets(s: Stage) -> list[Stage]:
        return [t for o in s.outputs for t in (targets(o) if o.variable else [o])]

    lines = ["digraph pipeline {", "  rankdir=TB;", "  node [shape=box];"]
    for s in (s for s in stages if not s.variable):
        label = "\\n".join([s.name, *textwrap.wrap(" ".join(s.args), 30)]).replace('"', '\\"')
        lines.append(f'  n{s.number} [label="{label}"];')
    lines += [f"  n{s.number} -> n{t.number};" for s in stages if not s.variable for t in targets(s)]
    return "\n".join([*lines, "}"])


def unite(streams: list[Events]) -> Events:
    """UNION ALL; fields that a stream lacks are null. Order: the streams one after another, each in its own order, also where they
    are branches of one source. The order keeps its type: streams whose orders have one type share a column of the order."""
    if len(streams) == 1:
        return streams[0]
    kinds: list[T.DataType] = []
    for s in streams:
        if (kind := s.df.schema[s.order].dataType) not in kinds:
            kinds.append(kind)

    def part(k: int, s: Events) -> DataFrame:
        own = kinds.index(s.df.schema[s.order].dataType)
        orders = [(s.seq() if j == own else F.lit(None).cast(kind)).alias(f"o{j}") for j, kind in enumerate(kinds)]
        order = F.struct(F.lit(k).alias("stream"), *orders)
        return s.df.select(*[F.col(f"`{c}`") for c in s.fields], order.alias(SEQ))

    parts = [part(k, s) for k, s in enumerate(streams)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return Events(out, SEQ)


class Pipeline:
    """A compiled text. run() gives the events of `acc` stages, or of all last stages that aren't sinks."""

    def __init__(self, text: str, env: dict[str, str] | None = None):
        self.text = substitute(text, env)
        self.stages = graph(self.text)
        for s in self.stages:
            if not s.variable:
                op = find(s.name)
                parse(op, s.args)
                if op.kind == "source" and s.inputs:
                    raise UsageError(f"{s.name} is a source and takes no input")

    def run(self, spark: SparkSession, given: DataFrame | Events | None = None, tables: dict[str, DataFrame | Events] | None = None, sinks: bool = True) -> DataFrame | None:
        """given: the events of pipes that start without a source, and of `lambda`. tables: more of them by name, as sources."""
        tables = tables or {}
        done: dict[int, Events] = {}
        given = events(given) if isinstance(given, DataFrame) else given

        def build(s: Stage) -> Events:
            if s.number in done:
                return done[s.number]
            inputs = [build(i) for i in s.inputs]
            if s.variable:
                out = unite(inputs)
            elif s.name in tables:
                t = tables[s.name]
                out = events(t) if isinstance(t, DataFrame) else t
            else:
                op = find(s.name)
                a = parse(op, s.args)
                if op.kind == "source":
                    out = op.run(spark, SimpleNamespace(**vars(a), given=given))
                else:
                    source = unite(inputs) if inputs else given
                    if source is None:
                        raise UsageError(f"{s.name} has no input")
                    if op.kind == "sink" and not sinks:
                        out = source
                    else:
                        out = op.run(source, a)
            done[s.number] = out
            return out

        last = [s for s in self.stages if not s.outputs]
        built = {s.number: build(s) for s in last}
        wanted = [s for s in self.stages if s.name == "acc"] or [s for s in last if s.variable or s.name in tables or find(s.name).kind != "sink"]
        if not wanted:
            acknowledge()  # all sinks have written
            return None
        return unite([built.get(s.number) or done[s.number] for s in wanted]).frame()

    def __call__(self, spark: SparkSession, given: DataFrame) -> DataFrame:
        return self.run(spark, given)


def run(spark: SparkSession, text: str, given: DataFrame | Events | None = None, **options) -> DataFrame | None:
    tables = options.get("tables") or {}
    if tables:
        names = set(tables)
        return _WithTables(text, names).run(spark, given, **options)
    return Pipeline(text).run(spark, given, **options)


class _WithTables(Pipeline):
    def __init__(self, text: str, names: set[str]):
        self.text = substitute(text)
        self.stages = graph(self.text)
        for s in self.stages:
            if not s.variable and s.name not in names:
                parse(find(s.name), s.args)
