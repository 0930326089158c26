"""Names, arguments and functions of all operators."""

from __future__ import annotations

import argparse
import shlex
from collections.abc import Callable
from dataclasses import dataclass
from types import SimpleNamespace

from brookline.plans.frame import Events


class UsageError(ValueError):
    pass


class _Arguments(argparse.ArgumentParser):
    def error(self, message: str):
        raise UsageError(f"{self.prog}: {message}")


@dataclass
class Operator:
    names: tuple[str, ...]
    run: Callable
    parser: argparse.ArgumentParser
    kind: str = "step"  # source, step or sink
    predicate: Callable | None = None  # (scope, args) -> condition
    scalar: Callable | None = None  # (scope, args) -> (label, Value)
    help: str = ""


OPERATORS: dict[str, Operator] = {}


def arg(*names: str, **options) -> tuple[tuple[str, ...], dict]:
    return names, options


def words(name: str, optional: bool = False):
    """Positional words that make one path, joined by spaces."""
    return arg(name, nargs="*" if optional else "+")


def operator(*names: str, args: tuple = (), kind: str = "step", predicate: Callable | None = None, scalar: Callable | None = None):
    def register(run: Callable) -> Callable:
        parser = _Arguments(prog=names[0], add_help=False, allow_abbrev=False, conflict_handler="resolve")
        for n, o in args:
            parser.add_argument(*n, **o)
        op = Operator(names, run, parser, kind, predicate, scalar, (run.__doc__ or "").strip())
        for n in names:
            if n in OPERATORS:
                raise ValueError(f"{n} is registered twice")
            OPERATORS[n] = op
        return run

    return register


#: Paths given as several words are joined; lists of other things are not.
_LISTS = {"match", "pattern", "value", "keys", "labels", "rules", "position", "types", "pairs", "command", "tags", "files", "output_tag"}


def parse(op: Operator, tokens: list[str]) -> SimpleNamespace:
    head, tail = (tokens[: tokens.index("--")], tokens[tokens.index("--") + 1 :]) if "--" in tokens else (tokens, [])
    rest = any(x.nargs == argparse.REMAINDER for x in op.parser._actions)
    a = vars(op.parser.parse_args(head) if rest else op.parser.parse_intermixed_args(head))
    if tail:
        a["command"] = tail
    return SimpleNamespace(**{k: " ".join(v) if isinstance(v, list) and k not in _LISTS else v for k, v in a.items()})


def find(name: str) -> Operator:
    if name not in OPERATORS:
        raise UsageError(f"no operator {name!r}")
    return OPERATORS[name]


def call(ev, name: str, *args, **options) -> Events:
    """Run an operator: either a command line in one string (`"value -k user_id"`), or positional words and options by name."""
    op = find(name)
    if len(args) == 1 and not options and isinstance(args[0], str):
        return op.run(ev, parse(op, shlex.split(args[0])))
    tokens = [str(a) for a in args]
    dests = {x.dest: x for x in op.parser._actions}
    for k, v in options.items():
        if k not in dests:
            raise UsageError(f"{name}: no option {k!r}")
        action = dests[k]
        flag = action.option_strings[-1] if action.option_strings else None
        many = v if isinstance(v, (list, tuple)) else [v]
        if flag is None:
            tokens += [str(x) for x in many]
        elif isinstance(action, argparse._StoreTrueAction):
            tokens += [flag] if v else []
        elif action.nargs in ("+", "*"):
            tokens += [flag, *map(str, many)]
        else:
            for x in many:
                tokens += [f"{flag}={x}" if flag.startswith("--") else flag + str(x)]
    return op.run(ev, parse(op, tokens))
