"""Remote services behind plain interfaces: queues, streams, topics, SQL services, models.

The library has no vendor code. A factory that is registered under a kind gives a client object; it is called on
the executors for sinks (so it must be picklable) and on the driver for polls.

    queue:  receive(wait) -> list[(body, receipt, sent)], delete(receipts)
    stream, topic, table: send(list of strings or dicts)
    sql:    query(text) -> DataFrame
    model:  answer(prompt, event text) -> text
"""

from __future__ import annotations

from collections.abc import Callable

_factories: dict[str, Callable] = {}


def register_client(kind: str, factory: Callable) -> None:
    _factories[kind] = factory


def client_factory(kind: str) -> Callable:
    if kind not in _factories:
        raise LookupError(f"no client for {kind!r}: call register_client({kind!r}, factory)")
    return _factories[kind]


_read: list[tuple[str, list[str]]] = []


def delete_later(queue: str, receipts: list[str]) -> None:
    """Note messages that were read. They go when acknowledge() is called, so a run that fails gets them again."""
    _read.append((queue, receipts))


def acknowledge() -> None:
    """Delete the messages that were read. A pipeline that ends in sinks alone calls this when all have written; a caller that
    gets a frame calls it once the frame's rows are safe."""
    while _read:
        queue, receipts = _read[0]
        client_factory("queue")(queue).delete(receipts)
        _read.pop(0)
