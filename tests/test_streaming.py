"""Streaming forms over two micro-batches, and sources that are polled."""

import json
import os
from datetime import UTC, datetime

import pytest

from brookline.plans.language import run
from brookline.sources.clients import acknowledge, register_client
from brookline.streaming import keyed

BASE = 1_700_000_040_000
ROWS = [("a", 1.0, 1000, "on"), ("a", 3.0, 4000, "off"), ("b", 5.0, 2000, "on"), ("a", 2.0, 9000, "off"), ("a", 8.0, 60000, "on"), ("b", None, 61000, "on"), ("b", 10.0, 400000, "off")]


@pytest.fixture
def stream(spark, tmp_path):
    for k, part in enumerate((ROWS[:3], ROWS[3:])):
        path = tmp_path / f"{k}.json"
        path.write_text("".join(json.dumps({"n": k * 3 + j, "k": r[0], "v": r[1], "t": BASE + r[2], "at": datetime.fromtimestamp((BASE + r[2]) / 1000, UTC).isoformat(), "s": r[3]}) + "\n" for j, r in enumerate(part)))
        os.utime(path, (k + 1e9, k + 1e9))  # the order of the files
    return spark.readStream.schema("n long, k string, v double, t long, at string, s string").option("maxFilesPerTrigger", 1).json(str(tmp_path))


def finish(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return [r.asDict() for r in spark.table(name).collect()]


def test_running_values(spark, stream):
    got = finish(spark, keyed.keycount(stream, "k", order="n"), "s_count")
    assert sorted((r["k"], r["n"], r["count"]) for r in got) == [("a", 0, 1), ("a", 1, 2), ("a", 3, 3), ("a", 4, 4), ("b", 2, 1), ("b", 5, 2), ("b", 6, 3)]
    got = finish(spark, keyed.diff(stream, "k", "v", order="n"), "s_diff")
    assert {r["n"]: r["v_diff"] for r in got} == {0: None, 1: 2.0, 2: None, 3: -1.0, 4: 6.0, 5: None, 6: 5.0}


def test_times_between_events(spark, stream):
    got = finish(spark, keyed.timedelta(stream, "k", "at", order="n"), "s_delta")
    assert {r["n"]: r["time_delta_milliseconds"] for r in got} == {1: 3000, 3: 5000, 4: 51000, 5: 59000, 6: 339000}
    got = finish(spark, keyed.state_delta(stream, "k", "s", "at", order="n"), "s_state")
    assert {r["n"]: (r["previous_state"], r["current_state"], r["state_transition_delta_milliseconds"]) for r in got} == {1: ("on", "off", 3000), 4: ("off", "on", 51000), 6: ("on", "off", 339000)}


def test_windows(spark, stream):
    got = finish(spark, keyed.sessions(stream, "t", "30s", key="k"), "s_sessions")
    assert sorted((r["key"], r["count"], r["duration"]) for r in got) == [("a", 1, 0), ("a", 3, 8), ("b", 1, 0), ("b", 1, 0)]
    got = finish(spark, keyed.window(stream, "t", "1m", "30s"), "s_sliding")
    assert {r["window_start"][11:19]: r["count"] for r in got} == {"22:13:30": 4, "22:14:00": 4, "22:14:30": 2, "22:15:00": 2}


class Queue:
    waiting, deleted = [], []

    def receive(self, wait):
        found, Queue.waiting = Queue.waiting[:4], Queue.waiting[4:]
        return found

    def delete(self, receipts):
        Queue.deleted += receipts


def test_messages_go_after_the_sinks(spark, tmp_path):
    register_client("queue", lambda name: Queue())
    Queue.waiting, Queue.deleted = [(json.dumps({"v": k}), f"r{k}", "0") for k in range(10)], []
    run(spark, f"sqs q -s m | select '{{v: m.v}}' | print -f {tmp_path}/out")
    assert sorted(Queue.deleted) == sorted(f"r{k}" for k in range(10))
    assert run(spark, f"json {tmp_path}/out").count() == 10
    Queue.waiting, Queue.deleted = [(json.dumps({"v": 1}), "x", "0")], []
    frame = run(spark, "sqs q -s m")
    assert frame.count() == 1 and Queue.deleted == []
    acknowledge()
    assert Queue.deleted == ["x"]


def test_refused_options(spark):
    from brookline.operators.registry import UsageError
    from brookline.plans.frame import events

    register_client("stream", lambda name: None)
    ev = events(spark.range(1))
    for name, text in (("kinesis_out", "s -p id"), ("sns", "t -s subject"), ("dynamodbput", "t --retry-backoff-ms 5")):
        with pytest.raises(UsageError, match="no support"):
            ev.apply(name, text)
