"""Operators on small literals: nulls, types, ties and the rules that SQL doesn't show."""

import json

import pytest
from pyspark.sql import functions as F

import brookline
from brookline import OPERATORS, Pipeline, dot, events, run
from brookline.operators.registry import UsageError
from brookline.plans.frame import Events, in_ranges, numbered
from brookline.plans.language import graph, substitute, tokens, unite


def rows(ev):
    return [r.asDict(recursive=True) for r in ev.df.orderBy(ev.seq()).select(*[f"`{c}`" for c in ev.fields]).collect()]


def make(spark, data, schema):
    return events(spark.createDataFrame(data, schema).coalesce(1))


def test_registry():
    assert len(OPERATORS) >= 135
    assert all(o.help for o in OPERATORS.values())


@pytest.fixture(scope="module")
def values(spark):
    return make(spark, [("a", 10.0), ("b", 50.0), (None, 30.0), ("a", None), ("c", 40.0), ("a", 50.0)], "key string, value double")


@pytest.mark.parametrize(
    ("call", "left"),
    [
        ("numfilter value > 30", [50.0, 40.0, 50.0]), ("numfilter value between 10 30", [10.0, 30.0]), ("numfilter value > 30 -n", [50.0, None, 40.0, 50.0]), ("nummatch value -v 10 40", [10.0, 40.0]),
        ("nummatch value -v 10 40 -n", [50.0, 30.0, None, 50.0]), ("has_field value", [10.0, 50.0, 30.0, 40.0, 50.0]), ("match 'value == `50`'", [50.0, 50.0]), ("match value", []), ("uniq key", [10.0, 50.0, 40.0]),
        ("firstn key -n 2", [10.0, 50.0, None, 40.0]), ("aftern key -n 1", [None, 50.0]), ("contains key -m a c", [10.0, None, 40.0, 50.0]), ("contains key -m z -n", [30.0]), ("head -n 2", [10.0, 50.0]),
        ("sample -n 1 -k key", [10.0, 50.0, 40.0]), ("regexmatcher key -p '^[ab]$'", [10.0, 50.0, None, 50.0]), ("starts_with key -m b", [50.0]), ("top value -n 2", [50.0, 50.0]), ("numsort value", [10.0, 30.0, 40.0, 50.0, 50.0]),
    ],
)
def test_filters(values, call, left):
    name, _, rest = call.partition(" ")
    assert [r["value"] for r in rows(values.apply(name, rest))] == left


def test_running(values):
    assert [r["count"] for r in rows(values.apply("count", ""))] == [1, 2, 3, 4, 5, 6]
    assert [r["enumeration"] for r in rows(values.apply("enumerate", ""))] == [0, 1, 2, 3, 4, 5]
    assert [r["count"] for r in rows(values.apply("keycount", "key"))] == [1, 1, None, 2, 1, 3]
    assert [r["threshold_value"] for r in rows(values.apply("threshold", "key -v value -t 55"))] == [60.0]
    assert [r["threshold_value"] for r in rows(values.apply("threshold", "key -t 2 -r"))] == [2.0]


def test_diff(values):
    assert [r["value_diff"] for r in rows(values.apply("diff", "-k key -f value --previous"))] == [None, None, None, None, None, 40.0]
    assert [r["value_pct_change"] for r in rows(values.apply("diff", "-k key -f value --value 0"))] == [None] * 6


def test_keyed_totals(values):
    assert {r["key"]: r["count"] for r in rows(values.apply("sum", "value -k key"))} == {"a": 60.0, "b": 50.0, "c": 40.0}
    assert rows(values.apply("sum", "value"))[0] == {"key": "total", "count": 180.0}
    last = {r["key"]: r["value"] for r in rows(values.apply("lastn", "key"))}
    assert last == {"a": 50.0, "b": 50.0, "c": 40.0}


def test_rank_rules(spark):
    g = make(spark, [("g", v) for v in (100.0, 90.0, 90.0, 80.0)], "key string, value double")
    assert [r["rank"] for r in rows(g.apply("rank", "value -k key"))] == [1, 2, 2, 4]
    assert [r["rank"] for r in rows(g.apply("rank", "value -k key -d"))] == [1, 2, 2, 3]
    assert [r["rank"] for r in rows(g.apply("rank", "value -g --asc"))] == [4, 2, 2, 1]


def test_anomaly_percentile_histogram(spark):
    v = make(spark, [("g", x) for x in (10.0, 20.0, 30.0, 40.0, 100.0)], "key string, value double")
    odd = [r for r in rows(v.apply("anomaly", "value -k key --threshold 1.5")) if r["is_anomaly"]]
    assert [r["value"] for r in odd] == [100.0] and abs(odd[0]["anomaly_score"] - 1.897) < 1e-3
    ten = make(spark, [(float(x),) for x in range(1, 11)], "value double")
    p = rows(ten.apply("percentile", "value"))[0]["percentiles"]
    assert (p["min"], p["p50"], p["p100"]) == (1.0, 5.5, 10.0)
    h = rows(ten.apply("histogram", "value -b 2:8:3"))[0]["histogram"]["buckets"]
    assert h == {"<2": 1, "[2-5)": 3, "[5-8]": 4, ">8": 2}
    h = rows(make(spark, [(5.0,)] * 4, "value double").apply("histogram", "value -b quantile:4"))[0]["histogram"]["buckets"]
    assert list(h.values()) == [4] and next(iter(h)).startswith("<")


def test_strings(spark):
    s = make(spark, [("Hello World",), (None,), ("",)], "data string")
    get = lambda call, label: [r[label] for r in rows(s.apply(*call.split(" ", 1)))]
    assert get("upper data", "transformed") == ["HELLO WORLD", None, ""]
    assert get("transform data -f lo -t x", "transformed") == ["Hexxx Wxrxd", None, ""]
    assert get("transform data -f lo", "transformed") == ["He Wrd", None, ""]
    assert get("substring data -d 5", "substring") == ["Hello", None, None]
    assert get("substring data -d 5 -f", "substring") == ["World", None, None]
    assert get("substring data -d 3 -o 3 -f", "substring") == [" Wo", None, None]
    assert get("regex data -p '(W\\w+)' -c 1", "regex_extract") == ["World", None, None]
    d = make(spark, [("SGVsbG8gV29ybGQ=", "JBSWY3DPEBLW64TMMQ======", "48656c6c6f", "!!", "/////w==")], "b string, c string, h string, x string, bad string")
    out = d
    for k, m in (("b", "base64"), ("c", "base32"), ("h", "hex"), ("x", "base64"), ("bad", "base64")):
        out = out.apply("decode", f"{k} -m {m} -l {k}2")
    assert [rows(out)[0][f"{k}2"] for k in ("b", "c", "h", "x", "bad")] == ["Hello World", "Hello World", "Hello", None, None]
    u = make(spark, [("see http://example.com/path?x=a.b and ftp://h.org or HTTP://no.org",)], "t string")
    assert rows(u.apply("defang", "t"))[0]["defang"] == "see hxxp://example[.]com/path?x=a.b and fxp://h[.]org or HTTP://no.org"


def test_arrays(spark):
    a = make(spark, [(["x", "y"],), ([],), (None,), (["x", None],)], "tags array<string>")
    assert [r["joined"] for r in rows(a.apply("arrayjoiner", "tags -s ,"))] == ["x,y"]
    assert [r["joined"] for r in rows(a.apply("arrayjoiner", "tags -s , -p"))] == ["x,y", None, None, None]
    items = make(spark, [("p", [(1,), (None,), (3,)])], "account string, items array<struct<x: int>>")
    assert rows(items.apply("flatten", "items -p")) == [{"account": "p", "x": 1}, {"account": "p", "x": None}, {"account": "p", "x": 3}]
    assert rows(items.apply("filterarray", "items numfilter x > 1"))[0]["items"] == [{"x": 3}]
    assert rows(items.apply("apply", "items has_field x"))[0]["items"] == [{"x": 1}, {"x": 3}]
    assert "account" not in rows(items.apply("filterarray", "account has_field @"))[0]
    kv = make(spark, [([("a", 1), ("b", None), ("a", 3), (None, 4)],)], "e array<struct<label: string, value: int>>")
    assert rows(kv.apply("kvmap", "e"))[0]["transformed"] == {"a": 3}
    edges = make(spark, [([("A", "B"), ("B", "C"), ("D", "E")],), (None,)], "edges array<struct<parent: string, child: string>>")
    assert rows(edges.apply("components", "edges"))[0]["component_count"] == 2


def test_time(spark):
    t = make(spark, [("a", "2024-01-01T00:00:00Z"), ("a", "2024-01-01T00:00:30Z"), ("a", "bad"), ("b", None)], "key string, timestamp string")
    assert [r["time_delta_milliseconds"] for r in rows(t.apply("timedelta", "key"))] == [30000]
    assert [r["time_delta_milliseconds"] for r in rows(t.apply("timedelta", "key -e"))] == [0, 30000]
    b = make(spark, [("a", "2024-01-01T00:00:00Z"), ("a", "2024-01-01T00:01:00Z")], "key string, timestamp string")
    assert [r["group_length"] for r in rows(b.apply("burstgroup", "key -t timestamp -g 30 -o 1"))] == [1, 1]
    assert [r["group_length"] for r in rows(b.apply("burstgroup", "key -t timestamp -g 60 -o 1"))] == [2]


def test_windows_drop_late_events(spark):
    e = make(spark, [(0,), (3600,), (1800,), (7200,)], "t long")
    w = rows(e.apply("window", "t -w 1h"))
    assert sorted((r["window_start"], r["count"]) for r in w) == [("1970-01-01T00:00:00+00:00", 1), ("1970-01-01T01:00:00+00:00", 1), ("1970-01-01T02:00:00+00:00", 1)]
    w = rows(e.apply("window", "t -w 1h --allowed-lateness 30m"))
    assert sorted(r["count"] for r in w) == [1, 1, 2]
    s = rows(e.apply("window", "t --session-gap 1h --allowed-lateness 1h"))
    assert sorted((r["count"], r["duration"]) for r in s) == [(1, 0), (1, 0), (2, 0)] or sorted(r["count"] for r in s) == [1, 1, 2]
    u = rows(e.apply("window", "t -w 1d --emit on-update"))
    assert [r["count"] for r in u] == [1, 2, 3]


def test_pivot_and_join(spark, tmp_path):
    p = make(spark, [("1", "x", 0.9), ("1", "y", 0.8), ("2", "x", 0.5)], "account string, policy string, score double")
    assert sorted(map(repr, rows(p.apply("pivot", "-k account -c policy -v score --fill 0")))) == sorted(map(repr, [{"account": "1", "x": 0.9, "y": 0.8}, {"account": "2", "x": 0.5, "y": 0.0}]))
    ref = tmp_path / "ref.json"
    ref.write_text(json.dumps([{"account": "1", "region": "w"}, {"account": "1", "region": "e", "score": None}]))
    left = rows(p.apply("join", f"-k account -f {ref}"))
    assert [(r["region"]) for r in left] == ["e", "e", None]
    assert len(rows(p.apply("join", f"-k account -f {ref} --inner"))) == 2
    assert rows(p.apply("join", f"-k account -f {ref} --inner -s _r"))[0]["region_r"] == "e"
    base = tmp_path / "base.json"
    base.write_text(json.dumps({"1": 0.4}))
    assert [r["score_pct_change"] and round(r["score_pct_change"]) for r in rows(p.apply("diff", f"-k account -f score --baseline {base}"))] == [125, 100, None]


def test_paths(spark):
    df = spark.createDataFrame([({"b": "x"}, [3, 1, 2], [("p", 1), ("q", 5)], "s")], "m map<string, string>, a array<int>, o array<struct<n: string, v: int>>, s string")
    ev = events(df)
    cases = {
        "m.b": "x", "a[0]": 3, "a[-1]": 2, "a[1:]": [1, 2], "a[::-1]": [2, 1, 3], "a[?@ > `1`]": [3, 2], "o[*].n": ["p", "q"], "o[?v > `2`].n | [0]": "q", "sort(a)": [1, 2, 3], "max_by(o, &v).n": "q", "sort_by(o, &v)[0].n": "p",
        "length(a)": 3, "sum(a)": 6.0, "avg(a)": 2.0, "join('-', o[*].n)": "p-q", "contains(s, 's')": True, "not_null(zz, s)": "s", "type(a)": "array", "a[5]": None, "zz.y": None, "s == 's' && a[0] > `2`": True, "!s": False,
        "zz || s": "s", "to_number('12')": 12.0, "keys({x: s})": ["x"], "map(&v, o)": [1, 5], "starts_with(s, 's')": True, "{x: s, y: a[0]}.y": 3, "[s, m.b]": ["s", "x"], "a == `[3, 1, 2]`": True, "reverse(a)": [2, 1, 3], "ceil(`1.2`)": 2.0,
    }
    got = ev.df.select(*[ev.path(p).c.alias(f"c{k}") for k, p in enumerate(cases)]).first()
    assert {p: got[k] for k, p in enumerate(cases)} == cases


def test_language(spark):
    assert [v for _, v in tokens("a 'x | y' \"q\\\"r\" # note\n b")] == ["a", "x | y", 'q"r', "\n", "b"]
    assert substitute("${A}-${B}", {"A": "1"}) == "1-"
    with pytest.raises(UsageError):
        graph("$a | $b ; $b | $a")
    with pytest.raises(UsageError):
        Pipeline("nothing_of_this_name x")
    df = spark.range(6).withColumnRenamed("id", "n")
    out = run(spark, "head -n 6 | $a ; $a | match 'n > `3`' | $b ; $a | match 'n == `0`' | $b ; $b | acc", given=events(df, "n"))
    assert sorted(r["n"] for r in out.collect()) == [0, 4, 5]
    assert "n0 -> n2" in dot("gen -c 5 | $a ; $a | count")


def test_files(spark, tmp_path):
    lines = tmp_path / "in.json"
    lines.write_text('{"a": 1, "b": "x"}\n{"a": 2, "b": "keep"}\n')
    assert [r["a"] for r in run(spark, f"json {lines} -c keep").collect()] == [2]
    run(spark, f"json {lines} | print -f {tmp_path}/out -g")
    assert sorted(json.loads(r["value"])["a"] for r in spark.read.text(f"{tmp_path}/out").collect()) == [1, 2]
    run(spark, f"json {lines} | s3buffer {tmp_path}/buffer --compression gzip")
    assert spark.read.json(f"{tmp_path}/buffer").count() == 2
    table = tmp_path / "in.csv"
    table.write_text("x;y\n1;2\n")
    assert run(spark, f"csv {table} -d 59").collect()[0].asDict() == {"x": "1", "y": "2"}
    bad = tmp_path / "bad.json"
    bad.write_text('{"a": 1}\n{oops\n')
    with pytest.raises(Exception, match="(?i)malformed|corrupt"):
        run(spark, f"json {bad}").collect()
    named = make(spark, [(str(tmp_path), "in.json")], "bucket_name string, object_key string")
    assert sorted(r["a"] for r in rows(named.apply("s3event", ""))) == [1, 2]


def test_persistent_dedup(spark, tmp_path):
    e = make(spark, [("a",), ("b",), ("a",)], "id string")
    assert [r["id"] for r in rows(e.apply("dynamodbdedup", f"{tmp_path}/keys -k id"))] == ["a", "b"]
    again = make(spark, [("b",), ("c",)], "id string")
    assert [r["id"] for r in rows(again.apply("dynamodbdedup", f"{tmp_path}/keys -k id"))] == ["c"]


def test_exec(spark):
    e = make(spark, [("x",), (None,)], "a string")
    out = rows(e.apply("exec", "-p a -l o -- tr a-z A-Z"))
    assert [r["o"] for r in out] == ['"X"', None]
    assert rows(e.apply("exec", "-p a -- false")) == [{"a": None, "exec_output": None}]


def test_streams(spark, tmp_path):
    from brookline.streaming import keyed

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("".join(json.dumps({"k": k, "v": v}) + "\n" for k, v in [("a", 1.0), ("a", 2.0), ("b", 5.0), ("a", 3.0)]))
    stream = spark.readStream.schema("k string, v double").json(str(tmp_path / "in"))

    def finish(df, mode, name):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return [r.asDict() for r in spark.table(name).collect()]

    assert sorted(r["k"] for r in finish(keyed.uniq(stream, "k"), "append", "s_uniq")) == ["a", "b"]
    assert {r["key"]: r["count"] for r in finish(keyed.total(stream, "v", "k"), "complete", "s_total")} == {"a": 6.0, "b": 5.0}
    assert sorted(r["threshold_value"] for r in finish(keyed.threshold(stream, "k", 3.0, "v"), "append", "s_threshold")) == [3.0, 5.0, 6.0]


def test_package_names_every_operator():
    assert brookline.__all__


@pytest.mark.parametrize("call", ["numsort value", "numsort value -r", "sort name", "sort name -r"])
def test_positions_of_a_sort_over_partitions(spark, call):
    """A run of the plan samples its own ranges for a sort, and numbers take more than one run."""
    df = spark.range(60000, numPartitions=6).selectExpr("id", "CASE WHEN id = 77 THEN double('NaN') WHEN id % 500 = 3 THEN NULL ELSE double(id * 7919 % 997) END AS value", "concat('n', if(id % 2 = 0, '', 'é'), id * 7919 % 997) AS name")
    field, back = call.split()[1], call.endswith("-r")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["at"]: r["id"] for r in run(spark, f"rows | {call} | enumerate -l at", tables={"rows": events(df, "id")}).select("id", "at").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    kept = [(r["id"], r[field]) for r in df.collect() if r[field] is not None]
    kept.sort(key=lambda r: (r[1] != r[1], r[1] if r[1] == r[1] else 0) if field == "value" else r[1].encode(), reverse=back)  # stable
    assert [got.get(k) for k in range(len(kept))] == [k for k, _ in kept] and len(got) == len(kept)


def test_ranges_of_an_order_by_halving(spark):
    """Nulls are below and NaN above all bounds; a higher range never comes before a lower one, and few events share one."""
    df = spark.range(4000, numPartitions=4).selectExpr("CASE WHEN id % 100 = 0 THEN NULL WHEN id % 100 < 4 THEN double('NaN') ELSE double(id * 31 % 4000) END AS x", "id")
    ranged = in_ranges(Events(df.selectExpr("id", "struct(x, id) AS o"), "o"))
    assert "lambda" not in ranged._jdf.queryExecution().optimizedPlan().toString()  # no walk over all bounds
    rows = ranged.selectExpr("o.x AS x", "id", "__p").collect()
    rows.sort(key=lambda r: (r["x"] is not None, r["x"] != r["x"], r["x"] if r["x"] == r["x"] and r["x"] is not None else 0, r["id"]))
    places = [r["__p"] for r in rows]
    assert places == sorted(places) and len(set(places)) == 4


def test_union_of_shuffled_streams_in_one_order(spark):
    """The order of a union is made of the streams' orders alone, so every run of the plan agrees on it."""
    df = spark.range(5000, numPartitions=3).withColumn("value", F.col("id") % 2)
    ev = unite([events(df.repartition(5), "id"), events(df.repartition(3), "id")])
    assert "monotonically" not in ev.df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert [r["id"] for r in numbered(ev, "at", 0).orderBy("at").collect()] == [*range(5000), *range(5000)]
