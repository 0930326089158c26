"""Sources: each gives Events; the order is that of the scan."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brookline.functions.jsons import json_schema
from brookline.operators.registry import UsageError, arg, operator
from brookline.plans.frame import SEQ, Events, events
from brookline.sources.clients import client_factory, delete_later


def _scan(df: DataFrame) -> Events:
    """Order of files and of rows in them, without a shuffle."""
    return Events(df.withColumn(SEQ, F.monotonically_increasing_id()), SEQ)


def _json(spark: SparkSession, paths: list[str], needle: str | None = None, schema: str | None = None) -> DataFrame:
    if needle:  # the raw text is tested before it is parsed
        lines = spark.read.text(paths).filter(F.contains("value", F.lit(needle)))
        schema = schema or json_schema(lines, F.col("value"))
        return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("e")).select("e.*")
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(paths)


@operator("json", "in", args=(arg("files", nargs="*"), arg("-c", "--contains"), arg("-b", "--batch", type=int), arg("-l", "--label"), arg("-d", "--no-decode", action="store_true"), arg("--schema"), arg("--variant", action="store_true")), kind="source")
def json(spark: SparkSession, a) -> Events:
    """JSON lines. -c keeps lines with a string before they are parsed; -d gives the lines themselves; -l puts events under a label.

    --variant (with -l) keeps each event as an open value: no schema is looked for, fields may have another type in each event, mixed arrays
    stay mixed, and paths into them are resolved value by value."""
    if a.no_decode:
        return line(spark, a)
    if a.variant:
        if not a.label:
            raise UsageError("json: --variant needs -l")
        lines = spark.read.text(a.files).filter(F.trim("value") != "")
        lines = lines.filter(F.contains("value", F.lit(a.contains))) if a.contains else lines
        return _scan(lines.select(F.parse_json("value").alias(a.label)))
    ev = _scan(_json(spark, a.files, a.contains, a.schema))
    return Events(ev.df.select(ev.event().alias(a.label), SEQ), SEQ) if a.label else ev


@operator("line", args=(arg("files", nargs="*"), arg("-c", "--contains"), arg("-b", "--batch", type=int), arg("-l", "--label"), arg("-d", "--no-decode", action="store_true")), kind="source")
def line(spark: SparkSession, a) -> Events:
    """Lines of text."""
    df = spark.read.text(a.files)
    df = df.filter(F.contains("value", F.lit(a.contains))) if a.contains else df
    return _scan(df.withColumnRenamed("value", a.label) if a.label else df)


@operator("csv", args=(arg("files", nargs="*"), arg("--labels", nargs="+"), arg("-d", "--delimiter", default=","), arg("--disable-double-quote", action="store_true"), arg("-f", "--flexible", action="store_true"), arg("--disable-quote", action="store_true"), arg("-t", "--trim", action="store_true"), arg("--buffer-capacity", type=int)), kind="source")
def csv(spark: SparkSession, a) -> Events:
    """CSV with a header, or with labels given; all values are text. The delimiter is a character or its byte number."""
    sep = chr(int(a.delimiter)) if a.delimiter.isdigit() and len(a.delimiter) > 1 else a.delimiter
    reader = spark.read.option("sep", sep).option("header", not a.labels).option("mode", "PERMISSIVE" if a.flexible else "FAILFAST")
    reader = reader.option("quote", "" if a.disable_quote else '"').option("escape", "\\" if a.disable_double_quote else '"')
    if a.trim:
        reader = reader.option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    if a.labels:
        labels = a.labels.split() if isinstance(a.labels, str) else a.labels
        # No line has more fields than delimiters and one.
        fields = spark.read.text(a.files).agg(F.max(F.size(F.split("value", re.escape(sep))))).first()[0] if a.flexible else 0
        more = [f"Column{k}" for k in range(len(labels), fields or 0)]
        df = reader.schema(T.StructType([T.StructField(n, T.StringType()) for n in [*labels, *more]])).csv(a.files)
        if more:
            used = df.agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in more]).first()
            df = df.drop(*[c for c in more if not used[c]])
        return _scan(df)
    return _scan(reader.csv(a.files))


@operator("gen", "generate", args=(arg("types", nargs="*"), arg("-c", "--count", type=int, default=1000), arg("-s", "--sleep-ms", type=int), arg("-b", "--batch", type=int), arg("--seed", type=int)), kind="source")
def generate(spark: SparkSession, a) -> Events:
    """Random rows of label:type: number, word, float, log (lognormal, whole)."""
    cols = []
    for k, spec in enumerate(a.types or ["key:word", "valueA", "valueB:log", "valueC:float"]):
        label, _, kind = spec.partition(":")
        seed = None if a.seed is None else a.seed + k
        u = F.rand(seed) if seed is not None else F.rand()
        z = F.randn(seed) if seed is not None else F.randn()
        if kind in ("", "number"):
            c = F.floor(u * (1 << 32)).cast("long")
        elif kind == "float":
            c = u
        elif kind.startswith("log"):
            c = F.floor(F.exp(2 + 3 * z)).cast("long")
        elif kind == "word":
            c = F.substring(F.sha2((u * (1 << 53)).cast("long").cast("string"), 256), 1, 8)
        else:
            raise UsageError(f"gen: no type {kind!r}")
        cols.append(c.alias(label))
    return Events(spark.range(a.count).select(*cols, F.col("id").alias(SEQ)), SEQ)


def power_law(most: int, alpha: float, least: int = 1) -> np.ndarray:
    """Probabilities of event counts least..most: a continuous power law from `least` to most + 1, rounded down. It is what keygen draws."""
    x = np.arange(least, most + 2, dtype=float)
    upto = np.log(x / least) / np.log((most + 1) / least) if abs(alpha - 1) < 1e-9 else ((x / least) ** (1 - alpha) - 1) / (((most + 1) / least) ** (1 - alpha) - 1)
    return np.diff(upto)


def solve_alpha(goal: str, value: float, most: int, least: int, share: float = 0.0) -> float:
    """The exponent at which a figure of the distribution has a value, by bisection: all figures fall or rise with it."""
    counts = np.arange(least, most + 1)

    def figure(alpha: float) -> float:
        p = power_law(most, alpha, least)
        if goal == "singleton":
            return p[0] * 100
        if goal == "mean":
            return counts @ p
        if goal == "median":
            return counts[min(np.searchsorted(np.cumsum(p), 0.5), len(p) - 1)]
        # The share of events that the most frequent keys have; the last count takes part in proportion.
        taken = np.minimum(np.maximum(share / 100 - (np.cumsum(p[::-1])[::-1] - p), 0), p)
        return counts @ taken / (counts @ p) * 100

    low, high = 0.01, 10.0
    rising = figure(high) > figure(low)
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (figure(mid) < value) == rising else (low, mid)
    return (low + high) / 2


@operator(
    "keygen", "key_gen",
    args=(arg("-k", "--keys", type=int, default=10000), arg("-c", "--count", type=int), arg("-a", "--alpha", type=float), arg("--singleton-pct", type=float), arg("--median", type=float), arg("--mean", type=float), arg("--top-pct"), arg("-m", "--max-events", type=int, default=100000), arg("--min-events-per-key", type=int, default=1), arg("-s", "--sleep-ms", type=int), arg("-b", "--batch", type=int), arg("-l", "--label", default="key"), arg("-p", "--prefix", default=""), arg("--cache-size", type=int, default=100), arg("--cache-probability", type=float, default=0.2), arg("--persistent-keys", type=int, default=0), arg("--persistent-probability", type=float, default=0.001), arg("--lifetime-variance", type=float, default=0.1), arg("--new-key-label", default="is_new"), arg("--persistent-label", default="is_persistent"), arg("--seed", type=int, default=0)),
    kind="source",
)
def keygen(spark: SparkSession, a) -> Events:
    """Keys whose numbers of events follow a truncated power law, in a shuffled but local order of time."""
    most, least = a.max_events, a.min_events_per_key
    alpha = a.alpha
    if a.singleton_pct is not None:
        alpha = solve_alpha("singleton", a.singleton_pct, most, least)
    elif a.median is not None:
        alpha = solve_alpha("median", a.median, most, least)
    elif a.mean is not None:
        alpha = solve_alpha("mean", a.mean, most, least)
    elif a.top_pct:
        top, share = map(float, a.top_pct.split(":"))
        alpha = solve_alpha("top", share, most, least, top)
    alpha = 2.0 if alpha is None else alpha
    # Inverse of the continuous law, rounded down: no table of the distribution is needed on the executors.
    u = F.rand(a.seed)
    lo, hi = float(least), float(most + 1)
    if abs(alpha - 1) < 1e-9:
        life = lo * F.pow(F.lit(hi / lo), u)
    else:
        e = 1 - alpha
        life = F.pow(F.lit(lo**e) + u * (hi**e - lo**e), F.lit(1 / e))
    life = F.greatest(F.lit(least), F.least(F.lit(most), F.floor(life))).cast("int")
    keys = spark.range(a.keys).withColumn("n", life)
    name = F.concat(F.lit(f"{a.prefix}0." if a.prefix else ""), F.col("id").cast("string"))
    rows = keys.select(name.alias(a.label), F.col("id"), F.posexplode(F.sequence(F.lit(1), F.col("n"))).alias("at", "__n"))
    when = F.col("id") + F.rand(a.seed + 1) * a.cache_size * (1 + a.lifetime_variance) * (F.col("at") > 0).cast("int")
    out = rows.select(a.label, (F.col("at") == 0).alias(a.new_key_label), F.lit(False).alias(a.persistent_label), F.struct(when.alias("t"), F.col("id"), F.col("at")).alias(SEQ))
    if a.persistent_keys:
        total = a.count or a.keys
        more = spark.range(int(total * a.persistent_probability)).select(F.concat(F.lit(f"{a.prefix}p."), F.floor(F.rand(a.seed + 2) * a.persistent_keys).cast("string")).alias(a.label), F.lit(False).alias(a.new_key_label), F.lit(True).alias(a.persistent_label), F.struct((F.rand(a.seed + 3) * a.keys).alias("t"), F.col("id"), F.lit(0).alias("at")).alias(SEQ))
        out = out.unionByName(more)
    return Events(out.orderBy(SEQ).limit(a.count) if a.count else out, SEQ)


@operator("s3", args=(arg("files", nargs="+"), arg("--schema")), kind="source")
def objects(spark: SparkSession, a) -> Events:
    """JSON lines of objects (compressed ones by their suffix), named by any path that Spark reads."""
    return _scan(_json(spark, a.files, schema=a.schema))


@operator("s3list", "s3_list", "listobjects", args=(arg("bucket"), arg("-p", "--prefix", default="")), kind="source")
def list_objects(spark: SparkSession, a) -> Events:
    """bucket_name, object_key, size and last_modified of each file below a path; contents are not read."""
    base = a.bucket.rstrip("/")
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).select("path", "length", "modificationTime")
    key = F.regexp_replace(F.substring_index("path", base.split("://")[-1] + "/", -1), "^/", "")
    df = df.select(F.lit(base).alias("bucket_name"), key.alias("object_key"), F.col("length").alias("size"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("last_modified"), F.lit(None).cast("string").alias("etag"))
    return _scan(df.filter(F.startswith("object_key", F.lit(a.prefix))))


def _poll(a) -> list[tuple]:
    """All messages that wait, until a poll finds none. Messages are short notices; they stay in the queue until acknowledge()."""
    queue = client_factory("queue")(a.queue)
    rows = []
    while got := queue.receive(a.wait):
        rows += got
    return rows


_NOTICE = "struct<Message: string, Records: array<struct<s3: struct<bucket: struct<name: string>, object: struct<key: string>>>>>"


def decode_notices(df: DataFrame, body: str = "body") -> DataFrame:
    """bucket_name and object_key of an object notice, also inside a topic's envelope; only its first record."""
    outer = F.from_json(body, _NOTICE)
    df = df.withColumn("__o", outer).withColumn("__i", F.coalesce(F.col("__o.Records"), F.from_json(F.col("__o.Message"), _NOTICE)["Records"]))
    one = F.get("__i", F.lit(0))["s3"]
    return df.withColumn("bucket_name", one["bucket"]["name"]).withColumn("object_key", F.try_url_decode(one["object"]["key"])).drop("__o", "__i")


@operator("sqs", args=(arg("queue"), arg("-w", "--wait", type=int, default=20), arg("-k", "--keep", action="store_true"), arg("-s", "--label")), kind="source")
def queue(spark: SparkSession, a) -> Events:
    """Messages of a queue: object notices are decoded; others are parsed under the label, or kept as sqs_body. They are deleted
    (unless -k) once the pipeline's sinks have written, see clients.acknowledge."""
    rows = _poll(a)
    df = decode_notices(spark.createDataFrame([(b, r, s) for b, r, s in rows], "body string, sqs_receipt_handle string, sqs_sent_timestamp string"))
    if a.label and rows:
        df = df.withColumn(a.label, F.from_json("body", json_schema(df, F.col("body"))))
    df = df.withColumn("sqs_body", F.when(F.col("bucket_name").isNull(), F.col("body"))).drop("body")
    if not a.keep and rows:
        delete_later(a.queue, [r for _, r, _ in rows])
    return _scan(df)


@operator("sqss3", args=(arg("queue"), arg("-w", "--wait", type=int, default=2), arg("-m", "--max", type=int, default=1024), arg("-s", "--silent", action="store_true"), arg("--schema"), arg("--root", default="")), kind="source")
def queue_objects(spark: SparkSession, a) -> Events:
    """Rows of the objects that a queue's notices name. Messages are deleted once the pipeline's sinks have
    written, see clients.acknowledge."""
    rows = _poll(a)
    if not rows:
        return events(spark.createDataFrame([], "value string"))
    df = decode_notices(spark.createDataFrame([(b,) for b, _, _ in rows], "body string")).filter("object_key is not null")
    paths = [f"{a.root}{r['bucket_name']}/{r['object_key']}" for r in df.select("bucket_name", "object_key").distinct().collect()]
    ev = _scan(_json(spark, paths, schema=a.schema))
    delete_later(a.queue, [r for _, r, _ in rows])
    return ev


@operator("kinesis_in", args=(arg("stream"), arg("-s", "--shard", type=int, default=0), arg("-p", "--poll-ms", type=int, default=500), arg("-l", "--loops", type=int, default=60)), kind="source")
def stream_records(spark: SparkSession, a) -> Events:
    """JSON records of one shard of a stream, for a number of polls."""
    source = client_factory("stream")(a.stream)
    rows = [(r,) for _ in range(a.loops) for r in source.poll(a.shard, a.poll_ms)]
    df = spark.createDataFrame(rows, "value string")
    return _scan(df.select(F.from_json("value", json_schema(df, F.col("value"))).alias("e")).select("e.*") if rows else df)


@operator("athena", args=(arg("text", nargs="*"), arg("-E", "--execution-id"), arg("-f", "--file"), arg("-s", "--output"), arg("-w", "--workgroup"), arg("-j", "--json-columns", nargs="+"), arg("-b", "--batch", type=int), arg("-e", "--emit-location", action="store_true")), kind="source")
def sql(spark: SparkSession, a) -> Events:
    """Rows of a SQL query, run by Spark. -j columns hold JSON text and are parsed. -e writes the result and gives its place."""
    text = a.text
    if a.file:
        with open(a.file, encoding="utf-8") as f:
            text = f.read()
    df = spark.sql(text)
    if a.emit_location:
        if not a.output:
            raise UsageError("athena: -e needs -s")
        df.write.mode("overwrite").option("header", True).csv(a.output)
        bucket, _, key = a.output.rpartition("/")
        return _scan(spark.createDataFrame([(bucket, key)], "bucket_name string, object_key string"))
    for c in (a.json_columns.split() if isinstance(a.json_columns, str) else a.json_columns or []):
        df = df.withColumn(c, F.from_json(c, json_schema(df, F.col(c))))
    return _scan(df)


@operator("null_source", kind="source")
def null_source(spark: SparkSession, a) -> Events:
    """No events."""
    return events(spark.createDataFrame([], "value string"))


@operator("lambda", kind="source")
def injected(spark: SparkSession, a) -> Events:
    """The events that the caller of the pipeline passes in."""
    if getattr(a, "given", None) is None:
        raise UsageError("lambda: the caller passes events to run()")
    return a.given
