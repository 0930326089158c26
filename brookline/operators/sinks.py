"""Sinks and plumbing. Sinks give their events on unchanged; writing is one action of Spark."""

from __future__ import annotations

import subprocess

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brookline.functions.jmespath import text
from brookline.functions.jsons import json_schema
from brookline.functions.times import duration_ms
from brookline.operators.project import defanged
from brookline.operators.registry import UsageError, arg, operator, words
from brookline.plans.frame import SEQ, Events
from brookline.sources.clients import client_factory


def as_text(ev: Events, pretty: bool = False) -> DataFrame:
    return ev.df.select(F.to_json(ev.event(), {"pretty": str(pretty).lower()}).alias("value"), ev.seq().alias(SEQ))


@operator("print", args=(arg("labels", nargs="*"), arg("-f", "--file"), arg("-g", "--gzip", action="store_true"), arg("-p", "--pretty", action="store_true"), arg("-d", "--defang", action="store_true"), arg("-t", "--tsv", action="store_true"), arg("-r", "--raw", action="store_true"), arg("--append-thread-id-to-filename", action="store_true"), arg("--avoid-overwrite", action="store_true")), kind="sink")
def print_(ev: Events, a) -> Events:
    """Write events as JSON lines (or pretty, tab-separated, raw text, defanged) to a folder, or the first thousand to the screen."""
    chosen = ev.select(*[F.col(f"`{c}`") for c in a.labels]) if a.labels else ev
    if a.tsv:
        value = F.array_join(F.array(*[F.coalesce(text(chosen.path(f'"{c}"')), F.lit("")) for c in chosen.fields]), "\t")
        out = chosen.df.select(value.alias("value"), chosen.seq().alias(SEQ))
    elif a.raw and len(chosen.fields) == 1:
        out = chosen.df.select(text(chosen.path(f'"{chosen.fields[0]}"')).alias("value"), chosen.seq().alias(SEQ))
    else:
        out = as_text(chosen, a.pretty)
    if a.defang:
        out = out.withColumn("value", defanged(F.col("value")))
    if a.file:
        writer = out.select("value").write.mode("errorifexists" if a.avoid_overwrite else "overwrite")
        writer.option("compression", "gzip" if a.gzip else "none").text(a.file)
    else:
        for r in out.orderBy(SEQ).limit(1000).collect():
            print(r["value"])
    return ev


def unsupported(name: str, **options) -> None:
    """Options without a meaning for a registered client are refused, not ignored."""
    if given := [n for n, v in options.items() if v]:
        raise UsageError(f"{name}: no support for {', '.join(given)}; the registered client decides")


def size_bytes(text: str) -> int:
    units = {"KB": 1 << 10, "MB": 1 << 20, "GB": 1 << 30, "B": 1}
    for u, n in units.items():
        if text.upper().endswith(u):
            return int(float(text[: -len(u)]) * n)
    return int(text)


@operator("s3buffer", args=(arg("bucket"), arg("-d", "--dir", default=""), arg("-f", "--prefix", default=""), arg("-s", "--size", default="1024KB"), arg("-c", "--count", type=int, default=1000), arg("-t", "--time", default="60s"), arg("--compression", default="gzip", choices=["gzip", "zstd"]), arg("-r", "--region")), kind="sink")
def buffered_objects(ev: Events, a) -> Events:
    """JSON lines in folders by hour; a file holds at most -c events and about -s of text. A run on a table writes at once,
    so -t has no effect; a stream's trigger is its interval."""
    duration_ms(a.time)
    now = F.current_timestamp()
    parts = {"year": "yyyy", "month": "MM", "day": "dd", "hour": "HH"}
    df = as_text(ev).select("value", *[F.date_format(now, p).alias(n) for n, p in parts.items()])
    path = "/".join(x.strip("/") if k else x.rstrip("/") for k, x in enumerate((a.bucket, a.dir)) if x)
    average = df.agg(F.avg(F.octet_length("value") + 1)).first()[0] or 1
    rows = max(1, min(a.count, int(size_bytes(a.size) / average)))
    df.write.mode("append").partitionBy(*parts).option("maxRecordsPerFile", rows).option("compression", a.compression).text(path)
    return ev


def send(ev: Events, kind: str, target: str, value, batch: int) -> Events:
    """Send one string for each event through a client on the executors, in batches. A task that runs twice sends twice."""
    factory = client_factory(kind)

    def run(rows):
        client, waiting = factory(target), []
        for r in rows:
            waiting.append(r["value"])
            if len(waiting) == batch:
                client.send(waiting)
                waiting = []
        if waiting:
            client.send(waiting)

    ev.df.select(value.alias("value")).filter("value is not null").foreachPartition(run)
    return ev


def _payload(ev: Events, path: str | None):
    return text(ev.path(path)) if path else F.to_json(ev.event())


@operator("kinesis_out", args=(arg("stream"), arg("-p", "--partition-key"), arg("-c", "--compress", action="store_true"), arg("-s", "--size", type=int, default=1), arg("-d", "--debug", action="store_true")), kind="sink")
def to_stream(ev: Events, a) -> Events:
    """Put each event on a stream, -s at a time."""
    unsupported("kinesis_out", **{"-p": a.partition_key, "-c": a.compress})
    return send(ev, "stream", a.stream, _payload(ev, None), max(a.size, 1))


@operator("firehose", args=(arg("stream"), arg("-d", "--debug", action="store_true")), kind="sink")
def to_firehose(ev: Events, a) -> Events:
    """Put events on a delivery stream, a line each."""
    return send(ev, "stream", a.stream, F.concat(_payload(ev, None), F.lit("\n")), 500)


@operator("sns", args=(arg("topic"), arg("-c", "--compact", action="store_true"), arg("-s", "--subject"), arg("-p", "--path"), arg("-d", "--debug", action="store_true"), arg("-t", "--tail", type=int)), kind="sink")
def to_topic(ev: Events, a) -> Events:
    """Publish each event to a topic; -t keeps the end of the text."""
    unsupported("sns", **{"-s": a.subject, "-c": a.compact})
    v = _payload(ev, a.path)
    return send(ev, "topic", a.topic, F.right(v, F.lit(a.tail)) if a.tail else v, 1)


@operator("sqs_remove", args=(arg("queue"), arg("-r", "--receipt", default="sqs_receipt_handle")), kind="sink")
def delete_messages(ev: Events, a) -> Events:
    """Delete messages by their handle, or an array of handles."""
    v, queue, factory = ev.path(a.receipt), a.queue, client_factory("queue")
    handles = F.explode(v.c) if isinstance(v.t, T.ArrayType) else v.c

    def run(rows):
        found = [r["h"] for r in rows if r["h"] is not None]
        if found:
            factory(queue).delete(found)

    ev.df.select(handles.alias("h")).foreachPartition(run)
    return ev


@operator("dynamodbput", "dynamodb_put", args=(arg("table"), arg("-j", "--path"), arg("--retry-backoff-ms", type=int), arg("-r", "--region"), arg("--batch-size", type=int, default=25)), kind="sink")
def put_items(ev: Events, a) -> Events:
    """Write each event to a key-value table, --batch-size at a time. Retries are the client's."""
    unsupported("dynamodbput", **{"--retry-backoff-ms": a.retry_backoff_ms})
    return send(ev, "table", a.table, _payload(ev, a.path), a.batch_size)


@operator("null")
def null(ev: Events, a) -> Events:
    """Pass events on."""
    return ev


@operator("acc")
def acc(ev: Events, a) -> Events:
    """What the pipeline's caller gets."""
    return ev


@operator("rebatch", args=(arg("size", type=int, nargs="?", default=10),))
def rebatch(ev: Events, a) -> Events:
    """No effect on events."""
    return ev


@operator("exec", args=(arg("command", nargs="*"), arg("-p", "--path"), arg("-l", "--label", default="exec_output"), arg("-j", "--json", action="store_true"), arg("--pass-through", action="store_true")))
def exec_(ev: Events, a) -> Events:
    """Run a command for each event with JSON on its input. A failed one drops the event, or passes it with --pass-through."""
    command = a.command if isinstance(a.command, list) else a.command.split()
    if not command:
        raise UsageError("exec: a command is needed")
    v = ev.path(a.path) if a.path else None
    body = F.when(v.c.isNotNull(), F.to_json(F.struct(v.c.alias("v")))) if v else F.to_json(ev.event())
    if v is not None:
        body = F.when(v.c.isNotNull(), F.substring(body, F.lit(6), F.length(body) - 6))

    @F.pandas_udf("struct<ok: boolean, out: string>")
    def run(inputs: pd.Series) -> pd.DataFrame:
        found = []
        for s in inputs:
            if s is None:
                found.append((True, None))
                continue
            p = subprocess.run(command, input=s.encode(), capture_output=True, check=False)
            out = p.stdout[: 10 << 20].decode("utf-8", "replace").strip()
            found.append((p.returncode == 0, out if p.returncode == 0 and out else None))
        return pd.DataFrame(found, columns=["ok", "out"])

    out = ev.add("__r", run(body))
    out = out if a.pass_through else out.filter(F.col("__r.ok"))
    out = out.add(a.label, F.col("__r.out"))
    if a.json:
        parsed = F.from_json(a.label, json_schema(out.df, F.col(a.label)))
        out = out.add(a.label, parsed)
    return out.with_df(out.df.drop("__r"))


@operator("bedrock", args=(words("prompt", optional=True), arg("-f", "--file"), arg("-j", "--path"), arg("-o", "--output-tag", nargs="+"), arg("-m", "--model", default=""), arg("-l", "--label", default="bedrock"), arg("-r", "--retries", type=int, default=5), arg("-b", "--batch", type=int, default=10)))
def model_call(ev: Events, a) -> Events:
    """Ask a registered model about each event; lines of the answer, or what stands in the given tags, go under the label. A
    failed call is made again up to -r times."""
    prompt = a.prompt or ""
    if a.file:
        with open(a.file, encoding="utf-8") as f:
            prompt = f.read()
    factory, model, batch = client_factory("model"), a.model, a.batch

    retries = a.retries

    def attempt(client, event: str) -> str:
        for left in range(retries, -1, -1):
            try:
                return client.answer(prompt, event)
            except Exception:
                if not left:
                    raise

    @F.pandas_udf("string")
    def ask(events: pd.Series) -> pd.Series:
        from concurrent.futures import ThreadPoolExecutor

        client = factory(model)
        with ThreadPoolExecutor(batch) as pool:
            return pd.Series(list(pool.map(lambda e: attempt(client, e), events)), dtype=object)

    answer = F.col("__a")
    out = ev.add("__a", ask(_payload(ev, a.path)))
    if a.output_tag:
        tags = a.output_tag if isinstance(a.output_tag, list) else a.output_tag.split()
        value = F.struct(*[F.nullif(F.regexp_extract(answer, f"(?s)<{t}>(.*?)</{t}>", 1), F.lit("")).alias(t) for t in tags])
    else:
        value = F.filter(F.split(answer, "\n"), lambda x: F.trim(x) != "")
    return out.with_df(out.add(a.label, value).df.drop("__a"))


@operator("s3event", args=(words("path", optional=True), arg("-b", "--bucket", default="bucket_name"), arg("-k", "--key", default="object_key"), arg("-s", "--receipt", default="sqs_receipt_handle"), arg("-c", "--contains"), arg("-m", "--max", type=int), arg("--parse-as-csv", action="store_true"), arg("--schema")))
def object_rows(ev: Events, a) -> Events:
    """Events that name objects to the rows of these objects. Each object is read once; the handle of its message joins its rows."""
    b, k, r = ev.path(a.bucket), ev.path(a.key), ev.path(a.receipt)
    named = ev.df.select(F.concat(text(b), F.lit("/"), text(k)).alias("path"), text(r).alias("handle")).filter("path is not null").distinct()
    paths = [x["path"] for x in named.select("path").distinct().collect()]
    spark = ev.df.sparkSession
    if not paths:
        return Events(spark.createDataFrame([], "value string").withColumn(SEQ, F.lit(0)), SEQ)
    if a.parse_as_csv or all(p.split(".gz")[0].endswith(".csv") for p in paths):
        df = spark.read.option("header", True).csv(paths)
    else:
        lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("__p"))
        lines = lines.filter(F.contains("value", F.lit(a.contains))) if a.contains else lines
        df = lines.select(F.from_json("value", a.schema or json_schema(lines, F.col("value"))).alias("e"), "__p").select("e.*", "__p")
        if not isinstance(r.t, T.NullType):
            # Handles: one row for each object that was named.
            one = named.groupBy(F.regexp_replace("path", "^[a-z0-9]+:/*", "/").alias("__q")).agg(F.first("handle").alias(a.receipt))
            df = df.withColumn("__q", F.regexp_replace("__p", "^[a-z0-9]+:/*", "/")).join(one, "__q", "left").drop("__q")
        df = df.drop("__p")
    return Events(df.withColumn(SEQ, F.monotonically_increasing_id()), SEQ)
