"""Joins to reference tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brookline.functions.jsons import json_schema
from brookline.operators.registry import UsageError, arg, operator
from brookline.plans.frame import Events


def read_reference(spark, path: str, key: str) -> DataFrame:
    """A JSON array of objects (indexed by the key field, the last of equal keys wins) or an object by key, as __k and its fields.

    The file is one JSON value, read and taken apart by Spark."""
    whole = spark.read.text(path, wholetext=True).select(F.col("value").alias("t"))
    text = F.ltrim(F.regexp_replace("t", r"^[\s\uFEFF]+", ""))
    named = whole.filter(F.startswith(text, F.lit("{"))).select(F.explode(F.from_json("t", "map<string, string>")).alias("__k", "j")).select("__k", "j", F.lit(0).alias("at"))
    listed = whole.filter(F.startswith(text, F.lit("["))).select(F.posexplode(F.from_json("t", "array<string>")).alias("at", "j"))
    listed = listed.select(F.from_json("j", "map<string, string>")[key].alias("__k"), "j", "at")
    lines = named.unionByName(listed).filter(F.col("__k").isNotNull() & F.startswith(F.ltrim("j"), F.lit("{")))
    lines = lines.groupBy("__k").agg(F.max_by("j", "at").alias("j"))
    schema = json_schema(lines, F.col("j"))
    df = lines.select("__k", F.from_json("j", schema).alias("r"))
    return df.select("__k", *[F.col("r").getField(f.name).alias(f.name) for f in df.schema["r"].dataType.fields])


def join_reference(ev: Events, ref: DataFrame, key: str, how: str = "left", suffix: str | None = None) -> Events:
    """ref: __k (unique) and fields. Fields of a match overwrite the event's (nulls too), or get the suffix. Spark broadcasts ref if its
    bytes are below spark.sql.autoBroadcastJoinThreshold, and shuffles it beyond that."""
    own = [c for c in ref.columns if c != "__k"]
    ref = ref.select("__k", *[F.col(f"`{c}`").alias(f"__r_{c}") for c in own], F.lit(True).alias("__hit"))
    df = ev.df.withColumn("__k", ev.key(key)).join(ref, "__k", how)
    for c in own:
        name = c + (suffix or "")
        r = F.col(f"`__r_{c}`")
        df = df.withColumn(name, F.when(F.col("__hit"), r).otherwise(F.col(f"`{name}`").cast(df.schema[f"__r_{c}"].dataType)) if name in ev.df.columns else r)
    return ev.with_df(df.drop("__k", "__hit", *[f"__r_{c}" for c in own]))


@operator("join", args=(arg("-k", "--key", required=True), arg("-f", "--file", required=True), arg("--left", action="store_true"), arg("--inner", action="store_true"), arg("-s", "--suffix")))
def join(ev: Events, a) -> Events:
    """Left (default) or inner join to a JSON file by one key."""
    if a.left and a.inner:
        raise UsageError("join: --left or --inner, not both")
    return join_reference(ev, read_reference(ev.df.sparkSession, a.file, a.key), a.key, "inner" if a.inner else "left", a.suffix)


@operator("dynamodbquery", "dynamodb_query", "dynamodbget", "dynamodb_get", args=(arg("table"), arg("-q", "--query-type", default="getitem", choices=["getitem", "query", "scan"]), arg("-j", "--key", default="key"), arg("-l", "--label", default="dynamodb_result"), arg("-p", "--pass-through", action="store_true"), arg("--retry-backoff-ms", type=int), arg("-r", "--region")))
def lookup(ev: Events, a) -> Events:
    """Look keys up in a registered key-value table: one hit is an object (of several the first by its JSON text), with query and scan
    all are an array; misses drop unless -p.

    The path gives the key, or an object whose fields are compared to the table's fields of these names."""
    from brookline.sources.tables import lookup_table

    table = lookup_table(ev.df.sparkSession, a.table)
    v = ev.path(a.key)
    on = list(v.t.names) if isinstance(v.t, T.StructType) else ["key"]
    parts = [v.c.getField(n) for n in on] if isinstance(v.t, T.StructType) else [v.c]
    keys = [F.col(f"`{n}`").cast("string").alias(f"__t{k}") for k, n in enumerate(on)]
    row = F.struct(*[F.col(f"`{c}`") for c in table.columns])
    groups = table.groupBy(*keys).agg((F.min_by(row, F.to_json(row)) if a.query_type == "getitem" else F.collect_list(row)).alias(a.label))
    df = ev.df
    for k, p in enumerate(parts):
        df = df.withColumn(f"__t{k}", p.cast("string"))
    names = [f"__t{k}" for k in range(len(on))]
    out = df.join(groups, names, "left" if a.pass_through else "inner")
    return ev.with_df(out.drop(*names))
