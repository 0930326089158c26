"""Registered queries of sources and sinks: a table is written to the shared folder by one operator and read back by another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookline.plans.frame import Events, events
from brookline.plans.language import run
from brookline.sources.tables import shared_folder

CUT = "select '{event_id: event_id, user_id: user_id, event_type: event_type, value: value}'"
EVENTS = "SELECT event_id, user_id, event_type, value FROM events"


def table(spark: SparkSession, sf_dir: str, name: str, order: str) -> Events:
    return events(spark.read.parquet(f"{sf_dir}/{name}.parquet"), order)


def through(name: str, order: str, sink: str, source: str) -> Callable[[SparkSession, str], DataFrame]:
    """{0} stands for the folder in both texts."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = shared_folder(spark, "round-trip")
        run(spark, f"{name} | {sink.replace('{0}', folder)}", tables={name: table(spark, sf_dir, name, order)})
        return run(spark, source.replace("{0}", folder))

    return query


def csv_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "csv")
    spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name").write.option("header", True).csv(folder)
    return run(spark, f"csv {folder}")


def csv_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields beyond the labels get names of their own, however many there are."""
    folder = shared_folder(spark, "csv")
    more = [F.col("n_regionkey").alias(f"c{k}") for k in range(70)]
    spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", *more).write.csv(folder)
    return run(spark, f"csv {folder} --labels k name -f | select '{{k: k, name: name, last: Column71}}'")


def join_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "reference")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    nation.coalesce(1).agg(F.to_json(F.collect_list(F.struct("*"))).alias("value")).write.text(folder)  # a reference of 25 rows
    return run(spark, f"customer | join -k c_nationkey -f {folder} | select '{{k: c_custkey, nation: n_name, region: n_regionkey}}'", tables={"customer": table(spark, sf_dir, "customer", "c_custkey")})


def dedup_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of a first run are left out of a second."""
    folder, ev = shared_folder(spark, "keys"), table(spark, sf_dir, "events", "event_id")
    ev.filter(F.col("event_id") % 50 == 0).apply("dynamodbdedup", f"{folder} -k user_id").frame().count()
    return ev.apply("dynamodbdedup", f"{folder} -k user_id").apply("select", "{event_id: event_id, user_id: user_id}").frame()


def sql_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, f"athena 'SELECT n_name, count(*) OVER (PARTITION BY n_regionkey) AS n FROM parquet.`{sf_dir}/nation.parquet`'")


def injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, "lambda | null | rebatch 5 | acc", table(spark, sf_dir, "region", "r_regionkey"))


def command(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, "nation | exec cat -l out -j | select '{k: out.n_nationkey, name: out.n_name}'", tables={"nation": table(spark, sf_dir, "nation", "n_nationkey")})


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One field is a number, a text, a mixed array, null or absent from event to event."""
    folder = shared_folder(spark, "mixed")
    id_ = F.col("event_id").cast("string")
    forms = ['"v": 7', '"v": "seven"', '"v": [1, "a", {"z": true}]', '"v": null', '"w": {"deep": 1}']
    body = F.element_at(F.array(*[F.lit(f) for f in forms]), (F.col("event_id") % 5 + 1).cast("int"))
    spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit('{"id": '), id_, F.lit(", "), body, F.lit("}")).alias("value")).write.text(folder)
    text = "select '{{id: to_number(d.id), kind: type(d.v), n: length(d.v), seven: d.v == `7`, first: to_string(d.v[1]), z: to_string(d.v[?z] | [0].z), sum: sum(d.v), deep: to_number(d.w.deep)}}'"
    return run(spark, f"json {folder} -l d --variant | has_field d.id | {text}".replace("{{", "{").replace("}}", "}")).withColumns({"id": F.col("id").cast("long")})


MIXED = """
SELECT event_id AS id, k[event_id % 5 + 1] AS kind, CAST(n[event_id % 5 + 1] AS BIGINT) AS n, event_id % 5 = 0 AS seven, CASE WHEN event_id % 5 = 2 THEN 'a' END AS first,
       CASE WHEN event_id % 5 = 2 THEN 'true' END AS z, CASE WHEN event_id % 5 = 2 THEN 1.0::DOUBLE END AS sum, CASE WHEN event_id % 5 = 4 THEN 1.0::DOUBLE END AS deep
FROM events, (SELECT ['number', 'string', 'array', 'null', 'null'] AS k, [NULL, 5, 3, NULL, NULL] AS n)
"""


def counted(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run(spark, text).agg(F.count(F.lit(1)).alias("n"))


def keygen_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events a key come near the asked mean."""
    n = run(spark, "keygen -k 20000 --mean 4 -m 1000").groupBy("key").count()
    return n.agg((F.abs(F.avg("count") - 4) < 0.6).alias("near"), F.count(F.lit(1)).alias("keys"))


def found() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    nation = "SELECT n_nationkey, n_name, n_regionkey FROM nation"
    return {
        "json": (through("events", "event_id", CUT + " | print -f {0}", "json {0}"), EVENTS),
        "print": (through("nation", "n_nationkey", "print n_name n_nationkey -t -f {0}", "line {0}"), "SELECT n_name || chr(9) || CAST(n_nationkey AS VARCHAR) AS value FROM nation"),
        "line": (through("nation", "n_nationkey", "select '{n: n_name}' | print -r -f {0}", "line {0} -c AN"), "SELECT n_name AS value FROM nation WHERE contains(n_name, 'AN')"),
        "s3buffer": (through("events", "event_id", CUT + " | s3buffer {0} -c 400", "s3 {0} | " + CUT), EVENTS),
        "s3event": (through("nation", "n_nationkey", "print -f {0}", "s3list {0} | s3event | select '{n_nationkey: n_nationkey, n_name: n_name, n_regionkey: n_regionkey}'"), nation),
        "csv": (csv_file, "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation"),
        "csv_labels": (csv_labels, "SELECT CAST(n_nationkey AS VARCHAR) AS k, n_name AS name, CAST(n_regionkey AS VARCHAR) AS last FROM nation"),
        "join": (join_file, "SELECT c_custkey AS k, n_name AS nation, n_regionkey AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"),
        "dynamodbdedup": (dedup_twice, "SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id % 50 = 0) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1"),
        "athena": (sql_text, "SELECT n_name, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation"),
        "variant": (mixed, MIXED),
        "lambda_acc": (injected, "SELECT * FROM region"),
        "exec": (command, "SELECT n_nationkey AS k, n_name AS name FROM nation"),
        "null_source": (counted("null_source"), "SELECT CAST(0 AS BIGINT) AS n"),
        "gen_count": (counted("gen -c 1000 --seed 1"), "SELECT CAST(1000 AS BIGINT) AS n"),
        "keygen_mean": (keygen_mean, "SELECT true AS near, CAST(20000 AS BIGINT) AS keys"),
    }
