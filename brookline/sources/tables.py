"""Named tables that operators look up or keep state in."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_lookups: dict[str, DataFrame] = {}
_roots: dict[str, str] = {}


def register_lookup(name: str, df: DataFrame) -> None:
    """Make a DataFrame known to the lookup operators."""
    _lookups[name] = df


def lookup_table(spark: SparkSession, name: str) -> DataFrame:
    if name in _lookups:
        return _lookups[name]
    return spark.table(name)


def register_key_folder(name: str, folder: str) -> None:
    """Where the persistent key table of that name lies (a folder that all executors share)."""
    _roots[name] = folder


class KeyTable:
    """Keys of earlier runs, as Parquet files; each run appends its new keys in one file set."""

    def __init__(self, spark: SparkSession, folder: str, key: str, ttl: str):
        self.spark, self.folder, self.key, self.ttl = spark, folder, key, ttl

    def live(self) -> DataFrame:
        schema = f"`{self.key}` string, `{self.ttl}` long"
        try:
            df = self.spark.read.schema(schema).parquet(self.folder)
        except Exception as e:  # no run has written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            df = self.spark.createDataFrame([], schema)
        now = F.unix_timestamp(F.current_timestamp())
        return df.filter(F.col(self.ttl).isNull() | (F.col(self.ttl) > now)).select(self.key).distinct()

    def claim(self, new: DataFrame, column: str, ttl_seconds: int | None) -> DataFrame:
        """Write the events to a scratch folder once, append their keys, and give the events: the answer doesn't change when it is read later."""
        path = f"{self.folder.rstrip('/')}-events/{uuid.uuid4().hex}"
        new.write.parquet(path)
        kept = self.spark.read.schema(new.schema).parquet(path)
        end = (F.unix_timestamp(F.current_timestamp()) + ttl_seconds) if ttl_seconds else F.lit(None)
        kept.select(F.col(column).cast("string").alias(self.key), end.cast("long").alias(self.ttl)).write.mode("append").parquet(self.folder)
        return kept


def key_table(spark: SparkSession, name: str, key: str, ttl: str) -> KeyTable:
    return KeyTable(spark, _roots.get(name, name), key, ttl)


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder name that the driver and all executors share: below spark.checkpoint.dir, or a temporary one on a local master."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="brookline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/brookline-{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex[:12]}"
