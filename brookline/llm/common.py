"""What the operators of this subpackage share: scratch tables, input columns, word rules."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_folders: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A folder that the driver and all executors share: below spark.checkpoint.dir, or, on a local master only, an own
    temporary folder where that is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="brookline-")
        spark.conf.set("spark.checkpoint.dir", base)
    folder = f"{base.rstrip('/')}/brookline-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_drop, spark, folder)
    return folder


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{scratch(spark)}/{what}-{uuid.uuid4().hex[:12]}"


def _drop(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def written(df: DataFrame, what: str, settings: dict[str, str] | None = None) -> DataFrame:
    """Write df once to the shared scratch folder and read it back. Lineage ends here: a lost
    executor costs the tasks that ran on it, never the stages before the table. settings: of the session, for this write."""
    spark = df.sparkSession
    path = new_folder(spark, what)
    # Nothing reads the shuffle files of this write again, so Spark may drop them when it ends.
    settings = {CLEANUP: "true"} | (settings or {})
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        df.write.parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that written() made, once nothing is left to be computed from them."""
    for t in tables:
        _drop(t.sparkSession, t.scratch_path)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, _UPPER, _LOWER)


def broken(key: Column) -> Column:
    """The same key as a new expression. A join on it doesn't reuse the partitioning of an
    aggregation below it, so both sides are plain exchanges and AQE may split a hot key."""
    return F.concat(key, F.lit(""))


_kept: dict[str, object] = {}


def kept_in_worker(key: str, make):
    """What make() gives, kept in this Python worker for later tasks with the same key. Spark hands workers on from stage to
    stage, so what another key kept goes first and only one thing is ever held."""
    if key not in _kept:
        nothing_kept()
        _kept[key] = make()
    return _kept[key]


def nothing_kept() -> None:
    """Let go what an earlier stage kept in this Python worker."""
    if _kept:
        _kept.clear()
        give_back()


def give_back() -> None:
    """Free memory of this Python worker goes back to the system, where it has a way to ask for that: workers wait beside others for their next task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, a function for mapInArrow that keeps nothing, in a worker that doesn't hold what others kept, nor run's free memory afterwards."""

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_kept()
        yield from run(batches)
        give_back()

    return alone


def fresh_key() -> str:
    return uuid.uuid4().hex


class Pieces:
    """The numbers that a text's pieces (runs between white space) stand for, in order: none, one or several for each piece.

    numbers(pieces) gives a list for each of some new pieces. They are remembered up to `most` bytes by a rough count that takes in the
    length of the pieces; then all is forgotten, after a call of forget(), and memory fills again."""

    ENTRY = 160

    def __init__(self, numbers: Callable[[list[str]], Iterable[list[int]]], most: int = 40_000_000, forget: Callable[[], None] = lambda: None):
        self.numbers, self.most, self.forget = numbers, most, forget
        self.known: dict[str, int] = {}
        self.others: list[list[int]] = []
        self.size = 0

    def _learn(self, pieces: set[str]) -> None:
        new = list(pieces.difference(self.known))
        if self.known and self.size + sum(map(len, new)) + self.ENTRY * len(new) > self.most:
            self.known, self.others, self.size = {}, [], 0
            self.forget()
            new = list(pieces)
        self.size += sum(map(len, new)) + self.ENTRY * len(new)
        for p, found in zip(new, self.numbers(new), strict=True):
            if len(found) == 1:
                self.known[p] = found[0]
            else:  # a negative number stands for a list
                self.others.append(found)
                self.size += 8 * len(found)
                self.known[p] = -len(self.others)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All numbers of all texts, and how many each text has."""
        flat, sizes = self.by_piece(texts)[:2]
        return flat, sizes

    def by_piece(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Numbers, numbers of each text, numbers of each piece, pieces of each text."""
        split = [t.split() if t else [] for t in texts]
        self._learn(set().union(*split))
        get = self.known.__getitem__
        pieces = np.array([len(x) for x in split], np.int64)
        ids = np.fromiter(map(get, chain.from_iterable(split)), np.int64, int(pieces.sum()))
        size = np.ones(len(ids), np.int64)
        odd = np.flatnonzero(ids < 0)
        if len(odd):
            lists = [self.others[-k - 1] for k in ids[odd].tolist()]
            size[odd] = [len(x) for x in lists]
            ids = np.repeat(ids, size)
            ids[ids < 0] = [k for x in lists for k in x]
        upto = np.r_[0, np.cumsum(size)]
        ends = np.cumsum(pieces)
        return ids, upto[ends] - upto[ends - pieces], size, pieces
