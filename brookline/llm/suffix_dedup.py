"""Removal of long repeated byte strings by bucket-pointer refinement over the suffixes of all texts.

A bucket pointer of depth d names the class of all suffixes that share their first d bytes. The first
pointers are the 8-byte strings themselves; a pointer of depth 2d is made from the pointer at a place and the one d bytes
further on, so each level reuses the one before (8, 16, 32, 64, 128, 200). Pointers are 64-bit
hashes of that pair, not ranks, so a task needs no other task's order to refine. Where classes decide about a
removal, two 64-bit values must agree: anchor and span pointer for whole spans, two independent pointers for blocks and windows.

Only suffixes that can matter are ever shuffled. The q-gram bucket of a 200-byte window is that of the least depth-32 pointer
in it (its anchor); equal windows have equal anchors at equal places. Windows in a row with one
anchor form a span, about one in 85 bytes. Spans are sorted into buckets by (anchor, span pointer):
a span that occurs twice is repeated as a whole. Buckets whose anchor is shared by different spans are refined in two
more steps, with one span for each class: blocks of 16 windows at equal distances from the anchor are sorted by the pointer of what all
windows of the block share; where others share it too, the block is repeated as a whole or goes on to the last
step, window by window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookline.llm.common import discard, written

Q = 32
#: Windows of a block in the second step.
WIDE = 16
#: Bytes of text that one pass of the refinement holds; a single longer text is taken whole.
BLOCK = 2_000_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _refine(p: np.ndarray, step: int, lane: int) -> np.ndarray:
    """Pointers of greater depth from each pointer and the one `step` bytes on."""
    h = p[step:] * (_B + np.uint64(2 * lane))
    h ^= h >> np.uint64(31)
    h += p[: len(p) - step]
    h *= _A
    h ^= h >> np.uint64(29)
    h *= _C
    h ^= h >> np.uint64(32)
    return h


def pointers(data: bytes, depths: tuple[int, ...], lane: int = 0) -> dict[int, np.ndarray]:
    """Pointers at each of the depths (32, then the window's), for all places that have so many bytes."""
    n = len(data) - 7
    p = np.empty(n, np.uint64)
    for r in range(8):
        part = np.frombuffer(data, "<u8", (len(data) - r) // 8, r)
        p[r::8] = part[: len(p[r::8])]
    out, depth = {}, 8
    for d in depths:
        while depth < d:
            step = min(depth, d - depth)
            if len(p) <= step:
                p = p[:0]
            else:
                p = _refine(p, step, lane)
            depth += step
        out[d] = p
    return out


def least_places(p: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` pointers the place of the least one, by its upper 36 bits, the first of equal ones."""
    n = len(p)
    mask = np.uint64((1 << 28) - 1)
    key = (p & ~mask) | (np.arange(n, dtype=np.uint64) & mask)
    rows = -(-n // width)
    padded = np.full(rows * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = key
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    best = np.minimum(back[: n - width + 1], ahead[width - 1 : n])
    start = np.arange(len(best), dtype=np.int64)
    return start + ((best & mask).astype(np.int64) - start & ((1 << 28) - 1))


def _cover(whole: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Pointers of the strings that the windows from first to last cover. They overlap, so the two outer ones hold all."""
    h = whole[first] * _B ^ (whole[last] + (last - first).astype(np.uint64)) * _A
    h ^= h >> np.uint64(30)
    return h * _C


def blocks_of(text: bytes, first: np.ndarray, last: np.ndarray, gap: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(span number, first window, last window, pointer of the common part, two pointers of the cover) of the spans' blocks."""
    near, far = gap - (last - first), gap
    n = far // WIDE - near // WIDE + 1
    k = np.repeat(np.arange(len(n)), n)
    b = near[k] // WIDE + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    anchor = (first + gap)[k]
    a, z = anchor - np.minimum(far[k], b * WIDE + WIDE - 1), anchor - np.maximum(near[k], b * WIDE)
    one, two = (pointers(text, (length - WIDE + 1, length), lane) for lane in (0, 1))
    core = one[length - WIDE + 1][anchor - b * WIDE]
    return k, a, z, core.view(np.int64), _cover(one[length], a, z).view(np.int64), _cover(two[length], a, z).view(np.int64)


def spans_of(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(text number, first window, last window, bytes from the first window to the anchor, anchor pointer, span pointer)."""
    none = (np.zeros(0, np.int64),) * 6
    data = b"".join(texts)
    if len(data) < length:
        return none
    sizes = np.array([len(t) for t in texts])
    start = np.cumsum(sizes) - sizes
    found = pointers(data, (Q, length))
    gram, whole = found[Q], found[length]
    windows = len(data) - length + 1
    anchor = least_places(gram[: windows + length - Q], length - Q + 1)
    owner = np.repeat(np.arange(len(texts)), sizes)[:windows]
    valid = np.arange(windows) + length <= (start + sizes)[owner]
    cut = np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]) | (valid[1:] != valid[:-1])]
    first = np.flatnonzero(cut)
    last = np.r_[first[1:], windows] - 1
    keep = valid[first]
    first, last = first[keep], last[keep]
    span = _cover(whole, first, last)
    who = owner[first]
    return who, first - start[who], last - start[who], anchor[first] - first, gram[anchor[first]].view(np.int64), span.view(np.int64)


def _blocks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    a = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= BLOCK:
            yield a, k + 1
            a, size = k + 1, 0
    if a < len(texts):
        yield a, len(texts)


def _batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


def _joined(names: list[str], batches: Iterator[pa.RecordBatch], one_text) -> Iterator[pa.RecordBatch]:
    """What one_text gives for each row (id, x, text, spans), in batches of at least 50,000 rows."""
    parts, size = [], 0
    for batch in batches:
        for i, x, text, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            parts.append(one_text(i, x, text, found))
            size += len(parts[-1][0])
            if size >= 50_000:
                yield _batch(names, *(np.concatenate(c) for c in zip(*parts, strict=True)))
                parts, size = [], 0
    if parts:
        yield _batch(names, *(np.concatenate(c) for c in zip(*parts, strict=True)))


def _same(*keys: str) -> list:
    """Join keys as new expressions: both sides of the join are plain exchanges then, and AQE may split a hot key."""
    return [F.col(k).bitwiseXOR(F.lit(0).cast("long")).alias(f"k{n}") for n, k in enumerate(keys)]


def _semi(rows: DataFrame, keys: tuple[str, ...], wanted: DataFrame) -> DataFrame:
    names = [f"k{n}" for n in range(len(keys))]
    return rows.select("*", *_same(*keys)).join(wanted.select(*_same(*keys)), names, "left_semi").drop(*names)


def _classes(rows: DataFrame, bucket: str, *finer: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (with at, many) by bucket and finer pointers: the table of classes, those that occur twice, and (at, many) of one row of each class in the buckets
    that hold several classes, one of them of a single row."""
    c = rows.groupBy(bucket, *finer).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"), F.max("many").alias("many"))
    c = written(c.select(bucket, *finer, "at", (F.col("many") | (F.col("n") > 1)).alias("many")), "classes")
    mixed = c.groupBy(bucket).agg(F.count(F.lit(1)).alias("c"), F.min("many").alias("settled")).filter("c > 1 and not settled")
    return c, c.filter("many"), _semi(c, (bucket,), mixed).select("at", "many")


def _listed(rows: DataFrame, chosen: DataFrame, *fields: str) -> DataFrame:
    """The chosen rows as one list for each text."""
    return rows.drop("many").join(chosen, "at").groupBy("id", "x").agg(F.collect_list(F.struct(*fields, "many")).alias("spans"))


def repeated_runs(docs: DataFrame, length: int) -> DataFrame:
    """(id, x, a, b): byte ranges that repeated windows cover. docs: id, x, t (bytes)."""

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for lo, hi in _blocks(texts):
                who, first, last, gap, anchor, span = spans_of(texts[lo:hi], length)
                at = pa.array(who + lo)
                yield _batch(["id", "x", "first", "last", "gap", "anchor", "span"], batch.column(0).take(at), batch.column(1).take(at), first.astype(np.int32), last.astype(np.int32), gap.astype(np.int16), anchor, span)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "x", "first", "last", "core", "one", "two", "many"]

        def one_text(i: int, x: int, text: bytes, found: list[dict]) -> tuple[np.ndarray, ...]:
            first, last, gap = (np.array([s[c] for s in found], np.int64) for c in ("first", "last", "gap"))
            k, a, z, core, one, two = blocks_of(text, first, last, gap, length)
            return np.full(len(k), i), np.full(len(k), x), a.astype(np.int32), z.astype(np.int32), core, one, two, np.array([s["many"] for s in found])[k]

        return _joined(names, batches, one_text)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one_text(i: int, x: int, text: bytes, found: list[dict]) -> tuple[np.ndarray, ...]:
            one, two = (pointers(text, (length - WIDE + 1, length), lane)[length].view(np.int64) for lane in (0, 1))
            p = np.concatenate([np.arange(s["first"], s["last"] + 1) for s in found])
            many = np.repeat([s["many"] for s in found], [s["last"] - s["first"] + 1 for s in found])
            return np.full(len(p), i), np.full(len(p), x), p.astype(np.int32), one[p], two[p], many

        return _joined(["id", "x", "p", "one", "two", "many"], batches, one_text)

    def covered(rows: DataFrame) -> DataFrame:
        return rows.select("id", "x", F.col("first").alias("a"), (F.col("last") + length).alias("b"))

    def with_text(lists: DataFrame) -> DataFrame:
        return docs.join(lists.hint("shuffle_hash"), ["id", "x"]).select("id", "x", "t", "spans")

    # Rows are written once, so that their numbers stay.
    found = docs.mapInArrow(spans, "id long, x long, first int, last int, gap short, anchor long, span long")
    every = written(found.withColumn("at", F.monotonically_increasing_id()).withColumn("many", F.lit(False)), "spans")
    classes, twice, chosen = _classes(every, "anchor", "span")
    whole = written(covered(_semi(every, ("anchor", "span"), twice)), "whole-spans")
    # A text comes once even if its row is repeated: a span is a place in a text.
    held = with_text(_listed(every, chosen, "first", "last", "gap")).mapInArrow(blocks, "id long, x long, first int, last int, core long, one long, two long, many boolean")
    held = written(held.withColumn("at", F.monotonically_increasing_id()), "blocks")
    discard(every, classes)
    classes, twice, chosen = _classes(held, "core", "one", "two")
    parts = written(covered(_semi(held.filter("not many"), ("core", "one", "two"), twice)), "whole-blocks")
    single = with_text(_listed(held, chosen, "first", "last")).mapInArrow(windows, "id long, x long, p int, one long, two long, many boolean")
    single = written(single, "windows")
    discard(held, classes)
    again = single.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n"), F.max("many").alias("many")).filter("n > 1 or many")
    last = _semi(single.filter("not many"), ("one", "two"), again).select("id", "x", F.col("p").alias("a"), (F.col("p") + length).alias("b"))
    last = written(last, "single-windows")
    discard(single)
    return whole.unionByName(parts).unionByName(last)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, with_text: bool = False) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes that are left).

    Every byte goes that a `length`-byte string covers which also starts elsewhere, in the same text or another.
    Strings are judged on the input; matches never cross texts. Null and empty texts have 0 bytes and keep the hash of nothing;
    texts shorter than `length` stay as they are. Repeated rows count as texts of their own, so
    they remove each other. Null ids are ids like any other; rows that share an id, or have none, are told apart by 64 bits
    of their text. Very long texts are taken whole, one at a time. An empty table gives no rows; extra columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("real"), text.cast("binary").alias("t")).select("real", F.coalesce("real", F.lit(-(1 << 63))).alias("id"), F.xxhash64("t").alias("x"), "t")
    runs = repeated_runs(rows.select("id", "x", "t"), length).groupBy("id", "x").agg(F.collect_set(F.struct("a", "b")).alias("runs"))
    runs = written(runs.select("id", "x", F.transform("runs", lambda r: r["a"]).alias("a"), F.transform("runs", lambda r: r["b"]).alias("b")), "repeated-runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, text, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kept, removed, spans = text, 0, 0
                if a:
                    order = np.argsort(a, kind="stable")
                    starts, ends = np.array(a)[order], np.maximum.accumulate(np.array(b)[order])
                    new = np.r_[True, starts[1:] > ends[:-1]]
                    lo = starts[new]
                    hi = ends[np.r_[np.flatnonzero(new)[1:] - 1, len(ends) - 1]]
                    kept = b"".join(text[s:e] for s, e in zip([0, *hi.tolist()], [*lo.tolist(), len(text)], strict=True))
                    removed, spans = int((hi - lo).sum()), len(lo)
                out.append((i, len(text), removed, spans, hashlib.sha256(kept).hexdigest(), *([kept] * with_text)))
            names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_text]
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=False)], names)

    joined = rows.join(runs.hint("shuffle_hash"), ["id", "x"], "left").select("real", "t", "a", "b")
    out = joined.mapInArrow(cut, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
    return out.withColumnRenamed("id", id_col)
