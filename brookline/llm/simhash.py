"""SimHash near-duplicates by a generalised pigeonhole search over 64-bit fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookline.llm.common import broken, lean, written
from brookline.llm.components import components

BITS = 64
#: Relative costs that the allocation weighs: a row that is shuffled and sorted, a pair that is compared.
ROW_COST, PAIR_COST = 100.0, 1.0
#: Fingerprints of one bucket that one task compares; larger buckets are dealt out in tiles.
TILE = 2048
#: Buckets up to this many rows are compared pair by pair, larger ones by a search for a spanning forest.
SMALL = 128


#: Shingles whose bits are unpacked at a time.
CHUNK = 60_000


def majorities(hashes: list[np.ndarray]) -> np.ndarray:
    """The fingerprint of each list of unsigned 64-bit hashes: bits that are set in over half of them. No hashes give zero. Bits are
    summed in chunks, so a very long list needs no more memory than its hashes."""
    n, sums = np.array([len(h) for h in hashes], np.int64), np.zeros((len(hashes), BITS), np.int64)
    flat = np.concatenate([*hashes, np.zeros(0, np.uint64)]).astype("<u8")
    owner = np.repeat(np.arange(len(n)), n)
    for lo in range(0, len(flat), CHUNK):
        who = owner[lo : lo + CHUNK]
        first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        sums[who[first]] += np.add.reduceat(_bits(flat[lo : lo + CHUNK]), first, axis=0, dtype=np.int32)
    return np.packbits(sums * 2 > n[:, None], axis=1, bitorder="little").view("<u8").ravel()


def shingle_hashes(text: bytes | None, width: int, seed: int) -> np.ndarray:
    """XXH64 of each run of `width` words, repeats included; fewer words are one shingle, none give none."""
    words = text.lower().split() if text else []
    plain, n, hash64 = b" ".join(words), len(words), xxhash.xxh64_intdigest
    if n <= width:
        return np.array([hash64(plain, seed)] if n else [], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: n - width].tolist()]
    return np.array([hash64(plain[a:b], seed) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)], np.uint64)


def fingerprints_of(texts: list[bytes | None], width: int, seed: int) -> np.ndarray:
    """Unsigned 64-bit fingerprints of whole texts, as int64."""
    out, waiting, size = [], [], 0
    for text in texts:
        waiting.append(shingle_hashes(text, width, seed))
        size += len(waiting[-1])
        if size > CHUNK:
            out.append(majorities(waiting))
            waiting, size = [], 0
    return np.concatenate([*out, majorities(waiting)] if waiting else out or [np.zeros(0, np.uint64)]).view(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp). Words are runs of characters other than ASCII white space after lower-casing A-Z."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                piece = batch.slice(a, 512)
                fp = fingerprints_of(piece.column(1).to_pylist(), width, seed)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(fp, pa.int64())], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("t")).mapInArrow(lean(run), "id long, fp long")


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and how often each two bits are set together, over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            x = _bits(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.float32)
            total += x.T @ x
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1), pa.int32()), pa.array([*total.ravel().astype(np.int64).tolist(), n], pa.int64())], ["k", "v"])

    rows = fps.select("fp").mapInArrow(lean(run), "k int, v long").groupBy("k").agg(F.sum("v").alias("v")).collect()
    v = np.zeros(BITS * BITS + 1)
    for r in rows:
        v[r["k"]] = r["v"]
    return int(v[-1]), v[:-1].reshape(BITS, BITS)


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fp, dtype="<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def group_bits(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Parts of nearly equal width; bits that correlate go to one part."""
    p = together.diagonal() / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((together / n - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    free, out = set(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        part = [max(free, key=lambda b: (corr[b, list(free)].sum(), -b))]
        free.discard(part[0])
        while len(part) < size:
            part.append(max(free, key=lambda b: (corr[b, part].sum(), -b)))
            free.discard(part[-1])
        out.append(part)
    return out


def differing(part: list[int], together: np.ndarray, n: int) -> np.ndarray:
    """Estimated chance that two fingerprints differ in 0, 1, ... bits of the part: its bits are taken two at
    a time with their joint frequencies, and the pairs are convolved."""
    dist = np.ones(1)
    for k in range(0, len(part), 2):
        if k + 1 == len(part):
            p = together[part[k], part[k]] / n
            dist = np.convolve(dist, [p * p + (1 - p) ** 2, 2 * p * (1 - p)])
            continue
        i, j = part[k], part[k + 1]
        p11, p1, q1 = together[i, j] / n, together[i, i] / n, together[j, j] / n
        p10, p01, p00 = p1 - p11, q1 - p11, 1 - p1 - q1 + p11
        same, two = p11**2 + p10**2 + p01**2 + p00**2, 2 * (p11 * p00 + p10 * p01)
        dist = np.convolve(dist, [same, max(0.0, 1 - same - two), two])
    return dist


def allocate(together: np.ndarray, n: int, radius: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part that is searched. Thresholds sum to radius - parts + 1, so two
    fingerprints within the radius agree within the threshold in some part; a threshold of -1 leaves a part
    out. Dynamic programming over the parts finds the cheapest thresholds by the estimated rows and
    candidates, for each number of parts; the cheapest of all is taken."""
    best = (float("inf"), [])
    for parts in range(2, radius + 4):
        groups = group_bits(together, n, parts)
        goal = radius - parts + 1
        # reach[sum of thresholds] = (cost, thresholds)
        reach: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for bits in groups:
            dist = np.cumsum(differing(bits, together, n))
            ball = np.cumsum([_choose(len(bits), w) for w in range(radius + 1)])
            step: dict[int, tuple[float, list[int]]] = {}
            for total, (cost, chosen) in reach.items():
                for t in range(-1, radius + 1):
                    more = 0.0 if t < 0 else ROW_COST * n * float(ball[t]) + PAIR_COST * n * n * float(dist[min(t, len(dist) - 1)])
                    if total + t not in step or cost + more < step[total + t][0]:
                        step[total + t] = (cost + more, [*chosen, t])
            reach = step
        if goal in reach and reach[goal][0] < best[0]:
            best = (reach[goal][0], [(g, t) for g, t in zip(groups, reach[goal][1], strict=True) if t >= 0])
    return best[1]


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def probes(fps: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """(key, role, fp): role 0 is the fingerprint's own value in a part, role 1 a value within its threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = []
        for bits, t in plan:
            shifts = [np.uint64(1) << np.uint64(k) for k in range(len(bits))]
            masks.append([np.bitwise_or.reduce(np.array(c, np.uint64)) for w in range(1, t + 1) for c in combinations(shifts, w)])
        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False)
            for a in range(0, len(whole), 4096):
                fp = whole[a : a + 4096]
                bits = _bits(fp).astype(np.uint64)
                for k, (part, _) in enumerate(plan):
                    value = (bits[:, part] << np.arange(len(part), dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
                    top = np.uint64(k << 58)
                    yield _probe_rows(value | top, 0, fp)
                    for m in masks[k]:
                        yield _probe_rows((value ^ m) | top, 1, fp)

    return fps.select("fp").mapInArrow(lean(run), "key long, role int, fp long")


def _probe_rows(key: np.ndarray, role: int, fp: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(fp), role, np.int32)), pa.array(fp)], ["key", "role", "fp"])


def links_in_runs(radius: int):
    """A function over rows sorted by (key, tile, role, fp): links of each run. Small runs give every link, larger
    ones a spanning forest of their links, so what is emitted is bounded by the rows that are read."""

    def small(fp: np.ndarray, start: np.ndarray, own: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of an own value and any later row of its run."""
        n = own.sum()
        if not n:
            return fp[:0], fp[:0]
        run = np.repeat(np.arange(len(own)), own)
        first = np.arange(n) - np.repeat(np.cumsum(own) - own, own)
        later = length[run] - first - 1
        i = np.repeat(start[run] + first, later)
        j = i + 1 + np.arange(later.sum()) - np.repeat(np.cumsum(later) - later, later)
        a, b = fp[i], fp[j]
        near = (np.bitwise_count((a ^ b).view(np.uint64)) <= radius) & (a != b)
        return a[near], b[near]

    def forest(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rest, a, b = np.unique(fp), [], []
        while len(rest):
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                x = queue.pop()
                near = np.bitwise_count((rest ^ x).view(np.uint64)) <= radius
                if near.any():
                    found, rest = rest[near], rest[~near]
                    queue += found.tolist()
                    a.append(np.full(len(found), x))
                    b.append(found)
        none = np.zeros(0, np.int64)
        return np.concatenate(a) if a else none, np.concatenate(b) if b else none

    def links(key: np.ndarray, tile: np.ndarray, role: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])])
        length = np.diff(np.r_[start, len(key)])
        own = np.add.reduceat((role == 0).astype(np.int64), start)
        few = (length <= SMALL) & (length > 1)
        for lo in range(0, few.sum(), 20_000):
            s = np.flatnonzero(few)[lo : lo + 20_000]
            yield _edges(*small(fp, start[s], own[s], length[s]))
        for r in np.flatnonzero((length > SMALL) & (own > 0)):
            yield _edges(*forest(fp[start[r] : start[r] + length[r]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        for batch in batches:
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            if kept is not None:
                now = [np.concatenate(x) for x in zip(kept, now, strict=True)]
            if not len(now[0]):
                continue
            # The last run may go on in the next batch.
            last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield from links(*(x[:cut] for x in now))
            kept = [x[cut:] for x in now]
        if kept is not None and len(kept[0]):
            yield from links(*kept)

    return run


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def near_links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Links (a, b) of distinct fingerprints within `radius` bits, enough of them that they connect whatever all of
    them connect.

    Buckets with more than TILE own values are dealt out: their rows fall into groups by a hash of the
    fingerprint, and each pair of groups is a tile of its own, so no task gets a whole hot bucket and
    no pair is left out.
    """
    n, together = bit_counts(fps)
    if n < 2:
        return fps.sparkSession.createDataFrame([], "a long, b long")
    rows = probes(fps, allocate(together, n, radius))
    hot = rows.groupBy("key").agg(F.sum(1 - F.col("role")).alias("own"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > TILE)
    hot = written(hot.select("key", F.ceil(F.col("n") / TILE).cast("int").alias("g")), "hot-buckets")
    if hot.isEmpty():
        dealt = rows.withColumn("tile", F.lit(0))
    else:
        marked = rows.join(hot, "key", "left")
        mine = F.pmod(F.xxhash64("fp"), F.col("g")).cast("int")
        others = F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("o")
        tiles = marked.filter("g is not null").select("key", "role", "fp", "g", mine.alias("mine"), others)
        tiles = tiles.select("key", "role", "fp", (F.least("mine", "o") * F.col("g") + F.greatest("mine", "o") + 1).cast("int").alias("tile"))
        dealt = marked.filter("g is null").select("key", "role", "fp", F.lit(0).alias("tile")).unionByName(tiles)
    ordered = dealt.repartition("key", "tile").sortWithinPartitions("key", "tile", "role", "fp")
    return ordered.select("key", "tile", "role", "fp").mapInArrow(lean(links_in_runs(radius)), "a long, b long")


def groups(distinct: DataFrame, radius: int) -> DataFrame:
    """distinct with `root`, the smallest fingerprint that links reach. distinct: fp and more, one row for each fingerprint."""
    # Written between the two functions in Python: in one stage they would run in two workers for each task.
    roots = components(written(near_links(distinct, radius), "links"))
    return distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (smallest id that links reach).

    Texts of fewer than `width` words are one shingle; texts without words (null too) have fingerprint zero
    and link like any other. Equal fingerprints are searched once, however many rows bear them. Null ids
    take part in links but never name a component unless it has no other id; repeated ids and rows give a row each; an
    empty table gives no rows. Very long texts are taken whole, their bits summed in chunks. Extra columns are not read.
    """
    marked = written(fingerprints(docs, id_col, text_col, width, seed), "fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    named = groups(distinct, radius)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.select("fp", broken(F.col("root").cast("string")).alias("r")).join(least.select(F.col("root").cast("string").alias("r"), "component_id"), "r").select("fp", "component_id")
    of = written(of, "fingerprint-components")
    out = marked.join(of, "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def text_key(text_col: str) -> Column:
    """64 bits that stand for a whole text; null and empty texts differ."""
    return F.xxhash64(F.col(text_col).cast("string"))


def first_of_each(docs: DataFrame, of: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each root, all columns. of: (raw, root), the component of each text_key.

    The row with the smallest id stays, rows without an id come last, then the text's key decides. Rows that share
    an id but are in different components don't touch each other.
    """
    rows = docs.select(F.col(id_col).alias("i"), text_key(text_col).alias("raw"))
    of = of.select(F.col("raw").cast("string").alias("r"), "root")
    least = F.min(F.struct(F.col("i").isNull().alias("none"), "i", "raw")).alias("m")
    stay = written(rows.distinct().withColumn("r", broken(F.col("raw").cast("string"))).join(of, "r").groupBy("root").agg(least).select(F.col("m.i").alias("__i"), F.col("m.raw").alias("__raw")), "representatives")

    def chosen(table: DataFrame, i: str) -> DataFrame:
        return table.join(stay, F.col(i).eqNullSafe(F.col("__i")) & (F.col("__r") == F.col("__raw")), "left_semi")

    kept = chosen(docs.withColumns({"__id": F.col(id_col), "__r": text_key(text_col)}), "__id")
    if chosen(rows.withColumnRenamed("raw", "__r"), "i").count() > stay.count():  # the same id and text on several rows
        kept = kept.dropDuplicates(["__id", "__r"])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
