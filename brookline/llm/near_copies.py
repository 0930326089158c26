"""Near copies by the Jaccard similarity of word shingles, the filtering form of the SimHash operator.

Candidates are the groups of SimHash fingerprints that the pigeonhole search of `simhash` finds. At a similarity of 0.8 two fingerprints
differ in about 10 of 64 bits, more than that search can allow, so MinHash bands add the candidates that it can't see. Whole shingle
sets decide about every link."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookline.llm.common import broken, lean, written
from brookline.llm.components import components
from brookline.llm.simhash import first_of_each, groups, majorities, shingle_hashes, text_key

#: Two texts of similarity s share a band with chance 1 - (1 - s ** ROWS) ** BANDS: 0.9998 at 0.8, 0.36 at 0.5.
BANDS, ROWS = 28, 6
#: Texts, and shingles, of a candidate component that one task compares; larger ones are dealt out in tiles.
TILE, TILE_SHINGLES = 1024, 4_000_000
_rng = np.random.default_rng(7)
MASKS, FACTORS = (_rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64, endpoint=False) for _ in range(2))
FACTORS |= np.uint64(1)


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """The distinct 64-bit hashes of all runs of `width` words, ascending; fewer words are one shingle, none give none."""
    return np.unique(shingle_hashes(text, width, 0))


def bands_of(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BANDS keys for each set; sets are not empty."""
    flat, first = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    out = np.zeros((len(sets), BANDS), np.uint64)
    for k, (mask, factor) in enumerate(zip(MASKS, FACTORS, strict=True)):
        low = np.minimum.reduceat((flat ^ mask) * factor, first)
        at = k // ROWS
        out[:, at] = ((out[:, at] ^ low) + np.uint64(at + 1)) * np.uint64(0x9E3779B97F4A7C15)
    return out ^ out >> np.uint64(29)


def _lists(rows: np.ndarray) -> pa.Array:
    n, m = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * m + 1, m, dtype=np.int32)), pa.array(rows.view(np.int64).ravel()))


def signatures(texts: DataFrame, width: int) -> DataFrame:
    """(raw, words, n, fp, bands) of texts (raw, t): a hash of the words, the number of shingles, a SimHash fingerprint of the distinct
    shingles, and MinHash bands."""

    def some(raw: list[int], found: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        full = [k for k, s in enumerate(sets) if len(s)]
        bands = np.zeros((len(sets), BANDS), np.uint64)
        if full:
            bands[full] = bands_of([sets[k] for k in full])
        columns = [pa.array(raw, pa.int64()), pa.array(found, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(majorities(sets).view(np.int64)), _lists(bands)]
        return pa.RecordBatch.from_arrays(columns, ["raw", "words", "n", "fp", "bands"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, found, sets, total = [], [], [], 0
            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_py()
                raw.append(batch.column(0)[k].as_py())
                found.append(xxhash.xxh64_intdigest(b" ".join((text or b"").lower().split())) - (1 << 63))
                sets.append(shingles(text, width))
                total += len(sets[-1])
                if total > 60_000:
                    yield some(raw, found, sets)
                    raw, found, sets, total = [], [], [], 0
            if raw:
                yield some(raw, found, sets)

    return texts.select("raw", F.col("t").cast("string").cast("binary")).mapInArrow(lean(run), "raw long, words long, n long, fp long, bands array<long>")


def candidates(distinct: DataFrame, radius: int) -> DataFrame:
    """(node, root): components of texts in one group of fingerprints or with a band in common. distinct: words, n, fp, bands, a row for each `words`."""
    full = distinct.filter("n > 0")
    rows = full.select("words", F.posexplode("bands").alias("band", "v"))
    # The band is in the key: equal values of different bands don't meet. A group of fingerprints is a band of its own.
    found = groups(written(full.select("fp").distinct(), "distinct-fingerprints"), radius).select(F.col("fp").cast("string").alias("f"), "root")
    grouped = full.withColumn("f", broken(F.col("fp").cast("string"))).join(found, "f").select("words", F.xxhash64(F.lit(BANDS), "root").alias("key"))
    rows = written(rows.select("words", F.xxhash64("band", "v").alias("key")).unionByName(grouped), "bands")
    shared = rows.groupBy("key").agg(F.min("words").alias("b"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    links = rows.withColumn("k", broken(F.col("key").cast("string"))).join(shared.select(F.col("key").cast("string").alias("k"), "b"), "k")
    return components(links.select(F.col("words").alias("a"), "b").filter("a <> b").distinct())


def similar(x: np.ndarray, others: list[np.ndarray], least: float) -> np.ndarray:
    """Whether the Jaccard similarity of x to each of the others is `least` or more."""
    sizes = np.array([len(o) for o in others])
    flat = np.concatenate(others)
    at = np.searchsorted(x, flat).clip(max=len(x) - 1)
    common = np.add.reduceat((x[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
    return common / (len(x) + sizes - common) >= least


def verified(bands: np.ndarray, fps: np.ndarray, sets: list[np.ndarray], least: float, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that share a band, or have near fingerprints, and are similar enough."""
    rest, out = np.arange(len(sets)), []
    sizes = np.array([len(s) for s in sets])
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            n = sizes[rest]
            near = (np.minimum(n, sizes[x]) / np.maximum(n, sizes[x]) >= least) & ((bands[rest] == bands[x]).any(axis=1) | (np.bitwise_count(fps[rest] ^ fps[x]) <= radius))
            at = np.flatnonzero(near)
            for lo in range(0, len(at), 256):
                part = at[lo : lo + 256]
                near[part] = similar(sets[x], [sets[k] for k in rest[part]], least)
            found, rest = rest[near], rest[~near]
            queue += found.tolist()
            out += [(x, k) for k in found]
    return out


def links(of: DataFrame, texts: DataFrame, width: int, least: float, radius: int) -> DataFrame:
    """Links (a, b) of texts with a Jaccard similarity of `least` or more, enough of them that they connect whatever
    all of them connect. of: words, raw, n, fp, bands; texts: raw, t.

    Every pair of candidates lies in one candidate component. Large components are dealt out: their texts fall
    into groups, and each pair of groups is a tile, so no task gets a whole one and no pair is left out.
    """
    roots = written(candidates(of, radius), "candidate-components")
    named = of.withColumn("k", broken(F.col("words").cast("string"))).join(roots.select(F.col("node").cast("string").alias("k"), "root"), "k")
    named = written(named.select("words", "raw", "n", "fp", "bands", "root"), "candidates")
    hot = named.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / TILE), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int").alias("g"))
    hot = written(hot.filter("g > 1"), "large-components")
    # One text for each raw; a text on very many rows is reduced before it is moved.
    wanted = named.select(F.col("raw").cast("string").alias("r"))
    one = texts.withColumn("r", broken(F.col("raw").cast("string"))).join(wanted, "r", "left_semi").select("raw", F.col("t").cast("string").cast("binary").alias("t"))
    one = written(one.groupBy("raw").agg(F.min("t").alias("t")), "candidate-texts")
    whole = named.join(one, "raw")
    g = F.col("g")
    marked = whole.join(F.broadcast(hot), "root", "left") if hot.count() < 10_000 else whole.join(hot, "root", "left")
    mine = F.pmod(F.xxhash64("words"), g).cast("int")
    tiles = F.when(g.isNull(), F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.coalesce(g, F.lit(1)) - 1), lambda o: (F.least(mine, o) * g + F.greatest(mine, o) + 1).cast("int")))
    dealt = marked.select("root", F.explode(tiles).alias("tile"), "words", "fp", "bands", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, fps, bands, sets = None, [], [], [], []

        def done() -> Iterator[pa.RecordBatch]:
            if len(ids) > 1:
                found = verified(np.array(bands, np.int64), np.array(fps, np.int64).view(np.uint64), sets, least, radius)
                a, b = ([ids[p[side]] for p in found] for side in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for k in range(batch.num_rows):
                root, tile, word, fp, band, text = (batch.column(c)[k].as_py() for c in range(6))
                if (root, tile) != key:
                    yield from done()
                    key, ids, fps, bands, sets = (root, tile), [], [], [], []
                ids.append(word)
                fps.append(fp)
                bands.append(band)
                sets.append(shingles(text, width))
        yield from done()

    return dealt.repartition("root", "tile").sortWithinPartitions("root", "tile").mapInArrow(lean(run), "a long, b long")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8, radius: int = 4) -> DataFrame:
    """One row of each component of similar texts, all columns: see first_of_each.

    Texts with the same words are one text; so are all texts without words (null and empty too). Texts of fewer than `width` words are one
    shingle. Repeated rows, ties and null ids: see first_of_each. Very long texts are taken whole; an empty table gives no rows."""
    texts = docs.select(text_key(text_col).alias("raw"), F.col(text_col).alias("t"))
    marked = written(signatures(texts, width), "signatures")
    of = written(marked.groupBy("words").agg(F.min("raw").alias("raw"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "distinct-words")
    # Written between the two functions in Python: in one stage they would run in two workers for each task.
    roots = components(written(links(of, texts, width, least, radius), "links"))
    pairs = marked.select("raw", "words").distinct().withColumn("k", broken(F.col("words").cast("string")))
    named = pairs.join(roots.select(F.col("node").cast("string").alias("k"), "root"), "k", "left")
    return first_of_each(docs, named.select("raw", F.coalesce("root", "words").alias("root")), id_col, text_col)
