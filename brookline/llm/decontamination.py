"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of the passage and the test item."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookline.llm.common import lean

WORDS = re.compile(r"[^\W_]+")
#: Characters of test items that one pass over the documents searches for; more items take more passes.
BLOCK_CHARS = 2_000_000
#: A seed has at least so many words, and by the words' frequencies a chance below this to start at a given place.
SEED_WORDS, RARE = 3, 1e-9
MATCH, MISMATCH, GAP = 2, -1, -1


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment by Smith-Waterman with linear gaps: score, and the first and last + 1 place of the passage."""
    n = len(passage)
    steps = np.arange(n + 1)
    h, origin = np.zeros(n + 1, np.int64), steps.copy()
    best = (0, 0, 0)
    for w in item:
        diagonal = h[:-1] + np.where(passage == w, MATCH, MISMATCH)
        up = h[1:] + GAP
        new, start = np.zeros(n + 1, np.int64), steps.copy()
        take = np.maximum(diagonal, up)
        from_ = np.where(diagonal >= up, origin[:-1], origin[1:])
        new[1:] = np.maximum(take, 0)
        start[1:] = np.where(take > 0, from_, steps[1:])
        # A gap along the passage: the running maximum of score - GAP * place.
        lifted = new - GAP * steps
        run = np.maximum.accumulate(lifted)
        at = np.maximum.accumulate(np.where(lifted == run, steps, 0))
        better = run + GAP * steps > new
        start = np.where(better, start[at], start)
        h, origin = np.where(better, run + GAP * steps, new), start
        top = int(h.argmax())
        if h[top] > best[0]:
            best = (int(h[top]), int(origin[top]), top)
    return best


class Index:
    """Seeds of a block of test items. Words of items have numbers from 1; all other words are 0 and match nothing."""

    def __init__(self, items: list[tuple[int, list[str]]], frequency: dict[str, int], total: int):
        self.number = {w: k + 1 for k, w in enumerate(sorted({w for _, words in items for w in words}))}
        self.items = [(i, np.array([self.number[w] for w in words], np.int64)) for i, words in items]
        self.short = any(len(words) < SEED_WORDS for _, words in items)
        seeds: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for k, (_, words) in enumerate(items):
            found = False
            p = [math.log(max(frequency.get(w, 0), 1) / max(total, 1)) for w in words]
            for a in range(len(words)):
                chance, n = 0.0, 0
                while a + n < len(words) and (n < SEED_WORDS or chance > math.log(RARE)):
                    chance += p[a + n]
                    n += 1
                if n >= SEED_WORDS and chance <= math.log(RARE):
                    seeds.setdefault(tuple(self.items[k][1][a : a + n].tolist()), []).append((k, a))
                    found = True
            chance = sum(p)
            if not found and (len(words) >= SEED_WORDS or chance <= math.log(RARE)):  # an item of common words alone, or a rare short one, is its own seed
                seeds.setdefault(tuple(self.items[k][1].tolist()), []).append((k, 0))
        self.by_head: dict[int, list[tuple[tuple[int, ...], list[tuple[int, int]]]]] = {}
        for s, where in seeds.items():
            self.by_head.setdefault(self.head(s), []).append((s, where))
        self.heads = np.array(sorted(self.by_head), np.int64)

    def head(self, s: tuple[int, ...]) -> int:
        a, b, c = (*s[:3], 0, 0)[:3]
        n = len(self.number) + 1
        return (a * n + b) * n + c

    def hits(self, ids: np.ndarray) -> dict[int, list[int]]:
        """By item, the places where the item would start for each of its seeds in the text."""
        out: dict[int, list[int]] = {}
        n = len(self.number) + 1
        padded = np.r_[ids, 0, 0]
        first = np.flatnonzero(ids)
        for heads in ((padded[first] * n + padded[first + 1]) * n + padded[first + 2], (padded[first] * n + padded[first + 1]) * n, padded[first] * n * n):
            at = np.searchsorted(self.heads, heads).clip(max=max(0, len(self.heads) - 1))
            good = first[self.heads[at] == heads] if len(self.heads) else first[:0]
            for place in np.unique(good).tolist():
                for key in {self.head(tuple(padded[place : place + k].tolist())) for k in (1, 2, 3)}:
                    for s, where in self.by_head.get(key, ()):
                        if tuple(ids[place : place + len(s)].tolist()) == s:
                            for k, a in where:
                                out.setdefault(k, []).append(place - a)
            if not self.short:
                break
        return out

    def matches(self, ids: np.ndarray, least: float, passage: int) -> Iterator[tuple[int, float, int, int]]:
        """(item id, score, first word, last word + 1) of each item whose best alignment reaches `least` of a full match, or the score of
        `passage` words that are all the same."""
        for k, starts in self.hits(ids).items():
            item_id, item = self.items[k]
            n, best = len(item), (0.0, 0, 0)
            enough = min(least, passage / n)
            margin = max(5, n // 2)
            starts = sorted(set(starts))
            groups, last = [[starts[0], starts[0]]], starts[0]
            for s in starts[1:]:
                if s - last > margin:
                    groups.append([s, s])
                groups[-1][1] = last = s
            for lo, hi in groups:
                if lo == hi and lo >= 0 and lo + n <= len(ids) and (ids[lo : lo + n] == item).all():
                    best = max(best, (1.0, lo, lo + n))
                    continue
                a, b = max(0, lo - margin), min(len(ids), hi + n + margin)
                score, s, e = align(item, ids[a:b])
                best = max(best, (score / (MATCH * n), a + s, a + e))
                if best[0] >= 1:
                    break
            if best[0] >= enough:
                yield item_id, best[0], best[1], best[2]


def numbers(number: dict[str, int], text: str | None) -> np.ndarray:
    """The words of a text as numbers of an index, 0 for words that it lacks."""
    words = words_of(text)
    return np.fromiter(map(number.get, words, repeat(0)), np.int64, len(words))


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, list[str]]]]:
    """Items with at least one word, in blocks of bounded size. Repeated rows of an item are one item; items without an id count by their text."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).filter("t is not null").distinct()
    chars = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, math.ceil(chars / BLOCK_CHARS))
    for k in range(n):
        part = [(r["i"], words_of(r["t"])) for r in rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).orderBy("i", "t").collect()]
        part = [(i, w) for i, w in part if w]
        if part:
            yield part


def _indexes(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text: str) -> list[Index]:
    out = []
    for items in _blocks(benchmark, item_col, item_text):
        number = {w: k + 1 for k, w in enumerate(sorted({w for _, words in items for w in words}))}

        def count(batches: Iterator[pa.RecordBatch], number: dict[str, int] = number) -> Iterator[pa.RecordBatch]:
            n, waiting, size = np.zeros(len(number) + 1, np.int64), [], 0
            for batch in batches:
                for text in batch.column(0):
                    waiting.append(numbers(number, text.as_py()))
                    size += len(waiting[-1])
                    if size > 500_000:
                        n += np.bincount(np.concatenate(waiting), minlength=len(n))
                        waiting, size = [], 0
            if waiting:
                n += np.bincount(np.concatenate(waiting), minlength=len(n))
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(n[used], pa.int64())], ["k", "n"])

        counts = {r["k"]: r["n"] for r in docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(lean(count), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()}
        names = {k: w for w, k in number.items()}
        out.append(Index(items, {names[k]: n for k, n in counts.items() if k}, sum(counts.values())))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: float = 0.5, passage: int = 50) -> DataFrame:
    """One row per document and test item whose alignment reaches `least` of a full match: id, item_id, score (of a full
    match), first_word, last_word. Of a long item the score of `passage` equal words is enough.

    Word frequencies are counted over all documents (only words of the items are kept, so what reaches the
    driver is bounded by a block of items). At each word of an item the shortest run of three or more words whose chance
    by these frequencies is below one in 10^9 is a seed. Documents are read once per block of items and never shuffled, so a passage
    that a third of them share costs no hot key. Items of one or two words count only if they are as rare as a seed
    as a whole; items of three words and more that are common throughout match as a whole alone. Null and empty texts match nothing; items without a word are
    left out, items without an id are searched like others and give a null item_id; repeated rows each get their rows; no items give no rows.
    Very long texts are aligned only around their seeds. Extra columns are not read.
    """
    out = None
    for index in _indexes(docs, benchmark, text_col, item_col, item_text):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(i, *m) for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for m in index.matches(numbers(index.number, text.as_py()), least, passage)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()], strict=True)], ["id", "item_id", "score", "first_word", "last_word"])

        part = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(lean(run), "id long, item_id long, score double, first_word int, last_word int")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "id long, item_id long, score double, first_word int, last_word int")
    return out.withColumnRenamed("id", id_col)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: float = 0.5, passage: int = 50) -> DataFrame:
    """The rows of docs that hold no test item, with all their columns. One pass per block of items; no shuffle."""
    schema, at = docs.schema, docs.columns.index(text_col)
    for index in _indexes(docs, benchmark, text_col, item_col, item_text):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [next(index.matches(numbers(index.number, text.as_py()), least, passage), None) is None for text in batch.column(at)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(lean(run), schema)
    return docs
