"""Quality grades by ordinal cumulative-link regression on hashed text features."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookline.llm.common import Pieces, kept_in_worker
from brookline.llm.sampling import labelled_sample

ROWS = 1 << 17
_RUNS = re.compile(r"([^\W\d_]+)|(\d+)")


def _shape(piece: str) -> str:
    """Runs of letters as a (A with a leading capital), of digits as 0; all else is kept."""
    return _RUNS.sub(lambda m: "0" if m[2] else "A" if m[1][0].isupper() else "a", piece)


def _row(kind: str, text: str) -> int:
    return zlib.crc32(f"{kind}:{text}".encode()) % ROWS


class Features:
    """Hashed features of whole texts: words, shapes of pieces, pairs of shapes, line statistics. Counts enter
    as 1 + log, each of the four kinds is scaled to length 1."""

    def __init__(self):
        self.pieces = Pieces(lambda new: [[_row("w", p.lower().strip(".,;:!?")) * ROWS + _row("s", _shape(p))] for p in new])

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the texts, features and values, sorted by row."""
        found, n_words = self.pieces(texts)
        both = np.stack([found // ROWS, found % ROWS], axis=1)
        owner = np.repeat(np.arange(len(texts)), n_words)
        same = owner[1:] == owner[:-1]
        double = ((both[:-1, 1] * 31 + both[1:, 1] * 17 + 7) % ROWS)[same]
        at = np.r_[0, np.cumsum(n_words)]
        line_owner, line_row = [], []
        for k, t in enumerate(texts):
            lines = (t or "").split("\n")
            sizes = [len(x) for x in lines]
            repeated = len(lines) - len(set(lines))
            words = found[at[k] : at[k + 1]]
            facts = [f"n{int(np.log2(len(words) + 1))}", f"l{int(np.log2(len(lines)))}", f"r{round(8 * repeated / len(lines))}", f"m{int(np.log2(max(sizes) + 1))}", f"u{round(8 * len(np.unique(words)) / max(1, len(words)))}"]
            line_row += [_row("f", f) for f in facts]
            line_owner += [k] * len(facts)
        kinds = [(owner, both[:, 0]), (owner, both[:, 1]), (owner[1:][same], double), (np.array(line_owner, np.int64), np.array(line_row, np.int64))]
        parts = []
        for o, f in kinds:
            key, n = np.unique(o * ROWS + f, return_counts=True)
            o, v = key // ROWS, 1 + np.log(n)
            norm = np.sqrt(np.bincount(o, v * v, len(texts)))
            parts.append((o, key % ROWS, v / norm[o]))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


class Ordinal:
    """P(grade > k) = sigmoid(w x - cut k), with shared weights and increasing cuts."""

    def __init__(self, grades: list[int], weights: np.ndarray, cuts: np.ndarray):
        self.grades, self.weights, self.cuts = grades, weights, cuts

    def above(self, eta: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(eta[:, None] - self.cuts, -30, 30)))

    def eta(self, texts: list[str | None], features: Features) -> np.ndarray:
        owner, row, value = features(texts)
        return np.bincount(owner, self.weights[row] * value, len(texts))


def train(rows: list[tuple[str, int]], epochs: int = 30, decay: float = 1e-4, seed: int = 5) -> Ordinal | None:
    """Maximum likelihood by Adagrad over small batches. None without two grades."""
    grades = sorted({y for _, y in rows})
    if len(grades) < 2:
        return None
    y = np.array([grades.index(g) for _, g in rows])
    features, vectors = Features(), []
    for a in range(0, len(rows), 256):
        texts = [t for t, _ in rows[a : a + 256]]
        owner, row, value = features(texts)
        order = np.argsort(owner, kind="stable")
        ends = np.searchsorted(owner[order], np.arange(len(texts) + 1))
        vectors += [(row[order[s:e]], value[order[s:e]]) for s, e in zip(ends[:-1], ends[1:], strict=True)]
    share = np.array([(y > k).mean() for k in range(len(grades) - 1)])
    first, steps = np.log((1 - share[0]) / share[0]), np.full(len(grades) - 2, 0.5)
    w, g2 = np.zeros(ROWS), np.full(ROWS, 1e-6)
    cut, cut2 = np.r_[first, np.log(np.expm1(np.maximum(steps, 1e-3)))], np.full(len(grades) - 1, 1e-6)
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        rate = 0.3 / (1 + 0.1 * epoch)
        for a in range(0, len(order), 32):
            some = order[a : a + 32]
            row = np.concatenate([vectors[i][0] for i in some])
            value = np.concatenate([vectors[i][1] for i in some])
            owner = np.repeat(np.arange(len(some)), [len(vectors[i][0]) for i in some])
            eta = np.bincount(owner, w[row] * value, len(some))
            rise = np.logaddexp(0, cut[1:])
            cuts = cut[0] + np.r_[0, np.cumsum(rise)]
            up = 1 / (1 + np.exp(-np.clip(eta[:, None] - cuts, -30, 30)))  # P(grade > k)
            # The likelihood of grade g is up[g - 1] - up[g], with up[-1] = 1 and up[last] = 0.
            full = np.concatenate([np.ones((len(some), 1)), up, np.zeros((len(some), 1))], axis=1)
            mine = y[some]
            hi, lo = full[np.arange(len(some)), mine], full[np.arange(len(some)), mine + 1]
            p = np.maximum(hi - lo, 1e-9)
            dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
            deta = -(dhi - dlo)
            dcuts = np.zeros(len(cuts) + 2)
            np.add.at(dcuts, mine, dhi)
            np.add.at(dcuts, mine + 1, -dlo)
            dcuts = dcuts[1:-1]
            grad = np.bincount(row, deta[owner] * value, ROWS) / len(some)
            used = np.unique(row)
            grad = grad[used] + decay * w[used]
            g2[used] += grad * grad
            w[used] -= rate * grad / np.sqrt(g2[used])
            dcut = np.r_[dcuts.sum(), [dcuts[k + 1 :].sum() / (1 + np.exp(-cut[k + 1])) for k in range(len(cut) - 1)]] / len(some)
            cut2 += dcut * dcut
            cut -= 0.3 * rate * dcut / np.sqrt(cut2)
    return Ordinal(grades, w, cut[0] + np.r_[0, np.cumsum(np.logaddexp(0, cut[1:]))])


def fit(docs: DataFrame, labels: DataFrame, held_out, per_grade: int = 1500, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "quality") -> Ordinal | None:
    """Learn from a bounded sample: about per_grade rated texts of each grade."""
    return train([(t, int(y)) for t, y in labelled_sample(docs, labels, per_grade, id_col, text_col, grade_col, held_out)])


def grade(docs: DataFrame, model: Ordinal | None, id_col: str = "doc_id", text_col: str = "text", tail_from: int | None = None) -> DataFrame:
    """id, expected_grade, tail_probability (that the grade is at least tail_from; the highest grade by default).

    Null and empty texts are graded by their line statistics alone. Without a model (fewer than two grades were
    seen) both are null. Equal texts get equal grades; repeated rows each get a row; an empty table gives none. Very long texts are taken
    whole. Extra columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = kept_in_worker("quality", Features)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                piece = batch.slice(a, 256)
                n = piece.num_rows
                if model is None:
                    expected = tail = pa.nulls(n, pa.float64())
                else:
                    up = model.above(model.eta(piece.column(1).to_pylist(), features))
                    # P(grade > last) is 0, P(grade > one before the first) is 1.
                    full = np.concatenate([np.ones((n, 1)), up, np.zeros((n, 1))], axis=1)
                    at = np.searchsorted(model.grades, model.grades[-1] if tail_from is None else tail_from)
                    expected = pa.array(model.grades[0] + up @ np.diff(model.grades), pa.float64())
                    tail = pa.array(full[:, at], pa.float64())
                yield pa.RecordBatch.from_arrays([piece.column(0), expected, tail], ["id", "expected_grade", "tail_probability"])

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "id long, expected_grade double, tail_probability double")
    return out.withColumnRenamed("id", id_col)
