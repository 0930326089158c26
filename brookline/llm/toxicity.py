"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookline.llm.common import Pieces, fresh_key, give_back, kept_in_worker
from brookline.llm.sampling import labelled_sample

WORDS = re.compile(r"[^\W\d_]+")
#: Words of a window, and the step from one window to the next: windows overlap by half, and all are scored.
WINDOW, STEP = 40, 20
#: Longer runs of letters are several words of this many characters; each shares two with the next, so no trigram is lost.
LONGEST = 60
HIDDEN, WORD_DIM, CHAR_DIM, CHAR_ROWS, ATTEND = 8, 8, 8, 2048, 8


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Word input: a row of a table for words of the training vocabulary, row 0 for others. Character
    input: the mean of hashed trigram rows of the word between boundary marks. Both go into a forward and a
    backward gated recurrent layer; attention pools the states of a window into one logit."""

    def __init__(self, vocabulary: list[str], seed: int = 3):
        g = np.random.default_rng(seed)
        self.index = {w: k + 1 for k, w in enumerate(vocabulary)}

        def make(*shape: int, scale: float = 0.3) -> np.ndarray:
            return (g.standard_normal(shape) * scale).astype(np.float32)

        h, d = HIDDEN, WORD_DIM + CHAR_DIM
        self.p = {
            "words": make(len(vocabulary) + 1, WORD_DIM, scale=0.05), "chars": make(CHAR_ROWS, CHAR_DIM, scale=0.05), "w": make(d, 6 * h), "b": np.zeros(6 * h, np.float32),
            "uf": make(h, 3 * h), "ub": make(h, 3 * h), "a": make(2 * h, ATTEND), "v": make(ATTEND), "o": make(2 * h), "c": np.zeros(1, np.float32),
        }
        self.scale, self.key = np.array([1.0, 0.0]), fresh_key()

    @staticmethod
    def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the trigrams of all words, and where each word's begin."""
        marked = [f"<{w}>".encode() for w in words]
        sizes = np.array([len(m) for m in marked])
        text = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint32)
        value = (text[:-2] * np.uint32(2654435761) ^ text[1:-1] * np.uint32(2246822519) ^ text[2:] * np.uint32(3266489917)) * np.uint32(668265263)
        first = np.cumsum(sizes) - sizes
        inner = np.ones(len(value), bool)
        edge = (first + sizes)[:-1, None] - np.array([1, 2])
        inner[edge.ravel()] = False
        return (value[inner] >> np.uint32(21)).astype(np.int64), np.cumsum(sizes - 2) - (sizes - 2)

    def inputs(self, words: list[str]) -> np.ndarray:
        p = self.p
        rows, first = self.grams(words)
        chars = np.add.reduceat(p["chars"][rows], first, axis=0) / np.diff(np.r_[first, len(rows)])[:, None].astype(np.float32)
        return np.concatenate([p["words"][[self.index.get(w, 0) for w in words]], chars], axis=1)

    def project(self, words: list[str]) -> np.ndarray:
        return self.inputs(words) @ self.p["w"] + self.p["b"]

    def _layer(self, x: np.ndarray, u: np.ndarray, mask: np.ndarray, order: range, keep: list | None) -> np.ndarray:
        """x: time, rows, 3 * HIDDEN. States by time."""
        h, n = HIDDEN, x.shape[1]
        state, out = np.zeros((n, h), np.float32), np.empty((x.shape[0], n, h), np.float32)
        whole = mask.all()
        for t in order:
            hu = state @ u
            gates = _sigmoid(x[t, :, : 2 * h] + hu[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            new = np.tanh(x[t, :, 2 * h :] + r * hu[:, 2 * h :])
            after = new + z * (state - new)
            if not whole:
                after = np.where(mask[t, :, None], after, state)
            if keep is not None:
                keep.append((t, state, z, r, hu[:, 2 * h :], new))
            state = out[t] = after
        return out

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits. x: time, rows, 6 * HIDDEN; mask: time, rows."""
        p, h3 = self.p, 3 * HIDDEN
        kf, kb = ([], []) if keep is not None else (None, None)
        f = self._layer(x[:, :, :h3], p["uf"], mask, range(x.shape[0]), kf)
        b = self._layer(x[:, :, h3:], p["ub"], mask, range(x.shape[0] - 1, -1, -1), kb)
        s = np.concatenate([f, b], axis=2)
        act = np.tanh(s @ p["a"])
        score = np.where(mask, act @ p["v"], -1e9)
        e = np.exp(score - score.max(axis=0))
        alpha = e / e.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", alpha, s)
        if keep is not None:
            keep.update(f=kf, b=kb, s=s, act=act, alpha=alpha, pooled=pooled)
        return pooled @ p["o"] + p["c"][0]

    def backward(self, x: np.ndarray, mask: np.ndarray, keep: dict, dz: np.ndarray) -> tuple[np.ndarray, dict]:
        p, h = self.p, HIDDEN
        s, act, alpha = keep["s"], keep["act"], keep["alpha"]
        g = {"o": keep["pooled"].T @ dz, "c": np.array([dz.sum()], np.float32)}
        dpool = dz[:, None] * p["o"]
        dalpha = np.einsum("nh,tnh->tn", dpool, s)
        dscore = alpha * (dalpha - (alpha * dalpha).sum(axis=0))
        g["v"] = np.einsum("tn,tnk->k", dscore, act)
        dact = dscore[:, :, None] * p["v"] * (1 - act**2)
        g["a"] = np.einsum("tnh,tnk->hk", s, dact)
        ds = alpha[:, :, None] * dpool + dact @ p["a"].T
        dx = np.zeros_like(x)
        for key, name, lo in (("f", "uf", 0), ("b", "ub", h)):
            u, gu, carry = p[name], np.zeros_like(p[name]), 0.0
            for t, before, z, r, hn, new in reversed(keep[key]):
                m = mask[t, :, None]
                d = ds[t, :, lo : lo + h] + carry
                dm = d * m
                dzr, dn = dm * (before - new) * z * (1 - z), dm * (1 - z) * (1 - new**2)
                dr, dhn = dn * hn * r * (1 - r), dn * r
                both = np.concatenate([dzr, dr, dhn], axis=1)
                gu += before.T @ both
                carry = dm * z + both @ u.T + d * (1 - m)
                dx[t, :, 3 * lo : 3 * lo + 3 * h] = np.concatenate([dzr, dr, dn], axis=1)
            g[name] = gu
        return dx, g


def windows(n: int) -> np.ndarray:
    """Starts of all windows over n words; the last one ends at the last word."""
    if n <= WINDOW:
        return np.zeros(1 if n else 0, np.int64)
    last = n - WINDOW
    starts = np.arange(0, last + 1, STEP)
    return starts if starts[-1] == last else np.r_[starts, last]


def words_of(text: str | None) -> list[str]:
    found = WORDS.findall(text.lower()) if text else []
    if found and len(max(found, key=len)) > LONGEST:
        found = [w[a : a + LONGEST] for w in found for a in range(0, max(1, len(w) - 2), LONGEST - 2)]
    return found


def thin_copies(docs: list[tuple[np.ndarray, int]], crc: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """One of each family of near copies, by the smallest hashes of their rare words: copies share a label and
    would teach their accidental words. docs: word numbers and label; crc: the hash of each word."""
    df = _texts_with([words for words, _ in docs], len(crc))
    most = max(3, len(docs) // 100)
    seen, out = set(), []
    for words, y in docs:
        low = np.unique(crc[words[df[words] <= most]])[:6].tolist()
        pairs = set(zip(low, low[1:], strict=False))
        if pairs and pairs & seen:
            continue
        seen |= pairs
        out.append((words, y))
    return out


def _texts_with(docs: list[np.ndarray], n: int) -> np.ndarray:
    """Of each word the number of texts that hold it."""
    out = np.zeros(n, np.int64)
    for words in docs:
        out[np.unique(words)] += 1
    return out


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places first, first + 1, ... of runs of the given sizes."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


def train(rows: list[tuple[str, str]], most_words: int = 30_000, least_texts: int = 10, epochs: int = 10, seed: int = 3, log: Callable[[str], None] | None = None) -> Network | None:
    """Multiple-instance training: a text is as toxic as its most toxic window, so each epoch scores all windows of
    the sample and learns from the strongest of each text. Word rows start at smoothed log-odds in their
    first coordinate. Words in fewer than least_texts texts have no row of their own; with few texts of a label, an eighth of them is
    enough. None if the sample lacks one of the labels. Texts are held as numbers of words, about 4 bytes a word."""
    number: dict[str, int] = {}
    docs = [(np.array([number.setdefault(w, len(number)) for w in found], np.int32), int(int(y) == 1)) for t, y in rows if (found := words_of(t))]
    every = list(number)
    del number
    docs = thin_copies(docs, np.array([zlib.crc32(w.encode()) for w in every], np.int64))
    if len({y for _, y in docs}) < 2:
        return None
    y = np.array([y for _, y in docs])
    n = [int((y == 0).sum()), int((y == 1).sum())]
    df = [_texts_with([words for words, label in docs if label == k], len(every)) for k in (0, 1)]
    both = df[0] + df[1]
    frequent = np.flatnonzero(both >= min(least_texts, max(2, min(n) // 8)))
    frequent = sorted(frequent.tolist(), key=lambda w: (-both[w], every[w]))[:most_words]
    net = Network([every[w] for w in frequent], seed)
    odds = np.log((df[1][frequent] + 0.5) / (n[1] + 1)) - np.log((df[0][frequent] + 0.5 + 0.02 * n[0]) / (n[0] + 1))
    net.p["words"][1:, 0] += np.clip(odds, 0, 4).astype(np.float32) * 0.5

    flat, first = net.grams(every)
    flat, size = flat.astype(np.int32), np.diff(np.r_[first, len(flat)])
    rows_of = np.array([net.index.get(w, 0) for w in every], np.int32)
    idx, owner = [], []
    for k, (ids, _) in enumerate(docs):
        starts = windows(len(ids))
        at = starts[:, None] + np.arange(WINDOW)
        idx.append(np.where(at < len(ids), ids[np.minimum(at, len(ids) - 1)], -1).astype(np.int32))
        owner.append(np.full(len(starts), k))
    idx, owner = np.concatenate(idx), np.concatenate(owner)

    def inputs(some: np.ndarray) -> np.ndarray:
        chars = np.add.reduceat(net.p["chars"][flat[_spread(first[some], size[some])]], np.cumsum(size[some]) - size[some], axis=0) / size[some][:, None].astype(np.float32)
        return np.concatenate([net.p["words"][rows_of[some]], chars], axis=1)

    def all_logits() -> tuple[np.ndarray, np.ndarray]:
        parts = [inputs(np.arange(a, min(a + 4096, len(every)))) @ net.p["w"] + net.p["b"] for a in range(0, len(every), 4096)]
        proj = np.concatenate(parts)
        return proj, np.concatenate([net.forward(*_gather(proj, idx[a : a + 1024])) for a in range(0, len(idx), 1024)])

    rng = np.random.default_rng(seed)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step, weight = 0, np.where(y == 1, 0.5 * len(y) / n[1], 0.5 * len(y) / n[0])
    for epoch in range(epochs):
        proj, logits = all_logits()
        order = np.lexsort((logits, owner))
        ends = np.r_[np.flatnonzero(np.diff(owner[order])), len(order) - 1]
        top = order[ends]  # by document, its strongest window
        if log:
            z = logits[top]
            log(f"epoch {epoch}: toxic over 0 {np.mean(z[y == 1] > 0):.3f}, others {np.mean(z[y == 0] > 0):.3f}")
        # Strongest windows of all documents, and random ones of those that are not toxic.
        extra = rng.choice(np.flatnonzero(y[owner] == 0), min(600, n[0]), replace=False)
        use = np.r_[top, extra]
        rng.shuffle(use)
        rate = 0.02 * (1 - epoch / epochs) + 0.002
        for a in range(0, len(use), 64):
            x, mask = _gather(proj, idx[use[a : a + 64]])
            seen, back = np.unique(idx[use[a : a + 64]].T[mask], return_inverse=True)
            fresh = inputs(seen)
            x[mask] = (fresh @ net.p["w"] + net.p["b"])[back]
            keep: dict = {}
            z = net.forward(x, mask, keep)
            who = owner[use[a : a + 64]]
            dz = ((_sigmoid(z) - (0.03 + 0.94 * y[who])) * weight[who] / len(z)).astype(np.float32)
            dx, g = net.backward(x, mask, keep, dz)
            by = np.zeros((len(seen), dx.shape[2]), np.float32)
            np.add.at(by, back, dx[mask])
            g["w"], g["b"] = fresh.T @ by, by.sum(axis=0)
            din = by @ net.p["w"].T
            g["words"], g["chars"] = np.zeros_like(net.p["words"]), np.zeros_like(net.p["chars"])
            np.add.at(g["words"], rows_of[seen], din[:, :WORD_DIM])
            sizes = size[seen]
            np.add.at(g["chars"], flat[_spread(first[seen], sizes)], np.repeat(din[:, WORD_DIM:] / sizes[:, None], sizes, axis=0))
            step += 1
            for k, v in net.p.items():
                grad = g[k] + 1e-5 * v
                m, s2 = moments[k]
                m *= 0.9
                m += 0.1 * grad
                s2 *= 0.99
                s2 += 0.01 * grad * grad
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s2 / (1 - 0.99**step)) + 1e-6)
    best = np.full(len(docs), -np.inf)
    np.maximum.at(best, owner, all_logits()[1])
    net.scale = _calibrate(best, y, np.full(len(y), 1 / len(y)))
    return net


def _gather(proj: np.ndarray, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return proj[np.maximum(idx.T, 0)], idx.T >= 0


def _calibrate(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Slope and shift of a logistic curve over the strongest logits."""
    a = np.array([1.0, 0.0])
    for _ in range(400):
        d = (_sigmoid(a[0] * z + a[1]) - (0.02 + 0.96 * y)) * weight
        a -= 0.5 * np.array([(d * z).sum(), d.sum()])
        a[0] = max(a[0], 0.05)
    return a


class Scorer:
    """Scores whole texts. A piece between white space stands for all its words, in order, as in training; their
    projected inputs are remembered as rows of a table."""

    def __init__(self, net: Network, most: int = 48_000_000):
        self.net, self.n, self.rows = net, 0, np.zeros((1, 6 * HIDDEN), np.float32)
        self.pieces = Pieces(self._learn, most, self._forget)
        self.pieces.ENTRY += self.rows.nbytes  # a row for each, or nearly so

    def _forget(self) -> None:
        self.n, self.rows = 0, self.rows[:1].copy()

    def _learn(self, pieces: list[str]) -> list[list[int]]:
        words = [words_of(x) for x in pieces]
        fresh = sorted({w for found in words for w in found})
        if self.n + len(fresh) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((self.n // 2 + len(fresh), 6 * HIDDEN), np.float32)])
        for a in range(0, len(fresh), 4096):
            self.rows[self.n + a : self.n + a + len(fresh[a : a + 4096])] = self.net.project(fresh[a : a + 4096])
        at = dict(zip(fresh, range(self.n, self.n + len(fresh)), strict=True))
        self.n += len(fresh)
        return [[at[w] for w in found] for found in words]

    def best(self, texts: list[str | None]) -> np.ndarray:
        """The strongest window's logit of each text; -inf for texts without words."""
        out = np.full(len(texts), -np.inf)
        found, sizes = self.pieces(texts)
        offsets = np.r_[0, np.cumsum(sizes)]
        flat = np.r_[found, np.full(WINDOW, -1)]
        starts, ends, owner = [], [], []
        for k in range(len(texts)):
            s = windows(sizes[k]) + offsets[k]
            starts.append(s)
            ends.append(np.full(len(s), offsets[k + 1]))
            owner.append(np.full(len(s), k))
        starts, ends, owner = np.concatenate(starts), np.concatenate(ends), np.concatenate(owner)
        for a in range(0, len(starts), 2048):
            at = starts[a : a + 2048, None] + np.arange(WINDOW)
            idx = np.where(at < ends[a : a + 2048, None], flat[at], -1)
            np.maximum.at(out, owner[a : a + 2048], self.net.forward(*_gather(self.rows, idx)))
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        a, c = self.net.scale
        return _sigmoid(np.clip(a * np.maximum(self.best(texts), -50) + c, -50, 50))


def score(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text", keep_columns: list[str] | None = None, prior: float = 0.0) -> DataFrame:
    """Score every whole text: id, score (0 to 1), or all of keep_columns and `score`.

    Texts without words (null and empty too) score as a text without a toxic window. Without a network (one label only was
    seen) all score `prior`. Equal texts score alike; repeated rows each get a row; an empty table gives none. Very long texts are scored in
    all their windows. Columns other than those named are not read.
    """
    cols = keep_columns or [id_col]
    kept = docs.select(*cols, F.col(text_col).cast("string").alias("__text"))
    schema = docs.select(*cols).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept_in_worker(net.key, lambda: Scorer(net)) if net else None
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                piece = batch.slice(a, 256)
                texts = piece.column(piece.num_columns - 1).to_pylist()
                s = scorer.scores(texts) if scorer else np.full(len(texts), prior)
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(s, pa.float64())], [*piece.schema.names[:-1], "score"])

    return kept.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, net: Network | None, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs that score below `least`, with all their columns, whatever they are called. Without a network all rows stay."""
    if net is None:
        return docs
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept_in_worker(net.key, lambda: Scorer(net))
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                piece = batch.slice(a, 256)
                yield piece.filter(pa.array(scorer.scores(piece.column(at).to_pylist()) < least))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def fit(docs: DataFrame, labels: DataFrame, held_out: Callable[[Column], Column], per_class: int = 1500, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Network | None:
    """Train on a bounded sample: about per_class labelled texts of each label."""
    return train(labelled_sample(docs, labels, per_class, id_col, text_col, label_col, held_out))
