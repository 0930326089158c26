"""Language identification: scripts narrow the candidates, then a Viterbi path over word scores."""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame

from brookline.llm.common import Pieces, fresh_key, kept_in_worker
from brookline.llm.sampling import labelled_sample

LETTERS = regex.compile(r"\p{L}+")
#: First code point of each range and its script; fixed values of the Unicode block list. None: no script of its own.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, None), (0x0750, "Arabic"), (0x0780, None),
    (0x08A0, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"),
    (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, None), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, None), (0x1C80, "Cyrillic"), (0x1C90, "Georgian"), (0x1CC0, None),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, None), (0x2C60, "Latin"), (0x2C80, None), (0x2DE0, "Cyrillic"), (0x2E00, None), (0x3040, "Kana"), (0x3100, None),
    (0x3130, "Hangul"), (0x3190, None), (0x31F0, "Kana"), (0x3200, None), (0x3400, "Han"), (0xA000, None), (0xA640, "Cyrillic"), (0xA6A0, None), (0xA720, "Latin"), (0xA800, None),
    (0xAB30, "Latin"), (0xAB70, None), (0xAC00, "Hangul"), (0xD7B0, None), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB50, "Arabic"), (0xFE00, None), (0xFF66, "Kana"), (0xFFA0, None), (0x20000, "Han"), (0x32000, None),
]
_STARTS = [a for a, _ in SCRIPTS]
ROWS = 1 << 16
#: Letters of a step of the path at most; longer runs of letters are several steps.
LONGEST = 40
#: All letters before this one are Latin.
LATIN_END = "\u0250"
UNKNOWN = "und"


@lru_cache(1 << 16)
def script_of(letter: str) -> str | None:
    """The script of a letter."""
    return SCRIPTS[bisect_right(_STARTS, ord(letter)) - 1][1]


def steps_of(text: str) -> list[tuple[int, int]]:
    """First and last + 1 place of each step: runs of letters of one script, cut into LONGEST letters. Letters without a script of
    their own go with those before them."""
    out = []
    for m in LETTERS.finditer(text):
        a, z = m.span()
        cuts, now = [a], None
        if max(m[0]) >= LATIN_END:
            for k in range(a, z):
                script = script_of(text[k]) or now
                if now not in (None, script):
                    cuts.append(k)
                now = script
        for lo, hi in zip(cuts, [*cuts[1:], z], strict=True):
            out += [(k, min(hi, k + LONGEST)) for k in range(lo, hi, LONGEST)]
    return out


def words_of(text: str) -> list[str]:
    """The steps' letters in lower case."""
    bare = text.strip(".,;:!?()\"'")
    if len(bare) <= LONGEST and bare.isalpha() and (bare.isascii() or max(bare) < LATIN_END):  # one step
        return [bare.lower()]
    return [text[a:z].lower() for a, z in steps_of(text)]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all words, and where each word's begin: its trigrams between boundary marks, and itself."""
    marked = [f"<{w}>".encode() for w in words]
    sizes = np.array([len(m) for m in marked])
    text = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint32)
    value = (text[:-2] * np.uint32(2654435761) ^ text[1:-1] * np.uint32(2246822519) ^ text[2:] * np.uint32(3266489917)) * np.uint32(668265263)
    first = np.cumsum(sizes) - sizes
    powers = np.cumprod(np.full(int(sizes.max()) + 1, 1000003, np.uint64)).astype(np.uint64)
    place = np.arange(len(text)) - np.repeat(first, sizes)
    whole = np.add.reduceat(text.astype(np.uint64) * powers[place], first)
    # The two places after a word's last trigram: the first holds the word itself, the second nothing.
    ends = first + sizes - 2
    feature = np.r_[value, np.zeros(2, np.uint32)]
    feature[ends] = ((whole * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.uint32) << np.uint32(8)
    inner = np.ones(len(text), bool)
    inner[ends + 1] = False
    return (feature[inner] >> np.uint32(16)).astype(np.int64), np.cumsum(sizes - 1) - (sizes - 1)


class Model:
    """Log-probabilities of hashed features in each language, and the languages that each script admits."""

    def __init__(self, rows: list[tuple[str, str]], smooth: float = 0.3, least_share: float = 0.005):
        self.key, self.langs = fresh_key(), sorted({y for _, y in rows})
        counts = np.full((ROWS, len(self.langs)), smooth)
        letters: dict[str | None, Counter] = {}
        for k, lang in enumerate(self.langs):
            words = Counter(w for t, y in rows if y == lang for w in words_of(t))
            if not words:
                continue
            feature, first = grams(list(words))
            # Repeats of a word count by their square root, so that texts in many copies don't rule.
            np.add.at(counts[:, k], feature, np.repeat(np.sqrt(list(words.values())), np.diff(np.r_[first, len(feature)])))
            for w, n in words.items():
                letters.setdefault(script_of(w[0]), Counter())[lang] += n * len(w)
        total = Counter()
        for c in letters.values():
            total.update(c)
        self.table = np.log(counts / counts.sum(axis=0)).astype(np.float32)
        self.table -= self.table.mean(axis=1, keepdims=True)
        self.scripts = {s: [k for k, lang in enumerate(self.langs) if c[lang] >= least_share * max(1, total[lang])] for s, c in letters.items()}

    def word_scores(self, words: list[str], most: float = 8.0) -> np.ndarray:
        """Per word and language, clipped; languages that a word's script does not admit are far below all others."""
        feature, first = grams(words)
        s = np.clip(np.add.reduceat(self.table[feature], first, axis=0), -most, most)
        first_letters = np.array([ord(w[0]) for w in words])
        for letter in np.unique(first_letters).tolist():
            allowed = self.scripts.get(script_of(chr(letter)))
            if allowed and len(allowed) < len(self.langs):
                s[np.ix_(first_letters == letter, np.setdiff1d(np.arange(len(self.langs)), allowed))] = -100.0
        return s


def viterbi(scores: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """Labels of all words of several texts. scores: words, languages; sizes: words of each text, in order. A path
    gains the scores of its words and pays `penalty` at each change of language."""
    order = np.argsort(-sizes, kind="stable")
    first = (np.cumsum(sizes) - sizes)[order]
    length = sizes[order]
    labels = np.zeros(len(scores), np.int8)
    if not len(scores):
        return labels
    back = np.zeros(scores.shape, np.int8)
    own = np.arange(scores.shape[1], dtype=np.int8)
    active = len(length) - np.searchsorted(length[::-1], np.arange(length[0]), side="right")
    first = first[: active[0]]
    v = scores[first].copy()
    last = np.zeros(len(length), np.int8)
    for t in range(1, length[0]):
        k = active[t]
        if k < len(v):
            last[k : len(v)] = v[k:].argmax(axis=1)
            v, first = v[:k], first[:k]
        best = v.argmax(axis=1)
        other = v[np.arange(k), best][:, None] - penalty
        stay = v >= other
        at = first + t
        back[at] = np.where(stay, own, best[:, None])
        v = np.where(stay, v, other) + scores[at]
    last[: len(v)] = v.argmax(axis=1)
    first = (np.cumsum(sizes) - sizes)[order]
    now = last.copy()
    for t in range(length[0] - 1, -1, -1):
        k = active[t]
        at = first[:k] + t
        labels[at] = now[:k]
        if t:
            now[:k] = back[at, now[:k]]
    return labels


class Labeller:
    """Labels of whole texts. Each step of a text (see steps_of) has its scores in a row of a table, remembered by the piece between
    white space that it stands in."""

    def __init__(self, model: Model, penalty: float):
        self.model, self.penalty = model, penalty
        self.pieces = Pieces(self._learn, forget=self._forget)
        self._forget()

    def _forget(self) -> None:
        self.n, self.rows, self.weight = 0, np.zeros((1, len(self.model.langs)), np.float32), np.zeros(1, np.int64)

    def _learn(self, pieces: list[str]) -> list[list[int]]:
        words = [words_of(p) for p in pieces]
        fresh = list({w: 0 for found in words for w in found})
        if self.n + len(fresh) > len(self.rows):
            more = self.n // 2 + len(fresh)
            self.rows, self.weight = np.concatenate([self.rows, np.zeros((more, self.rows.shape[1]), np.float32)]), np.r_[self.weight, np.zeros(more, np.int64)]
        for a in range(0, len(fresh), 8192):
            some = fresh[a : a + 8192]
            self.rows[self.n + a : self.n + a + len(some)] = self.model.word_scores(some)
            self.weight[self.n + a : self.n + a + len(some)] = [len(w) for w in some]
        at = dict(zip(fresh, range(self.n, self.n + len(fresh)), strict=True))
        self.n += len(fresh)
        return [[at[w] for w in found] for found in words]

    def _rows(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, sizes = self.pieces(texts)
        return self.rows[ids], self.weight[ids], sizes

    def __call__(self, texts: list[str | None]) -> Iterator[tuple[str, float, list[dict]]]:
        """(language, score, spans) of each text."""
        parts = [self._rows(texts[a : a + 128]) for a in range(0, len(texts), 128)]
        scores, weight, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
        langs = self.model.langs
        labels = viterbi(scores, sizes, self.penalty)
        owner = np.repeat(np.arange(len(texts)), sizes)
        share = np.zeros((len(texts), len(langs)))
        np.add.at(share, (owner, labels), weight)
        total = np.zeros((len(texts), len(langs)))
        for k in range(len(langs)):
            total[:, k] = np.bincount(owner, scores[:, k], len(texts))
        total = np.exp(np.clip(total - total.max(axis=1, keepdims=True), -60, 0))
        posterior = total / total.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        offset = np.cumsum(sizes) - sizes
        for k, text in enumerate(texts):
            if not sizes[k]:
                yield UNKNOWN, 0.0, []
                continue
            own = labels[offset[k] : offset[k] + sizes[k]]
            change = np.flatnonzero(own[1:] != own[:-1]) + 1
            where = share[k, best[k]] / share[k].sum()
            sure = posterior[k, best[k]] if not len(change) else 1.0
            if not len(change):
                spans = [{"start": 0, "end": len(text), "lang": langs[own[0]]}]
            else:
                steps = steps_of(text)
                cuts = [0, *(steps[c][0] for c in change), len(text)]
                spans = [{"start": a, "end": b, "lang": langs[own[c]]} for a, b, c in zip(cuts[:-1], cuts[1:], [0, *change], strict=True)]
            yield langs[best[k]], float(np.clip(where * sure, 0, 1)), spans


def fit(docs: DataFrame, held_out: Callable[[Column], Column], per_class: int = 1000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Learn from a bounded sample: about per_class texts of each language, 6 million characters of each (see sampling)."""
    rows = labelled_sample(docs, docs, per_class, id_col, text_col, lang_col, held_out)
    return Model(rows) if rows else None


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", penalty: float = 12.0) -> DataFrame:
    """id, lang_pred, score, spans (start, end, lang: character positions) of every whole text.

    A step of the path is a run of letters of one script, at most 40; so words joined by dashes or slashes, and scripts
    without spaces, are judged letter by letter to their end. Null text and text without a letter give "und", score 0 and no spans; so does every
    text if nothing was learned. Ties go to the language that sorts first. Repeated rows each get a row; an empty table gives none; very long texts
    are taken whole; extra columns are ignored.
    """
    from pyspark.sql import functions as F

    spans = "array<struct<start: int, end: int, lang: string>>"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = kept_in_worker(f"{model.key}{penalty}", lambda: Labeller(model, penalty)) if model else None
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                piece = batch.slice(a, 2048)
                texts = piece.column(1).to_pylist()
                lang, score, found = zip(*(label(texts) if label else [(UNKNOWN, 0.0, [])] * len(texts)), strict=True)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(lang), pa.array(score), pa.array(found, kind)], ["id", "lang_pred", "score", "spans"])

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id long, lang_pred string, score double, spans {spans}")
    return out.withColumnRenamed("id", id_col)
