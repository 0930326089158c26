"""Awkward tables through every operator: null ids, repeated rows, ties, long texts, clashing columns, nothing at all; and slow, plain forms of the operators."""

import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.test_operators import VOCABULARY, brute_fingerprint, brute_repeats, brute_targets, classes, lower

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, t string, row long, size long, fp long, x long, unit int, w string, score double, key string, root long, words long"
RNG = random.Random(31)
BODY = " ".join(RNG.choice(VOCABULARY) for _ in range(80))
LONG = " ".join(RNG.choice(VOCABULARY) for _ in range(30_000))
JOINED = "/".join(RNG.choice(VOCABULARY) for _ in range(3_000))


def awkward():
    texts = [(None, BODY), (None, BODY + " more"), (None, None), (None, "another text"), (5, BODY), (5, BODY), (5, "one id, another text"), (6, None), (6, ""), (7, LONG), (8, LONG + " tail"), (9, JOINED), (10, JOINED.replace("/", "-")), (11, "漢字" * 400), (12, " "), (13, "!!! 12 \x0b")]
    return [(i, t, ["aa", None][k % 2], [None, "s"][k % 2], k, "c", "c", 1, 1, 1, 1, 1, "c", 1.0, "c", 1, 1) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3)


def operators(spark):
    import public_tokenizers

    from brookline.llm import decontamination, exact_dedup, language, licenses, mixing, quality, simhash, suffix_dedup, token_files, toxicity

    model = language.Model([("abc bad cab", "aa"), ("gef feg hef", "bb")])
    net = toxicity.Network(["bad", "cab"])
    grades = quality.train([(BODY, 0), ("A. B. C.", 1), (LONG[:2000], 2)] * 3, epochs=2)
    items = spark.createDataFrame([(1, BODY), (None, JOINED), (2, "yes"), (3, None), (1, BODY)], "item_id long, text string")
    return {
        "language": lambda d: language.identify(d, model),
        "suffix": lambda d: suffix_dedup.remove_repeats(d),
        "decontamination": lambda d: decontamination.contaminated(d, items),
        "simhash": simhash.near_duplicates,
        "exact": exact_dedup.exact_groups,
        "quality": lambda d: quality.grade(d, grades),
        "toxicity": lambda d: toxicity.score(d, net),
        "mix": mixing.mix,
        "licenses": lambda d: licenses.scan(d.withColumn("path", F.concat(F.lit("/"), "source", F.lit("/x"))), id_col="doc_id"),
        "tokens": lambda d: token_files.tokenise(d, public_tokenizers.path("word_bpe_49k.json")),
    }


@pytest.mark.parametrize("name", ["language", "suffix", "decontamination", "simhash", "exact", "quality", "toxicity", "mix", "licenses", "tokens"])
def test_awkward_tables(spark, odd, name):
    """A row for each input row, equal rows alike, no row for no input."""
    run, data = operators(spark)[name], awkward()
    got = run(odd).collect()
    nothing = run(odd.filter("n_chars < 0"))
    assert nothing.collect() == [] and nothing.columns == run(odd.limit(1)).columns
    if name == "decontamination":
        assert sorted((str(r["doc_id"]), str(r["item_id"])) for r in got) == sorted([("None", "1"), ("None", "1"), ("5", "1"), ("5", "1"), ("9", "None"), ("10", "None")])
        return
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in data)
    if name == "suffix":
        want = brute_repeats([(r[1] or "").encode() for r in data], 200)
        assert Counter(tuple(r) for r in got) == Counter((r[0], *w) for r, w in zip(data, want, strict=True))
    elif name == "exact":
        assert Counter(r["group_size"] for r in got) == Counter(sum(lower(x[1]) == lower(r[1]) for x in data) for r in data)
    elif name == "simhash":
        fp = [brute_fingerprint(r[1]) for r in data]
        root = classes(fp, 4)
        least = {c: min((r[0] for r, k in zip(data, root, strict=True) if k == c and r[0] is not None), default=None) for c in root}
        assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == Counter((r[0], f"{f:016x}", least[c]) for r, f, c in zip(data, fp, root, strict=True))
    elif name == "tokens":
        import public_tokenizers
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
        ids = [np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4") for r in data]
        assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((r[0], len(x), zlib.crc32(x.tobytes())) for r, x in zip(data, ids, strict=True))
        ends = sorted((r["start"], r["start"] + r["n_tokens"]) for r in got)
        assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
    elif name in ("language", "toxicity"):
        by_id = {r["doc_id"]: r for r in got}
        column = "lang_pred" if name == "language" else "score"
        assert by_id[9][column] == by_id[10][column]  # slashes or dashes, all words count
        assert all(0 <= r["score"] <= 1 for r in got)


def test_pipeline_stages_keep_rows(spark, odd):
    """Nulls, repeats and extra columns through the stages that need no model."""
    import corpus_pipeline
    from brookline.llm import mixing

    near = corpus_pipeline.drop_near_duplicates(spark, odd, "")
    assert near.columns == odd.columns
    texts = [r["text"] for r in near.collect()]
    assert len(texts) == len(set(texts)) and {"another text", "one id, another text", "漢字" * 400} <= set(texts)
    mixed = mixing.apply_mix(odd)
    copies = mixing.mix(odd).agg(F.sum("copies")).first()[0]
    assert mixed.columns == odd.columns and mixed.count() == copies
    assert mixing.apply_mix(odd.filter("n_chars < 0")).count() == 0


def test_language_sees_whole_pieces():
    """The end of a long piece counts as much as its start, with or without marks between the words."""
    from brookline.llm import language

    rng = random.Random(4)
    syllables = {"aa": ["ka", "to", "mi", "ra"], "bb": ["sch", "ung", "ein", "te"]}

    def words(lang, n):
        return ["".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n)]

    model = language.Model([(" ".join(words(lang, 400)), lang) for lang in syllables])
    few, many = words("aa", 20), words("bb", 3000)
    label = language.Labeller(model, 12.0)
    for join in ("", "-", "/", "_", ", ", " "):
        lang, _, spans = next(label([join.join(few + many)]))
        assert lang == "bb" and [s["lang"] for s in spans] == ["aa", "bb"], join
    assert language.steps_of("abcдеfg") == [(0, 3), (3, 5), (5, 7)]
    text = "x" * 100
    assert [b - a for a, b in language.steps_of(text)] == [40, 40, 20]


def test_quality_sees_whole_pieces():
    from brookline.llm import quality

    one, other = quality.Features()(["a" * 500 + "b"]), quality.Features()(["a" * 500 + "c"])
    assert any((x != y).any() for x, y in zip(one, other, strict=True))
    assert quality._shape("-a1" * 9) != quality._shape("-a1" * 8)


def test_tail_of_grades(spark):
    from brookline.llm import quality

    model = quality.train([(BODY, 1), ("A. B. C.", 2), ("- - -", 4)] * 3, epochs=2)
    docs = spark.createDataFrame([(1, BODY)], "doc_id long, text string")
    tail = [quality.grade(docs, model, tail_from=k).first()["tail_probability"] for k in range(7)]
    assert tail[0] == tail[1] == 1 and tail[5] == tail[6] == 0 and tail[1] >= tail[2] >= tail[3] == tail[4]


def test_mix_against_plain_pareto(spark):
    """The level, the ranking and the cut of each source in plain Python."""
    from brookline.llm.mixing import mix

    rng = random.Random(8)
    rows = [(k, " ".join(["w"] * int(rng.paretovariate(0.8) % 400)), rng.choice(["a", "b", "c", "c", "c", None])) for k in range(600)]
    got = {r["doc_id"]: r for r in mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()}
    size = {k: len(t.split()) for k, t, _ in rows}
    per = Counter()
    for k, _, s in rows:
        per[s] += size[k]
    target = brute_targets(dict(per))
    for source, goal in target.items():
        own = [k for k, _, s in rows if s == source and size[k]]
        g = {k: 1 + int(math.log2(size[k])) for k in own}
        low, high = 0.0, 2.0
        for _ in range(80):
            level = (low + high) / 2
            low, high = (level, high) if sum(size[k] * min(2, level * g[k]) for k in own) < goal else (low, level)
        expected = {k: min(2, low * g[k]) for k in own}
        assert all(abs(got[k]["expected"] - expected[k]) < 1e-6 for k in own)
        sure = {k: math.floor(got[k]["expected"] + 1e-9) for k in own}
        left, order = goal - sum(size[k] * sure[k] for k in own), []
        for k in own:
            p = max(0.0, got[k]["expected"] - sure[k])
            if p > 0:
                h = xxhash.xxh64_intdigest(struct.pack("<i", 17), xxhash.xxh64_intdigest(struct.pack("<q", got[k]["row"]), 42))
                u = ((h >> 11) + 0.5) / (1 << 53)
                order.append(((u / (1 - u)) / (p / (1 - p)), k))
        upto, more = 0, set()
        for _, k in sorted(order):
            upto += size[k]
            if upto - size[k] / 2 <= left:
                more.add(k)
        assert {k: got[k]["copies"] for k in own} == {k: sure[k] + (k in more) for k in own}


def test_mix_of_equal_rows(spark):
    """Very many equal rows, without ids: the taken words still meet the target, and as many rows come out."""
    from brookline.llm.mixing import apply_mix, mix

    docs = spark.createDataFrame([(None, "one two three", "a")] * 300 + [(k, "w " * (k % 50 + 1), "bc"[k % 2]) for k in range(300)], "doc_id long, text string, source string").repartition(3)
    got = mix(docs)
    sums = {r["source"]: (r["t"], r["target"]) for r in got.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target")).collect()}
    assert all(abs(t - target) <= 26 for t, target in sums.values())
    assert apply_mix(docs).count() == got.agg(F.sum("copies")).first()[0]


def test_decontamination_against_all_pairs(spark):
    """Every document against every item by Smith-Waterman."""
    from brookline.llm.decontamination import MATCH, align, contaminated, words_of

    rng = random.Random(12)
    prose = lambda n: [rng.choice(VOCABULARY) + rng.choice("xyz") for _ in range(n)]
    items = [(k, prose(rng.choice([4, 12, 30, 60, 300]))) for k in range(12)]
    docs = []
    for k in range(60):
        item = items[k % 12][1]
        part = list(item)
        if k % 5 == 1:  # one word in seven is another
            part = [w if j % 7 else "other" for j, w in enumerate(part)]
        if k % 5 == 2:  # words left out
            part = [w for j, w in enumerate(part) if j % 9]
        if k % 5 == 3:  # a long piece of an item
            part = part[: max(4, min(len(part) // 3, 100))]
        if k % 5 == 4:
            part = []
        docs.append((k, " ".join(prose(40) + part + prose(25))))
    want = {}
    for i, text in docs:
        for j, item in items:
            number = {w: x + 1 for x, w in enumerate(sorted(set(item)))}
            score = align(np.array([number[w] for w in item]), np.array([number.get(w, 0) for w in words_of(text)]))[0]
            if score / (MATCH * len(item)) >= min(0.5, 50 / len(item)):
                want[i, j] = score / (MATCH * len(item))
    bench = spark.createDataFrame([(j, " ".join(item)) for j, item in items], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    # Edits leave items of a few words without a run of three words as a seed; all others are found.
    short = {j for j, item in items if len(item) < 12}
    assert set(got) <= set(want) and {k for k in want if k[1] not in short} <= set(got)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_items_in_several_blocks(spark, monkeypatch):
    from brookline.llm import decontamination

    rng = random.Random(13)
    items = [(k, " ".join(rng.choice(VOCABULARY) + "q" for _ in range(20))) for k in range(9)]
    docs = spark.createDataFrame([(k, "before " + t + " after") for k, t in items] + [(99, "nothing of it")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 200)
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, bench).collect()} == {(k, k) for k, _ in items}
    assert [r["doc_id"] for r in decontamination.decontaminate(docs, bench).collect()] == [99]


def test_license_cosines(spark):
    """Scores against TF-IDF cosines in plain Python, over whole, wrapped and commented texts."""
    from brookline.llm import licenses

    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 500)
    wrapped = re.sub(r"(.{50}\S*) ", r"\1\n", mit)
    apache = next(t for n, t in licenses.TEMPLATES if n == "Apache-2.0" and len(t) > 400)
    header = "\n".join("# " + x for x in re.sub(r"(.{60}\S*) ", r"\1\n", apache).split("\n")) + "\nimport os\n"
    files = [(1, "/p/LICENSE", wrapped), (2, "/p/a.py", "x = 1"), (3, "/q/b.py", header), (4, "/q/c.py", "y"), (5, "/r/d.c", "/* SPDX-License-Identifier: BSD-2-Clause */\nint x;"), (6, "/s/e", "No cue here. A license of some sort applies to permission."), (7, None, "Released under the MIT License."), (7, None, "Released under the MIT License."), (8, "/t/f", "license " * 4000), (9, "/u/COPYING", None)]
    got = licenses.scan(spark.createDataFrame(files, "id long, path string, text string")).collect()
    units = []
    for i, path, text in files:
        text = text or ""
        found = [s for s in re.split(r"(?<=[.!?;:])\s+|[\r\n]+", text) if re.search(licenses.CUE, s)]
        comment = []
        for line in text.split("\n"):
            if not re.search(licenses.COMMENT, line):
                break
            comment.append(re.sub(r"^\s*" + licenses.MARKER + r"+|\*/|-->", "", line))
        if re.search(r"^\s*" + licenses.MARKER, text):
            found.append(" ".join(comment))
        if path and re.search(licenses.NAMES, path) and text:
            found.append(text)
        units += [(i, Counter(licenses._tokens(s))) for s in found if licenses._tokens(s)]
    n = len(units) + len(licenses.TEMPLATES)
    vectors = [(name, Counter(licenses._tokens(t))) for name, t in sorted(licenses.TEMPLATES)]
    known = {w for _, v in vectors for w in v}

    def idf(w):
        return math.log((n + 1) / (sum(w in u for _, u in units) + sum(w in v for _, v in vectors) + 1)) + 1 if w in known else math.log(n + 1) + 1

    def cosine(a, b):
        norm = [math.sqrt(sum((c * idf(w)) ** 2 for w, c in x.items())) for x in (a, b)]
        return sum(c * b[w] * idf(w) ** 2 for w, c in a.items()) / norm[0] / norm[1]

    want = {}
    for i, u in units:
        for name, v in vectors:
            if (c := cosine(u, v)) >= 0.75:
                want[i] = max(want.get(i, (0, "")), (round(c, 9), name))
    own = {r["id"]: (round(r["score"], 9), r["license"]) for r in got if r["origin"] == "own" and r["id"] != 5}
    assert own == want and own[1][1] == "MIT" and own[3][1] == "Apache-2.0" and own[7][1] == "MIT"
    assert {(r["id"], r["license"], r["origin"]) for r in got if r["id"] in (2, 4, 5, 6)} == {(2, "MIT", "inherited"), (4, None, "none"), (5, "BSD-2-Clause", "own"), (6, None, "none")}
    assert len(got) == len(files)
