"""Operators for training text against plain Python, on small tables with nulls, empty and long texts, repeats and odd columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, t string"
random.seed(11)
VOCABULARY = ["".join(random.choices("abcdefgh", k=random.randint(2, 6))) for _ in range(400)]


def prose(n):
    return " ".join(random.choice(VOCABULARY) for _ in range(n))


PASSAGE = prose(60)
LONG = prose(6000)


def rows_of():
    texts = [None, "", " \n\t ", "!!! 123", "One two", "one TWO", "ÄÖ äö", LONG, LONG + " end", PASSAGE, f"{prose(40)} {PASSAGE} {prose(30)}", f"{PASSAGE} {prose(50)}", "x" * 900, PASSAGE.upper()]
    texts += [prose(random.randint(1, 120)) for _ in range(40)]
    base = prose(150).split()
    for k in range(30):
        w = list(base)
        w[k * 3] = "edited"
        texts.append(" ".join(w))
    return [(k, t, ["en", "de", None][k % 3], ["a", "b", None, "ü"][k % 4 if k > 30 else 0], 0, "clash", "clash") for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def data():
    return rows_of()


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_exact(docs, data):
    from brookline.llm.exact_dedup import exact_groups

    groups = {}
    for r in data:
        groups.setdefault(lower(r[1]), []).append(r[0])
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_groups(docs).collect()}
    want = {i: (max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    assert got == want
    assert exact_groups(docs.filter("doc_id < 0")).collect() == []


def test_exact_collisions(docs, data, monkeypatch):
    """With a hash that always collides, bytes still tell the texts apart."""
    from brookline.llm import exact_dedup

    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: F.lpad(F.lit("0"), 32, "0"))
    got = {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_groups(docs).collect()}
    groups = {}
    for r in data:
        groups.setdefault(lower(r[1]), []).append(r[0])
    assert got == {i: max(g) for g in groups.values() for i in g}


def brute_repeats(texts, n):
    c = Counter(t[p : p + n] for t in texts for p in range(len(t) - n + 1))
    out = []
    for t in texts:
        cover = bytearray(len(t))
        for p in range(len(t) - n + 1):
            if c[t[p : p + n]] > 1:
                cover[p : p + n] = b"\1" * n
        kept = bytes(b for b, k in zip(t, cover, strict=True) if not k)
        runs = sum(1 for k in range(len(cover)) if cover[k] and (k == 0 or not cover[k - 1]))
        out.append((len(t), sum(cover), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length", [200, 64])
def test_suffixes(docs, data, length):
    from brookline.llm.suffix_dedup import remove_repeats

    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in remove_repeats(docs, length=length).collect()}
    want = brute_repeats([(r[1] or "").encode() for r in data], length)
    assert got == {r[0]: w for r, w in zip(data, want, strict=True)}


def test_suffixes_empty(docs):
    from brookline.llm.suffix_dedup import remove_repeats

    assert remove_repeats(docs.filter("doc_id < 0")).collect() == []


def brute_fingerprint(text, width=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    sh = [" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum((x >> b) & 1 for x in h) * 2 > len(h))


def classes(fp, radius):
    root = list(range(len(fp)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fp)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fp))]


def test_simhash(docs, data):
    from brookline.llm.simhash import near_duplicates

    fp = [brute_fingerprint(r[1]) for r in data]
    want = {data[i][0]: (f"{fp[i]:016x}", data[c][0]) for i, c in enumerate(classes(fp, 4))}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in near_duplicates(docs).collect()}
    assert got == want
    assert near_duplicates(docs.filter("doc_id < 0")).collect() == []


def test_one_of_each_keeps_rows_without_or_with_shared_ids(spark):
    from brookline.llm.near_copies import one_of_each

    rng = random.Random(21)
    a, b, c, d = (" ".join(rng.choices(VOCABULARY, k=80)) for _ in range(4))
    clean = [" ".join(rng.choices(VOCABULARY, k=60)) for _ in range(40)]
    rows = [(None, t) for t in clean]  # none of them may go
    rows += [(None, a), (5, a), (6, a.upper())]  # a real id comes before none
    rows += [(2, b), (7, b), (7, c), (8, c), (7, c)]  # 7 stands for c's group although b's group has 2
    rows += [(None, d), (None, d), (9, None), (10, "")]
    got = one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = [(None, t) for t in clean] + [(5, a), (2, b), (7, c), (None, d), (9, None)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def jaccard_representatives(texts):
    """The first text of each group that five-word shingles of Jaccard 0.8 or more link, all pairs compared."""

    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets, root = [grams(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] | sets[j])
            if not both or len(sets[i] & sets[j]) / both >= 0.8:
                root = [root[j] if r == root[i] else r for r in root]
    groups = {}
    for k, r in enumerate(root):
        groups.setdefault(r, []).append(k)
    return {min(g) for g in groups.values()}


@pytest.mark.parametrize("tile", [8, 1024])
def test_near_copies(spark, monkeypatch, tile):
    """Edited copies with similarities on both sides of 0.8, against all pairs; SimHash in 4 bits misses most of them."""
    import corpus_pipeline
    from brookline.llm import near_copies

    monkeypatch.setattr(near_copies, "TILE", tile)
    rng = random.Random(4)
    texts = [None, "", "one two", "One  TWO", "one three"]
    for size in (60, 200, 400):
        for _ in range(8):
            base = [rng.choice(VOCABULARY) for _ in range(size)]
            texts.append(" ".join(base))
            for edits in (1, size // 100 + 1, size // 50, size // 40):
                w = list(base)
                for at in rng.sample(range(size), edits):
                    w[at] = f"edit{rng.randrange(10**6)}"
                texts.append(" ".join(w))
    base = [rng.choice(VOCABULARY) for _ in range(150)]
    texts += [" ".join([*base[:k], f"edit{k}", *base[k + 1 :]]) for k in range(30)]

    want = jaccard_representatives(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert got == want


@pytest.mark.parametrize("tile", [8, 10_000])
@pytest.mark.parametrize("radius", [3, 4])
def test_links_of_clusters(spark, monkeypatch, tile, radius):
    """Dense clusters, with and without tiles, connect as all pairs do."""
    from brookline.llm import simhash
    from brookline.llm.components import components

    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "SMALL", 8)
    rng = random.Random(5)
    fps = set()
    for _ in range(6):
        c = rng.getrandbits(64)
        for _ in range(25):
            fps.add(c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    roots = classes(fps, radius)
    links = simhash.near_links(spark.createDataFrame([(s,) for s in signed], "fp long"), radius)
    found = {r["node"]: r["root"] for r in components(links).collect()}
    want = {}
    for k, r in enumerate(roots):
        want.setdefault(r, set()).add(signed[k])
    got = {}
    for s in signed:
        got.setdefault(found.get(s, s), set()).add(s)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_allocation_covers_the_radius():
    from brookline.llm.simhash import allocate

    rng = np.random.default_rng(0)
    for n in (100, 100_000, 1_000_000_000):
        x = rng.integers(0, 2, (500, 64)).astype(float)
        for radius in (1, 4):
            plan = allocate(x.T @ x * (n / 500), n, radius)
            assert sum(t + 1 for _, t in plan) >= radius + 1
            bits = [b for p, _ in plan for b in p]
            assert len(bits) == len(set(bits))


def test_components_of_a_chain(spark):
    from brookline.llm.components import components

    chain = spark.range(1, 300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.range(1).select(F.lit(1000).cast("long"), F.lit(1001).cast("long")))
    found = {r["node"]: r["root"] for r in components(chain).collect()}
    assert found == {**dict.fromkeys(range(1, 301), 1), 1000: 1000, 1001: 1000}


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > cap * sizes[s]}
        if not over:
            return target | {s: level * w[s] for s in free}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mix(docs, data):
    from brookline.llm.mixing import apply_mix, mix

    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in data}
    per = {}
    for r in data:
        per[r[3]] = per.get(r[3], 0) + size[r[0]]
    want = brute_targets(per)
    got = {r["doc_id"]: r.asDict() for r in mix(docs).collect()}
    again = {r["doc_id"]: r["taken"] for r in mix(docs.repartition(5)).collect()}
    assert {i: g["taken"] for i, g in got.items()} == again and len(got) == len(data)
    for r in data:
        g = got[r[0]]
        assert (g["size"], g["source_size"]) == (size[r[0]], per[r[3]])
        assert abs(g["target"] - want[r[3]]) < 1e-6 * max(1, want[r[3]])
        assert g["taken"] in (0, g["size"], 2 * g["size"])
    for s, t in want.items():
        taken = sum(got[r[0]]["taken"] for r in data if r[3] == s)
        assert abs(taken - t) <= max([size[r[0]] for r in data if r[3] == s]) / 2 + 1
    out = apply_mix(docs).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in out} == {i: g["copies"] for i, g in got.items() if g["copies"]}
    assert mix(docs.filter("doc_id < 0")).collect() == []


def test_tokens(docs, data):
    import public_tokenizers
    from tokenizers import Tokenizer

    from brookline.llm import token_files

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, want = 0, []
    for r in sorted(data):
        ids = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((r[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = token_files.tokenise(docs, public_tokenizers.path("word_bpe_49k.json"), block=500)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert token_files.tokenise(docs.filter("doc_id < 0"), public_tokenizers.path("word_bpe_49k.json")).collect() == []


def test_encoder_equals_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    from brookline.llm.token_files import Encoder

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["It's a DOG's, life.  \r\n\ttab", "ÉTÉ été, été. ΟΔΟΣ, x y z", "<|endoftext|> a<|startoftext|>b, 12.5.", "don't, we'll.", "İstanbul, ǅ.", ",. .,", "日本語、テスト.", "a\x0bb\x0cc"]
    e = Encoder(public_tokenizers.path("word_bpe_49k.json"), most=700, most_bases=700)
    for _ in range(2):
        for x, ids in zip(texts, e(texts, 1), strict=True):
            assert ids.tolist() == [*t.encode(x, add_special_tokens=False).ids, 1], x


def test_encoder_takes_texts_together():
    """A run is looked up once for all its places in the texts of a group; texts come back cut where they were."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from brookline.llm.token_files import Encoder

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["", " \n", "one two", "two one, One", "", "three" * 40, "été one.", "x ", " x"]
    want = [[*t.encode(x, add_special_tokens=False).ids, 1] for x in texts]
    for together in (1, 12, 1000):
        e, asked = Encoder(public_tokenizers.path("word_bpe_49k.json")), []
        e.TOGETHER, learn = together, e.learn
        e.learn = lambda words, learn=learn, asked=asked: asked.extend(words) or learn(words)
        assert [ids.tolist() for ids in e(texts, 1)] == want
        assert len(asked) == len(set(asked)) == 8
    assert list(e([], 1)) == []


@pytest.mark.parametrize("planes", ["bit", "byte"])
def test_plane_files(planes):
    import io

    from brookline.llm.token_files import Reader, encode_to_bytes

    rng = random.Random(2)
    rows = [(k * 3 - 5, [rng.choice([0, 1, 49407, (1 << 32) - 1, rng.getrandbits(17)]) for _ in range(rng.randint(0, 300))]) for k in range(50)]
    body = encode_to_bytes(rows, block=256, planes=planes)
    assert [(k, ids.tolist()) for k, ids in Reader(io.BytesIO(body))] == rows
    assert [(k, ids.tolist()) for k, ids in Reader(io.BytesIO(encode_to_bytes([])))] == []
    with pytest.raises(ValueError, match="not a bit-plane file"):
        Reader(io.BytesIO(body[:-1] + b"x"))


def test_decontamination(spark, docs, data):
    from brookline.llm.decontamination import contaminated, decontaminate

    edited = PASSAGE.split()
    for k in range(0, 60, 7):
        edited[k] = "changed"
    more = spark.createDataFrame([(900, prose(30) + " " + " ".join(edited) + " " + prose(20), "en", "a", 0, "", ""), (901, "tiny item here", "en", "a", 0, "", "")], SCHEMA)
    bench = spark.createDataFrame([(7, PASSAGE), (8, "tiny item here"), (9, None), (10, ""), (11, prose(50)), (7, PASSAGE)], "item_id long, text string")
    every = docs.unionByName(more)
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(every, bench).collect()}
    holds = {r[0] for r in data if r[1] and PASSAGE in r[1].lower()}
    assert got == {(i, 7) for i in holds | {900}} | {(901, 8)}
    kept = decontaminate(every, bench)
    assert kept.columns == every.columns
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in data} - holds
    assert contaminated(docs, bench.filter("item_id < 0")).collect() == []


def test_alignment():
    from brookline.llm.decontamination import GAP, MATCH, MISMATCH, align

    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = rng.integers(1, 5, rng.integers(1, 12)), rng.integers(1, 5, rng.integers(1, 15))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (MATCH if a[i] == b[j] else MISMATCH), h[i, j + 1] + GAP, h[i + 1, j] + GAP)
        score, first, last = align(a, b)
        assert score == h.max() and 0 <= first <= last <= len(b)


def test_language(spark):
    from brookline.llm import language

    rng = random.Random(4)
    syllables = {"aa": ["ka", "to", "mi", "ra"], "bb": ["sch", "ung", "ein", "te"], "ru": ["да", "не", "мо", "ро"]}

    def text(lang, n):
        return " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))

    rows = [(k, text(lang, 30), lang) for k, lang in enumerate(["aa", "bb", "ru"] * 40)]
    docs = spark.createDataFrame([*rows, (500, None, "aa"), (501, "", None), (502, "123 !?", "bb"), (503, text("aa", 30) + " " + text("bb", 20), None)], "doc_id long, text string, lang string")
    model = language.fit(docs, lambda i: F.pmod(i, F.lit(4)) == 1)
    got = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    assert all(got[k]["lang_pred"] == lang for k, _, lang in rows)
    assert [got[k]["lang_pred"] for k in (500, 501, 502)] == ["und"] * 3
    assert [s["lang"] for s in got[503]["spans"]] == ["aa", "bb"] and got[503]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in language.identify(docs, None).collect()} == {"und"}


def test_viterbi():
    from brookline.llm.language import viterbi

    rng = np.random.default_rng(1)
    sizes = np.array([3, 0, 5, 1, 4])
    scores = rng.normal(size=(sizes.sum(), 3)).astype(np.float32)
    got, at = viterbi(scores, sizes, 0.7), 0
    for n in sizes:
        own = scores[at : at + n]
        best = max((sum(own[t, p[t]] for t in range(n)) - 0.7 * sum(a != b for a, b in zip(p, p[1:], strict=False)) for p in np.ndindex(*[3] * n)), default=0)
        p = got[at : at + n]
        assert abs(best - (sum(own[t, p[t]] for t in range(n)) - 0.7 * sum(a != b for a, b in zip(p, p[1:], strict=False)))) < 1e-5
        at += n


def test_toxicity(spark):
    from brookline.llm import toxicity

    rng = random.Random(9)
    rows = []
    for k in range(500):
        words = [rng.choice(VOCABULARY) for _ in range(rng.randint(20, 150))]
        bad = k % 4 == 0
        for _ in range(3 * bad):
            words[rng.randrange(len(words))] = rng.choice(["vile", "scumbag"])
        rows.append((k, " ".join(words), int(bad)))
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(900, None), (901, ""), (902, "?!")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    net = toxicity.fit(docs, labels, lambda i: F.pmod(i, F.lit(5)) == 0, per_class=300)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, net).collect()}
    held = [(got[k] >= 0.5) == bool(y) for k, _, y in rows if k % 5 == 0]
    assert sum(held) / len(held) > 0.95
    assert all(got[k] < 0.5 for k in (900, 901, 902))
    clean = toxicity.drop_toxic(docs, net)
    assert clean.columns == docs.columns and clean.count() == sum(s < 0.5 for s in got.values())
    assert toxicity.fit(docs, labels.filter("toxic = 0"), lambda i: F.lit(False)) is None


def test_toxicity_sees_whole_texts():
    """Words joined by punctuation, broken at combining marks or without spaces count as in training, all of them."""
    from brookline.llm import toxicity

    net = toxicity.Network(["vile", "calm", "हिन्दी"])
    net.p["words"][1] += 2
    scorer = toxicity.Scorer(net)
    few = " ".join(["calm"] * 30 + ["vile"] + ["other"] * 30)
    for join in ("/", "_", "-", ", ", "..."):
        assert np.allclose(scorer.best([few.replace(" ", join)]), toxicity.Scorer(net).best([few]))
    mixed = [few, "हिन्दी में लिखा हुआ", "a_b/c vile-calm x1y", "漢" * 200 + "字" * 50, None, ""]
    for text, got in zip(mixed, scorer.best(mixed), strict=True):
        words = toxicity.words_of(text)
        at = [words[s : s + toxicity.WINDOW] for s in toxicity.windows(len(words))]
        want = [net.forward(net.project(w)[:, None], np.ones((len(w), 1), bool))[0] for w in at]
        assert np.isclose(got, max(want), atol=1e-4) if want else got == -np.inf
    ends = scorer.best(["漢" * 80 + "字" * 400, "漢" * 80 + "語" * 400])
    assert ends[0] != ends[1]
    assert 2 * toxicity.STEP <= toxicity.WINDOW
    small = toxicity.Scorer(net, most=500)
    assert np.allclose(small.best(mixed[:4]), scorer.best(mixed[:4])) and np.allclose(small.best(mixed[:1]), scorer.best(mixed[:1]))


def test_gradients():
    from brookline.llm import toxicity

    net = toxicity.Network(["a", "b"])
    rng = np.random.default_rng(0)
    x = rng.normal(size=(5, 3, 6 * toxicity.HIDDEN)).astype(np.float64)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    mask = np.ones((5, 3), bool)
    mask[3:, 1] = False
    w = rng.normal(size=3)
    keep = {}
    net.forward(x, mask, keep)
    dx, g = net.backward(x, mask, keep, w)
    for name in ("uf", "ub", "a", "v", "o"):
        at = tuple(rng.integers(0, s) for s in net.p[name].shape)
        old, eps = net.p[name][at], 1e-3
        net.p[name][at] = old + eps
        up = net.forward(x, mask) @ w
        net.p[name][at] = old - eps
        down = net.forward(x, mask) @ w
        net.p[name][at] = old
        assert abs((up - down) / (2 * eps) - g[name][at]) < 1e-3


def test_quality(spark):
    from brookline.llm import quality

    rng = random.Random(3)

    def text(grade):
        return " ".join(rng.choice(VOCABULARY) + ("***" if rng.random() > grade / 2 else "") for _ in range(60))

    rows = [(k, text(k % 3), k % 3) for k in range(300)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, quality int")
    model = quality.fit(docs, labels, lambda i: F.pmod(i, F.lit(5)) == 0)
    assert all(a < b for a, b in zip(model.cuts, model.cuts[1:], strict=False))
    got = {r["doc_id"]: r for r in quality.grade(docs, model, tail_from=2).collect()}
    held = [abs(got[k]["expected_grade"] - y) < 0.5 for k, _, y in rows if k % 5 == 0]
    assert sum(held) / len(held) > 0.9 and len(got) == 302
    assert all(0 <= r["tail_probability"] <= 1 for r in got.values())
    assert quality.grade(docs, None).first()["expected_grade"] is None


def test_licenses(spark):
    from brookline.llm.licenses import scan

    files = [(1, "/a/LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"), (2, "/a/b/x.py", "print(1)"), (3, "/a/b/y.py", "# Licensed under the Apache License, Version 2.0.\nprint(2)"), (4, "/c/z.py", "text about a license plate"), (5, "/a/b/c/COPYING", "This work is licensed under the GNU General Public License, version 3."), (6, "/a/b/c/d/w.py", None), (7, None, ""), (8, "/a/b/x.py", "print(1)")]
    df = spark.createDataFrame(files, "id long, path string, text string")
    got = {r["id"]: (r["license"], r["origin"]) for r in scan(df).collect()}
    assert got == {1: ("MIT", "own"), 2: ("MIT", "inherited"), 3: ("Apache-2.0", "own"), 4: (None, "none"), 5: ("GPL-3.0", "own"), 6: ("GPL-3.0", "inherited"), 7: (None, "none"), 8: ("MIT", "inherited")}
    assert scan(df.filter("id < 0")).collect() == []
