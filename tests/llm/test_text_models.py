"""Decontamination, license scan, classifiers and the language model against brute force or held-out rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import common, decontaminate, language_model, license_rules, license_scan, quality, toxicity

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def test_alnum_words_equal_the_pattern():
    for t in ("", "A-b C_d é!É 日本\x7f x\x00y", "".join(map(chr, range(0x250)))):
        assert [w.decode() for w in common.alnum_words(t.encode())] == _alnum(t)


def _bench(rng):
    return [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 20)))) for i in range(12)] + [(3, "a b c a"), (None, "zz yy"), (20, None)]


@pytest.mark.parametrize("block_bytes", [1 << 25, 60])
def test_decontamination_equals_brute_force(spark, make, block_bytes):
    """In one block and in several."""
    rng = random.Random(5)
    items = _bench(rng)
    rows = [(i, " ".join(rng.choice("abcD,zz").strip() or "yy" for _ in range(rng.randint(0, 60)))) for i in range(40)] + [(40, None), (41, "Zz, YY!")]
    out = decontaminate.scan(make(rows), spark.createDataFrame(items, "item_id bigint, text string"), block_bytes=block_bytes)
    got = {r["doc_id"]: (r["n_words"], [tuple(s) for s in r["spans"]], r["items"]) for r in out.select("row.doc_id", "n_words", "spans", "items").collect()}
    for i, t in rows:
        w, hit, found = _alnum(t), set(), set()
        for item, x in items:
            p = _alnum(x)
            m = min(13, len(p))
            for a in range(len(p) - m + 1 if m else 0):
                for q in range(len(w) - m + 1):
                    if w[q : q + m] == p[a : a + m]:
                        hit |= set(range(q, q + m))
                        found |= {str(item)} if item is not None else set()
        spans = decontaminate.merge([(q, q + 1) for q in hit])
        assert got[i] == (len(w), spans, sorted(found))


def test_a_large_benchmark_fits_a_worker():
    """32 MB of items, twice the size of a block, within 1 GB of memory."""
    import subprocess
    import sys

    code = """
import random
from corpusloom.llm import decontaminate
rng = random.Random(1)
words = [f"w{i}" for i in range(300000)]
peak = lambda: int([x for x in open("/proc/self/status") if x.startswith("VmHWM")][0].split()[1]) >> 10
before, texts = peak(), ((str(k), " ".join(rng.choices(words, k=300)).encode().split()) for k in range(16500))
table = decontaminate.WuManber(texts)
assert len(table.tables[0].text) > 32 << 20
print(peak() - before)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert int(out.stdout) < 1024


def test_colliding_patterns_are_told_apart(monkeypatch):
    """Also where all hashes of words and blocks are equal."""
    rng = random.Random(9)
    items = [(str(i), [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 8))]) for i in range(30)]
    text = [rng.choice([b"a", b"b", b"c"]) for _ in range(200)]
    want = decontaminate.WuManber(items, 4).scan(text)
    monkeypatch.setattr(decontaminate, "hash", lambda x: 5, raising=False)
    assert decontaminate.WuManber(items, 4).scan(text) == want


def test_license_places_and_suppression(spark, make):
    texts = [
        "All rights reserved, cc by; CC-BY cc by.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "gnu General Public License version 2",
        "creative commons attribution share alike 4.0 international license",
        "nothing here",
        None,
        "",
    ]
    rows = list(enumerate(texts))
    out = {r["doc_id"]: r for r in license_scan.scan(make(rows)).select("row.doc_id", "n_words", "base", "found").collect()}
    for i, t in rows:
        w = _alnum(t)
        places = sorted((k, label) for label, p in license_rules.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        assert out[i]["n_words"] == len(w)
        assert sorted((h["s"], h["label"]) for h in out[i]["base"]) == places
    assert {h["label"] for h in out[1]["found"]} == {"mit"}
    assert {h["label"] for h in out[2]["found"]} == {"gpl-3.0"}
    assert {h["label"] for h in out[3]["found"]} == {"gpl-2.0"}
    assert {h["label"] for h in out[4]["found"]} == {"cc-by-sa"}
    assert not out[5]["found"] and not out[6]["found"]


def test_license_of_wrapped_and_hyphenated_notices(spark, make):
    notices = {
        "This text is in the public domain": "public-domain",
        "Released under the MIT": "mit",
        "Creative Commons Attribution 4 0": "cc-by",
        "Creative Commons Zero": "cc0-1.0",
        "Altered source versions must be plainly marked as such": "zlib",
        "Neither the name of it nor the names of its contributors may be used to endorse or promote": "bsd-3-clause",
    }
    joined = [(sep.join(n.split(" ")), label) for n, label in notices.items() for sep in (" ", "\n", "-", "\t", "  ", "\r\n * ")]
    out = {r["doc_id"]: r["found"] for r in license_scan.scan(make(list(enumerate(t for t, _ in joined)))).select("row.doc_id", "found").collect()}
    assert [(t, label) for i, (t, label) in enumerate(joined) if label not in {h["label"] for h in out[i]}] == []


def _found(text):
    """All detections by every rule, ungated, on plain Python regexes; then suppression."""
    norm = " " + " ".join(_alnum(text)) + " "
    hits = []
    for k, (label, priority, weight, _, regex) in enumerate(license_rules.rules()):
        for m in re.finditer("(?<= )(?:" + regex + ")(?= )", norm):
            start = norm.count(" ", 0, m.start()) - 1
            hits.append((start, start + m[0].count(" ") + 1, priority, k, weight, label))
    base = len(license_rules.rules()) - len(license_rules.BASE)

    def held(h):
        return any(o[0] <= h[0] and o[1] >= h[1] and (o[2], o[0] - o[1], o[3]) < (h[2], h[0] - h[1], h[3]) for o in hits)

    return sorted(h for h in hits if h[3] >= base), sorted(h for h in hits if not held(h))


def _samples(regex, rng):
    """A text that matches a rule, made from its regex by choosing alternatives."""
    regex = re.sub(r"\.\{\d+,\d+\}\??", "acme", regex)
    while m := re.search(r"\(\?:([^()]*)\)(\?|\*)?", regex):
        parts = m[1].split("|") + ([""] if m[2] else [])
        regex = regex[: m.start()] + rng.choice(parts) + regex[m.end() :]
    regex = re.sub(r"\[(.)[^]]*\](?:-\d\])?", lambda m: m[1], regex).replace(r"\d", "7").replace(".{1,80}?", "acme")
    return re.sub(r"(.)\?", lambda m: rng.choice([m[1], ""]), regex)


def test_license_rules_equal_brute_force(spark, make):
    """Every rule on texts of its own, plain, wrapped, hyphenated and in capitals, against all rules ungated."""
    rng = random.Random(4)
    rules = license_rules.rules()
    rows, own = [], 0
    for k, (_, _, _, _, regex) in enumerate(rules):
        for sep in (" ", "\n", "-", "\r\n * "):
            other = _samples(rng.choice(rules)[4], rng) if sep == "-" else ""  # the others pass the gate by themselves
            text = sep.join(f"zq {_samples(regex, rng)} xq {other} İK".split())
            rows.append((len(rows), text.upper() if k % 3 == 0 else text))
            own += any(h[3] == k for h in _found(text)[1]) or bool(re.search("(?<= )(?:" + regex + ")(?= )", " " + " ".join(_alnum(text)) + " "))
    assert own > 0.95 * len(rows)  # the texts do match their rules
    out = license_scan.scan(make(rows)).select("row.doc_id", "base", "found").collect()
    key = lambda hits: sorted((h["s"], h["e"], h["p"], h["k"], h["w"], h["label"]) for h in hits)
    got = {r["doc_id"]: (key(r["base"]), key(r["found"])) for r in out}
    assert [(t, got[i], _found(t)) for i, t in rows if got[i] != _found(t)][:3] == []


def test_license_rules_compile():
    rules = license_rules.rules()
    assert len(license_rules.TEXTS) > 120 and len(rules) > 400
    for label, _, weight, _, regex in rules:
        re.compile(regex)
        assert label and 0 < weight <= 1


def _auc(score, y):
    order = np.argsort(np.argsort(score, kind="stable"))
    pos = y == 1
    return (order[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.fixture(scope="session")
def check(spark):
    return "/root/testdata/sf0.1"


@pytest.mark.parametrize("query,label,least", [(toxicity.op5_toxicity, "toxic", 0.93), (quality.op6_quality, "quality", 0.93)])
def test_held_out_accuracy(spark, check, query, label, least):
    rows = query(spark, check).join(spark.read.parquet(f"{check}/labels.parquet"), "doc_id").where(F.col("held_out") & F.col(label).isNotNull()).select("score", "predicted", label).collect()
    s, y = np.array([r["score"] for r in rows]), np.array([r[label] for r in rows])
    assert _auc(s, y) > least and ((s >= 0) & (s <= 1)).all()


def _mixed(x, salt=0):
    """The 64-bit finaliser on Python's own numbers."""
    low = (1 << 64) - 1
    x = x + (salt * 0x9E3779B97F4A7C15 & low) & low
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & low
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & low
    return x ^ x >> 31


def _features(text):
    """Words, pairs and skip pairs, one after the other."""
    h = [xxhash.xxh3_64_intdigest(w.encode()) for w in _alnum(text)]
    out = [_mixed(x, 1) for x in h]
    for gap in (1, 2):
        out += [_mixed((a * 3 + b) & (1 << 64) - 1, gap + 1) for a, b in zip(h, h[gap:], strict=False)]
    return sorted({x >> 64 - toxicity.BITS for x in out})


def _plain_ftrl(examples, epochs):
    """FTRL-proximal with dictionaries, one coordinate at a time; weights by coordinate."""
    z, n = Counter(), Counter()

    def weight(i):
        l1 = 0.0 if i == 1 << toxicity.BITS else toxicity.L1
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * l1) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(epochs):
        for features, y in examples:
            at = [*features, 1 << toxicity.BITS]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y
            for i in at:
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / toxicity.ALPHA * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z if weight(i)}


def _labelled(rng, n, words=("bad", "good")):
    rows = [(i, " ".join(rng.choice([f"w{rng.randrange(40)}", words[i % 2]]) for _ in range(rng.randint(1, 30)))) for i in range(n)]
    return rows, [(i, i % 2, 1 - i % 2) for i, _ in rows]


def test_toxicity_equals_a_plain_ftrl(spark, make):
    """Weights, margins and scores of the whole operator against dictionaries."""
    from corpusloom.llm import labelled

    rows, labels = _labelled(random.Random(3), 120)
    docs, table = make(rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs, table, allowed=F.lit(True))
    sample, _ = labelled.sample(docs, table, label="toxic", allowed=F.lit(True), per_class=toxicity.PER_CLASS)
    turns = [(r["text"], r["y"]) for r in sample.withColumn("turn", F.xxhash64("order", "text")).orderBy("turn", "y").collect()]
    want = _plain_ftrl([(_features(t), y) for k, (t, y) in enumerate(turns) if k % 4], toxicity.EPOCHS)
    got = dict(zip(model["at"].tolist(), model["w"].tolist(), strict=True))
    assert got.keys() == want.keys() and want and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    texts = dict(rows)
    for r in toxicity.measure(docs, spark.sparkContext.broadcast(model)).select("row.doc_id", "margin", "score").collect():
        margin = sum(want.get(i, 0.0) for i in [*_features(texts[r["doc_id"]]), 1 << toxicity.BITS])
        assert abs(r["margin"] - margin) < 1e-9 and abs(r["score"] - 1 / (1 + np.exp(-(model["slope"] * margin + model["intercept"])))) < 1e-9


def test_quality_equals_a_direct_computation(spark, make):
    """Differences and scores of the whole operator from fresh compressors, piece by piece."""
    import zstandard

    rows, labels = _labelled(random.Random(4), 80)
    rows += [(200, "long " * 2000), (201, ""), (202, None)]
    docs, table = make(rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = quality.fit(docs, table, allowed=F.lit(True))

    def size(text, blob):
        how = {"level": quality.LEVEL, "write_content_size": False, "write_dict_id": False} | ({"dict_data": zstandard.ZstdCompressionDict(blob)} if blob else {})
        return sum(len(zstandard.ZstdCompressor(**how).compress(text[i : i + quality.PIECE])) for i in range(0, len(text), quality.PIECE))

    texts = {i: (t or "").encode() for i, t in rows}
    for r in quality.measure(docs, spark.sparkContext.broadcast(model)).select("row.doc_id", "difference", "score").collect():
        good, bad = (size(texts[r["doc_id"]], model[k]) for k in ("good", "bad"))
        want = (bad - good) / (bad + good) if good + bad else 0.0
        assert abs(r["difference"] - want) < 1e-12 and abs(r["score"] - 1 / (1 + np.exp(-(model["slope"] * want + model["intercept"])))) < 1e-9


def test_samples_hold_whole_texts_up_to_a_bound(spark, make):
    from corpusloom.llm import labelled

    rows, labels = _labelled(random.Random(5), 60)
    docs, table = make(rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    every, _ = labelled.sample(docs, table, label="toxic", allowed=F.lit(True), per_class=20)
    some, _ = labelled.sample(docs, table, label="toxic", allowed=F.lit(True), per_class=20, class_bytes=500)
    assert every.count() == 40 and 0 < some.count() < 40
    sizes = {r["y"]: r["n"] for r in some.groupBy("y").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    assert all(n <= 500 for n in sizes.values()) and {r["text"] for r in some.collect()} <= {r["text"] for r in every.collect()}


def test_samples_pass_over_what_does_not_fit(spark, make):
    """A class keeps rows whatever its first text is, and its shortest text where none fits."""
    from corpusloom.llm import labelled

    docs = make([(i, ("x" * 5000 if i % 2 else "y" * 10)) for i in range(20)] + [(101, "z" * 4500)])
    table = spark.createDataFrame([(i, i % 2, i % 2) for i in [*range(20), 101]], "doc_id bigint, quality int, toxic int")
    got = labelled.sample(docs, table, label="toxic", allowed=F.lit(True), per_class=50, class_bytes=4000)[0].collect()
    assert sorted((r["y"], len(r["text"])) for r in got) == [(0, 10)] * 10 + [(1, 4500)]
    got = labelled.sample(docs, table, label="toxic", allowed=F.lit(True), per_class=50, class_bytes=4700)[0].collect()
    assert sorted((r["y"], len(r["text"])) for r in got) == [(0, 10)] * 10 + [(1, 4500)]


def test_long_text_counts_whole(spark, make):
    """A toxic word at the end of a very long text still counts."""
    rng = random.Random(1)
    filler = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    rows = [(i, filler(60) + (" vile slime" if i % 2 else "")) for i in range(200)]
    docs = make(rows + [(1000, filler(20000) + " vile slime"), (1001, filler(20000))])
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id bigint, toxic int")
    model = spark.sparkContext.broadcast(toxicity.fit(docs, labels, allowed=F.lit(True)))
    got = {r["doc_id"]: r["score"] for r in toxicity.measure(docs, model).select("row.doc_id", "score").collect()}
    assert got[1000] > 0.7 > 0.3 > got[1001]


def test_ftrl_is_sparse():
    rng = np.random.default_rng(1)
    m = toxicity.Ftrl(1000)
    for _ in range(3):
        for _ in range(400):
            y = int(rng.random() < 0.5)
            m.learn(np.unique(np.append(rng.integers(10, 1000, 20), [1000] + [3] * y)), y)
    w = m.weights(np.arange(1001))
    assert w[3] > 1 and (w[10:1000] == 0).mean() > 0.8


def test_lm_base_and_known_tokens(spark, make):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["The", "the", "of"] + [f"x{rng.randrange(80)}"] * 3) for _ in range(rng.randint(0, 30)))) for i in range(60)] + [(60, None), (61, ""), (61, ""), (62, "only new words")]
    out = language_model.score(make(rows), train=F.col("doc_id") % 7 != 2).select("row.doc_id", "row.text", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
    tokens = lambda t: (t or "").translate(LOW).split() + [None]
    c = Counter(w for i, t in rows if i % 7 != 2 for w in tokens(t))
    n, v = sum(c.values()), len(c)
    assert len(out) == len(rows)
    for r in out:
        w = tokens(r["text"])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(x in c for x in w), n)
        assert abs(r["base_score"] - sum(np.log10((c.get(x, 0) + 1) / (n + v + 1)) for x in w)) < 1e-8
        assert r["score"] < 0


def _pairs(rng, words=30, contexts=6):
    counts = rng.poisson(0.5, (contexts, words)) * rng.integers(1, 60, (contexts, words))
    context, word = np.nonzero(counts)
    return language_model.Pairs(word, context, counts[context, word], np.arange(words, dtype=np.uint64) * np.uint64(7919)), counts


def test_lm_probabilities_are_normalised():
    pairs, counts = _pairs(np.random.default_rng(2))
    first = language_model.Totals(language_model._vector(_pairs(np.random.default_rng(2))[0]))
    second = language_model.Totals(language_model._vector(_pairs(np.random.default_rng(2))[0], first), first.discount)
    sums = pairs.sampled(first, second)
    final = language_model.Totals(pairs.vector(*sums, language_model.SAMPLES), first.discount, language_model.SAMPLES)
    extra, served = pairs.own(sums, final.discount)
    own = np.zeros(counts.shape)
    own[pairs.context, pairs.word] = extra
    known = served > 0
    for c in (0, 3, 4000):  # the last one has never been seen
        p = 10 ** final.log(own[c][known] if c < len(own) else np.zeros(known.sum()), np.full(known.sum(), c), final.probability(served[known]))
        unseen = 10 ** final.log(np.zeros(1), np.array([c]), final.probability(np.zeros(1)))
        assert abs(p.sum() + unseen[0] - 1) < 1e-9 and (p > 0).all()


def _partitions(n):
    if n == 0:
        yield []
        return
    for rest in _partitions(n - 1):
        yield [*rest, 1]
        for i in range(len(rest)):
            yield [*rest[:i], rest[i] + 1, *rest[i + 1 :]]


@pytest.mark.parametrize("customers,strength,base,discount", [(2, 1.5, 0.3, 0.5), (5, 4.0, 0.1, 0.75), (6, 0.7, 0.9, 0.2)])
def test_lm_tables_follow_their_exact_distribution(customers, strength, base, discount):
    """Against all seatings of a few customers, with the weights of the restaurant."""
    weight = Counter()
    for sizes in _partitions(customers):
        w = 1.0
        for j, size in enumerate(sizes):
            w *= (strength + discount * j) * base * np.prod([k - discount for k in range(1, size)])
        weight[len(sizes)] += w
    total, n = sum(weight.values()), 200_000
    drawn = language_model.tables(np.full(n, customers), np.full(n, strength), np.full(n, base), discount, np.arange(n, dtype=np.uint64), 3)
    for t in range(1, customers + 1):
        assert abs((drawn == t).mean() - weight[t] / total) < 0.006


def test_lm_sampler_agrees_with_enumeration():
    """Two contexts over two words: mean tables of the sweeps against all table counts of the whole hierarchy."""
    from itertools import product

    m, d, counts = language_model, 0.5, [3, 2, 4]  # (context, word): (0, 0), (0, 1), (1, 0)
    word, context = np.array([0, 1, 0]), np.array([0, 0, 1])
    s, s0 = np.exp(m.stirling(d)), np.exp(m.stirling(m.PARENT_DISCOUNT))
    rise = lambda theta, step, n: np.prod([theta + step * j for j in range(n)])
    mean, total = np.zeros(3), 0.0
    for t in product(*(range(1, c + 1) for c in counts)):
        served = [t[0] + t[2], t[1]]
        w = np.prod([s[c, x] for c, x in zip(counts, t, strict=True)]) * rise(m.STRENGTH, d, t[0] + t[1]) * rise(m.STRENGTH, d, t[2])
        parent = sum(s0[served[0], a] * s0[served[1], b] * rise(m.PARENT_STRENGTH, m.PARENT_DISCOUNT, a + b) / 3 ** (a + b) for a in range(1, served[0] + 1) for b in range(1, served[1] + 1))
        w *= parent / rise(m.PARENT_STRENGTH, 1, sum(served))
        mean += w * np.array(t)
        total += w
    mean /= total
    got = np.zeros(3)
    for seed in range(60):
        pairs = m.Pairs(word, context, np.array(counts), np.array([11, 12], np.uint64) + np.uint64(100 * seed))
        first = m.Totals(pairs.vector(), d)
        pairs.sweeps(first, 5, 0)
        second = m.Totals(pairs.vector(), d)
        got += pairs.sweeps(second, 40, 5)[0] / 40 / 60
    # All dishes of a sweep move at once, given the sweep before: near the exact means, not on them.
    assert np.abs(got - mean).max() < 0.3, (got, mean)


def test_lm_many_customers():
    c = np.array([0, 1, 2, 10, 100, 5000])
    key = np.arange(6, dtype=np.uint64)
    t = language_model.tables(c, np.ones(6), np.full(6, 0.2), 0.5, key, 0)
    assert (t <= c).all() and (t[1:] >= 1).all() and t[0] == 0
    # Few tables where the parent finds the dish unlikely, many where it is certain.
    few, many = (language_model.tables(np.full(50, 40), np.ones(50), np.full(50, p), 0.5, np.arange(50, dtype=np.uint64), 1).mean() for p in (1e-6, 1.0))
    assert few < 1.05 < 3 < many


def test_lm_frequent_words_are_exact(spark, make, monkeypatch):
    monkeypatch.setattr(language_model, "HEADS", 7)
    rng = random.Random(1)
    rows = [(i, " ".join(f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(20))) for i in range(200)]
    c = Counter(w for _, t in rows for w in t.split())
    hashes = {w: int(common.Words([w.encode()]).hashes()[0]) for w in c}
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    want = sorted(c, key=lambda w: (-c[w], signed(hashes[w])))[:7]
    for n in (1, 7, 30):
        heads = language_model.frequent(make(rows).repartition(n).select(F.lit(True).alias("train"), "text"))
        by_rank = [h for _, h in sorted(zip(heads.ranks.tolist(), heads.hashes.tolist(), strict=True))]
        assert by_rank == [hashes[w] for w in want]


def test_lm_scores_do_not_depend_on_partitions(spark, make, monkeypatch):
    monkeypatch.setattr(language_model, "WORD_BYTES", 20_000)
    monkeypatch.setattr(language_model, "FLUSH", 700)
    rng = random.Random(6)
    rows = [(i, " ".join(f"w{min(rng.randrange(4000), rng.randrange(4000))}" for _ in range(rng.randint(0, 60)))) for i in range(400)]
    rows += [(7, rows[7][1]), (400, None)]
    want = None
    for n in (1, 7, 64):
        out = language_model.score(make(rows).repartition(n), train=F.col("doc_id") % 5 != 1).select("row.doc_id", "score", "base_score", "n_known").collect()
        got = sorted((r["doc_id"], round(r["score"], 9), round(r["base_score"], 9), r["n_known"]) for r in out)
        assert want is None or got == want
        want = got


def test_lm_beats_the_base_on_held_out_text(spark, sf):
    r = language_model.op9_lm_scoring(spark, sf).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).head()
    assert r["s"] > r["b"]


def test_held_out_rules(spark):
    df = spark.createDataFrame([(i,) for i in range(50)], "doc_id bigint").select("doc_id", toxicity.held_out().alias("a"), quality.held_out().alias("b"), language_model.held_out().alias("c"))
    for r in df.collect():
        h = zlib.crc32(str(r["doc_id"]).encode())
        assert (r["a"], r["b"], r["c"]) == (h % 3 == 1, h % 5 == 0, h % 7 == 2)
