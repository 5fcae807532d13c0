"""Hard negatives and the source audit against brute force: ties, repeated rows, nulls, skew, every tile size."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import hard_negatives as H
from corpusloom.llm import source_audit as A

VECTORS = "vec_id bigint, label int, embedding array<float>, id string, v string, group string"


def _vectors(n, dims=6, seed=1, labels=4, spread=0.5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dims))
    return [(i, int(rng.integers(labels)), (centres[i % labels] + spread * rng.normal(size=dims)).astype(np.float32).tolist()) for i in range(n)]


def _brute(rows, every, scale=256.0, positives=5, negatives=3):
    ok = [(i, lab, [math.floor(scale * x) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    anchors = {}
    for i, lab, v in sorted(ok, key=lambda r: (r[0], r[1], r[2])):
        if i % every == 0:
            anchors.setdefault(i, (lab, v))
    out = []
    for a, (lab, v) in anchors.items():
        scored = sorted((-dot(v, w), i, m) for i, m, w in ok)
        own = [(-s, i) for s, i, m in scored if m == lab and i != a][:positives]
        for p, pid in own:
            found = [(-s, i) for s, i, m in scored if m != lab and 50 * p <= -100 * s <= 95 * p][:negatives]
            out += [(a, pid, r, i, p, s) for r, (s, i) in enumerate(found, 1)]
    return sorted(out)


def _mined(spark, rows, every, **options):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], VECTORS)
    got = H.mine(df, F.col("id") % every == 0, id="vec_id", vector="embedding", scale=256.0, **options)
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("pivots,spread,group_rows", [(8, 0.2, 1 << 16), (3, 2.0, 16), (1, 0.5, 1 << 16)])
def test_mining_equals_brute_force(spark, monkeypatch, pivots, spread, group_rows):
    monkeypatch.setattr(H, "TILE", 16)
    rows = _vectors(260, seed=pivots, spread=spread)
    got = _mined(spark, rows, 10, pivots=pivots, group_rows=group_rows)
    assert got == _brute(rows, 10) and len(got) > 20


def test_mining_edges(spark):
    """Ties, one common vector, repeated ids, null and non-finite parts, short vectors, no positives, extra columns."""
    rows = _vectors(60, dims=3)
    common = rows[7][2]
    rows += [(100 + i, i % 3, common) for i in range(40)] + [(0, *rows[0][1:]), (5, 1, common), (None, 1, common), (300, None, common), (301, 1, None), (302, 1, [1.0, None, 2.0]), (303, 1, [1.0, float("nan"), 2.0]), (305, 2, [float("inf"), 0.0, 0.0]), (310, 9, [1.0, 1.0, 1.0]), (311, 1, [])]
    full = [(i, lab, v if v is None or len(v) == 3 else [*v, *[0.0] * (3 - len(v))]) for i, lab, v in rows]
    got = _mined(spark, rows, 5)
    assert got == _brute(full, 5) and {r[0] for r in got} and 310 not in {r[0] for r in got}
    assert _mined(spark, [], 5) == [] and _mined(spark, rows[:1], 5) == []


def test_brackets_hold_and_spare_checks(spark, monkeypatch):
    rows = _vectors(4000, dims=8, spread=0.05, labels=8)
    x = np.floor(256 * np.array([r[2] for r in rows], np.float64))
    space = H.Space(8, float((x * x).sum(axis=1).max()), float(np.abs(x).max()), x[:500], 1.0, 8)
    dx, q = space.distances(space.lifted(x)), x[:40]
    dq = space.distances(np.hstack([q, np.zeros((40, 1))]))
    score, norm2 = q @ x.T, (q * q).sum(axis=1)
    near, far = np.abs(dq[:, None] - dx[None]).max(axis=2) - space.loose, (dq[:, None] + dx[None]).min(axis=2) + space.loose
    assert (score <= (norm2[:, None] + space.limit - np.maximum(near, 0) ** 2) / 2).all()
    assert (score >= (norm2[:, None] + space.limit - far**2) / 2).all()
    checked = []
    monkeypatch.setattr(H.Group, "_checked", _counting(H.Group._checked, checked))
    labels = [r[1] for r in rows]
    group = H.Group(space, [dict(zip(("kind", "part", "n", "ids", "labels", "vectors", "distances"), H._block(0, space, np.arange(4000), labels, x)[:7], strict=True))])
    block = dict(zip(("kind", "part", "n", "ids", "labels", "vectors", "distances"), H._block(1, space, np.arange(40), labels[:40], q)[:7], strict=True))
    group.search(block, 5)
    assert sum(checked) < 0.3 * 40 * 4000


def _counting(f, into):
    def run(*args):
        out = f(*args)
        into.append(len(out[0]))
        return out

    return run


def test_scores_stay_exact_in_every_type():
    for most, product in ((100, np.float32), (1 << 20, np.float64), (1 << 29, object)):
        x = np.array([[most, -most, most - 1], [1, 2, 3]], np.float64)
        space = H.Space(3, float((x * x).sum(axis=1).max()), float(most), x, 1.0, 2)
        assert space.product is product
        assert space.scores(x, x).tolist() == [[sum(int(a) * int(b) for a, b in zip(r, s, strict=True)) for s in x] for r in x]


DOCS = "doc_id bigint, lang string, source string, text string, n bigint, term string, docs string"


def _audit(rows, min_docs, top=10):
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    rows = [(lang or "", source or "", terms(text)) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        words = {w for r in own for w in r[2]}
        kept = sorted((w for w in words if sum(w in r[2] for r in own) >= min_docs), key=str.encode)
        sources = sorted({r[1] for r in own}, key=str.encode)
        count = {s: {w: sum(r[2].count(w) for r in own if r[1] == s) for w in kept} for s in sources}
        share = lambda c: {w: 1 + 1_000_000_000 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept}  # noqa: B023, E731
        q = share({w: sum(count[s][w] for s in sources) for w in kept})
        p = {s: share(count[s]) for s in sources}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = sorted((-sum(f(p[s][w], p[o][w]) for w in kept), o.encode(), o) for o in sources if o != s)
            term = sorted((-f(p[s][w], q[w]), w.encode(), w) for w in kept if count[s][w] and p[s][w] > q[w])[:top]
            for part, ranked in (("pair", pair), ("term", term)):
                out += [(lang, s, part, item, -v, r) for r, (v, _, item) in enumerate(ranked, 1)]
    return sorted(out)


def _reported(spark, rows, **options):
    df = spark.createDataFrame([(i, *r, 1, "t", "d") for i, r in enumerate(rows)], DOCS)
    return sorted(tuple(r) for r in A.audit(df, **options).select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("cells", [1 << 20, 8])
def test_audit_equals_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(A, "CELLS", cells)
    monkeypatch.setattr(A, "RUN_BYTES", 300)
    rng = random.Random(cells)
    words = ["The", "der", "ÜBER", "naïve", "é", "zz", "中文", "\U0001f642", "a1b", "x_y", "nbsp w", *[f"{c}{d}" for c in "abc" for d in "xyz"]]
    rows = [(rng.choice(["en", "de", "x"]), rng.choice(["s1", "s2", "S3", "é"]), " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for _ in range(150)]
    rows += [("one", "alone", "many words"), (None, None, None), (None, "s", "w"), ("en", None, "the the"), ("fr", "a", ""), ("fr", "b", None), ("en", "s1", "the " * 3000)] + [("de", "s2", "der zz zz")] * 20
    got = _reported(spark, rows, min_docs=3)
    assert got == _audit(rows, 3)
    assert ("fr", "a", "pair", "b", 0, 1) in got and not [r for r in got if r[0] == "one"]


def test_audit_of_nothing_and_of_too_many_sources(spark, monkeypatch):
    assert _reported(spark, []) == []
    monkeypatch.setattr(A, "MAX_SOURCES", 2)
    with pytest.raises(ValueError):
        _reported(spark, [("en", f"s{i}", "x") for i in range(3)])


def test_shares_are_exact():
    rng = random.Random(3)
    pairs = [(c, c + rng.randrange(1 << rng.randrange(1, 45))) for c in (rng.randrange(1, 1 << rng.randrange(2, 48)) for _ in range(300))]
    count, total = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
    assert A.shares(count, total).tolist() == [1 + 1_000_000_000 * c // t for c, t in pairs]
