"""Exact, near, substring and line dedup against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import exact_dedup, exchange, line_dedup, near_dedup, substring_dedup


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 1000, 50000])
def test_binary_fuse_has_no_false_negatives(n):
    keys = np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64)
    f = exact_dedup.BinaryFuse.from_bytes(exact_dedup.BinaryFuse.build(keys).to_bytes())
    if n:
        assert f.contains(keys).all()
    if n >= 1000:
        assert f.contains(keys + np.uint64(1)).mean() < 0.02 and len(f.cells) < 2 * n


def _texts(seed, n):
    rng = random.Random(seed)
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 12))) for _ in range(n // 4)]
    return [(i, rng.choice(base).replace(" ", rng.choice([" ", "  ", "\n"])) if rng.random() < 0.9 else None) for i in range(n)]


@pytest.mark.parametrize("digest", [exact_dedup.strong_digest, lambda norm: F.substring(F.md5(norm.cast("binary")), 1, 1)])
@pytest.mark.parametrize("limit", [exact_dedup.BROADCAST_KEYS, 0])
def test_exact_groups(spark, make, digest, limit):
    """Also with a digest that collides, and beyond the broadcast bound."""
    import re

    rows = _texts(1, 200)
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[ \t\n\r\f\v]+", " ", t or "")].append(i)
    want = {i: (min(g), len(g)) for g in groups.values() for i in g}
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.dedup(make(rows), digest=digest, limit=limit).collect()}
    assert got == want


@pytest.mark.parametrize("digest", [exact_dedup.strong_digest, lambda norm: F.substring(F.md5(norm.cast("binary")), 1, 1)])
def test_batches_against_stored_snapshots(spark, make, tmp_path, digest):
    """Three runs, each of a new store object, also with a digest that collides."""
    import re

    rows = _texts(2, 240)
    norm = [(i, re.sub(r"[ \t\n\r\f\v]+", " ", t or "")) for i, t in rows]
    owner, size = {}, Counter()
    for k in range(3):
        part = slice(80 * k, 80 * k + 80)
        here = Counter(t for _, t in norm[part])
        least = {t: min(i for i, x in norm[part] if x == t) for t in here}
        want = {i: (owner.get(t, least[t]), here[t] + size[t], t not in owner and i == least[t]) for i, t in norm[part]}
        store = exact_dedup.Store(spark, str(tmp_path / "store"))
        out = exact_dedup.dedup_batch(make(rows[part]), store, digest=digest)
        assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in out.collect()} == want
        for t in here:
            if t not in owner:
                owner[t], size[t] = least[t], here[t]
    assert len(store.snapshots()) == 3
    left = store.snapshots()[1].rows.inputFiles()[0].rsplit("/rows/", 1)[0].removeprefix("file:")
    (tmp_path / "store").joinpath(left.rsplit("/", 1)[1], "_SNAPSHOT").unlink()  # as a run that failed leaves it
    assert len(exact_dedup.Store(spark, str(tmp_path / "store")).snapshots()) == 2
    empty = exact_dedup.dedup_batch(make([]), store, add=False)
    assert empty.count() == 0 and len(exact_dedup.Store(spark, str(tmp_path / "new")).snapshots()) == 0


def test_superminhash_estimates_jaccard():
    rng = np.random.default_rng(3)
    common, a, b = (rng.integers(0, 1 << 63, k, dtype=np.uint64) for k in (600, 200, 200))
    x, y = np.sort(np.concatenate([common, a])), np.sort(np.concatenate([common, b]))
    s = near_dedup.superminhash(np.repeat([0, 1, 2], [800, 800, 1]), np.concatenate([x, y, x[:1]]), 3, 256)
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.1
    assert len(np.unique(np.floor(s[2]))) == 256  # one element: its whole permutation
    assert (near_dedup.superminhash(np.zeros(800, int), x, 1, 256)[0] == s[0]).all()


def _near_rows(seed):
    """Groups of near copies with many different degrees of overlap, and copies."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    out = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(3, 80))]
        for _ in range(rng.randint(1, 25)):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 6))):
                t[rng.randrange(len(t))] = rng.choice(words)
            out.append(" ".join(t))
    rng.shuffle(out)
    return list(enumerate(out + [out[0], None, "", "solo"]))


def _components(rows, k, percent):
    sets = {i: near_dedup.shingles((t or "").encode(), k) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                n = len(sets[x] & sets[y])
                if 100 * n >= percent * (len(sets[x]) + len(sets[y]) - n):
                    a, b = find(x), find(y)
                    parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("seed,k", [(1, 2), (2, 5), (3, 2)])
def test_near_components_equal_brute_force(spark, make, seed, k):
    rows = _near_rows(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(make(rows), shingle=k).collect()}
    assert got == _components(rows, k, 80)


def _merged(rows, k):
    """Components of rows that may share ids, each row with its own set."""
    parts = _components([(n, t) for n, (_, t) in enumerate(rows)], k, 80)
    parent = {n: parts[n][1] for n in parts}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    first = {}
    for n, (i, _) in enumerate(rows):
        a, b = find(first.setdefault(i, n)), find(n)
        parent[max(a, b)] = min(a, b)
    least = {}
    for n, (i, _) in enumerate(rows):
        least[find(n)] = min(least.get(find(n), i), i)
    return sorted((i, parts[n][0], least[find(n)]) for n, (i, _) in enumerate(rows))


@pytest.mark.parametrize("text_ids", [False, True])
def test_near_components_of_repeated_ids(spark, make, text_ids):
    """Rows that share an id keep the links of all their texts; ids may be strings."""
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    rows = [(5, a), (5, b), (7, b + " end"), (9, a + " end"), (11, "x y z"), (11, "x y z")]
    rows += [(20 + i % 7, t) for i, t in _near_rows(4)[:90] if t]
    docs = make(rows)
    if text_ids:
        rows = [(f"id{i}", t) for i, t in rows]
        docs = docs.withColumn("doc_id", F.concat(F.lit("id"), "doc_id"))
    got = near_dedup.near_duplicates(docs, shingle=2).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == _merged(rows, 2)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize("n", [1024, 4096])
def test_near_tells_colliding_words_apart(spark, make, n):
    x, y = thue_morse(n)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(make([(1, x), (2, y), (3, f"{x} {y}")])).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (1, 3)}


@pytest.mark.parametrize("together", [near_dedup.TOGETHER, 3])
def test_near_members_apart_from_their_hub(spark, make, monkeypatch, together):
    """Excerpts of one long text, shifted, with own and shared additions: linked with each other, not with it."""
    monkeypatch.setattr(near_dedup, "TOGETHER", together)
    rng = random.Random(8)
    whole = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(whole))]
    for i in range(1, 60):
        start = rng.choice([0, 10, 60, 65])
        part = whole[start : start + rng.randint(110, 140)] + [f"s{rng.randrange(3)}x{k}" for k in range(rng.randint(0, 25))]
        rows.append((i, " ".join(part)))
    for k in (2, 5):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(make(rows), shingle=k, rows=2, bands=20).collect()}
        assert got == _components(rows, k, 80)


def test_join_by_count_is_the_join(spark):
    from corpusloom.llm import common

    rows = spark.createDataFrame([(i % 50 if i % 3 else 1, i) for i in range(3000)] + [(None, -1), (99, -2)], "k bigint, i bigint")
    table = rows.where("k IS NOT NULL AND k <> 99").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    for how in ("left", "inner"):
        got = common.join_by_count(rows, table, "k", 3002, how).collect()
        assert sorted(map(str, got)) == sorted(map(str, rows.join(table, "k", how).collect()))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in near_dedup.components(edges).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[101] == 100


def _substring(rows, window):
    lists = [(t or "").split() for _, t in rows]
    count = Counter(tuple(w[i : i + window]) for w in lists for i in range(len(w) - window + 1))
    out = []
    for w in lists:
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def _runs_of(out):
    return sorted((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), r["kept"]) for r in out.select("row.doc_id", "n_words", "spans", "kept").collect())


@pytest.mark.parametrize("window,width,size,fan", [(4, 12, 1 << 20, None), (5, 8, 200, 3), (2, 6, 50, 2), (1, 10, 90, 4)])
def test_substring_equals_brute_force(spark, make, window, width, size, fan):
    """Also with a full sketch, tiny blocks, many shards over several levels, and periodic texts."""
    rng = random.Random(window)
    passages = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(3, 15))) for _ in range(6)]
    rows = []
    for i in range(60):
        t = " ".join(rng.choice(passages) if rng.random() < 0.3 else " ".join(f"u{rng.randrange(10**6)}" for _ in range(4)) for _ in range(rng.randint(0, 6)))
        rows.append((i, t))
    rows += [(60, "x y " * 20), (61, "p q r s t " * 3), (62, None), (63, ""), (64, "k"), (64, "k")]
    out = substring_dedup.remove_repeated(make(rows), window=window, width_bits=width, sketch_bytes=max(size, 300), exact_bytes=size, group_bytes=size, fan=fan)
    assert _runs_of(out) == sorted((i, *x) for (i, _), x in zip(rows, _substring(rows, window), strict=True))


def thue_morse(n):
    """Two strings of n letters that collide under every polynomial hash modulo a power of two (n from 1024)."""
    a = "".join("ab"[i.bit_count() % 2] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 4096])
def test_substring_keeps_windows_with_colliding_words(spark, make, n):
    x, y = thue_morse(n)
    same = " ".join(f"w{i}" for i in range(34))
    rows = [(1, f"{same} {x}"), (2, f"{same} {y}"), (3, f"{y} {same}")]
    assert [r[2] for r in _runs_of(substring_dedup.remove_repeated(make(rows)))] == [0, 0, 0]


def test_sketch_share_does_not_grow_with_the_input():
    """Unique anchors that pass, in a shard of the size that the production parameters give it."""
    rng = np.random.default_rng(1)
    for _ in range(3):
        h = rng.integers(0, 1 << 64, 500_000, dtype=np.uint64)
        assert substring_dedup.estimate(h, np.zeros(len(h), np.uint8), substring_dedup.WIDTH_BITS).mean() < 0.05
    assert substring_dedup.estimate(np.repeat(h[:1000], 2), np.zeros(2000, np.uint8), 22).all()


def test_exchange_rows_grow_with_entries_not_with_senders_times_targets(spark):
    """Twice the blocks and twice the targets: about twice the rows."""
    import pyarrow as pa

    def rows(senders, targets):
        x = exchange.Exchange(["u8", "+u4"], targets, lambda c: c[0] % np.uint64(targets), 8)

        def send(it):
            for batch in it:
                for i in batch.column("id").to_pylist():
                    yield x.cut([np.random.default_rng(i).integers(0, 1 << 60, 1000, dtype=np.uint64), np.arange(1000)])

        first = spark.range(senders, numPartitions=4).mapInArrow(send, exchange.ROWS)
        end = x.deliver(first)
        got = end.groupBy("bucket").applyInArrow(lambda t: pa.table({"n": [len(x.gather(t)[0])], "wrong": [int((x.gather(t)[0] % np.uint64(targets) != t.column("bucket")[0].as_py()).sum())]}), "n bigint, wrong bigint").toPandas()
        assert got["n"].sum() == senders * 1000 and got["wrong"].sum() == 0 and len(got) == targets
        return first.count(), end.count()

    small, large = rows(20, 60), rows(80, 240)
    assert large[0] <= 4 * small[0] * 1.1 and large[1] <= 16 * small[1] / 3


@pytest.mark.parametrize("n", range(41))
def test_windows_of_a_short_text_alone(n):
    found = substring_dedup.Windows([" ".join(f"w{i}" for i in range(n)).encode()], 35)
    assert found.at.tolist() == list(range(max(0, n - 34)))
    assert len(found.anchor) == len(found.at) and set(found.anchor) <= set(found.anchors)


@pytest.mark.parametrize("n", [3, 5, 6, 7])
def test_substring_of_a_short_text_alone(spark, make, n):
    text = " ".join(f"w{i}" for i in range(n))
    out = substring_dedup.remove_repeated(make([(1, text)]), window=35, width_bits=10)
    assert [(r["n_words"], r["spans"], r["kept"]) for r in out.collect()] == [(n, [], text)]


def _cut_lines(lines, window, classes):
    """(first, end) of the chunks of some lines in every class of the rolling hash."""
    import hashlib

    h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
    rolled = [sum((h[q - j] if q >= j else 0) * pow(line_dedup.BASE, j, line_dedup.MODULUS) % line_dedup.MODULUS for j in range(window)) % line_dedup.MODULUS % classes for q in range(len(lines))]
    out = set()
    for one in range(classes):
        start = 0
        for q in range(len(lines)):
            if q == len(lines) - 1 or rolled[q] == one:
                out.add((start, q + 1))
                start = q + 1
    return out


def _lines(rows, window, classes):
    """Chunks of every class, then all but the first place of each repeated chunk removed."""
    texts = [t.split("\n") if t else [] for _, t in rows]
    solid = lambda lines: sum(bool(x.strip(" \t\n\v\f\r")) for x in lines)
    places = defaultdict(set)
    for n, lines in enumerate(texts):
        for a, b in _cut_lines(lines, window, classes):
            if solid(lines[a:b]) >= 2:
                places[tuple(lines[a:b])].add((rows[n][0], n, a, b))
    gone = defaultdict(set)
    for found in places.values():
        for _, n, x, y in sorted(found)[1:]:
            gone[n] |= set(range(x, y))
    return {i: "\n".join(x for q, x in enumerate(texts[n]) if q not in gone[n]) for n, (i, _) in enumerate(rows)}


@pytest.mark.parametrize("window,classes", [(3, 4), (1, 2), (2, 3), (5, 8)])
def test_lines_equal_brute_force(spark, make, window, classes):
    rng = random.Random(classes)
    blocks = ["\n".join(rng.choice(["", f"line {rng.randrange(30)}", f"line {rng.randrange(30)}", " \t"]) for _ in range(rng.randint(2, 6))) for _ in range(6)]
    rows = [(i, "\n".join(rng.choice(blocks) if rng.random() < 0.6 else f"own {i} {k}" for k in range(rng.randint(0, 6)))) for i in range(40)]
    rows += [(40, None), (41, ""), (42, "\n\n"), (43, "single"), (44, "\n\n"), (45, "single")]
    out = line_dedup.remove_repeated(make(rows), window=window, classes=classes)
    assert {r["doc_id"]: r["kept"] for r in out.select("row.doc_id", "kept").collect()} == _lines(rows, window, classes)


def test_no_line_is_lost_from_all_documents():
    rng = random.Random(3)
    rows = [(i, "\n".join(f"l{rng.randrange(12)}" for _ in range(rng.randint(0, 9)))) for i in range(60)]
    kept = {x for t in _lines(rows, 3, 4).values() for x in t.split("\n")}
    assert kept >= {x for _, t in rows for x in t.split("\n")}


def test_chunks_have_several_lines(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("text IS NOT NULL")
    sizes = sorted(r["lines"] for r in line_dedup.chunked(docs).select("lines").collect())
    assert sizes[0] >= 2 and sizes[len(sizes) // 2] >= 3
    rng = random.Random(8)
    cut = [b - a for a, b in _cut_lines([str(rng.random()) for _ in range(4000)], line_dedup.WINDOW, line_dedup.CLASSES)]
    assert 3.8 < sum(cut) / len(cut) < 4.2


@pytest.mark.parametrize("lines,least", [(4, 0.1), (5, 0.3), (6, 0.5), (8, 0.85), (12, 0.98), (20, 1.0)])
def test_recall_of_shared_passages(lines, least):
    """Passages that two texts share, between lines of their own: in how many something goes, and how much of it."""
    rng = random.Random(lines)
    own = lambda: [f"{rng.random()} own" for _ in range(10)]
    rows, shared = [], []
    for k in range(500):
        shared.append([f"{k} {j} {rng.random()}" for j in range(lines)])
        rows += [(2 * k + j, "\n".join(own() + shared[-1] + own())) for j in (0, 1)]
    kept = _lines(rows, line_dedup.WINDOW, line_dedup.CLASSES)
    left = [len(set(shared[k]) & set(kept[2 * k + 1].split("\n"))) for k in range(500)]
    found, gone = sum(n < lines for n in left) / 500, 1 - sum(left) / 500 / lines
    print(f"{lines} lines: {100 * found:.1f} % of the passages, {100 * gone:.1f} % of their lines")
    assert found >= least
    assert all(set(shared[k]) <= set(kept[2 * k].split("\n")) for k in range(500))


def test_line_plan_has_no_python(spark, sf):
    from corpusloom.llm import license_scan

    for f in (line_dedup.op10_line_dedup, license_scan.op7_license_scan):
        plan = f(spark, sf)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
