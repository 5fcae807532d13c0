"""The threshold join against all pairs, and how many pairs it forms."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import search, similarity


def _jaccard(a, b):
    x, y = (Counter((n or "").lower().replace("-", " ").split()) for n in (a, b))
    both = sum((x & y).values())
    return both / (sum(x.values()) + sum(y.values()) - both) if both else 0.0


def _names(rng, n):
    words = ["inc", "group", "data", *[f"w{i}" for i in range(60)]]
    return [" ".join(rng.choice(words[: rng.choice([5, 63])]) for _ in range(rng.randint(1, 6))) for _ in range(n)]


@pytest.mark.parametrize("threshold", [0.3, 0.55, 0.8, 1.0])
def test_join_equals_all_pairs(spark, threshold):
    rng = random.Random(int(threshold * 100))
    catalog = [(i, n) for i, n in enumerate([*_names(rng, 150), None, " ", "Inc-Inc inc", "inc inc inc", *["the same name"] * 30])]
    mentions = [(1000 + i, n) for i, n in enumerate([*_names(rng, 40), "INC inc-inc", "same the name", None, ""])] + [(2000, "x"), (2000, "x")]
    got = similarity.join(spark.createDataFrame(catalog, "id int, name string"), spark.createDataFrame(mentions, "mention_id int, name string"), threshold, 7)
    want = set()
    for m, name in set(mentions):
        best = sorted((-s, i) for i, n in catalog if (s := _jaccard(name, n)) >= threshold - 1e-12)
        want |= {(m, i, round(-s, 9), r) for r, (s, i) in enumerate(best[:7], 1)}
    assert {(r["mention_id"], r["id"], round(r["score"], 9), r["rank"]) for r in got.collect()} == want and want


def test_far_fewer_pairs_and_the_same_winners(spark):
    rng = random.Random(5)
    words = ["inc", "group"] + [f"w{i}" for i in range(400)]
    names = [f"{rng.choice(words[:2])} {rng.choice(words)} {rng.choice(words)} {rng.choice(words)}" for _ in range(400)]
    p = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    m = p.where("id % 4 = 0").withColumnRenamed("id", "mention_id")
    sets_a, sets_b = similarity.classes(m, "mention_id")[0], similarity.classes(p, "id")[0]
    seen = sets_b.select(F.explode("set").alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("n"))
    formed = similarity.candidates(similarity._by_rarity(sets_a, seen), similarity._by_rarity(sets_b, seen), 0.55).count()
    sharing = sum(bool(set(a.split()) & set(b.split())) for i, a in enumerate(names) if i % 4 == 0 for b in names)
    assert formed * 20 < sharing
    new = {(r["mention_id"], r["winner"]) for r in search.best_or_none(similarity.join(p, m)).where("winner IS NOT NULL").collect()}
    old = {(r["mention_id"], r["winner"]) for r in search.best_or_none(search.multiset_jaccard(p, m)).where("winner IS NOT NULL").collect()}
    assert new == old and new


def test_threshold_is_checked(spark):
    p = spark.createDataFrame([], "id int, name string")
    with pytest.raises(ValueError):
        similarity.join(p, p.withColumnRenamed("id", "mention_id"), 0.0)
    assert similarity.join(p, p.withColumnRenamed("id", "mention_id")).count() == 0


def test_candidates_of_copies(spark):
    """Copies on both sides meet once as classes; rows, ties and repeated ids as by all pairs."""
    rng = random.Random(8)
    names = _names(rng, 40)
    catalog = [(i, names[i * i % 40] if i % 3 else "the same-name") for i in range(300)] + [(5, "again the"), (900, None), (901, " - ")]
    mentions = [(1000 + i, n) for i, n in enumerate([*names[:25], *["Same the name"] * 60, None, ""])] + [(1003, "and more")]
    frames = spark.createDataFrame(catalog, "id int, name string"), spark.createDataFrame(mentions, "mention_id int, name string")
    of = lambda rows: {i: " ".join(n or "" for j, n in rows if j == i) for i, _ in rows}
    want, classes = set(), [{tuple(sorted(n.lower().replace("-", " ").split())) for n in of(rows).values()} - {()} for rows in (mentions, catalog)]
    for m, name in of(mentions).items():
        best = sorted((-s, i) for i, n in of(catalog).items() if (s := _jaccard(name, n)) > 0)
        want |= {(m, i, round(-s, 9), r) for r, (s, i) in enumerate(best[:7], 1)}
    got = search.multiset_jaccard(*frames, 7).collect()
    assert {(r["mention_id"], r["id"], round(r["score"], 9), r["rank"]) for r in got} == want and len(got) == len(want)
    formed = search.class_scores(search._classes(frames[1], "mention_id")[0], search._classes(frames[0], "id")[0]).count()
    assert formed == sum(bool(set(x) & set(y)) for x in classes[0] for y in classes[1])
