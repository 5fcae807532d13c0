"""Threshold similarity join of names by prefix, length and position filters.

A name is the multiset of its lower-cased words; numbering equal words makes it
a set of elements, so multiset Jaccard becomes set Jaccard.  Two sets reach the
threshold t only if

* their sizes differ by no more than the factor t (length),
* they share one of their first ``size - ceil(t * size) + 1`` elements in any
  common order (prefix); with rare elements first, frequent words hardly ever
  bring two names together, and
* what follows the shared element leaves room for enough of them (position).

Names of equal words are one class, so copies meet once; pairs that pass are
checked on the whole sets.  An element of many classes is dealt to a task for
every ``TOGETHER`` of them.

Null and blank names have no elements and join nothing; repeated rows of one id
and name are one; ties go to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Classes of one element that a task takes together.
TOGETHER = 10_000


def elements(name):
    """Sorted elements of a name: each word with its turn among equal words."""
    words = F.array_sort(F.filter(F.split(F.lower(F.replace(F.coalesce(name, F.lit("")), F.lit("-"), F.lit(" "))), r"\s+", -1), lambda x: x != ""))
    # In the sorted array the turn of a word is its distance to the first of its kind.
    return F.transform(words, lambda w, i: F.concat_ws(" ", w, (i + 2 - F.array_position(words, w)).cast("string")))


def classes(rows: DataFrame, id: str) -> tuple[DataFrame, DataFrame]:
    """(class, set) of distinct names, and (id, class) of the rows."""
    each = rows.select(F.col(id).alias("id"), elements(F.col("name")).alias("set")).where(F.size("set") > 0)
    named = each.withColumn("class", F.sha2(F.array_join("set", "\n"), 256))
    return named.groupBy("class").agg(F.min("set").alias("set")), named.select("id", "class").distinct()


def _needed(size, t: float):
    return F.ceil(size * t - 1e-9)


def _by_rarity(sets: DataFrame, seen: DataFrame) -> DataFrame:
    """(class, set, size) with the rarest elements first."""
    each = sets.select("class", F.explode("set").alias("e")).join(seen, "e", "left").select("class", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "e").alias("x"))
    return each.groupBy("class").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["e"]).alias("set")).withColumn("size", F.size("set"))


def _prefix(sets: DataFrame, t: float) -> DataFrame:
    """(class, size, e, rest): first elements, and how many stand from each on."""
    first = F.slice("set", F.lit(1), (F.col("size") - _needed(F.col("size"), t) + 1).cast("int"))
    return sets.select("class", "size", F.posexplode(first).alias("pos", "e")).select("class", "size", "e", (F.col("size") - F.col("pos")).alias("rest"))


def candidates(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(a, b): pairs of classes that pass the filters; ``left`` and ``right`` as :func:`_by_rarity` gives them."""
    a, b = _prefix(left, threshold), _prefix(right, threshold)
    parts = b.groupBy("e").agg(F.ceil(F.count(F.lit(1)) / F.lit(TOGETHER)).cast("int").alias("parts"))
    a = a.join(parts, "e").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))  # elements of both sides only
    b = b.join(parts, "e").withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
    a = a.select(F.col("class").alias("a"), F.col("size").alias("size_a"), F.col("rest").alias("rest_a"), "e", "part")
    b = b.select(F.col("class").alias("b"), F.col("size").alias("size_b"), F.col("rest").alias("rest_b"), "e", "part")
    shared = _needed(F.col("size_a") + F.col("size_b"), threshold / (1 + threshold))
    near = (F.col("size_b") >= _needed(F.col("size_a"), threshold)) & (F.col("size_a") >= _needed(F.col("size_b"), threshold))
    return a.join(b, ["e", "part"]).where(near & (F.least("rest_a", "rest_b") >= shared)).select("a", "b").distinct()


def join(catalog: DataFrame, mentions: DataFrame, threshold: float = 0.55, k: int = 20) -> DataFrame:
    """(mention_id, id, score, rank): the first ``k`` catalogue rows (id, name) of each mention (mention_id, name) whose similarity reaches the threshold."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    sets_b, members_b = classes(catalog, "id")
    sets_a, members_a = classes(mentions, "mention_id")
    seen = sets_b.select(F.explode("set").alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("n"))
    left, right = _by_rarity(sets_a, seen), _by_rarity(sets_b, seen)
    pairs = candidates(left, right, threshold)
    full = pairs.join(left.select(F.col("class").alias("a"), F.col("set").alias("x")), "a").join(right.select(F.col("class").alias("b"), F.col("set").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    scored = full.select("a", "b", (both / (F.size("x") + F.size("y") - both)).alias("score")).where(F.col("score") >= threshold - 1e-12)
    # Of a class's rows only the first k by id can be among the k best of a mention.
    nth = F.row_number().over(Window.partitionBy("class").orderBy("id"))
    some = members_b.withColumn("nth", nth).where(F.col("nth") <= k).select(F.col("class").alias("b"), "id")
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "id"))
    best = scored.join(some, "b").withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(members_a.select(F.col("class").alias("a"), F.col("id").alias("mention_id")), "a").select("mention_id", "id", "score", "rank")
