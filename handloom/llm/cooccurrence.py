"""How often two items share a basket, and how much more often than chance.

Items are made distinct per basket, ordered pairs (a < b) are emitted and counted with a map-side combine, and lift and
pointwise mutual information follow from the marginals. A basket of more than ``BLOCK`` distinct items is cut into
blocks; each pair of blocks is a task of its own, so that no basket's pairs come out of one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from handloom.runtime import materialise, quoted

#: Distinct items of a basket that are paired in one place: 130,000 pairs, twice that between two blocks.
BLOCK = 512


def distinct_items(rows: DataFrame, basket: str, item: str) -> DataFrame:
    """``(basket, item)`` once each; rows with a null basket or item are left out."""
    return (
        rows.select(quoted(basket).alias("basket"), quoted(item).alias("item"))
        .filter("basket is not null and item is not null")
        .distinct()
    )


def _within(items):
    return F.flatten(
        F.transform(items, lambda a, i: F.transform(F.slice(items, i + 2, F.size(items)), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    )


def _across(left, right):
    return F.flatten(
        F.transform(left, lambda a: F.transform(right, lambda b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))))
    )


def pair_counts(items: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(a, b, n)``: baskets with both items, a < b, of distinct ``(basket, item)``. ``items`` is read twice."""
    large = materialise(items.groupBy("basket").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > block), "large")
    if large.isEmpty():
        usual, pairs = items, None
    else:
        usual = items.join(large, "basket", "left_anti")
        cut = items.join(large, "basket").withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
        cut = cut.withColumn("own", F.pmod(F.xxhash64("item"), "blocks").cast("int"))
        cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        tile = cut.groupBy("basket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(
            F.array_sort(F.collect_list(F.when(F.col("own") == F.least("own", "other"), F.col("item")))).alias("low"),
            F.array_sort(F.collect_list(F.when(F.col("own") != F.least("own", "other"), F.col("item")))).alias("high"),
        )
        pairs = tile.select(
            F.explode(F.when(F.col("i") == F.col("j"), _within(F.col("low"))).otherwise(_across(F.col("low"), F.col("high")))).alias("p")
        )
    lists = usual.groupBy("basket").agg(F.array_sort(F.collect_list("item")).alias("items")).filter(F.size("items") > 1)
    found = lists.select(F.explode(_within(F.col("items"))).alias("p"))
    if pairs is not None:
        found = found.unionByName(pairs)
    return found.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def together(rows: DataFrame, basket: str, item: str, least: int = 1) -> DataFrame:
    """``(a, b, n, n_a, n_b, whole, lift, pmi)`` for every pair of items that shares at least ``least`` baskets.

    ``whole`` is the number of baskets that ``rows`` names, also those without an item. Items in fewer than ``least``
    baskets cannot be in such a pair, so they are not paired.

    * null baskets: left out; null items: left out, their basket still counts in ``whole``;
    * an item repeated in a basket: once; baskets of one item: no pair; empty input: no row;
    * further columns, whatever their names, are ignored.
    """
    items = materialise(distinct_items(rows, basket, item), "items")
    whole = rows.select(quoted(basket).alias("basket")).filter("basket is not null").distinct().count()
    marginal = items.groupBy("item").agg(F.count(F.lit(1)).alias("m"))
    if least > 1:
        marginal = materialise(marginal.filter(F.col("m") >= least), "marginal")
        items = items.join(marginal.select("item"), "item", "left_semi")
    return _scored(pair_counts(items).filter(F.col("n") >= least), marginal, whole)


def joined_by(links: DataFrame, group: str, src: str, dst: str, weight: str) -> DataFrame:
    """The same of weighted links: n sums ``weight`` over both directions, n_a over all partners of a.

    A pair counts against chance as if both ends were drawn by their share of link ends, so lift is n * 2 whole / (n_a n_b).

    * links with a null end, null weight or equal ends: left out; (group, src, dst) delivered again: once, with the
      greatest weight; a null group is a group; empty input: no row.
    """
    once = (
        links.select(*(quoted(c).alias(a) for c, a in ((group, "g"), (src, "s"), (dst, "d"), (weight, "w"))))
        .filter("s is not null and d is not null and w is not null and s <> d")
        .groupBy("g", "s", "d")
        .agg(F.max("w").alias("w"))
    )
    pairs = materialise(
        once.groupBy(F.least("s", "d").alias("a"), F.greatest("s", "d").alias("b")).agg(F.sum("w").alias("n")), "pairs"
    )
    ends = pairs.select(F.explode(F.array("a", "b")).alias("item"), "n").groupBy("item").agg(F.sum("n").alias("m"))
    whole = pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return _scored(pairs, ends, whole, 2)


def _scored(pairs: DataFrame, marginal: DataFrame, whole: int, factor: int = 1) -> DataFrame:
    a = marginal.select(F.col("item").alias("a"), F.col("m").alias("n_a"))
    b = marginal.select(F.col("item").alias("b"), F.col("m").alias("n_b"))
    lift = F.col("n").cast("double") * F.lit(factor * whole).cast("double") / (F.col("n_a").cast("double") * F.col("n_b"))
    return (
        pairs.join(a, "a")
        .join(b, "b")
        .select("a", "b", "n", "n_a", "n_b", F.lit(whole).cast("bigint").alias("whole"), lift.alias("lift"), F.log2(lift).alias("pmi"))
    )
