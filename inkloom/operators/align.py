"""Alignment of two ordered catalogs by once-only titles and ordered neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ANCHOR, FILLED = "unique-title+ordered-neighbor", "title-sequence+two-anchors"


def align(canonical: DataFrame, candidate: DataFrame, by: list[str], within: list[str]) -> DataFrame:
    """Map candidate rows to canonical numbers.

    ``canonical`` has ``by``, ``n`` and ``k`` (number and key); ``candidate``
    has ``by``, ``within``, ``pos`` (0-based order in its catalog) and ``k``.
    Catalogs are the groups of ``by + within``. A row whose key occurs once on
    both sides is an anchor if an anchor stands beside it, all anchors beside
    it keep the order, and one is at most two numbers away; between two kept
    anchors of equal distance, an exactly equal sequence of keys is filled in.
    Null keys never match. Returns ``by, within, pos, k, n, proof``, mapped rows only.

    All windows are partitioned by catalog, so one catalog is one task's sort.
    """
    group = [*by, *within]
    once = canonical.filter("k is not null").groupBy(*by, "k").agg(F.min("n").alias("n"), F.count("*").alias("c")).filter("c = 1").drop("c")
    order = Window.partitionBy(*group).orderBy("pos")
    same = Window.partitionBy(*group, "k")
    single = candidate.withColumn("c", F.count("*").over(same)).join(once, [*by, "k"], "left")
    anchor = single.withColumn("a", F.when((F.col("c") == 1) & F.col("k").isNotNull(), F.col("n"))).select(*group, "pos", "k", "a")
    left, right = F.lag("a").over(order), F.lead("a").over(order)
    near = F.coalesce(F.abs(left - F.col("a")) <= 2, F.lit(False)) | F.coalesce(F.abs(right - F.col("a")) <= 2, F.lit(False))
    ordered = F.coalesce(left < F.col("a"), F.lit(True)) & F.coalesce(right > F.col("a"), F.lit(True))
    kept = anchor.withColumn("kept", F.when(near & ordered, F.col("a")))
    before = order.rowsBetween(Window.unboundedPreceding, 0)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col("kept").isNotNull(), F.col("pos"))
    between = (
        kept.withColumn("lp", F.last(at, ignorenulls=True).over(before))
        .withColumn("ln", F.last("kept", ignorenulls=True).over(before))
        .withColumn("rp", F.first(at, ignorenulls=True).over(after))
        .withColumn("rn", F.first("kept", ignorenulls=True).over(after))
        .withColumn("want", F.col("ln") + F.col("pos") - F.col("lp"))
    )
    known = canonical.groupBy(*by, F.col("n").alias("want")).agg(F.min("k").alias("ck"))
    gap = Window.partitionBy(*group, "lp", "rp")
    tested = between.join(known, [*by, "want"], "left").withColumn(
        "equal", F.min(F.coalesce(F.col("ck") == F.col("k"), F.lit(False))).over(gap)
    )
    distance = F.col("rp") - F.col("lp")
    filled = (distance == F.col("rn") - F.col("ln")) & (distance >= 2) & F.col("equal")
    number: Column = F.when(F.col("kept").isNotNull(), F.col("kept")).when(filled, F.col("want"))
    return (
        tested.withColumn("n", number)
        .withColumn("proof", F.when(F.col("kept").isNotNull(), ANCHOR).otherwise(FILLED))
        .filter("n is not null")
        .select(*group, "pos", "k", "n", "proof")
    )
