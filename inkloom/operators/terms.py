"""Registries of terms and of pinned catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged(proposals: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The registry that proposals, taken in ``order``, leave behind (V6).

    Proposals have ``by + source``, ``translation``, ``kind`` and
    ``approved``. A term of one character is only ever ``preferred``; an entity
    that wasn't approved is a ``candidate``. The first proposal of a term stays,
    but a candidate gives way to the first approved proposal behind it, once.
    """
    kind = F.when(F.length("source") == 1, "preferred").when(~F.col("approved") & (F.col("kind") == "entity"), "candidate").otherwise(F.col("kind"))
    key = [*by, "source"]
    at = Window.partitionBy(*key).orderBy(*order)
    ranked = proposals.withColumn("kind", kind).withColumn("r", F.row_number().over(at))
    first = F.first("kind").over(at.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    # Behind a candidate, approved proposals replace it until one isn't a candidate any more.
    replaces = (first == "candidate") & (F.col("r") > 1) & F.col("approved")
    chosen = F.when(replaces, F.struct(F.lit(0).alias("p"), F.col("r"))).when(F.col("r") == 1, F.struct(F.lit(1).alias("p"), F.col("r")))
    best = F.min("c").over(Window.partitionBy(*key))
    return ranked.withColumn("c", chosen).withColumn("b", best).filter(F.col("c") == F.col("b")).drop("c", "b", "r", "approved")


def differs(found: DataFrame, pinned: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Catalogs (``by``) whose rows, by ``pos``, aren't exactly the pinned ones."""
    left = found.select(*by, "pos", F.struct(*columns).alias("found"))
    right = pinned.select(*by, "pos", F.struct(*columns).alias("pinned"))
    same = F.coalesce(F.col("found").eqNullSafe(F.col("pinned")), F.lit(False))
    return left.join(right, [*by, "pos"], "full").groupBy(*by).agg(F.bool_and(same).alias("same")).filter("not same").select(*by)
