"""Problem 2: lines that a site sets into very many of its documents.

Each line's documents are a compressed bitmap per source: words of 64 chapter
numbers per book, of which only those that aren't zero are stored. Variants of
a line (other numbers, spacing, case, width, ornaments, own names) share a key,
so the aggregation's bit-wise or is the union of their bitmaps; cardinalities
are exact, and a line is deleted where the bitmap of its key has its chapter.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.llm.chapters import chapter_sites, line_keys
from inkloom.session import cut, few

#: A site's line is excessive in this many chapters and books and this share of its chapters.
CHAPTERS, BOOKS, SHARE = 3, 2, 1 / 30
#: Lines whose rates are spread over the sites with at least this much of the largest entropy are stock of the texts, no site's own.
EVEN = 0.8


def site_lines(spark: SparkSession, sf_dir: str, styles: bool = False) -> DataFrame:
    """``site, book_id, number`` and `line_keys`, one row per chapter with valid lines; cut from its lineage.

    Of rows that differ under one key, the one with the smallest keys stays.
    """
    keys = line_keys(spark, sf_dir, styles)
    sites = chapter_sites(spark, sf_dir)
    values = [c for c in keys.columns if c not in ("book_id", "number")]
    once = keys.groupBy("book_id", "number").agg(F.min(F.struct(*values)).alias("v")).select("book_id", "number", "v.*")
    return cut(once.join(sites, ["book_id", "number"]))


def spread(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """``key, lines, evenness``: entropy of a key's rates over the sites, as a share of the largest possible.

    ``counts`` has ``site, key, n``; ``totals`` has ``site, total``. 1 is the
    same rate at every site, 0 is one site only; with a single site it is 0.
    """
    sites = totals.count()
    rates = counts.join(few(totals), "site").withColumn("rate", F.col("n") / F.col("total"))
    spread_ = F.log("all_rates") - F.col("weighed") / F.col("all_rates")
    return (
        rates.groupBy("key")
        .agg(
            F.sum("n").alias("lines"),
            F.sum("rate").alias("all_rates"),
            F.sum(F.col("rate") * F.log("rate")).alias("weighed"),
        )
        .select("key", "lines", (spread_ / math.log(sites) if sites > 1 else F.lit(0.0)).alias("evenness"))
    )


def bitmaps(lines: DataFrame) -> DataFrame:
    """``site, key, book_id, word, bits`` of lines with ``site, key, book_id, number``."""
    return lines.groupBy("site", "key", "book_id", F.shiftright("number", 6).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(number & 63 as int)))").alias("bits")
    )


def excessive(
    pages: DataFrame, chapters: int = CHAPTERS, books: int = BOOKS, share: float = SHARE, even: float = EVEN
) -> DataFrame:
    """``book_id, number, para, key`` of every line that its site repeats excessively.

    ``pages`` has ``site, book_id, number, keys`` with one row per document and
    should be cheap to read, as it is read several times. Null keys count as no line.
    """
    totals = cut(pages.groupBy("site").agg(F.count("*").alias("total")))
    lines = pages.select("site", "book_id", "number", F.posexplode("keys").alias("at", "key"))
    counts = lines.groupBy("site", "key").agg(F.count("*").alias("n"))
    frequent = cut(
        counts.join(few(totals), "site").filter((F.col("n") >= chapters) & (F.col("n") >= F.col("total") * share))
        .select("site", "key")
    )
    # The rates of the frequent keys at all sites, to tell a site's own line from stock phrases.
    keys = few(cut(frequent.select("key").distinct()))
    own = spread(counts.join(keys, "key", "left_semi"), totals).filter(F.col("evenness") < even)
    found = cut(frequent.join(own.select("key"), "key", "left_semi"))
    bits = cut(bitmaps(lines.join(few(found), ["site", "key"], "left_semi")))
    kept = (
        bits.groupBy("site", "key", "book_id")
        .agg(F.sum(F.bit_count("bits")).alias("chapters"))
        .groupBy("site", "key")
        .agg(F.sum("chapters").alias("chapters"), F.count("*").alias("books"))
        .join(few(totals), "site")
        .filter(
            (F.col("chapters") >= chapters)
            & (F.col("books") >= books)
            & (F.col("chapters") >= F.col("total") * share)
        )
        .select("site", "key")
    )
    hit = bits.join(kept, ["site", "key"], "left_semi")
    return (
        # Lines whose key is excessive nowhere leave before the bitmaps are looked up.
        lines.join(few(found), ["site", "key"], "left_semi")
        .withColumn("word", F.shiftright("number", 6))
        .join(hit, ["site", "key", "book_id", "word"])
        .filter("shiftright(bits, cast(number & 63 as int)) & 1 = 1")
        .select("book_id", "number", (F.col("at") + 1).cast("long").alias("para"), "key")
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``book_id, number, para`` of every line that its site repeats excessively."""
    return excessive(site_lines(spark, sf_dir).filter("site != ''")).drop("key")
