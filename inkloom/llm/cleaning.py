"""Second results of problems 1, 2 and 6: the chapters without what was found.

Paragraphs are taken out by their number. A chapter that loses none keeps its
``source`` letter by letter, also where that is null or no valid JSON.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.llm.chapters import lines_of, table
from inkloom.llm.mainbody import page_lines
from inkloom.llm.repeats import p2_found
from inkloom.llm.residue import p1_found


def once(chapters: DataFrame) -> DataFrame:
    """Chapters without repeated rows; rows without a whole key are the same only if their texts are."""
    text = F.when(F.col("book_id").isNull() | F.col("number").isNull(), F.xxhash64("title", "source"))
    return chapters.withColumn("text", text).dropDuplicates(["book_id", "number", "text"]).drop("text")


def without(chapters: DataFrame, found: DataFrame) -> DataFrame:
    """``book_id, number, source, removed`` of every chapter once, without the paragraphs of ``found`` (``book_id, number, para``)."""
    paras = found.groupBy("book_id", "number").agg(F.collect_set("para").alias("paras"))
    left = F.filter(lines_of(F.col("source")), lambda _, k: ~F.array_contains("paras", (k + 1).cast("long")))
    return (
        once(chapters.select("book_id", "number", "title", "source").join(paras, ["book_id", "number"], "left"))
        .withColumn("source", F.when(F.col("paras").isNull(), F.col("source")).otherwise(F.to_json(left)))
        .select("book_id", "number", "source", F.coalesce(F.size("paras"), F.lit(0)).cast("long").alias("removed"))
    )


def p1_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``book_id, number, title, source`` of every chapter without residue, once."""
    chapters = table(spark, sf_dir, "chapters").select("book_id", "number", "title", "source").alias("c")
    found = p1_found(spark, sf_dir).alias("f")
    same = F.col("c.book_id").eqNullSafe(F.col("f.book_id")) & F.col("c.number").eqNullSafe(F.col("f.number"))
    return once(chapters.join(found, same, "left_anti"))


def p2_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``book_id, number, source, removed``: every chapter without the lines that its site repeats excessively."""
    return without(table(spark, sf_dir, "chapters"), p2_found(spark, sf_dir))


def p6_story(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``book_id, number, source, removed``: every chapter without its page lines."""
    return without(table(spark, sf_dir, "chapters"), page_lines(spark, sf_dir))
