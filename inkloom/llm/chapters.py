"""Chapters as pages: valid lines, sites, masked line keys. Shared by several problems."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.session import small, spread

#: Full-width ASCII and the ideographic space with their narrow forms.
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
NARROW = "".join(map(chr, range(0x21, 0x7F))) + " "

NUMERAL = "[0-9零〇一二三四五六七八九十百千万两]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines_of(source: Column) -> Column:
    """The paragraphs of a JSON array of strings; null where the value isn't valid JSON."""
    whole = F.trim(source).startswith("[") & F.trim(source).endswith("]")
    return F.when(whole, F.from_json(source, "array<string>", {"allowSingleQuotes": "false"}))


def paragraphs(source: str | None) -> list[str] | None:
    """The same in Python."""
    try:
        value = json.loads(source) if source else None
    except ValueError:
        return None
    return [x if isinstance(x, str) else "" if x is None else json.dumps(x, ensure_ascii=False) for x in value] if isinstance(value, list) else None


def lowered(text: Column) -> Column:
    """A text in lower case and narrow forms."""
    return F.lower(F.translate(text, WIDE, NARROW))


def masked(text: Column) -> Column:
    """What stays of a line without case, width, spacing, punctuation, ornaments, numbers and dates."""
    return bare(lowered(text))


def bare(text: Column) -> Column:
    """`masked` of a text that is `lowered`."""
    letters = F.regexp_replace(text, r"[^\p{L}\p{N}\p{M}]+", "")
    return F.regexp_replace(F.regexp_replace(letters, NUMERAL, "0"), "0年0月0日?", "0")


def style(text: Column) -> Column:
    """The presentation of a line that is `lowered`: its marks as they are, each run of Han signs as 中, of other letters as a, of digits as 0."""
    # Han signs first: what is left is short.
    short = F.regexp_replace(F.regexp_replace(text, r"\p{IsHan}+", "中"), r"[\p{L}\p{M}&&[^\p{IsHan}]]+", "a")
    return F.regexp_replace(F.regexp_replace(short, "[0-9]+", "0"), r"[\s\p{Z}\p{Cf}]+", " ")


def marks(style_: Column) -> Column:
    """What styles of one kind share: the set of their signs, and the last one."""
    return F.concat(F.array_join(F.array_sort(F.array_distinct(F.split(style_, ""))), ""), F.lit("/"), F.right(style_, F.lit(1)))


def chapter_name(title: Column) -> Column:
    """The masked name of a chapter title without its number."""
    return F.regexp_replace(masked(title), "^(正文)?(第?0[章节回话卷]?)+", "")


def host_of(url: Column) -> Column:
    return F.regexp_replace(
        F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/:?#]+)", 1)), r"^(www|wap|m)\.", ""
    )


def chapter_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``book_id, number, site``: source of the accepted candidate, else of the host in ``chapters.url``.

    One row per chapter; a chapter without either has the site ``''``.
    """
    chapters = table(spark, sf_dir, "chapters").groupBy("book_id", "number").agg(F.min("url").alias("url"))
    accepted = (
        table(spark, sf_dir, "source_candidates")
        .filter("state = 'accepted' and canonical_number is not null")
        .groupBy("book_id", F.col("canonical_number").alias("number"))
        .agg(F.min("source_id").alias("accepted"))
    )
    hosts = table(spark, sf_dir, "sources").groupBy(host_of(F.col("source_url")).alias("host")).agg(
        F.min("id").alias("hosted")
    )
    return (
        chapters.withColumn("host", host_of(F.col("url")))
        .join(small(hosts), "host", "left")
        .join(accepted, ["book_id", "number"], "left")
        .select("book_id", "number", F.coalesce("accepted", "hosted", F.lit("")).alias("site"))
    )


def line_keys(spark: SparkSession, sf_dir: str, styles: bool = False) -> DataFrame:
    """``book_id, number, keys``: the hash of each line's masked form, by paragraph.

    With ``styles`` also ``styles`` and ``kinds``, the hashes of each line's
    style and of its marks; null for lines with lost signs, which have no
    style of their own. The names of the book and of the chapter at hand are masked too. Rows
    delivered twice may occur twice. Lines without letters have the key of ''.
    """
    books = table(spark, sf_dir, "books").groupBy("id").agg(F.min("title").alias("book_title"))
    chapters = spread(table(spark, sf_dir, "chapters").select("book_id", "number", "title", "source"))
    named = chapters.join(small(books), chapters["book_id"] == books["id"], "left").select(
        "book_id",
        "number",
        lines_of(F.col("source")).alias("lines"),
        masked(F.coalesce("book_title", F.lit(""))).alias("book_name"),
        chapter_name(F.coalesce("title", F.lit(""))).alias("name"),
    )

    def key(text: Column) -> Column:
        text = F.replace(text, F.when(F.length("book_name") > 1, F.col("book_name")).otherwise(""), F.lit("Ⓑ"))
        text = F.replace(text, F.when(F.length("name") > 1, F.col("name")).otherwise(""), F.lit("Ⓒ"))
        return F.xxhash64(text)

    valid = named.filter("lines is not null").withColumn("lines", F.transform("lines", lambda x: F.coalesce(x, F.lit(""))))
    if not styles:
        return valid.select("book_id", "number", F.transform("lines", lambda x: key(masked(x))).alias("keys"))
    # Step by step over the array, so that a line is lowered, and its style found, once.
    low = F.transform("lines", lowered)
    shown = F.transform(low, lambda x: F.struct(x.alias("low"), F.when(~F.contains(x, F.lit("�")), style(x)).alias("style")))

    def hashes(x: Column) -> Column:
        shape = x["style"]
        return F.struct(
            key(bare(x["low"])).alias("key"),
            F.when(shape.isNotNull(), F.xxhash64(shape)).alias("style"),
            F.when(shape.isNotNull(), F.xxhash64(marks(shape))).alias("kind"),
        )

    found = valid.select("book_id", "number", F.transform(shown, hashes).alias("x"))
    return found.select("book_id", "number", F.col("x.key").alias("keys"), F.col("x.style").alias("styles"), F.col("x.kind").alias("kinds"))
