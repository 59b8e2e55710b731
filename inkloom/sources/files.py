"""Readers and sinks for the project's files."""

from __future__ import annotations

import json
import re
import tomllib
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkloom.operators.reading import response

CHAPTERS = "book_id string, number long, url string, title string, source string, source_hash string, translated string, edited string, summary string, state string, error string"
CALLS = "id long, book_id string, chapter long, stage string, provider string, model string, created double, day string, reserved long, usage long, status string, response string, prompt_hash string, error string, retry_at double, failure_kind string, style_revision string"
MANIFEST = "original_title string, author string, source_url string, chapters array<struct<number:long,source_title:string,original_title:string,url:string,word_count:long>>"
#: Defaults of columns that later versions of a table added.
ADDED = {"style_revision": "legacy", "kind": "entity", "retry_at": 0.0, "failure_kind": None, "error": None}


SLUG = re.compile(r"[a-z0-9][a-z0-9-]{0,79}")
#: Ways to number a catalog, of books and of sources, and ways to read a page (fixed values).
NUMBERING, SOURCE_NUMBERING, ADAPTERS = ("numbered", "ordered"), ("numbered", "ordered", "jjwxc"), ("css", "piaotia")
#: Limits that zero switches off (fixed values).
UNLIMITED = frozenset(("calls_per_day", "calls_total", "reserved_tokens_per_day", "reserved_tokens_total"))
#: Where a book names one site only, the keys that make its source.
OWN = ("source_url", "toc_selector", "content_selector", "encoding", "toc_mode")


def _slugs(items: list[dict]) -> bool:
    ids = [str(x.get("id", "")) for x in items]
    return all(map(SLUG.fullmatch, ids)) and len(set(ids)) == len(ids)


def _edition(book: dict, folder: Path) -> dict | None:
    """A book's pinned manifest; None without one or if it isn't whole or of another edition."""
    if not book.get("reference_manifest"):
        return None
    value = json.loads((folder / book["reference_manifest"]).read_text("utf-8"))
    chapters = value["chapters"]
    same = all(value.get(k) == book.get(k) for k in ("original_title", "author", "source_url"))
    numbered = [c["number"] for c in chapters] == list(range(1, book["expected_chapters"] + 1))
    counted = all(type(c["word_count"]) is int and c["word_count"] > 0 for c in chapters)
    return value if same and numbered and counted and len({c["url"] for c in chapters}) == len(chapters) else None


def _book_checks(book: dict, pinned: dict | None) -> dict[str, bool]:
    terms = book.get("contextual_terms", [])
    return {
        "expected_chapters": type(book.get("expected_chapters")) is int and book["expected_chapters"] > 0,
        "contextual_terms": isinstance(terms, list) and all(isinstance(t, str) and t for t in terms),
        "flags": all(type(book.get(f, False)) is bool for f in ("literal_titles", "allow_missing_chapters")),
        "toc_mode": book.get("toc_mode", "numbered") in NUMBERING,
        "reference_manifest": pinned is not None or not book.get("reference_manifest"),
        "ordered": pinned is not None or book.get("toc_mode") != "ordered",
        "sources": _slugs(book["sources"]),
    }


def _source_checks(source: dict, pinned: dict | None) -> dict[str, bool]:
    adapter = source.get("adapter", "css")
    return {
        "required": all(isinstance(source.get(k), str) and source[k] for k in ("source_url", "toc_selector", "encoding")),
        "toc_mode": source.get("toc_mode", "numbered") in SOURCE_NUMBERING,
        "adapter": adapter in ADAPTERS,
        "content_selector": adapter != "css" or bool(source.get("content_selector")),
        "reference_titles": pinned is not None or not source.get("reference_titles"),
    }


def config(path: str) -> dict:
    """A configuration file whose books, sources and limits were checked (S5); all faults are told at once.

    Books and sources get their defaults: a book without sources is its own
    only one. Settings of programs and deliveries aren't looked at.
    """
    folder = Path(path).resolve().parent
    with open(path, "rb") as file:
        value = tomllib.load(file)
    books, faults = value.get("books", []), []
    if not _slugs(books):
        faults.append("books: ids")
    for book in books:
        if not book.get("sources"):
            book["sources"] = [{"id": "primary"} | {k: book[k] for k in OWN if k in book}] if "source_url" in book else []
        whole = type(book.get("expected_chapters")) is int
        pinned = _edition(book, folder) if whole else None
        faults += [f"{book.get('id')}: {name}" for name, good in _book_checks(book, pinned).items() if not good]
        for source in book["sources"]:
            source.setdefault("literal_titles", book.get("literal_titles", False))
            faults += [f"{book.get('id')}/{source.get('id')}: {name}" for name, good in _source_checks(source, pinned).items() if not good]
    for section in ("limits", "jobs"):
        least = {k: 0 if section == "limits" and k in UNLIMITED else 1 for k in value.get(section, {})}
        faults += [f"{section}: {k}" for k, v in value.get(section, {}).items() if type(v) is not int or v < least[k]]
    if faults:
        raise ValueError("; ".join(faults))
    return value


def manifests(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Chapters of pinned editions, one row each."""
    read = spark.read.schema(MANIFEST).option("multiLine", True).json(paths)
    return read.select("original_title", "author", "source_url", F.posexplode("chapters").alias("pos", "c")).select("original_title", "author", "source_url", "pos", "c.*")


def dictionaries(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``term, translation`` of JSON objects of strings."""
    text = spark.read.text(paths, wholetext=True)
    value = F.from_json(F.regexp_replace("value", "^﻿", ""), "map<string,string>")
    return text.select(F.explode(value).alias("term", "translation"))


def streams(spark: SparkSession, paths: str | list[str], models: set[str], agent: str) -> DataFrame:
    """``path, content, usage, reason`` of recorded event streams, one file a stream."""
    shape = T.StructType([T.StructField("content", T.StringType()), T.StructField("usage", T.LongType()), T.StructField("reason", T.StringType())])

    def one(text: str) -> dict:
        try:
            return response(text.splitlines(), models, agent)
        except (ValueError, AttributeError):
            return {"content": None, "usage": None, "reason": "json"}

    @F.pandas_udf(shape)
    def read(texts: pd.Series) -> pd.DataFrame:
        rows = pd.DataFrame([one(t) for t in texts], columns=["content", "usage", "reason"])
        return rows.astype({"usage": "Int64"})

    lines = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), read("value").alias("r"))
    return lines.select("path", "r.*")


#: What says which call a recorded stream answers.
REQUEST = "call_id long, prompt_hash string, model string, effort string"


def recovered(spark: SparkSession, requests: str | list[str], events: str | list[str], calls: DataFrame, effort: str = "high", most: int = 1 << 20) -> DataFrame:
    """``id, path, content, usage`` of calls whose recorded stream is whole.

    ``requests`` and ``events`` are files in a folder for each attempt. A
    request belongs to a call if id, prompt hash, model and effort are its own;
    of several whole streams the one of the first path counts. Streams of more
    than four times ``most`` bytes and contents of more aren't used.
    """
    folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
    asked = spark.read.schema(REQUEST).option("multiLine", True).json(requests).select("*", folder.alias("folder")).filter(F.col("effort") == effort)
    keys = (F.col("r.call_id") == F.col("c.id")) & (F.col("r.prompt_hash") == F.col("c.prompt_hash")) & (F.col("r.model") == F.col("c.model"))
    known = asked.alias("r").join(calls.select("id", "prompt_hash", "model").distinct().alias("c"), keys).select("c.id", "c.model", "r.folder")
    texts = spark.read.text(events, wholetext=True).select(folder.alias("folder"), F.col("_metadata.file_path").alias("path"), "value").filter(F.octet_length("value") <= 4 * most)
    shape = T.StructType([T.StructField("content", T.StringType()), T.StructField("usage", T.LongType())])

    @F.pandas_udf(shape)
    def read(values: pd.Series, models: pd.Series) -> pd.DataFrame:
        found = []
        for text, model in zip(values, models):
            try:
                answer = response(text.splitlines(), {model}, effort)
            except (ValueError, AttributeError):
                answer = {"content": None, "usage": None}
            found.append((answer["content"], answer["usage"]))
        return pd.DataFrame(found, columns=["content", "usage"]).astype({"usage": "Int64"})

    whole = known.join(texts, "folder").select("id", "path", read("value", "model").alias("a")).filter(F.col("a.content").isNotNull() & (F.octet_length("a.content") <= most))
    return whole.groupBy("id").agg(F.min(F.struct("path", "a.content", "a.usage")).alias("x")).select("id", "x.*")


def with_added(df: DataFrame, columns: dict = ADDED) -> DataFrame:
    """A table of an older version with the added columns at their defaults (T4)."""
    return df.withColumns({c: F.lit(v) for c, v in columns.items() if c not in df.columns})


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose keys it hasn't (K1)."""
    return old.unionByName(new.dropDuplicates(keys).join(old, keys, "left_anti"))


def insert_replace(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of both, of equal keys the one with the largest ``order``; ``new`` wins ties (K1)."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(order), F.desc("_new"))
    return both.withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r", "_new")


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Overwrite only the partitions that ``df`` has (T5)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def snapshot(df: DataFrame, path: str, day: str) -> None:
    """Write a day's snapshot unless it exists (K5)."""
    df.write.mode("ignore").parquet(f"{path}/dt={day}")
