"""Problem 6: only the story of every page, by a site style tree.

The pages of a host are merged into one tree. ``source`` has no tags left, so
that a page's nodes are its lines: presentation is a line's style (its marks
and kinds of signs) and, for rare styles, the set of its marks; content is its
masked form, the leaf. A node's importance comes from entropies: over hosts
(what stands at one host only is that host's own, what is even belongs to the
texts), over places in the page (page lines stand at the edges), and, for
styles, over contents (a style that always says the same is no story's). A leaf
that occurs often is decided by its own importance, a rare one inherits its
style's, a rare style that of its marks. Leaves that their branch doesn't
decide either are few; their importance is carried over from decided nodes by
a logistic model over character n-grams, fitted on every line in shards whose
weights are mixed. Branches of low importance are removed from every page, over whole texts.
"""

from __future__ import annotations

import itertools
import operator
import re
import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.llm import mojibake, residue
from inkloom.llm.chapters import paragraphs, table
from inkloom.llm.ngrams import Learner, Model, mixed
from inkloom.llm.repeats import site_lines, spread
from inkloom.session import cut, few, small

#: Occurrences and books from which a masked form is decided by its node, and the largest share of one book.
OFTEN, BOOKS, ONE_BOOK = 12, 3, 0.8
#: Evenness up to which a form is its host's own, and from which it belongs to the texts unless it stands at the edges.
OWN, EVEN, EDGES = 0.6, 0.85, 0.6
#: Evenness over hosts, and entropy of contents, from which a style belongs to the texts if at most this share of it stands at the edges.
STYLE_EVEN, STYLE_RICH, STYLE_EDGES = 0.55, 0.7, 0.4
#: Contents are counted in this many buckets by their hash, so that a style's entropy takes bounded room.
BUCKETS = 64
#: The model is fitted in at most so many shards, of at least about so many lines, and in each by blocks of about so many lines or
#: characters, all epochs over a block at once.
SHARDS, SHARD_LINES, BLOCK, BLOCK_SIZE = 12, 80_000, 16_384, 1 << 20

#: Pages, and lines in training, that are scored at once.
PAGES, SCORED = 200, 4_000

#: Characters of a line's head, and by how much its score must exceed a whole line's.
HEAD, DOUBT = 10, 1.0

#: A chapter's own heading, whatever its style of numbering.
HEADING = re.compile(r"\W*(?:正文\W*)?第\s*[0-9零〇一二三四五六七八九十百千万两]+\s*[章节回话卷][^>|｜\[\]《》→←]{0,16}")
#: Masked forms of headings (fixed values; Ⓒ is the chapter's name).
HEADINGS = ("Ⓒ", "第0章Ⓒ", "第0回Ⓒ", "第0节Ⓒ", "第0话Ⓒ", "正文第0章Ⓒ", "0Ⓒ", "第0章", "第0回")
#: Marks of a scene break only (read in whatever encoding), or one piece of speech.
BREAK = re.compile(r"[\W_]*|(.{1,8}?)\1{2,}|[“「『][^“”「」『』]*[”」』]")
#: Ends of sentences and of broken-off speech.
CLOSED = re.compile(r"(?:[。！？…”’」』!?—]|\.\.)$")


#: Signs without width.
UNSEEN = r"[​-‏⁠﻿]"


def folded(line: str) -> str:
    """Narrow forms, lower case, without zero-width signs."""
    return re.sub(UNSEEN, "", unicodedata.normalize("NFKC", line)).lower()


#: Signs with another compatibility form that most lines have (fixed values).
USUAL = frozenset("，！？：；（）…\u3000")


@cache
def alone(sign: str) -> str | None:
    """A sign in compatibility form; None if signs beside it may change that, it ends a line, or it is a rare one with another form."""
    first = unicodedata.normalize("NFKD", sign)[0]
    jamo = "\u1100" <= first <= "\u11ff" or "\ua960" <= first <= "\ua97f" or "\ud7b0" <= first <= "\ud7ff"
    bound = sign > "\uffff" or unicodedata.combining(first) or unicodedata.category(first)[0] == "M" or jamo
    form = unicodedata.normalize("NFKC", sign)
    return None if bound or sign == "\n" or form != sign and sign not in USUAL else form


def folded_all(lines: list[str]) -> list[str]:
    """`folded` of each line; those of signs that stand alone are read at once."""
    signs = set("".join(lines))
    bound = "".join(c for c in signs if alone(c) is None)
    by_itself = [False] * len(lines)
    if bound:
        meets = re.compile(f"[{re.escape(bound)}]").search
        by_itself = [meets(x) is not None for x in lines]
    text = "\n".join(itertools.compress(lines, map(operator.not_, by_itself)))
    for c in signs & USUAL:
        text = text.replace(c, alone(c))
    whole = iter(re.sub(UNSEEN, "", text).lower().split("\n"))
    return [folded(x) if single else next(whole) for x, single in zip(lines, by_itself)]


def exploded(pages: DataFrame) -> DataFrame:
    """``site, book_id, number, book, at, size, key, style, kind``: the lines of all pages."""
    lines = pages.select("site", "book_id", "number", F.size("keys").alias("size"), F.posexplode(F.arrays_zip("keys", "styles", "kinds")).alias("at", "x"))
    return lines.select(
        "site", "book_id", "number", F.xxhash64("book_id").alias("book"), "at", "size",
        F.col("x.keys").alias("key"), F.col("x.styles").alias("style"), F.col("x.kinds").alias("kind"),
    )


EDGE = "count_if(at < 3 or at >= size - 4)"


def often(counts: DataFrame, node: str) -> DataFrame:
    """``node, edges`` of nodes with enough occurrences and books; ``counts`` has ``node, site, book, n, edge``."""
    return (
        counts.groupBy(node, "book").agg(F.sum("n").alias("n"), F.sum("edge").alias("edge"))
        .groupBy(node)
        .agg(F.sum("n").alias("n"), F.sum("edge").alias("edge"), F.count("*").alias("books"), F.max("n").alias("top"))
        .filter((F.col("n") >= OFTEN) & (F.col("books") >= BOOKS) & (F.col("top") <= ONE_BOOK * F.col("n")))
        .select(node, (F.col("edge") / F.col("n")).alias("edges"))
    )


def leaves(lines: DataFrame, totals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``key, own`` of leaves that decide themselves (true for a host's own line, false for a text's), and ``key`` of those in several books."""
    counts = cut(lines.groupBy("site", "key", "book").agg(F.count("*").alias("n"), F.expr(EDGE).alias("edge")))
    frequent = few(cut(often(counts, "key")))
    known = counts.join(frequent, "key", "left_semi").groupBy("site", "key").agg(F.sum("n").alias("n"))
    heading = F.col("key").isin([F.xxhash64(F.lit(x)) for x in HEADINGS])
    own = F.when(heading, False).when(F.col("evenness") < OWN, True).when(
        (F.col("evenness") > EVEN) & (F.col("edges") <= EDGES), False
    )
    decided = spread(known, totals).join(frequent, "key").select("key", own.alias("own")).filter("own is not null")
    shared = counts.groupBy("key").agg(F.min("book").alias("a"), F.max("book").alias("b")).filter("a != b").select("key")
    return cut(decided), cut(shared)


def branches(lines: DataFrame, totals: DataFrame, node: str) -> DataFrame:
    """``node, text``: whether an inner node (a style or the marks of styles) that occurs often belongs to the texts."""
    shown = lines.filter(F.col(node).isNotNull())
    counts = cut(shown.groupBy("site", node, "book").agg(F.count("*").alias("n"), F.expr(EDGE).alias("edge")))
    frequent = few(cut(often(counts, node)))
    even = spread(counts.join(frequent, node, "left_semi").groupBy("site", F.col(node).alias("key")).agg(F.sum("n").alias("n")), totals)
    said = shown.join(frequent, node, "left_semi").groupBy(node, F.pmod("key", F.lit(BUCKETS)).alias("bucket")).agg(F.count("*").alias("n"))
    rich = said.groupBy(node).agg(
        ((F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")) / F.log(F.least(F.sum("n"), F.lit(BUCKETS)))).alias("rich")
    )
    text = (F.col("evenness") > STYLE_EVEN) & (F.col("rich") >= STYLE_RICH) & (F.col("edges") <= STYLE_EDGES)
    return cut(even.withColumnRenamed("key", node).join(frequent, node).join(rich, node).select(node, text.alias("text")))


#: What the tree says of a line: the texts', the host's own, or nothing.
TEXT, PAGE, OPEN = 0, 1, 2


def verdicts(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``book_id, number, said, own`` with the tree's word on each line, and what its leaf tells; and the leaves ``key, own``."""
    totals = cut(pages.groupBy("site").agg(F.count("*").alias("total")))
    lines = exploded(pages)
    own, shared = leaves(lines, totals)
    styles, kinds = branches(lines, totals, "style"), branches(lines, totals, "kind")
    inherited = F.coalesce(F.col("style_text"), F.col("kind_text"), F.lit(False))
    said = F.when(F.col("own"), PAGE).when(~F.col("own"), TEXT).when(F.col("shared").isNull() & inherited, TEXT).otherwise(OPEN)
    return (
        lines.select("book_id", "number", "at", "key", "style", "kind")
        .join(few(own), "key", "left")
        .join(few(shared).withColumn("shared", F.lit(True)), "key", "left")
        .join(few(styles).withColumnRenamed("text", "style_text"), "style", "left")
        .join(few(kinds).withColumnRenamed("text", "kind_text"), "kind", "left")
        .groupBy("book_id", "number")
        .agg(F.array_sort(F.collect_list(F.struct("at", said.cast("tinyint").alias("said"), F.col("own").cast("tinyint").alias("own")))).alias("x"))
        .select("book_id", "number", F.col("x.said").alias("said"), F.col("x.own").alias("own"))
    ), own


def told(page: tuple) -> Iterator[tuple[str, int, int, int, bool]]:
    """``line, at, size, own, named`` of each line of a page ``(source, own, terms)``; own is -1 where the leaf tells nothing."""
    source, own, terms = page
    for at, (line, word) in enumerate(zip(paragraphs(source) or [], own)):
        yield line, at, len(own), -1 if word is None or word != word else int(word), terms is not None and any(n in line for n in terms)


def noted(pages: list[tuple]) -> Iterator[tuple[list[str], bytes, int]]:
    """``text, facts, size`` of pages ``(source, own, terms)``: lines that are `folded`, what is known of each, and the page's size."""
    lines = [list(told(page)) for page in pages]
    text = folded_all([x[0] for page in lines for x in page])
    own, named = (np.array([x[k] for page in lines for x in page], int) for k in (3, 4))
    story = np.array([bool(BREAK.fullmatch(t) or HEADING.fullmatch(t)) for t in text], int)
    closed = np.array([bool(CLOSED.search(t)) for t in text], int)
    facts, at = (own + 1 | named << 2 | story << 3 | closed << 4).astype(np.uint8), 0
    for page, (_, words, _) in zip(lines, pages):
        yield text[at : at + len(page)], facts[at : at + len(page)].tobytes(), len(words)
        at += len(page)


def lines_of(text: list[str], facts: bytes, size: int) -> Iterator[tuple[str, int, int, int]]:
    """``text, at, size, fact`` of each line of a page."""
    for at, (line, fact) in enumerate(zip(text, facts)):
        yield line, at, size, fact


def places(lines: list[tuple]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``text, own, named, story, open_end, edge, inner`` of lines."""
    text = [x[0] for x in lines]
    at, size, fact = (np.array([x[k] for x in lines], int) for k in (1, 2, 3))
    own, named, story, closed = (fact & 3) - 1, fact & 4 > 0, fact & 8 > 0, fact & 16 > 0
    # Presentation: lines that neither close nor break off speech, by themselves, are no story's.
    open_end = ~closed & ~named & ~story & (own < 0)
    free = (own < 0) & (size >= 12) & ~story
    edge = free & ~named & ((at < 2) | (at >= size - 2))
    inner = free & ~open_end & (at >= 4) & (at < size - 5)
    return text, own, named, story, open_end, edge, inner


def by_place(lines: list[tuple], _: Model | None) -> tuple[list[str], np.ndarray]:
    """Lines that tell the importance of contents by place, and whether they stand where story lines don't."""
    text, _, _, _, _, edge, inner = places(lines)
    chosen = np.flatnonzero(edge | inner)
    return [text[i] for i in chosen], edge[chosen]


def by_importance(lines: list[tuple], place: Model | None) -> tuple[list[str], np.ndarray]:
    """Lines whose importance their node, their presentation or their contents' place tells, and whether they are a page's."""
    text, own, named, story, open_end, _, _ = places(lines)
    score = np.zeros(len(text))
    if place is not None:
        score = np.concatenate([place.score(text[k : k + SCORED]) for k in range(0, len(text), SCORED)])
    one = ~story & ((own == 1) | ((own < 0) & ~named & (score > 0.3)) | (open_end & (score > -3)))
    zero = story | (own == 0) | named | ((own < 0) & ~open_end & (score < -1.3))
    known = np.flatnonzero((one | zero) & ~(one & zero))
    return [text[i] for i in known], one[known]


def blocks(lines: Iterator[tuple]) -> Iterator[list[tuple]]:
    block, size = [], 0
    for line in lines:
        block.append(line)
        size += len(line[0])
        if len(block) >= BLOCK or size >= BLOCK_SIZE:
            yield block
            block, size = [], 0
    if block:
        yield block


def fitted_shards(pages: DataFrame, choose, given: Model | None, epochs: int) -> tuple[Model | None, int, int]:
    """The model of all lines that ``choose`` labels, mixed from those of the shards, and how many of these are true and false."""
    shared = pages.sparkSession.sparkContext.broadcast(given)

    def shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        learner, random, ones, many = Learner(), np.random.default_rng(7), 0, 0
        rows = (page for batch in batches for page in zip(batch["text"], batch["facts"], batch["size"]))
        for block in blocks(line for page in rows for line in lines_of(*page)):
            texts, labels = choose(block, shared.value)
            if texts:
                learner.learn(texts, labels, epochs, random)
                ones, many = ones + int(labels.sum()), many + len(texts)
        if many:
            at = learner.touched()
            yield pd.DataFrame([(ones, many - ones, at.tobytes(), learner.w[at].astype(np.float32).tobytes(), learner.bias)], columns=["ones", "zeros", "at", "w", "bias"])

    counts = [0, 0]

    def parts() -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        # All shards are fitted at once; the driver reads a fixed number of rows, of a size fixed by the hash bits, one after the other.
        for r in cut(pages.mapInPandas(shard, "ones long, zeros long, at binary, w binary, bias double")).toLocalIterator():
            counts[0], counts[1] = counts[0] + r["ones"], counts[1] + r["zeros"]
            yield np.frombuffer(r["at"], np.int32), np.frombuffer(r["w"], np.float32), r["bias"]

    return mixed(parts()), *counts


def trained_pages(chapters: DataFrame, said: DataFrame, terms: DataFrame) -> DataFrame:
    """`noted` of every page once, in shards whose number is that of the lines; cut from its lineage."""
    lines = said.agg(F.sum(F.size("own")).alias("n")).first()["n"] or 0

    def note(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (whole.iloc[k : k + PAGES] for whole in batches for k in range(0, len(whole), PAGES)):
            yield pd.DataFrame(noted(list(zip(batch["source"], batch["own"], batch["terms"]))), columns=["text", "facts", "size"])

    # In a fixed order by hash, so that a block has pages of many books.
    return cut(
        chapters.groupBy("book_id", "number").agg(F.min("source").alias("source"))
        .join(said.select("book_id", "number", "own"), ["book_id", "number"])
        .join(small(terms), "book_id", "left")
        .select("source", "own", "terms", F.xxhash64("book_id", "number").alias("h"))
        .repartition(max(1, min(SHARDS, lines // SHARD_LINES)), "h")
        .sortWithinPartitions("h", "source")
        .select("source", "own", "terms")
        .mapInPandas(note, "text array<string>, facts binary, size long")
    )


def train(chapters: DataFrame, said: DataFrame, terms: DataFrame) -> Model | None:
    """The importance model of every line; None if no line is told to be a page's. The same rows give the same model."""
    pages = trained_pages(chapters, said, terms)
    place, edges, inner = fitted_shards(pages, by_place, None, 4)
    model, ones, _ = fitted_shards(pages, by_importance, place if edges and inner else None, 5)
    return model if ones else None


def readable(lines: list[str], labels: mojibake.Labels | None) -> list[str]:
    """Lines as they were before a wrong decoding, where that can be told."""
    if labels is None:
        return lines
    return [found[0] if found else line for line, found in zip(lines, mojibake.repaired_all(lines, labels))]


@lru_cache(1 << 14)
def residual(line: str) -> bool:
    """Whether a line is residue; judged as it stands, as its signs may look like a wrong decoding. Lines of pages recur."""
    return residue.told(line)


def find(chapters: DataFrame, model: Model | None, labels: mojibake.Labels | None = None) -> DataFrame:
    """``book_id, number, para`` of page lines of ``book_id, number, source, said, terms``; may repeat.

    ``said`` is the tree's word on each line. The model judges the lines that
    the tree leaves open, garbled ones as they read without the wrong decoding
    if ``labels`` has its model; lines that are template residue are no page
    lines. Null, empty and invalid sources have no row. Without a model no
    line was told to be a page's, and no open line is.
    """
    # Sizes fixed by the number of hash bits, and of characters and encodings.
    shared = chapters.sparkSession.sparkContext.broadcast((model, labels))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool, decoder = shared.value
        for batch in (whole.iloc[k : k + PAGES] for whole in batches for k in range(0, len(whole), PAGES)):
            rows, waiting, open_ = [], [], []
            for book, number, source, said, names in zip(batch["book_id"], batch["number"], batch["source"], batch["said"], batch["terms"]):
                parts = paragraphs(source) or []
                for k, (part, word) in enumerate(zip(parts, said)):
                    if word != TEXT:
                        open_.append((book, number, k + 1, part, word, names))
            for (book, number, para, part, word, names), plain in zip(open_, readable([x[3] for x in open_], decoder)):
                # A leaf that a wrong decoding made a host's own isn't the page's for that.
                if word == PAGE and plain == part:
                    if not residual(part):
                        rows.append((book, number, para))
                # A text of which signs were lost can't be told from a page's line; it stays.
                elif tool is not None and plain.count(mojibake.LOST) < 2:
                    waiting.append((book, number, para, part, plain, names))
            texts = folded_all([w[4] for w in waiting])
            if texts:
                # A long text may hang on a short label: the head alone tells too.
                scores = np.maximum(tool.score(texts), tool.score([x[:HEAD] for x in texts]) - DOUBT)
                for (book, number, para, part, plain, names), text, score in zip(waiting, texts, scores):
                    named = names is not None and score < 1.5 and any(n in plain for n in names)
                    if score > 0 and not (named or BREAK.fullmatch(text) or HEADING.fullmatch(text) or residual(part)):
                        rows.append((book, number, para))
            yield pd.DataFrame(rows, columns=["book_id", "number", "para"])

    return chapters.select("book_id", "number", "source", "said", "terms").mapInPandas(judge, "book_id string, number long, para long")


def book_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``book_id, terms``: names of a book that tell its story's lines."""
    return (
        table(spark, sf_dir, "book_terms")
        .filter(F.length("source") > 1)
        .groupBy("book_id")
        .agg(F.collect_set("source").alias("terms"))
    )


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``book_id, number, para`` of every line of the page; may repeat where rows were delivered twice."""
    pages = site_lines(spark, sf_dir, styles=True)
    said, _ = verdicts(pages)
    said = cut(said)
    terms = book_names(spark, sf_dir)
    chapters = table(spark, sf_dir, "chapters").select("book_id", "number", "source")
    model = train(chapters, said, terms)
    labels = mojibake.fitted(spark, sf_dir)
    # Pages that the tree decides as text throughout don't meet their texts again.
    unsettled = said.drop("own").filter(F.exists("said", lambda x: x != TEXT))
    chapters = chapters.join(unsettled, ["book_id", "number"])
    return find(chapters.join(small(terms), "book_id", "left"), model, labels)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``book_id, number, para`` of every page line."""
    return page_lines(spark, sf_dir).distinct()
