"""Findings on parallel paragraphs: markup, lengths, names and numbers (X19, X29, X30); whole results are judged in `results`."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.functions import glossary as G
from inkloom.functions.numerals import faithful
from inkloom.operators.reading import groups, loads, tidy
from inkloom.session import small

_MARKUP = re.compile("[\ue000-\uf8ff]|<[^>]*>|```")
_HAN = re.compile("[一-鿿]")


def findings(source: list[str], target: list[dict], names: dict[str, str], aliases: dict[str, list[str]] | None = None) -> list[tuple[int, str, str]]:
    """``(paragraph from 1, kind, detail)`` of a translation; kinds in order of severity.

    ``coverage`` and ``order`` concern the whole; the other gates run on each
    paragraph, names and numbers on paragraphs joined over an unfinished source
    sentence.
    """
    out = []
    if len(source) != len(target):
        out.append((0, "coverage", f"{len(target)} of {len(source)}"))
    if [p.get("id") for p in target] != list(range(1, len(target) + 1)):
        out.append((0, "order", ""))
    texts = [tidy(p.get("text") or "") for p in target]
    for k, (a, b) in enumerate(zip(source, texts), 1):
        if not b or _MARKUP.search(b):
            out.append((k, "markup" if b else "empty", ""))
        elif len(a) > 20 and not 0.35 <= len(b) / len(a) <= 12:
            out.append((k, "length", f"{len(b)} of {len(a)}"))
        if _HAN.search(b):
            out.append((k, "han", ""))
    for group in groups(source, [bool(p.get("join_previous")) for p in target]):
        group = [k for k in group if k < len(source)]
        if not group:
            continue
        a = "".join(source[k] for k in group)
        b = " ".join(G.unify_aliases(a, texts[k], names, aliases, frozenset()) if aliases else texts[k] for k in group)
        out += [(group[0] + 1, "name", m) for m in G.missing(a, b, names)]
        if faithful(a, b) is False:
            out.append((group[0] + 1, "number", ""))
    return out


def validate(chapters: DataFrame, terms: DataFrame) -> DataFrame:
    """``book_id, number, para, kind, detail`` of chapters' ``source`` and ``translated`` values.

    ``terms`` has ``book_id, source, translation, chapter``; a chapter is held
    to the entities known up to it (V5). Values that aren't valid JSON have one
    finding ``json``; null values have none.
    """
    known = terms.groupBy("book_id").agg(F.collect_set(F.struct("source", "translation", "chapter")).alias("terms"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for book, number, source, target, listed in zip(*(batch[c] for c in ("book_id", "number", "source", "translated", "terms"))):
                if not isinstance(source, str) or not isinstance(target, str):
                    continue
                try:
                    left, right = loads(source), loads(target)["paragraphs"]
                except (ValueError, KeyError, TypeError):
                    rows.append((book, number, 0, "json", ""))
                    continue
                names = {t["source"]: t["translation"] for t in (listed if listed is not None else ()) if t["chapter"] <= number and len(t["source"]) > 1}
                active = {n: names[n] for _, n in G.mentions("".join(left), names)}
                rows += [(book, number, *f) for f in findings(left, right, active)]
            yield pd.DataFrame(rows, columns=["book_id", "number", "para", "kind", "detail"])

    joined = chapters.select("book_id", "number", "source", "translated").join(small(known), "book_id", "left")
    return joined.mapInPandas(work, "book_id string, number long, para long, kind string, detail string")


def term_mentions(chapters: DataFrame, terms: DataFrame, lexicon: Mapping[str, float] | None = None) -> DataFrame:
    """``book_id, number, pos, start, term`` of longest-match mentions of each book's terms.

    ``chapters`` has ``book_id, number, lines`` (an array of paragraphs, ``pos``
    from 1): a book's terms travel once a chapter, not once a paragraph. With a
    lexicon, short matches that only cross two of its words don't count.
    """
    known = terms.groupBy("book_id").agg(F.collect_set("source").alias("terms"))
    words = G.Lexicon(lexicon or {})

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for book, number, lines, listed in zip(*(batch[c] for c in ("book_id", "number", "lines", "terms"))):
                names = frozenset(listed)
                rows += [
                    (book, number, pos, start, term)
                    for pos, text in enumerate(lines if lines is not None else (), 1)
                    if isinstance(text, str)
                    for start, term in G.mentions(text, names, words)
                ]
            yield pd.DataFrame(rows, columns=["book_id", "number", "pos", "start", "term"])

    return chapters.select("book_id", "number", "lines").join(small(known), "book_id").mapInPandas(work, "book_id string, number long, pos long, start long, term string")
