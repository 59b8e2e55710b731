"""Whole results of a chapter: shape, readings, terms and everything that is found about them.

A result is judged by gates that don't know of each other; each gives findings
with a level, and the levels decide. Nothing stops at the first fault.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from functools import cached_property
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.functions import glossary as G
from inkloom.functions.numerals import faithful
from inkloom.operators.reading import groups, loads, tidy
from inkloom.session import small

#: Keys of a result and of its parts (fixed values).
REQUIRED, OPTIONAL = {"title", "paragraphs", "continuity", "issues"}, {"terms", "source_notes", "glossary_readings"}
READING = {"paragraph_id", "source", "source_start", "source_quote", "translation", "reason"}
#: Limits of a result's parts (fixed values).
TITLE, CONTINUITY, READINGS, TERMS = 300, 2500, 100, 100
TRANSLATION, REASON, SOURCE, RENDERING = (2, 500), (15, 1000), (1, 50), (1, 150)
LEAST, MOST, SHORT = 0.35, 12, 20
#: Marks of issues that refuse, and of those that only note (fixed values).
REFUSAL, NOTE = "POLICY:", "SOURCE:"
HAN = re.compile("[一-鿿]")
MARKUP = re.compile("[\ue000-\uf8ff]|<[^>]*>|```")
#: Findings that a machine wrote into a draft's issues (fixed wording).
STALE = re.compile(
    r"(?:Paragraph \d+|Joined paragraphs \d+(?:,\d+)+): (?:glossary mismatch:|numeric literals changed;|untranslated Chinese remains;)|Term conflicts with locked glossary:"
)

#: Levels, the gravest first: a refusal, a result that can't be used, faults of the text, faults of names.
LEVELS = ("refused", "unusable", "quality", "names")


class Finding(NamedTuple):
    level: str
    kind: str
    para: int
    detail: str


def within(value: object, limits: tuple[int, int]) -> bool:
    return isinstance(value, str) and limits[0] <= len(value) <= limits[1]


def number(value: object, least: int, most: int | None = None) -> bool:
    return type(value) is int and least <= value and (most is None or value <= most)


@dataclass
class Case:
    """A result with its source paragraphs and the names that hold for it."""

    source: list[str]
    result: object
    names: Mapping[str, str]
    aliases: Mapping[str, list[str]] = field(default_factory=dict)
    reviewed: list[dict] = field(default_factory=list)
    lexicon: G.Lexicon = field(default_factory=G.Lexicon)

    @cached_property
    def shape(self) -> list[Finding]:
        """What keeps a result from being read (level ``unusable``), and refusals."""
        data = self.result
        if not isinstance(data, dict) or data.keys() - OPTIONAL != REQUIRED:
            return [Finding("unusable", "schema", 0, "")]
        issues = data["issues"]
        if not isinstance(issues, list) or not all(isinstance(x, str) for x in issues):
            return [Finding("unusable", "issues", 0, "")]
        out = [Finding("refused", "policy", 0, x) for x in issues if x.lstrip().startswith(REFUSAL)]
        for key, most in (("title", TITLE), ("continuity", CONTINUITY)):
            if not within(data[key], (1, most)) or not data[key].strip():
                out.append(Finding("unusable", key, 0, ""))
        if isinstance(data["title"], str) and re.search(f"{HAN.pattern}|<[^>]*>|```|[\r\n]", data["title"]):
            out.append(Finding("unusable", "title", 0, "markup"))
        paragraphs = data["paragraphs"]
        if not isinstance(paragraphs, list) or len(paragraphs) != len(self.source):
            return [*out, Finding("unusable", "coverage", 0, f"{len(paragraphs) if isinstance(paragraphs, list) else 0} of {len(self.source)}")]
        for k, p in enumerate(paragraphs, 1):
            if not isinstance(p, dict) or p.keys() - {"join_previous"} != {"id", "text"} or not number(p["id"], k, k) or not isinstance(p["text"], str):
                out.append(Finding("unusable", "order", k, ""))
            elif type(p.get("join_previous", False)) is not bool or k == 1 and p.get("join_previous"):
                out.append(Finding("unusable", "layout", k, ""))
        return out

    @property
    def readable(self) -> bool:
        return not any(f.kind in ("schema", "issues", "coverage", "order", "layout") for f in self.shape)

    @cached_property
    def mentions(self) -> list[list[tuple[int, str]]]:
        return [G.mentions(text, self.names, self.lexicon) for text in self.source]

    @cached_property
    def texts(self) -> list[str]:
        """Paragraphs as they are laid out, with aliases in their canonical form."""
        out = [tidy(p["text"]) for p in self.result["paragraphs"]]
        for group in self.groups:
            whole = "".join(self.source[k] for k in group)
            for k in group:
                out[k] = G.unify_aliases(whole, out[k], self.names, self.aliases, self.lexicon) if self.aliases else out[k]
        return out

    @cached_property
    def groups(self) -> list[list[int]]:
        return groups(self.source, [bool(p.get("join_previous")) for p in self.result["paragraphs"]])

    @cached_property
    def readings(self) -> list[dict]:
        """The result's own ordinary readings that carry full evidence (V2)."""
        given = self.result.get("glossary_readings", [])
        if not isinstance(given, list) or len(given) > READINGS:
            return []
        out: dict[tuple[int, int], dict] = {}
        for r in given:
            if not isinstance(r, dict) or r.keys() != READING or not number(r["paragraph_id"], 1, len(self.source)) or not number(r["source_start"], 0):
                continue
            k, at, term = r["paragraph_id"] - 1, r["source_start"], r["source"]
            proven = r["source_quote"] == self.source[k] and within(r["translation"], TRANSLATION) and within(r["reason"], REASON)
            if proven and (at, term) in self.mentions[k] and G.may_be_ordinary(self.source[k], at, term, self.lexicon):
                out.setdefault((k, at), r)
        return list(out.values())

    def decided(self, r: dict) -> bool:
        """Whether a review's decision still holds for this source and text (V3)."""
        if not number(r["paragraph_id"], 1, len(self.source)) or not number(r["source_start"], 0):
            return False
        k, term = r["paragraph_id"] - 1, r["source"]
        short = len(term) == 2 and term[1] not in G.KINDS and self.names.get(term) == r["canonical"]
        quoted = r["source_quote"] == self.source[k] and bool(r["translation_quote"].strip())
        return short and quoted and (r["source_start"], term) in self.mentions[k] and G.has_phrase(self.result["paragraphs"][k]["text"], r["translation_quote"])

    @cached_property
    def waived(self) -> set[tuple[int, int]]:
        """Paragraph (from 0) and start of mentions that are read as ordinary words."""
        given = [*self.readings, *filter(self.decided, self.reviewed)]
        return {(r["paragraph_id"] - 1, r["source_start"]) for r in given}

    def joined(self, group: list[int]) -> tuple[str, str, set[int]]:
        """A group's source, text, and the starts in the source that are waived."""
        starts, at = set(), 0
        for k in group:
            starts |= {at + start for j, start in self.waived if j == k}
            at += len(self.source[k])
        whole = "".join(self.source[k] for k in group)
        return whole, " ".join(self.texts[k] for k in group), starts & {start for start, _ in G.mentions(whole, self.names, self.lexicon)}

    def layout(self) -> Iterator[Finding]:
        for k, (before, text) in enumerate(zip(self.source, self.texts), 1):
            if not text or MARKUP.search(text):
                yield Finding("unusable", "markup" if text else "empty", k, "")
            elif len(before) > SHORT and not LEAST <= len(text) / len(before) <= MOST:
                yield Finding("unusable", "length", k, f"{len(text)} of {len(before)}")
            if HAN.search(text):
                yield Finding("quality", "han", k, "")

    def fidelity(self) -> Iterator[Finding]:
        for group in self.groups:
            whole, text, waived = self.joined(group)
            yield from (Finding("names", "name", group[0] + 1, m) for m in G.missing(whole, text, self.names, waived, self.lexicon))
            if faithful(whole, text) is False:
                yield Finding("quality", "number", group[0] + 1, "")

    def reported(self) -> Iterator[Finding]:
        for issue in self.result["issues"]:
            if not issue.lstrip().startswith((NOTE, REFUSAL)):
                yield Finding("quality", "issue", 0, issue)

    def registry(self) -> Iterator[Finding]:
        """Proposed terms that can't be read."""
        terms = self.result.get("terms", [])
        if not isinstance(terms, list) or len(terms) > TERMS:
            yield Finding("unusable", "terms", 0, "")
            return
        for t in terms:
            known = isinstance(t, dict) and t.keys() - {"kind"} == {"source", "translation"} and t.get("kind", "entity") in ("entity", "preferred")
            written = known and within(t["source"], SOURCE) and isinstance(t["translation"], str) and within(t["translation"].strip(), RENDERING)
            if not written or not HAN.search(t["source"]) or re.search(f"{HAN.pattern}|[\r\n<>]", t["translation"]):
                yield Finding("unusable", "terms", 0, str(t.get("source", "")) if isinstance(t, dict) else "")

    @cached_property
    def findings(self) -> list[Finding]:
        """Everything that is found, by level and place (V1)."""
        every = list(self.shape)
        if self.readable:
            for gate in (self.layout, self.fidelity, self.reported, self.registry):
                every += gate()
        return sorted(every, key=lambda f: (LEVELS.index(f.level), f.para))

    @property
    def outcome(self) -> str | None:
        """The gravest level of all findings; null for a result without any."""
        return self.findings[0].level if self.findings else None

    @cached_property
    def admitted(self) -> list[dict]:
        """Proposed terms that enter the registry (V4).

        A known name keeps its rendering, a proposal that conflicts with it or
        with an earlier one is left out, and so is one that no mention that
        isn't waived supports.
        """
        out: dict[str, dict] = {}
        for t in self.result.get("terms", []) if self.readable and not list(self.registry()) else ():
            term, said = t["source"], t["translation"]
            known = self.names.get(term)
            alike = known is not None and (said.casefold() in {a.casefold() for a in self.aliases.get(term, ())} or G.same_name(term, known, said))
            said = known if alike else said
            rivals = [x for x in (known, out.get(term, {}).get("translation")) if x is not None]
            if any(x.casefold() != said.casefold() for x in rivals):
                continue
            names = {**self.names, term: said}
            supported = any(
                at not in waived and found == term and G.rendered(term, said, text, whole, at + len(term))
                for whole, text, waived in map(self.joined, self.groups)
                for at, found in G.mentions(whole, names, self.lexicon)
            )
            if supported:
                out[term] = t | {"translation": said}
        return list(out.values())

    def targets(self, around: int = 400) -> list[dict]:
        """Short mentions that are neither rendered nor decided, with their surroundings, for review (V8)."""
        text_of = {k: " ".join(self.result["paragraphs"][j]["text"] for j in group) for group in self.groups for k in group}
        out = []
        for k, text in enumerate(self.source):
            for at, term in self.mentions[k]:
                short = len(term) == 2 and term[1] not in G.KINDS
                if short and (k, at) not in self.waived and not G.rendered(term, self.names[term], text_of[k], text, at + len(term)):
                    beside = [self.source[j] if 0 <= j < len(self.source) else "" for j in (k - 1, k + 1)]
                    out.append({"para": k + 1, "start": at, "term": term, "canonical": self.names[term], "previous": beside[0][-around:], "next": beside[1][:around]})
        return out


def redrafted(result: dict) -> dict:
    """A draft without the findings that a machine wrote into its issues: they are made anew (V7)."""
    return result | {"issues": [x for x in result.get("issues", []) if not STALE.match(x)]}


def relevant(source: list[str], names: Mapping[str, str], lexicon: G.Lexicon | None = None) -> dict[str, str]:
    """The names that a source mentions, in its paragraphs or over their ends (V5)."""
    lexicon = lexicon or G.Lexicon()
    found = {term for text in ("\n".join(source), "".join(source)) for _, term in G.mentions(text, names, lexicon)}
    return {term: names[term] for term in names if term in found}


def known_terms(terms: DataFrame) -> DataFrame:
    """``book_id, terms``: each book's ``source, translation, chapter``."""
    return terms.groupBy("book_id").agg(F.collect_set(F.struct("source", "translation", "chapter")).alias("terms"))


def names_at(listed, chapter: int) -> dict[str, str]:
    """Names of more than one sign that are known up to a chapter, the earliest rendering of each."""
    ordered = sorted(listed if listed is not None else (), key=lambda t: (t["chapter"] if t["chapter"] is not None else 0, t["translation"] or ""), reverse=True)
    return {t["source"]: t["translation"] for t in ordered if t["source"] and t["translation"] and len(t["source"]) > 1 and (t["chapter"] or 0) <= chapter}


def cases(batch: pd.DataFrame, column: str, lexicon: G.Lexicon) -> Iterator[tuple[object, int, Case | None]]:
    """A batch's results as cases; None for those that aren't JSON."""
    for book, chapter, source, value, listed in zip(batch["book_id"], batch["number"], batch["source"], batch[column], batch["terms"]):
        if not isinstance(source, str) or not isinstance(value, str) or pd.isna(chapter):
            continue
        try:
            paragraphs = [p if isinstance(p, str) else "" for p in json.loads(source)]
            result = loads(value)
        except (ValueError, TypeError):
            yield book, chapter, None
            continue
        yield book, chapter, Case(paragraphs, result, relevant(paragraphs, names_at(listed, chapter), lexicon), lexicon=lexicon)


def judged(chapters: DataFrame, terms: DataFrame, column: str = "edited", lexicon: Mapping[str, float] | None = None) -> DataFrame:
    """``book_id, number, level, kind, para, detail`` of everything that is found on a column of results.

    ``chapters`` has ``book_id, number, source`` and the column, ``terms``
    ``book_id, source, translation, chapter``. Nulls have no finding; values
    that aren't JSON have one, ``json``. A book's terms travel once a chapter.
    """
    words = G.Lexicon(lexicon or {})

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for book, chapter, case in cases(batch, column, words):
                found = case.findings if case else [Finding("unusable", "json", 0, "")]
                rows += [(book, chapter, *f) for f in found]
            yield pd.DataFrame(rows, columns=["book_id", "number", "level", "kind", "para", "detail"])

    joined = chapters.select("book_id", "number", "source", column).join(small(known_terms(terms)), "book_id", "left")
    return joined.mapInPandas(work, "book_id string, number long, level string, kind string, para long, detail string")


def review_targets(chapters: DataFrame, terms: DataFrame, column: str = "edited", lexicon: Mapping[str, float] | None = None) -> DataFrame:
    """``book_id, number, para, start, term, canonical, previous, next`` of mentions that wait for a review (V8)."""
    words = G.Lexicon(lexicon or {})
    columns = ["para", "start", "term", "canonical", "previous", "next"]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (book, chapter, *(t[c] for c in columns))
                for book, chapter, case in cases(batch, column, words)
                if case and case.readable
                for t in case.targets()
            ]
            yield pd.DataFrame(rows, columns=["book_id", "number", *columns])

    joined = chapters.select("book_id", "number", "source", column).join(small(known_terms(terms)), "book_id", "left")
    return joined.mapInPandas(work, "book_id string, number long, para long, start long, term string, canonical string, previous string, next string")


def excluded(chapters: DataFrame, terms: DataFrame, lexicon: Mapping[str, float]) -> DataFrame:
    """``book_id, number, para, start, term`` of matches that only cross two words of the lexicon."""
    words = G.Lexicon(lexicon)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for book, chapter, source, listed in zip(batch["book_id"], batch["number"], batch["source"], batch["terms"]):
                try:
                    paragraphs = json.loads(source) if isinstance(source, str) and not pd.isna(chapter) else []
                except ValueError:
                    continue
                names = frozenset(names_at(listed, chapter) if isinstance(paragraphs, list) and paragraphs else ())
                for k, text in enumerate(paragraphs if isinstance(paragraphs, list) else (), 1):
                    if isinstance(text, str):
                        kept = set(G.mentions(text, names, words))
                        rows += [(book, chapter, k, at, term) for at, term in G.mentions(text, names) if (at, term) not in kept]
            yield pd.DataFrame(rows, columns=["book_id", "number", "para", "start", "term"])

    joined = chapters.select("book_id", "number", "source").join(small(known_terms(terms)), "book_id")
    return joined.mapInPandas(work, "book_id string, number long, para long, start long, term string")
