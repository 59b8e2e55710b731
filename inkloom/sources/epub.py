"""EPUB files: chapters, parts, navigation, writing and verification.

A book is a list of element trees; each is built apart and written by the same
serializer, and a file is verified by checks that know nothing of how it was made.
"""

from __future__ import annotations

import hashlib
import io
import json
import math
import os
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.operators.reading import reader_paragraphs

#: Names of the format (fixed values).
XHTML, OPS, OPF, DC = "http://www.w3.org/1999/xhtml", "http://www.idpf.org/2007/ops", "http://www.idpf.org/2007/opf", "http://purl.org/dc/elements/1.1/"
CONTAINER, TYPE = "urn:oasis:names:tc:opendocument:xmlns:container", "application/epub+zip"
PAGE, PACKAGE = "application/xhtml+xml", "application/oebps-package+xml"
FOLDER, ROOT, CONTENTS, STYLE = "OEBPS/", "OEBPS/content.opf", "nav.xhtml", "style.css"
#: Words of the editions (fixed values).
CHAPTER, MISSING, INDEX = "Chương", "Chương bị thiếu", "Mục lục"
#: Largest part, and when a book was last changed if nobody says.
LARGEST, MODIFIED = 25_000_000, "1980-01-01T00:00:00Z"
CSS = "body{margin:0 3%;line-height:1.4}p{margin:0;text-indent:1.2em}h1,h2{text-align:center}section{break-before:page}.missing{text-indent:0;font-style:italic}"
#: Signs that XML can't hold.
_FORBIDDEN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff￾￿]")


class Chapter(NamedTuple):
    number: int
    title: str
    paragraphs: list[tuple[str, bool]]
    missing: bool = False

    def heading(self) -> str:
        return heading(self.number, self.title)


@dataclass
class Book:
    """What stands in a book's metadata, and its chapters in order."""

    id: str
    title: str
    chapters: list[Chapter]
    creator: str = ""
    source: str = ""
    modified: str = MODIFIED
    extra: dict[str, str] = field(default_factory=dict)


def heading(number: int, title: str) -> str:
    bare = f"{CHAPTER} {number}"
    return bare if title.strip().casefold() == bare.casefold() else f"{bare}: {title}"


def part_size(chapters: int) -> int:
    return max(20, math.ceil(chapters / 200))


def node(tag: str, *inside: ET.Element | str, **names: str) -> ET.Element:
    """An element; a trailing underscore keeps a name from Python, two stand for a colon."""
    made = ET.Element(tag, {k.rstrip("_").replace("__", ":").replace("_", "-"): _FORBIDDEN.sub("�", v) for k, v in names.items()})
    for child in inside:
        if isinstance(child, str):
            made.text = (made.text or "") + _FORBIDDEN.sub("�", child)
        else:
            made.append(child)
    return made


def page(title: str, *body: ET.Element) -> ET.Element:
    head = node("head", node("title", title), node("link", rel="stylesheet", type="text/css", href=STYLE))
    return node("html", head, node("body", *body), xmlns=XHTML, xmlns__epub=OPS, xml__lang="vi", lang="vi")


def section(chapter: Chapter) -> ET.Element:
    marked = {"class_": "missing"} if chapter.missing else {}
    shown = (node("p", text, **marked) for text in reader_paragraphs(chapter.paragraphs))
    return node("section", node("h2", chapter.heading()), *shown, id=f"ch-{chapter.number}")


def parts(book: Book) -> dict[str, list[Chapter]]:
    size = part_size(len(book.chapters))
    return {f"part-{k // size + 1:04}.xhtml": book.chapters[k : k + size] for k in range(0, len(book.chapters), size)}


def package(book: Book, files: list[str]) -> ET.Element:
    facts = [node("dc:identifier", f"urn:novel:{book.id}", id="book"), node("dc:title", book.title), node("dc:language", "vi")]
    facts += [node(name, value) for name, value in (("dc:creator", book.creator), ("dc:source", book.source)) if value]
    facts.append(node("meta", book.modified, property="dcterms:modified"))
    items = [node("item", id="css", href=STYLE, media_type="text/css"), node("item", id="nav", href=CONTENTS, media_type=PAGE, properties="nav")]
    items += [node("item", id=f"p{k}", href=name, media_type=PAGE) for k, name in enumerate(files)]
    spine = node("spine", *(node("itemref", idref=f"p{k}") for k in range(len(files))))
    return node("package", node("metadata", *facts, xmlns__dc=DC), node("manifest", *items), spine, xmlns=OPF, version="3.0", unique_identifier="book")


def build(book: Book) -> bytes:
    """A book's bytes; the same input gives the same bytes."""
    split = parts(book)
    links = [node("li", node("a", c.heading(), href=f"{name}#ch-{c.number}")) for name, chapters in split.items() for c in chapters]
    nav = node("nav", node("h1", INDEX), node("ol", *links), epub__type="toc", id="toc")
    root = node("rootfiles", node("rootfile", full_path=ROOT, media_type=PACKAGE))
    trees = {
        "META-INF/container.xml": node("container", root, xmlns=CONTAINER, version="1.0"),
        ROOT: package(book, list(split)),
        FOLDER + CONTENTS: page(INDEX, nav),
    } | {FOLDER + name: page(book.title, *map(section, chapters)) for name, chapters in split.items()}
    files = {"mimetype": TYPE.encode()} | {name: ET.tostring(tree, "utf-8", xml_declaration=True) for name, tree in trees.items()} | {FOLDER + STYLE: CSS.encode()}
    if any(len(data) > LARGEST for data in files.values()):
        raise ValueError("part too large")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, data in files.items():
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_DEFLATED if name != "mimetype" else zipfile.ZIP_STORED
            archive.writestr(info, data)
    return out.getvalue()


class Opened:
    """An archive that is being verified: its entries, and those that are markup as trees."""

    def __init__(self, archive: zipfile.ZipFile):
        self.archive, self.entries = archive, archive.infolist()
        self.names = {e.filename for e in self.entries}
        self.trees: dict[str, ET.Element] = {}

    def parse(self) -> bool:
        for name in self.names:
            if name.rpartition(".")[2] in ("xml", "opf", "xhtml"):
                self.trees[name] = ET.fromstring(self.archive.read(name))
        return True

    def attributes(self, file: str, space: str, tag: str, *names: str) -> list[tuple[str, ...]]:
        tree = self.trees.get(file)
        return [] if tree is None else [tuple(e.get(n, "") for n in names) for e in tree.iter(f"{{{space}}}{tag}")]

    def typed(self) -> bool:
        first = self.entries[0]
        return (first.filename, first.compress_type) == ("mimetype", zipfile.ZIP_STORED) and self.archive.read(first) == TYPE.encode()

    def whole(self) -> bool:
        return self.archive.testzip() is None

    def packaged(self) -> bool:
        return ROOT in self.trees and FOLDER + CONTENTS in self.trees

    def listed(self) -> bool:
        return {FOLDER + href for (href,) in self.attributes(ROOT, OPF, "item", "href")} <= self.names

    def spined(self) -> bool:
        return set(self.attributes(ROOT, OPF, "itemref", "idref")) <= set(self.attributes(ROOT, OPF, "item", "id"))

    def anchored(self) -> bool:
        ids = {(name, e.get("id")) for name, tree in self.trees.items() for e in tree.iter()}
        wanted = (href.split("#", 1) for (href,) in self.attributes(FOLDER + CONTENTS, XHTML, "a", "href"))
        return all(len(place) == 2 and (FOLDER + place[0], place[1]) in ids for place in wanted)


#: What is wrong if a check fails, in the order in which they build on each other.
CHECKS: dict[str, Callable[[Opened], bool]] = {
    "mimetype": Opened.typed,
    "checksum": Opened.whole,
    "markup": Opened.parse,
    "package": Opened.packaged,
    "manifest": Opened.listed,
    "spine": Opened.spined,
    "anchor": Opened.anchored,
}


def problem(data: bytes) -> str | None:
    """What is wrong with a book's bytes; null if nothing."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            opened = Opened(archive)
            return next((name for name, passes in CHECKS.items() if not passes(opened)), None)
    except ET.ParseError:
        return "markup"
    except (zipfile.BadZipFile, IndexError, EOFError, OSError):
        return "archive"


def chapter_of(number: int, state: str | None, edited: str | None, summary: str | None) -> Chapter | None:
    """A chapter as books have it (X48): its edited text, or for one that is recorded as missing the note on that; else None."""
    if state == "missing":
        return Chapter(number, MISSING, [(summary, False)], True) if summary else None
    try:
        result = json.loads(edited)
        return Chapter(number, result["title"], [(p.get("text") or "", bool(p.get("join_previous"))) for p in result["paragraphs"]])
    except (ValueError, KeyError, TypeError, AttributeError):
        return None


def gap(chapters: dict[int, Chapter | None], expected: int | None) -> str | None:
    """Why chapters aren't a whole book: the first number without a chapter, or one too many; null if they are."""
    if expected is None:
        return None
    absent = next((n for n in range(1, expected + 1) if chapters.get(n) is None), None)
    if absent is not None:
        return f"chapter {absent}"
    beyond = min((n for n in chapters if not 1 <= n <= expected), default=None)
    return None if beyond is None else f"chapter {beyond} of {expected}"


def books(chapters: DataFrame, folder: str | None = None, preview: bool = True, modified: str = MODIFIED) -> DataFrame:
    """``book_id, chapters, bytes, sha256, problem, gap`` of every book.

    Rows have ``book_id, title, number, edited``, and perhaps ``state,
    summary, expected, creator, source_url``. ``gap`` is why a book isn't whole
    (unknown without ``expected``); such a book is written as far as it can be
    read, or with ``preview=False`` not at all. A book is one task's work, as
    its file is. With ``folder`` (shared by the executors) files are written
    beside their final name first and renamed. Of repeated rows the smallest
    counts; rows without a number don't.
    """
    wanted = {"book_id": "string", "title": "string", "number": "long", "edited": "string", "state": "string", "summary": "string", "expected": "long", "creator": "string", "source_url": "string"}
    given = chapters.select(*(F.col(c).cast(t).alias(c) if c in chapters.columns else F.lit(None).cast(t).alias(c) for c, t in wanted.items()))

    def work(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        def text(value) -> str | None:
            return value if isinstance(value, str) else None

        def one(column: str) -> str:
            return min((v for v in rows[column] if isinstance(v, str)), default="")

        found: dict[int, Chapter | None] = {}
        known = rows[rows["number"].notna()]
        for number, state, edited, summary in sorted(zip(known["number"].astype(int), *(map(text, known[c]) for c in ("state", "edited", "summary"))), key=lambda r: (r[0], *(x or "" for x in r[1:]))):
            found[number] = found.get(number) or chapter_of(number, state, edited, summary)
        ready = [found[n] for n in sorted(found) if found[n] is not None]
        expected = rows["expected"].max()
        lack = gap(found, None if pd.isna(expected) else int(expected))
        columns = ["book_id", "chapters", "bytes", "sha256", "problem", "gap"]
        if not ready or lack and not preview:
            return pd.DataFrame([(key[0], 0, None, None, None, lack or "no chapter")], columns=columns) if lack else pd.DataFrame([], columns=columns)
        data = build(Book(str(key[0]), one("title"), ready, one("creator"), one("source_url"), modified))
        if folder:
            path = os.path.join(folder, f"{key[0]}.epub")
            with open(f"{path}.tmp", "wb") as file:
                file.write(data)
            os.replace(f"{path}.tmp", path)
        return pd.DataFrame([(key[0], len(ready), len(data), hashlib.sha256(data).hexdigest(), problem(data), lack)], columns=columns)

    return given.groupBy("book_id").applyInPandas(work, "book_id string, chapters long, bytes long, sha256 string, problem string, gap string")


def verified(files: DataFrame) -> DataFrame:
    """``path, problem`` of EPUB files read with ``binaryFile``."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "problem": [problem(bytes(c)) for c in batch["content"]]})

    return files.select("path", "content").mapInPandas(work, "path string, problem string")
