"""Problem 3: text that was decoded with the wrong character encoding.

A hidden Markov model labels characters: one clean state, and one state per
pair of true and wrong encoding. A state's emissions are those of clean text
sent through its pair; a labelled span is given back by its state's inverse.
The model is fitted on every value, by counts that add up over the rows; every
value is labelled.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.llm.chapters import table
from inkloom.session import spread

#: Encodings of the texts, and those that texts are misread with: of single bytes, and those whose misreading of a character
#: depends on its neighbours. Every pair of them is a state (fixed values).
TRUE = ("utf-8", "gb18030", "cp950")
SINGLE = (
    "latin-1 iso8859-2 iso8859-3 iso8859-4 iso8859-5 iso8859-7 iso8859-9 iso8859-10 iso8859-13 iso8859-14 iso8859-15 iso8859-16 "
    "cp1250 cp1251 cp1252 cp1253 cp1254 cp1257 cp1258 cp437 cp850 cp852 cp855 cp858 cp866 cp874 "
    "koi8-r koi8-u mac-roman mac-cyrillic mac-greek mac-latin2 mac-turkish"
).split()
DOUBLE = ("utf-8", "gb18030", "cp950", "cp932", "cp949", "euc_jp")
#: The encoding of which letters can be second bytes.
LETTERED = "cp950"
#: Encodings that texts are misread with twice over, and that show what a misreading to replacement marks left (fixed values).
TWICE, SHOWN = ("latin-1", "cp1252"), ("gb18030", "latin-1", "cp1252")


def pairs() -> tuple[tuple[str, ...], ...]:
    """States of garbled text: encodings by turns true and wrong, the last misreading last."""
    once = [(true, wrong) for true in TRUE for wrong in (*SINGLE, *DOUBLE) if true != wrong]
    twice = [("utf-8", wrong) * 2 for wrong in TWICE]
    return (*once, *twice, *(("utf-8", "utf-8-lost", wrong) for wrong in SHOWN), ("lost",))


PAIRS = pairs()

#: What is taken for known before the texts are read: one misread span in so many characters, of so many characters; and the floor of emissions.
ENTERED, LENGTH, FLOOR = 100_000, 100, 1e-7
#: States that are tried for a span whose bytes its likeliest state can't have given.
TRIED = 16
#: Log-odds of a sign of a block that a pair never gives.
UNSEEN = math.log(FLOOR) + 9.0
#: Characters that are counted, and that are labelled, at once.
COUNTED, LABELLED = 1 << 16, 1 << 16
#: Signs that no text holds are smoothed over blocks of this many code points.
BLOCK = 256
#: A character is suspect from this log-odds of a garbled state over the clean one. A lone suspect sign in a line may be a rare
#: one; a line with so many on end is garbled itself, and kept out of the clean texts.
SUSPECT, RUN = 3.0, 3
LOST = "�"
#: Signs of clean texts that misreadings have too (fixed values); wide ASCII is treated alike.
NEUTRAL = "·　©»"
#: Largest share of Latin letters without marks in a misread span; words of Latin languages have more.
FOREIGN = 0.3
#: Latin letters, and so many signs on either side that tell whether they stand among Latin words.
LATIN, BESIDE = re.compile("[A-Za-zÀ-ÖØ-öø-ɏḀ-ỿ]+"), 12
#: A single replacement mark at the end of a string is a cut, not a wrong encoding.
CUT = "\x03"


def misread(text: str, pair: tuple[str, ...]) -> str:
    """Clean text as it looks after the pair's misreading."""
    if pair == ("lost",):
        return LOST
    if "utf-8-lost" in pair:
        return decode((LOST * max(1, len(text.encode()) // 2)).encode(), pair[-1])
    for true, wrong in zip(pair[::2], pair[1::2]):
        text = decode(encode(text, true), wrong)
    return text


#: Bytes of single-byte encodings without a character stand for the control with the same number, as browsers have it.
def decode(data: bytes, name: str) -> str:
    if name in DOUBLE:
        return data.decode(name, "replace")
    return "".join(_single(name)[b] for b in data)


def encode(text: str, name: str) -> bytes:
    if name in DOUBLE:
        return text.encode(name, "ignore")
    back = _back(name)
    return bytes(back[c] for c in text if c in back)


_tables: dict[str, list[str]] = {}
_backs: dict[str, dict[str, int]] = {}


def _back(name: str) -> dict[str, int]:
    if name not in _backs:
        _backs[name] = {c: b for b, c in enumerate(_single(name))}
    return _backs[name]


def _single(name: str) -> list[str]:
    if name not in _tables:
        _tables[name] = [bytes([b]).decode(name, "replace").replace(LOST, chr(b)) for b in range(256)]
    return _tables[name]


def restore(text: str, pair: tuple[str, ...]) -> tuple[str, bool]:
    """The span's original text, and whether nothing was lost."""
    if pair == ("lost",) or "utf-8-lost" in pair:
        return text, False
    whole = True
    for wrong, true in zip(pair[::-2], pair[-2::-2]):
        pieces = []
        for part in re.split(f"({LOST}+)", text):
            if part.startswith(LOST):
                pieces.append(b"\xff" if wrong != "utf-8" else b"?")
                whole = False
                continue
            try:
                pieces.append(part.encode(wrong) if wrong in DOUBLE else bytes(_back(wrong)[c] for c in part))
            except (UnicodeError, KeyError):
                return text, False
        data = b"".join(pieces)
        try:
            text = data.decode(true)
        except UnicodeError:
            text, whole = data.decode(true, "replace"), False
    return text, whole


@dataclass
class Labels:
    """Log-odds of each garbled state over the clean one, by character."""

    odds: dict[str, np.ndarray]
    rest: np.ndarray
    #: Whether a code point is suspect.
    suspects: np.ndarray | None = field(default=None)
    usual: dict[str, float] = field(default_factory=dict)
    #: Log-probabilities of entering and of leaving a garbled state.
    enter: float = -math.log(ENTERED)
    leave: float = -math.log(LENGTH)

    def clean(self, text: str) -> float:
        """Mean log-probability in clean text of the characters that aren't ASCII; lost ones don't count."""
        kept = [self.usual.get(c, -14.0) for c in text if c != LOST and not c.isascii() and not c.isspace()]
        return sum(kept) / len(kept) if kept else -14.0

    def likelier(self, text: str, span: str) -> bool:
        """Whether a span was the text: as clean text that is likelier sign by sign, and as a whole even with what a misread span costs."""

        def whole(x: str) -> float:
            return sum(self.usual.get(c, -14.0) for c in x if c != LOST and not c.isascii() and not c.isspace())

        return self.clean(text) > self.clean(span) + 1 and whole(text) + self.enter + self.leave > whole(span)

    def inverse(self, span: str, states: list[int]) -> tuple[str, bool] | None:
        """A span's text by its state's inverse, and whether nothing was lost.

        ``states`` are the span's states, likeliest first; the first whose
        inverse is whole is the one that gave it, as the labels of single
        characters don't know which bytes make a character. None if the
        inverse isn't likelier than the span itself: then it was clean. Spans
        of which the misreading kept nothing have no such check.
        """
        if sum(c.isascii() and c.isalpha() for c in span) > FOREIGN * len(span):
            # Letters can be second bytes of one encoding only; else these are words of a Latin language.
            states = [k for k in states if PAIRS[k][0] == LETTERED]
            if not states:
                return None
        first = PAIRS[states[0]]
        if "lost" in first or "utf-8-lost" in first or first[-1] == "utf-8":
            return restore(span, first)
        for state in states:
            text, whole = restore(span, PAIRS[state])
            if whole and self.likelier(text, span):
                return text, True
        text, whole = restore(span, first)
        return (text, whole) if self.likelier(text, span) else None

    def spans(self, text: str) -> list[tuple[int, int, list[int]]]:
        """Garbled spans ``(start, end, states)`` of the best path (Viterbi): its state, then others by how well they give the span."""
        return self.paths([text])[0]

    def paths(self, texts: list[str]) -> list[list[tuple[int, int, list[int]]]]:
        """`spans` of each text; texts of like length are labelled at once."""
        found, order = [[] for _ in texts], sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        at = 0
        while at < len(order) and texts[order[at]]:
            some = order[at : at + max(1, LABELLED // len(texts[order[at]]))]
            at += len(some)
            for i, path in zip(some, self._paths([texts[i] for i in some])):
                found[i] = [(a, b, [k, *(x for x in self.likeliest(texts[i][a:b]) if x != k)]) for a, b, k in path]
        return found

    def _paths(self, texts: list[str]) -> Iterator[list[tuple[int, int, int]]]:
        """``(start, end, state)`` of the spans of texts, longest first."""
        n, size, states = len(texts[0]), len(texts), len(PAIRS)
        signs = {c: k for k, c in enumerate(sorted(set().union(*texts)))}
        odds = np.array([self.odds.get(c, self.rest) for c in signs], dtype=float)
        rows = np.zeros((n, size), np.int32)
        for j, text in enumerate(texts):
            rows[: len(text), j] = [signs[c] for c in text]
        long = np.array(list(map(len, texts)))
        clean_, garbled_ = np.zeros(size), np.full((size, states), -np.inf)
        entered = np.zeros((n, size, states), dtype=bool)
        came = np.full((n, size), -1)
        for i in range(n):
            on = int((long > i).sum())
            clean, garbled = clean_[:on], garbled_[:on]
            top = garbled.argmax(axis=1)
            out = garbled[np.arange(on), top] + self.leave
            enter = (clean + self.enter)[:, None]
            np.greater(enter, garbled, out=entered[i, :on])
            np.maximum(garbled, enter, out=garbled)
            garbled += odds[rows[i, :on]]
            left = np.flatnonzero(out > clean)
            clean[left], came[i, left] = out[left], top[left]
        last = garbled_.argmax(axis=1)
        inside = garbled_[np.arange(size), last] + self.leave > clean_
        some = inside | (came >= 0).any(axis=0)
        for j in range(size):
            found, end = [], int(long[j])
            state = int(last[j]) if inside[j] else -1
            for i in range(end - 1, -1, -1) if some[j] else ():
                if state >= 0:
                    if entered[i, j, state]:
                        found.append((i, end, state))
                        state, end = -1, i
                elif came[i, j] >= 0:
                    # The clean character at i follows a garbled one.
                    state, end = int(came[i, j]), i
            if state >= 0:
                found.append((0, end, state))
            yield found[::-1]

    def likeliest(self, span: str) -> list[int]:
        """States by how well they give a span, at most `TRIED`."""
        emit = np.array([self.odds.get(c, self.rest) for c in span], dtype=float)
        return np.argsort(-emit.sum(axis=0), kind="stable")[:TRIED].tolist()

    def original(self, text: str, start: int, end: int, states: list[int]) -> tuple[int, int, str, bool] | None:
        """A labelled span, what it was, and whether nothing was lost; None if it was clean.

        Signs that clean texts have too count neither way in the labelling, so
        that a span may start or end behind them: if its inverse isn't whole, up
        to two more on either side are tried.
        """
        beside = text[max(0, start - BESIDE) : start] + text[end : end + BESIDE]
        if LATIN.fullmatch(text[start:end]) and 2 * sum(c.isascii() and c.isalpha() for c in beside) > len(beside):
            # Letters with marks among Latin words are words themselves.
            return None
        first = None
        for a, b in ((0, 0), (1, 0), (0, 1), (1, 1), (2, 0), (0, 2)):
            edge = text[max(0, start - a) : start] + text[end : end + b]
            plain = any(c.isascii() for c in edge) and PAIRS[states[0]][0] != LETTERED
            if len(edge) < a + b or plain or LOST in edge:
                continue
            back = self.inverse(text[start - a : end + b], states)
            if back is not None and back[1]:
                return start - a, end + b, back[0], True
            if (a, b) == (0, 0):
                first = back
                if LOST in text[start:end]:
                    break
        if first is None:
            # Where no other state gave the span, replacement marks in it, but for one at a cut, are lost signs.
            marks = [k for k in range(start, end) if text[k] == LOST and not re.fullmatch(r"\W?", text[k + 1 :])]
            return (marks[0], marks[-1] + 1, text[marks[0] : marks[-1] + 1], False) if marks else None
        return start, end, first[0], False

    def find(self, value: str | None) -> list[tuple[int, int, str, bool]]:
        """Garbled spans over a whole value with what they were and whether nothing was lost."""
        return self.find_all([value])[0]

    def find_all(self, values: list[str | None]) -> list[list[tuple[int, int, str, bool]]]:
        """`find` of each value. Only strings of a value with a suspect character are labelled."""
        pieces = []
        for k, value in enumerate(values):
            end = 0
            for at in runs(value, self.suspects) if value else ():
                if at >= end:
                    start, end = value.rfind('"', 0, at) + 1, value.find('"', at) + 1 or len(value)
                    pieces.append((k, start, value[start:end]))
        found = [[] for _ in values]
        paths = self.paths([re.sub(f"(?<!{LOST}){LOST}(?=\\W?$)", CUT, piece) for *_, piece in pieces])
        for (k, at, piece), path in zip(pieces, paths):
            for start, end, states in path:
                if (span := self.original(piece, start, end, states)) is not None:
                    found[k].append((at + span[0], at + span[1], *span[2:]))
        return found


def repaired(value: str | None, model: Labels) -> tuple[str, bool] | None:
    """The value with each garbled span's original text, and whether nothing was lost; None if nothing is garbled."""
    return repaired_all([value], model)[0]


def repaired_all(values: list[str | None], model: Labels) -> list[tuple[str, bool] | None]:
    """`repaired` of each value."""
    return [mended(value, spans) if spans else None for value, spans in zip(values, model.find_all(values))]


def mended(value: str, spans: list[tuple[int, int, str, bool]]) -> tuple[str, bool]:
    """A value with its spans' original texts, and whether nothing was lost."""
    out, at = [], 0
    for start, end, text, _ in spans:
        out += [value[at:start], text]
        at = end
    return "".join(out) + value[at:], all(complete for *_, complete in spans)


def points(text: str) -> np.ndarray:
    """The code points of a text."""
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)
    if len(units) > len(text):
        # Signs beyond the basic plane.
        units = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return units


def runs(text: str, known: np.ndarray, length: int = 1) -> list[int]:
    """Where so many known signs on end start; ``known`` has all code points."""
    told = known[points(text)]
    for _ in range(length - 1):
        # Starts of runs that are longer by one.
        told[:-1] &= told[1:]
        told[-1:] = False
    return np.flatnonzero(told).tolist()


def counted(text: str) -> Counter:
    """How often each sign occurs."""
    return signs(np.bincount(points(text)))


def signs(many: np.ndarray) -> Counter:
    at = np.flatnonzero(many)
    return Counter(dict(zip(map(chr, at.tolist()), many[at].tolist())))


#: The count of the texts as they are, beside those of the pairs by their number in `PAIRS`.
CLEAN = -1
#: Pairs whose misreading depends on neighbours: counted over whole lines. The others' counts follow from those of the characters.
NEIGHBOURED = tuple(k for k, pair in enumerate(PAIRS) if pair[-1] in DOUBLE and "utf-8-lost" not in pair)


def tally(lines: Iterable[str]) -> dict[int, Counter]:
    """Signs of the lines as they are and as each pair of `NEIGHBOURED` misreads them; those of several parts of the lines add up."""
    counts = {k: np.zeros(0, np.int64) for k in (CLEAN, *NEIGHBOURED)}

    def add(k: int, text: str) -> None:
        more = np.bincount(points(text))
        if len(more) > len(counts[k]):
            counts[k] = np.pad(counts[k], (0, len(more) - len(counts[k])))
        counts[k][: len(more)] += more

    for part in portions(lines):
        add(CLEAN, "".join(part))
        # No misreading gives a line feed of its own or reads over one.
        wide = "\n".join(t for x in part if (t := _PLAIN.sub("", x)))
        data = {true: encode(wide, true) for true in TRUE}
        for k in NEIGHBOURED:
            true, wrong = PAIRS[k]
            add(k, decode(data[true], wrong))
    for k in NEIGHBOURED:
        counts[k][ord("\n") : ord("\n") + 1] = 0
    return {k: signs(n) for k, n in counts.items()}


#: What every misreading leaves alone, or has lost.
_PLAIN = re.compile(f"[\x00-\x7f{LOST}]+")


def portions(lines: Iterable[str]) -> Iterator[list[str]]:
    """The lines in lists of about `COUNTED` characters."""
    part, size = [], 0
    for line in lines:
        part.append(line)
        size += len(line)
        if size >= COUNTED:
            yield part
            part, size = [], 0
    if part:
        yield part


def emitted(counts: dict[int, Counter], characters: Counter, k: int) -> Counter:
    """What a pair makes of all the lines: counted, or from their characters by count where neighbours don't matter."""
    if k in NEIGHBOURED:
        return counts[k]
    if PAIRS[k][-1] in DOUBLE:
        found = counted(misread("中" * 1000, PAIRS[k]))
        del found["\n"]
        return found
    found = Counter()
    for c, n in characters.items():
        for g in misread(c, PAIRS[k]):
            found[g] += n
    return found


def by_block(counts: Counter) -> dict[int, float]:
    """Probability of each sign of a block that was not seen (Witten-Bell within the block)."""
    size, tokens, types = sum(counts.values()) or 1, Counter(), Counter()
    for c, n in counts.items():
        tokens[ord(c) // BLOCK] += n
        types[ord(c) // BLOCK] += 1
    return {b: n / size * types[b] / (n + types[b]) / max(1, BLOCK - types[b]) for b, n in tokens.items()}


def without(counts: dict[int, Counter], some: dict[int, Counter]) -> dict[int, Counter]:
    """Counts without those of some of the lines."""
    return {k: counts[k] - some[k] for k in counts}


def moved(labels: Labels, spans: int, inside: int, size: int) -> Labels:
    """The model with its transitions: how often spans begin and how long they are, by what it finds in texts of so many characters."""
    labels.enter = math.log((spans + 1) / (size - inside + ENTERED))
    labels.leave = math.log((spans + 1) / (inside + LENGTH))
    return labels


def learn(texts: list[str]) -> Labels:
    """Fit the emissions: clean ones by counting, each pair's by misreading the clean texts; then the transitions by labelling them."""
    counts = tally(texts)
    suspects = emissions(counts).suspects
    # Without the lines that are garbled themselves, the clean state is clean.
    labels = emissions(without(counts, tally(t for t in texts if runs(t, suspects, RUN))))
    spans = [end - start for found in labels.find_all(texts) for start, end, *_ in found]
    return moved(labels, len(spans), sum(spans), counts[CLEAN].total())


def emissions(sums: dict[int, Counter]) -> Labels:
    """The model of counted texts, with transitions as taken for known."""
    clean = sums[CLEAN]
    total = sum(clean.values()) or 1
    wide = Counter({c: n for c, n in clean.items() if ord(c) > 127 and c != LOST})
    plain = total - sum(wide.values())
    counts = [emitted(sums, wide, k) for k in range(len(PAIRS))]
    sizes = np.array([sum(g.values()) or 1 for g in counts])
    # What every misreading leaves alone is as frequent in garbled text as its share of what comes out, never more than in clean text.
    alone = np.minimum(np.log(total / (plain + sizes)), 0)
    alone[PAIRS.index(("lost",))] = math.log(FLOOR) / 2
    odds = {}
    alphabet = list(set(clean).union(*counts))
    row = {c: k for k, c in enumerate(alphabet)}
    seen = np.zeros((len(alphabet), len(PAIRS)), np.float32)
    for k, garbled in enumerate(counts):
        seen[[row[c] for c in garbled], k] = np.fromiter(garbled.values(), float, len(garbled)) / sizes[k]
    usual_ = np.array([clean.get(c, 0) / total for c in alphabet])
    ratio = np.log(np.maximum(seen, FLOOR)) - np.log(np.maximum(usual_, FLOOR))[:, None].astype(np.float32)
    for c, k in row.items():
        if c.isascii() or c in NEUTRAL or "！" <= c <= "～":
            odds[c] = alone.astype(np.float32)
        else:
            odds[c] = ratio[k] if c != LOST else np.log(np.maximum(seen[k], FLOOR)) - np.float32(math.log(1e-12))
    blocks, usual = [by_block(g) for g in counts], by_block(clean)
    for block in set().union(*blocks):
        q = np.array([s.get(block, 0.0) for s in blocks])
        q = np.log(np.maximum(q, FLOOR)) - math.log(max(usual.get(block, 0.0), FLOOR))
        # A pair that makes no sign of the block is against it as against any unseen sign.
        q = np.where([block in s for s in blocks], q, UNSEEN).astype(np.float32)
        for c in map(chr, range(block * BLOCK, (block + 1) * BLOCK)):
            if not (c in odds or c.isascii() or c in NEUTRAL or "！" <= c <= "～" or "\ud800" <= c <= "\udfff"):
                odds[c] = q
    odds[CUT] = np.full(len(PAIRS), -2.0, np.float32)
    suspects = np.zeros(0x110000, bool)
    suspects[[ord(c) for c, o in odds.items() if o.max() > SUSPECT and not c.isascii()]] = True
    return Labels(
        odds,
        np.full(len(PAIRS), UNSEEN, np.float32),
        suspects,
        {c: math.log(n / total) for c, n in clean.items()},
    )


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chapters").select("book_id", "number", "title", "source")


#: Strings of a source.
STRING = re.compile(r'"([^"\\]*(?:\\.[^"\\]*)*)"')


def lines_of(batch: pd.DataFrame, known: np.ndarray | None = None, length: int = 1) -> Iterator[str]:
    """Titles and strings of sources; with ``known`` only those with so many known signs on end (see `runs`)."""
    for source in batch["source"]:
        if source and known is None:
            yield from STRING.findall(source)
        elif source and (at := runs(source, known, length)):
            # No run crosses a quotation mark.
            spans = [m.span(1) for m in STRING.finditer(source)]
            yield from (source[a:b] for a, b in spans if (k := bisect_left(at, a)) < len(at) and at[k] < b)
    yield from (title for title in batch["title"] if title and (known is None or runs(title, known, length)))


def tallied(chapters: DataFrame, known: np.ndarray | None = None) -> dict[int, Counter]:
    """`tally` of all lines, or of those with `RUN` known signs on end: as many numbers as there are signs, whatever the rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = tally(line for batch in batches for line in lines_of(batch, known, RUN))
        for k, signs in found.items():
            yield pd.DataFrame({"k": k, "sign": list(map(ord, signs)), "n": list(signs.values())})

    sums = chapters.mapInPandas(count, "k int, sign int, n long").groupBy("k", "sign").agg(F.sum("n").alias("n")).toPandas()
    counts = {k: Counter() for k in (CLEAN, *NEIGHBOURED)}
    for k, part in sums.sort_values(["k", "sign"]).groupby("k"):
        counts[k] = Counter(dict(zip(map(chr, part["sign"].tolist()), part["n"].tolist())))
    return counts


def fitted(spark: SparkSession, sf_dir: str) -> Labels:
    """The model of every title and source, as `learn` has it; the same rows give the same model."""
    chapters = spread(values(spark, sf_dir).select("title", "source"))
    counts = tallied(chapters)
    labels = emissions(without(counts, tallied(chapters, emissions(counts).suspects)))
    shared = spark.sparkContext.broadcast(labels)

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = shared.value
        for batch in batches:
            spans = [end - start for found in tool.find_all(list(lines_of(batch, tool.suspects))) for start, end, *_ in found]
            yield pd.DataFrame({"spans": [len(spans)], "inside": [sum(spans)]})

    found = chapters.mapInPandas(label, "spans long, inside long").agg(F.sum("spans"), F.sum("inside")).first()
    return moved(labels, found[0] or 0, found[1] or 0, counts[CLEAN].total())


def find(chapters: DataFrame, model: Labels) -> DataFrame:
    """``book_id, number, field, restored, whole`` of every garbled title and source.

    ``restored`` is the value with each span's inverse transform, ``whole``
    whether nothing was lost. Null and empty values are never garbled; a lone
    replacement mark at the end of a string isn't either. Repeated rows repeat.
    """
    shared = chapters.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = shared.value
        for batch in batches:
            rows = []
            for name in ("title", "source"):
                for book, number, found in zip(batch["book_id"], batch["number"], repaired_all(batch[name].tolist(), tool)):
                    if found is not None:
                        rows.append((book, number, name, *found))
            yield pd.DataFrame(rows, columns=["book_id", "number", "field", "restored", "whole"])

    return chapters.mapInPandas(label, "book_id string, number long, field string, restored string, whole boolean")


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``book_id, number, field, restored, whole`` of every garbled value, once."""
    return find(spread(values(spark, sf_dir)), fitted(spark, sf_dir)).distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``book_id, number, field`` of every value garbled in whole or in part."""
    return find(spread(values(spark, sf_dir)), fitted(spark, sf_dir)).select("book_id", "number", "field").distinct()
