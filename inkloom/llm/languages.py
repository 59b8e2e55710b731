"""Problem 9: languages of documents and of stretches of lines, with confidence.

A linear-chain conditional random field over words. Node features are hashed:
affixes and character n-grams, the word itself, its script, and the languages
whose lexicon holds it; edges are transitions within a line and between lines.
The node weights are fitted alone first, then nodes and transitions together by
the gradient of the sequences' likelihood (forward-backward), on a bounded
sample of labelled documents. The sample is fitted in a fixed number of shards
at once, whose weights are mixed after each round. Words are labelled by
forward-backward; a line has the language with the largest sum of its words'
marginals, and equal neighbours form a stretch. Every document is labelled whole.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.session import cut, small, spread

#: Bounds of the model: labelled documents that it is fitted on, drawn by hash and evenly over languages; characters of them
#: all; and of one text, which gives whole lines up to that.
SAMPLE, SAMPLE_CHARS = 4000, 2_500_000
LONG_TEXT = SAMPLE_CHARS // 50
#: Parts of the sample that are fitted at once; words of a sequence in training; epochs of nodes alone, and with transitions.
SHARDS, SEGMENT, EPOCHS = 8, 48, (2, 1)
#: Words in the lexicons at most, and documents of a language from which a word is in its lexicon.
LEXICON, LISTED = 60_000, 3
BITS = 18
#: Longest word; runs without spaces are cut into pieces of this many letters.
PIECE, LONGEST = 3, 24
#: Weight of a word's script among its features.
SCRIPT = 3
#: Documents that are labelled together.
BLOCK = 256

#: Words: runs of one script; scripts without spaces in pieces.
WORDS = regex.compile(
    r"[\p{Hiragana}\p{Katakana}ー]+|\p{Han}+|\p{Hangul}+|[\p{L}\p{M}&&[^\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]]+",
    regex.V1,
)
_PRIME = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D], dtype=np.uint64)


def words_of(line: str) -> list[str]:
    out = []
    for word in WORDS.findall(line):
        size = PIECE if ord(word[0]) >= 0x2E80 else LONGEST
        if len(word) <= size:
            out.append(word)
        else:
            out += [word[k : k + size] for k in range(0, len(word), size)]
    return out


def features(words: list[str], lexicon: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(feature, word) arrays: 1-4-grams with the word's ends (affixes among them), the word, its script, and its lexicons."""
    text = "".join(f"\x02{w}\x03" for w in words)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    owner = np.repeat(np.arange(len(words)), sizes)
    bound = np.uint64((1 << BITS) - 1)
    out, of = [], []
    mixed = points * _PRIME[0]
    for n in range(1, 5):
        if n > 1:
            mixed = mixed[:-1] * _PRIME[n - 1] ^ (points[n - 1 :] * _PRIME[n])
        same = owner[: len(mixed)] == owner[n - 1 :]
        out.append((mixed[same] * _PRIME[5] >> np.uint64(40)) & bound)
        of.append(owner[: len(mixed)][same])
    # The word as a whole.
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    position = np.arange(len(points)) - np.repeat(start, sizes)
    whole = np.add.reduceat((points + np.uint64(1)) * (position.astype(np.uint64) * _PRIME[1] + _PRIME[2]), start)
    out.append((whole * _PRIME[3] >> np.uint64(40)) & bound)
    of.append(np.arange(len(words)))
    # The script, by blocks of code points, several times over: it must outweigh n-grams never seen.
    block = points[start + 1] // np.uint64(0x80)
    block = np.where((block >= 0x68) & (block < 0x140), np.uint64(0x68), block)
    script = ((block + np.uint64(7)) * _PRIME[4] >> np.uint64(30)) & bound
    out += [script] * SCRIPT
    of += [np.arange(len(words))] * SCRIPT
    # The set of languages whose lexicon holds the word.
    held = np.array([lexicon.get(w, 0) for w in words] if lexicon else [], dtype=np.uint64)
    if held.any():
        listed = np.flatnonzero(held)
        out.append(((held[listed] + np.uint64(11)) * _PRIME[1] >> np.uint64(28)) & bound)
        of.append(listed)
    return np.concatenate(out).astype(np.int64), np.concatenate(of)


def _rows_normal(edges: np.ndarray) -> np.ndarray:
    return np.exp(edges - np.logaddexp.reduce(edges, axis=1, keepdims=True))


class Crf:
    """Weights of the node factors and log transitions, with the languages they are of and their lexicons."""

    #: Least log node factor: no single word outweighs a line.
    LEAST = -7.0

    def __init__(self, languages: list[str], lexicon: dict[str, int] | None = None):
        self.languages, self.lexicon = languages, lexicon or {}
        k = len(languages)
        self.weights = np.zeros((1 << BITS, k), dtype=np.float32)
        self.bias = np.zeros(k)
        self.edges = np.full((k, k), np.log(1e-3))
        np.fill_diagonal(self.edges, 0.0)
        # Transitions from a line's last word to the next line's first.
        self.breaks = np.full((k, k), np.log(1e-2))
        np.fill_diagonal(self.breaks, 0.0)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.factors = np.empty((0, len(self.languages)))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "factors")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.clear()

    def scored(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Log node factors of words, and the features, words and scales that they come from."""
        feature, of = features(words, self.lexicon)
        scale = 1 / np.sqrt(np.bincount(of, minlength=len(words)))
        score = np.stack([np.bincount(of, weights=self.weights[feature, c], minlength=len(words)) for c in range(len(self.languages))], axis=1)
        score = score * scale[:, None] + self.bias
        return score - np.logaddexp.reduce(score, axis=1, keepdims=True), feature, of, scale

    def nodes(self, words: list[str]) -> np.ndarray:
        """Log node factors of each word; words are scored once."""
        if len(self.known) > 400_000:
            self.clear()
        number, start = self.known, len(self.known)
        at = [number.setdefault(w, len(number)) for w in words]
        if len(number) > start:
            fresh = list(number)[start:]
            parts = [np.maximum(self.scored(fresh[k : k + 20_000])[0], self.LEAST) for k in range(0, len(fresh), 20_000)]
            self.factors = np.concatenate([self.factors, *parts])
        return self.factors[at]

    def chain(self, emit: np.ndarray, fresh: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward-backward over padded sequences (time, sequence, language).

        Marginals, and expected transitions within lines and between them.
        """
        inside, across = _rows_normal(self.edges), _rows_normal(self.breaks)
        longest, count, k = emit.shape
        forward = np.empty_like(emit)
        now = emit[0] / k
        forward[0] = now / now.sum(axis=1, keepdims=True)
        for t in range(1, longest):
            now = np.where(fresh[t], forward[t - 1] @ across, forward[t - 1] @ inside) * emit[t]
            forward[t] = now / now.sum(axis=1, keepdims=True)
        back = np.ones((count, k))
        both, messages = np.empty_like(emit), np.empty_like(emit)
        for t in range(longest - 1, -1, -1):
            both[t] = forward[t] * back
            # Behind a sequence's end nothing is known: the message stays flat there.
            messages[t] = back * emit[t]
            step = np.where(fresh[t], messages[t] @ across.T, messages[t] @ inside.T)
            back = np.where((t < sizes)[:, None], step / step.sum(axis=1, keepdims=True), 1.0)
        both /= both.sum(axis=2, keepdims=True)
        return both, forward, messages

    def padded(self, documents: list[np.ndarray | list], lines: list[np.ndarray] | None, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(d) for d in documents])
        emit = np.ones((int(sizes.max()), len(documents), len(self.languages)))
        fresh = np.zeros((len(emit), len(documents), 1), bool)
        start = np.concatenate([[0], np.cumsum(sizes)])
        for j in range(len(documents)):
            emit[: sizes[j], j] = factors[start[j] : start[j + 1]]
            if lines is not None:
                fresh[1 : sizes[j], j, 0] = np.diff(lines[j]) > 0
        return emit, fresh, sizes

    def marginals(self, documents: list[list[str]], lines: list[np.ndarray] | None = None) -> list[np.ndarray]:
        """Marginals of each document's words; documents of like length go together.

        ``lines`` has the line of each word; without it a document is one line.
        """
        out: list[np.ndarray] = [np.empty((0, len(self.languages)))] * len(documents)
        order = sorted((i for i, d in enumerate(documents) if d), key=lambda i: len(documents[i]))
        for at in range(0, len(order), BLOCK):
            block = order[at : at + BLOCK]
            flat = np.exp(self.nodes([w for i in block for w in documents[i]]))
            emit, fresh, sizes = self.padded([documents[i] for i in block], [lines[i] for i in block] if lines is not None else None, flat)
            both, _, _ = self.chain(emit, fresh, sizes)
            for j, i in enumerate(block):
                out[i] = both[: sizes[j], j]
        return out

    def train(self, documents: list[list[str]], lines: list[np.ndarray], labels: list[np.ndarray], epochs: int, chained: bool, seed: int, rate: float = 0.5) -> np.ndarray:
        """Fit by AdaGrad on labelled words; ``chained`` fits nodes and transitions together by the gradient of the sequences.

        Returns which features were seen.
        """
        k = len(self.languages)
        pieces = [(i, a) for i, d in enumerate(documents) for a in range(0, len(d), SEGMENT)]
        pieces.sort(key=lambda x: min(SEGMENT, len(documents[x[0]]) - x[1]))
        batches = [pieces[at : at + 96] for at in range(0, len(pieces), 96)]
        size = np.full((1 << BITS, k), 1e-6, np.float32)
        sizes_e = np.full((2, k, k), 1e-2)
        random = np.random.default_rng(seed)
        for _ in range(epochs):
            for b in random.permutation(len(batches)):
                parts = [documents[i][a : a + SEGMENT] for i, a in batches[b]]
                truth = [labels[i][a : a + SEGMENT] for i, a in batches[b]]
                number: dict[str, int] = {}
                at = np.array([number.setdefault(w, len(number)) for part in parts for w in part])
                factors, feature, of, scale = self.scored(list(number))
                answer = np.concatenate(truth)
                if chained:
                    where = [lines[i][a : a + SEGMENT] for i, a in batches[b]]
                    emit, fresh, sizes = self.padded(parts, where, np.exp(np.maximum(factors, self.LEAST))[at])
                    both, forward, messages = self.chain(emit, fresh, sizes)
                    error = np.concatenate([both[:n, j] for j, n in enumerate(sizes)])
                    self.step_edges(forward, messages, fresh, sizes, truth, where, sizes_e)
                else:
                    error = np.exp(factors)[at]
                error[np.arange(len(at)), answer] -= 1
                error = np.stack([np.bincount(at, weights=error[:, c], minlength=len(number)) for c in range(k)], axis=1)
                used, inverse = np.unique(feature, return_inverse=True)
                scaled = error * scale[:, None]
                grad = np.stack([np.bincount(inverse, weights=scaled[of, c], minlength=len(used)) for c in range(k)], axis=1)
                size[used] += (grad * grad).astype(np.float32)
                self.weights[used] -= (rate * grad / np.sqrt(size[used])).astype(np.float32)
                self.bias -= 0.01 * error.sum(axis=0) / len(at)
        self.clear()
        return size.max(axis=1) > 2e-6

    def step_edges(self, forward, messages, fresh, sizes, truth, where, squares, rate: float = 0.3) -> None:
        """One step of both kinds of transitions along expected minus observed counts."""
        k = len(self.languages)
        count = max(int(sizes.sum()), 1)
        for kind, (name, value) in enumerate((("edges", self.edges), ("breaks", self.breaks))):
            steps = _rows_normal(value)
            live = (np.arange(1, len(forward))[:, None] < sizes[None, :]) & (fresh[1:, :, 0] == bool(kind))
            if not live.any():
                continue
            left, right = forward[:-1][live], messages[1:][live]
            weight = ((left @ steps) * right).sum(axis=1)
            expected = steps * (left.T @ (right / weight[:, None]))
            observed = np.zeros((k, k))
            for labels, line in zip(truth, where):
                if len(labels) > 1:
                    of_kind = (np.diff(line) > 0) == bool(kind)
                    np.add.at(observed, (labels[:-1][of_kind], labels[1:][of_kind]), 1)
            # Rows are normalised: only how a row's mass is spread counts.
            grad = (expected - observed) - steps * (expected - observed).sum(axis=1, keepdims=True)
            grad = grad / count * 100
            squares[kind] += grad * grad
            setattr(self, name, value - rate * grad / np.sqrt(squares[kind]))


def folded(text: str) -> str:
    return unicodedata.normalize("NFC", text).lower()


def lines_words(text: str | None) -> tuple[list[str], np.ndarray]:
    """A document's words and the line (from 0) of each."""
    words, at = [], []
    for k, line in enumerate(folded(text).split("\n") if text else ()):
        found = words_of(line)
        words += found
        at += [k] * len(found)
    return words, np.array(at, dtype=int)


def stretches(model: Crf, texts: list[str | None]) -> list[list[tuple[int, str, float]]]:
    """``(first line from 1, language, confidence)`` of each text's stretches; none for a text without letters."""
    split = [lines_words(t) for t in texts]
    out = []
    for (words, at), marginal in zip(split, model.marginals([w for w, _ in split], [at for _, at in split])):
        found: list[list] = []
        if words:
            weight = np.array([len(w) for w in words], dtype=float)
            lines, index = np.unique(at, return_inverse=True)
            # A line that only repeats one word (laughter, a run of one letter) has no language of its own, if another line has.
            spans = zip(np.searchsorted(at, lines), np.searchsorted(at, lines, "right"))
            sames = np.array([k - j >= 3 and len(set(words[j : k - 1])) == 1 and words[j].startswith(words[k - 1]) for j, k in spans])
            total = np.stack([np.bincount(index, weights=marginal[:, c] * weight) for c in range(marginal.shape[1])], axis=1)
            size = np.bincount(index, weights=weight)
            best = total.argmax(axis=1)
            for k, line in enumerate(lines):
                share = total[k, best[k]]
                if sames[k] and not sames.all():
                    continue
                if found and found[-1][1] == best[k]:
                    found[-1][2] += share
                    found[-1][3] += size[k]
                else:
                    found.append([int(line) + 1 if found else 1, best[k], share, size[k]])
        out.append([(line, model.languages[c], round(float(p / n), 4)) for line, c, p, n in found])
    return out


def bare(text: str) -> str:
    """Latin text as it looks without its marks."""
    return unicodedata.normalize("NFC", regex.sub(r"\p{Mn}+", "", unicodedata.normalize("NFD", text)).replace("đ", "d").replace("Đ", "D"))


def examples(model: Crf, texts: list[str], labels: list[str], relabel: bool) -> tuple[list, list, list]:
    """Documents, lines and labels of words to train on: each text, and without its marks where it has any.

    With ``relabel`` the model so far corrects the labels: texts that it
    contradicts throughout are left out, and words of mixed ones get the
    language that it finds.
    """
    index = {c: k for k, c in enumerate(model.languages)}
    documents, places, truth = [], [], []
    for text, label in zip(texts, labels):
        words, at = lines_words(text)
        if words:
            plain = [bare(w) for w in words]
            for version in [words] if plain == words else [words, plain]:
                documents.append(version)
                places.append(at)
                truth.append(np.full(len(words), index[label]))
    if not relabel:
        return documents, places, truth
    best = [m.argmax(axis=1) for m in model.marginals(documents, places)]
    agree = [(b == c).mean() for b, c in zip(best, truth)]
    kept = [k for k, share in enumerate(agree) if share >= 0.05]
    return (
        [documents[k] for k in kept],
        [places[k] for k in kept],
        [best[k] if agree[k] < 0.95 else truth[k] for k in kept],
    )


def mixed(model: Crf, parts: list[tuple[Crf, np.ndarray]]) -> Crf:
    """The shards' models in one: each weight is the mean of the shards that saw its feature."""
    seen = np.sum([touched for _, touched in parts], axis=0)
    total = np.sum([np.where(touched[:, None], part.weights, 0) for part, touched in parts], axis=0)
    model.weights = np.where(seen[:, None] > 0, total / np.maximum(seen, 1)[:, None], model.weights).astype(np.float32)
    for name in ("bias", "edges", "breaks"):
        setattr(model, name, np.mean([getattr(part, name) for part, _ in parts], axis=0))
    model.clear()
    return model


def train_shard(model: Crf, texts: list[str], labels: list[str], round_: int, seed: int) -> np.ndarray:
    """One round on one shard: node weights alone, in the second round then with the transitions; returns which features were seen."""
    documents, lines, truth = examples(model, texts, labels, relabel=round_ > 0)
    if round_ == 0:
        return model.train(documents, lines, truth, EPOCHS[0], False, seed)
    # What wrong labels taught is forgotten: the corrected ones are learned from the start.
    model.weights[:], model.bias[:] = 0, 0
    seen = model.train(documents, lines, truth, EPOCHS[0], False, seed)
    return seen | model.train(documents, lines, truth, EPOCHS[1], True, seed + 1)


def lexicons(languages: list[str], counts: list[tuple[str, str, int]]) -> dict[str, int]:
    """Each listed word with the set of its languages as bits, from ``(word, language, documents)``."""
    out: dict[str, int] = {}
    for word, language, n in counts:
        if n >= LISTED:
            out[word] = out.get(word, 0) | 1 << languages.index(language)
    return out


def listed(texts: list[str], labels: list[str]) -> list[tuple[str, str, int]]:
    """``(word, language, documents)`` of texts."""
    counts: Counter = Counter()
    for text, label in zip(texts, labels):
        words = set(lines_words(text)[0])
        counts.update((w, label) for w in words | {bare(w) for w in words})
    return [(w, c, n) for (w, c), n in counts.items()]


def fit(texts: list[str], labels: list[str]) -> Crf | None:
    """Fit on labelled texts in one shard; some labels may be wrong. None without words."""
    if not any(lines_words(t)[0] for t in texts):
        return None
    languages = sorted(set(labels))
    model = Crf(languages, lexicons(languages, listed(texts, labels)))
    for round_ in range(len(EPOCHS)):
        train_shard(model, texts, labels, round_, seed=round_)
    return model


def drawn(spark: SparkSession, sf_dir: str, bound: int = SAMPLE) -> DataFrame:
    """``at, text, code``: the labelled documents that the model is fitted on, drawn by hash and evenly over languages."""
    codes = spark.read.parquet(f"{sf_dir}/lang_codes.parquet").filter("lang is not null").select("label", F.col("lang").alias("code")).dropDuplicates(["label"])
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "doc_id")
    labelled = documents.filter(F.col("text").rlike(r"\p{L}")).join(small(codes), documents["lang"] == codes["label"])
    sizes = labelled.groupBy("code").agg(F.count("*").alias("n"), F.sum(F.least(F.length("text"), F.lit(LONG_TEXT))).alias("chars"))
    # At most as many rows as lang_codes has languages.
    sizes = {r["code"]: (r["n"], r["chars"]) for r in sizes.collect()}
    each, chars = bound / max(len(sizes), 1), SAMPLE_CHARS / max(len(sizes), 1)
    share = [(code, int(min(1.0, each / n, chars / max(c, 1)) * (1 << 50))) for code, (n, c) in sizes.items()]
    shares = spark.createDataFrame(share, "code string, below long")
    start = F.left("text", F.lit(LONG_TEXT))
    lines = F.regexp_replace(start, r"[\r\n][^\r\n]*$", "")
    head = F.when(F.length("text") <= LONG_TEXT, F.col("text")).when(lines.rlike(r"\p{L}"), lines).otherwise(start)
    at = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 50))
    # The same text under the same id counts once, so that no repeated row can fill the sample.
    return (
        labelled.withColumn("at", at).join(F.broadcast(shares), "code").filter(F.col("at") < F.col("below"))
        .groupBy("at", "code").agg(F.min(head).alias("text"))
    )


def fitted(spark: SparkSession, sf_dir: str, bound: int = SAMPLE) -> Crf | None:
    """The model of about ``bound`` documents whose label names a language, fitted in `SHARDS` tasks; None if there are none."""
    sample = cut(drawn(spark, sf_dir, bound).repartition(SHARDS, "at").sortWithinPartitions("at"))
    languages = sorted(r["code"] for r in sample.select("code").distinct().collect())
    if not languages:
        return None

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(listed(batch["text"].tolist(), batch["code"].tolist()), columns=["word", "code", "n"])

    words = sample.mapInPandas(count, "word string, code string, n long").groupBy("word", "code").agg(F.sum("n").alias("n")).filter(F.col("n") >= LISTED)
    model = Crf(languages, lexicons(languages, [tuple(r) for r in words.orderBy(F.desc("n"), "word", "code").limit(LEXICON).collect()]))
    context = spark.sparkContext
    for round_ in range(len(EPOCHS)):
        shared = context.broadcast(model)

        def shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            frames = [batch for batch in batches if len(batch)]
            if frames:
                rows = pd.concat(frames)
                own, k = shared.value, TaskContext.get().partitionId()
                seen = train_shard(own, rows["text"].tolist(), rows["code"].tolist(), round_, seed=17 * round_ + k)
                at = np.flatnonzero(seen).astype(np.int32)
                values = (at.tobytes(), own.weights[at].tobytes(), own.bias.tobytes(), own.edges.tobytes(), own.breaks.tobytes())
                yield pd.DataFrame([(k, *values)], columns=["k", "at", "weights", "bias", "edges", "breaks"])

        # A fixed number of rows of a fixed size: what one shard saw of the hashed features.
        parts = []
        for r in sample.mapInPandas(shard, "k int, at binary, weights binary, bias binary, edges binary, breaks binary").orderBy("k").collect():
            part, touched = Crf(languages), np.zeros(1 << BITS, bool)
            at, n = np.frombuffer(r["at"], np.int32), len(languages)
            touched[at] = True
            part.weights[at] = np.frombuffer(r["weights"], np.float32).reshape(-1, n)
            part.bias = np.frombuffer(r["bias"])
            part.edges, part.breaks = (np.frombuffer(r[c]).reshape(n, n) for c in ("edges", "breaks"))
            parts.append((part, touched))
        model = mixed(model, parts)
        shared.unpersist()
    return model


def label(documents: DataFrame, model: Crf | None) -> DataFrame:
    """``doc_id, lang, first_line, language, confidence, parts`` of each stretch of every document.

    ``parts`` is the number of the document's stretches.

    Null, empty and blank texts and those without letters have no stretch; each
    repeated row has its own. ``lang`` is the label as it came.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = shared.value
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.iloc[at : at + 2000]
                texts = [t if isinstance(t, str) else None for t in part["text"]]
                rows = [
                    (doc, lang, *stretch, len(found))
                    for doc, lang, found in zip(part["doc_id"], part["lang"], stretches(tool, texts) if tool else [])
                    for stretch in found
                ]
                yield pd.DataFrame(rows, columns=["doc_id", "lang", "first_line", "language", "confidence", "parts"])

    return documents.select("doc_id", "lang", "text").mapInPandas(
        work, "doc_id long, lang string, first_line long, language string, confidence double, parts int"
    )


def p9_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, first_line, language, confidence`` of every stretch of every document."""
    model = fitted(spark, sf_dir)
    documents = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text"))
    return label(documents, model).drop("lang", "parts")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, first_line, lang``: documents with a missing or wrong label, and every stretch of mixed ones."""
    model = fitted(spark, sf_dir)
    documents = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text"))
    codes = spark.read.parquet(f"{sf_dir}/lang_codes.parquet").select("label", F.col("lang").alias("code")).dropDuplicates(["label"])
    found = label(documents, model)
    return (
        found.join(small(codes), found["lang"] == codes["label"], "left")
        .filter("parts > 1 or code is null or code != language")
        .select("doc_id", "first_line", F.col("language").alias("lang"))
    )
