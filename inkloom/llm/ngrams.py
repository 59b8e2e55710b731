"""Hashed character n-gram features and a logistic model, vectorised with numpy."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

BITS = 20
#: Odd multipliers of the n-gram hashes (fixed values).
PRIMES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint64)


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each between a start and an end mark, and each point's text."""
    joined = "".join("\x02" + t + "\x03" for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    # Decimal digits look alike; so do the wide and the narrow forms of ASCII.
    wide = (points >= 0xFF01) & (points <= 0xFF5E)
    points[wide] -= 0xFEE0
    points[(points >= 48) & (points <= 57)] = 48
    owner = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    return points, owner


#: N-grams that start this early in a text, or this close to its end, also count as features of its head or tail.
HEAD, TAIL = 8, 5


def features(points: np.ndarray, owner: np.ndarray, orders: tuple[int, ...] = (1, 2, 3)):
    """Yield (feature, text) arrays for each order; no n-gram crosses texts."""
    bound = np.uint64((1 << BITS) - 1)
    first = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1]) if len(owner) else np.empty(0, int)
    sizes = np.diff(np.append(first, len(owner)))
    since = np.arange(len(owner)) - np.repeat(first, sizes)
    until = np.repeat(sizes, sizes) - since
    heads, tails = np.flatnonzero(since < HEAD), np.flatnonzero(until <= TAIL)
    mixed = points * PRIMES[0]
    for n in orders:
        if n > 1:
            if len(points) < n:
                return
            mixed = mixed[:-1] * PRIMES[1] ^ (points[n - 1 :] * PRIMES[n % 4])
        inside = np.flatnonzero(until >= n)
        yield (mixed[inside] * PRIMES[2] >> np.uint64(40)) & bound, owner[inside]
        for salt, near in ((1, heads), (2, tails)):
            near = near[until[near] >= n]
            yield ((mixed[near] + np.uint64(salt)) * PRIMES[1] >> np.uint64(41)) & bound, owner[near]


class Model:
    """Logistic model over hashed n-grams; a text's score is a log-odds."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)

    def score(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts))
        if not texts:
            return out
        points, owner = codes(texts)
        size = np.bincount(owner, minlength=len(texts))
        for feature, of in features(points, owner):
            out += np.bincount(of, weights=self.weights[feature], minlength=len(texts))
        return out / np.sqrt(size) + self.bias


class Learner:
    """A logistic model while it is fitted by mini-batch AdaGrad."""

    def __init__(self, rate: float = 0.5, decay: float = 1e-6):
        self.rate, self.decay = rate, decay
        self.w, self.g = np.zeros(1 << BITS), np.full(1 << BITS, START)
        self.bias, self.gb = 0.0, START
        self.seen, self.place, self.room = np.zeros(1 << BITS, bool), np.zeros(1 << BITS, np.intp), np.empty(0)

    def step(self, batch: tuple[np.ndarray, ...], labels: np.ndarray) -> None:
        used, inverse, row, scale = batch
        if len(row) > len(self.room):
            self.room = np.empty(2 * len(row))
        # The same memory for every step: fresh pages cost more than the sums.
        w, each = self.w[used], self.room[: len(row)]
        z = np.bincount(row, weights=w.take(inverse, out=each, mode="clip"), minlength=len(scale)) * scale + self.bias
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels
        grad = np.bincount(inverse, weights=(error * scale).take(row, out=each, mode="clip"), minlength=len(used)) + self.decay * w
        g = self.g[used] + grad * grad
        self.g[used] = g
        self.w[used] = w - self.rate * grad / np.sqrt(g) / 4
        db = error.mean()
        self.gb += db * db
        self.bias -= self.rate * db / np.sqrt(self.gb) / 4

    def learn(self, texts: list[str], labels: np.ndarray, epochs: int, random: np.random.Generator) -> None:
        """All epochs over a block of texts, whose features are made once."""
        labels, ids = np.asarray(labels, dtype=float), random.permutation(len(texts))
        parts = [ids[k : k + BATCH] for k in range(0, len(ids), BATCH)]
        batches = [self.made([texts[i] for i in part]) for part in parts]
        for _ in range(epochs):
            for k in random.permutation(len(parts)):
                self.step(batches[k], labels[parts[k]])

    def made(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """The features that occur, and of each occurrence its feature by place among these and its text; and the texts' scales."""
        points, owner = codes(texts)
        f, row = (np.concatenate(x) for x in zip(*features(points, owner)))
        f = f.view(np.int64)
        # As `np.unique` with its inverse, by tables of all features.
        self.seen[f] = True
        used = np.flatnonzero(self.seen)
        self.seen[used] = False
        self.place[used] = np.arange(len(used))
        return used, self.place[f], row, 1 / np.sqrt(np.bincount(owner, minlength=len(texts)))

    def touched(self) -> np.ndarray:
        return np.flatnonzero(self.w).astype(np.int32)


#: Texts of a step, and what AdaGrad's sums begin with.
BATCH, START = 512, 1e-6


def mixed(parts: Iterable[tuple[np.ndarray, np.ndarray, float]]) -> Model | None:
    """One model of ``(features, weights, bias)`` of several: each feature's mean weight over those that met it."""
    sums, many, biases = np.zeros(1 << BITS), np.zeros(1 << BITS, np.int32), []
    for at, weights, bias in parts:
        sums[at] += weights
        many[at] += 1
        biases.append(bias)
    return Model(sums / np.maximum(many, 1), float(np.mean(biases))) if biases else None
