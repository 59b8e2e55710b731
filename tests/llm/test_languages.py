"""The conditional random field: gradients of its transitions, shards, and held-out accuracy on the given documents."""

from __future__ import annotations

import random

import numpy as np
import pytest

from inkloom.llm import languages


def likelihood(model, words, lines, labels):
    """Log-likelihood of a labelling, by the forward pass."""
    factors = np.exp(np.maximum(model.scored(words)[0], model.LEAST))
    steps = [languages._rows_normal(e) for e in (model.edges, model.breaks)]
    k = factors.shape[1]
    now, path = factors[0] / k, np.log(factors[0, labels[0]] / k)
    for t in range(1, len(words)):
        step = steps[int(lines[t] > lines[t - 1])]
        path += np.log(step[labels[t - 1], labels[t]] * factors[t, labels[t]])
        now = (now @ step) * factors[t]
    return path - np.log(now.sum())


def test_transitions_follow_the_gradient():
    rng = np.random.default_rng(5)
    model = languages.Crf(["x", "y", "z"])
    model.weights = rng.normal(0, 0.4, model.weights.shape).astype(np.float32)
    model.edges, model.breaks = rng.normal(0, 1, (3, 3)), rng.normal(0, 1, (3, 3))
    words = ["the", "boat", "lune", "mer", "rumah", "di", "the", "old"]
    lines, labels = np.array([0, 0, 0, 1, 1, 2, 2, 2]), np.array([0, 0, 1, 1, 2, 2, 0, 0])
    expected = {}
    for name in ("edges", "breaks"):
        value = getattr(model, name).copy()
        slope = np.zeros((3, 3))
        for a in range(3):
            for b in range(3):
                moved = [value.copy(), value.copy()]
                moved[0][a, b] += 1e-5
                moved[1][a, b] -= 1e-5
                up, down = (setattr(model, name, m) or likelihood(model, words, lines, labels) for m in moved)
                slope[a, b] = (up - down) / 2e-5
        setattr(model, name, value)
        expected[name] = slope
    emit, fresh, sizes = model.padded([words], [lines], np.exp(np.maximum(model.scored(words)[0], model.LEAST)))
    _, forward, messages = model.chain(emit, fresh, sizes)
    before = {n: getattr(model, n).copy() for n in expected}
    huge = np.full((2, 3, 3), 1e12)
    model.step_edges(forward, messages, fresh, sizes, [labels], [lines], huge, rate=1e6 * len(words) / 100)
    for name, slope in expected.items():
        assert np.allclose(getattr(model, name) - before[name], slope, atol=1e-4), name


def test_wrong_labels_and_mixed_documents():
    """Labels are corrected on the way, and changes of language inside a line and between lines are learned."""
    random.seed(2)
    stock = {
        "en": "the old man walked home and boat landed before dawn with nobody on it".split(),
        "fr": "le vieil homme marchait vers la maison et le bateau arrivait avant la nuit".split(),
        "id": "orang tua itu berjalan pulang dan perahu tiba sebelum fajar tanpa siapa pun".split(),
    }
    line = lambda c: " ".join(random.choices(stock[c], k=8))
    texts, labels = [], []
    for k in range(300):
        a, b = random.sample(sorted(stock), 2)
        texts.append("\n".join([line(a)] * 3 if k % 5 else [line(a), line(a), line(b)]))
        labels.append(a if k % 9 else b)
    model = languages.fit(texts, labels)
    right = 0
    for _ in range(60):
        a, b = random.sample(sorted(stock), 2)
        found = languages.stretches(model, ["\n".join([line(a), line(a), "", line(b), "7 *", line(a)])])[0]
        right += [(x, y) for x, y, _ in found] == [(1, a), (4, b), (6, a)]
    assert right >= 57
    assert (np.diag(languages._rows_normal(model.edges)) > 0.8).all()


def test_a_repeated_word_has_no_language():
    random.seed(2)
    en, fr = "the old man walked home and ha said boat".split(), "le vieil homme marchait vers la maison".split()
    texts = [" ".join(random.choices(w, k=10)) for w in (en, fr) for _ in range(80)]
    model = languages.fit(texts, ["en"] * 80 + ["fr"] * 80)
    out = languages.stretches(model, ["le vieil homme marchait\nha ha ha ha ha\nvers la maison", "ha ha ha ha"])
    assert [(x, y) for x, y, _ in out[0]] == [(1, "fr")] and len(out[1]) == 1


def test_rare_languages_are_drawn_whole(spark, tables, monkeypatch):
    monkeypatch.setattr(languages, "SAMPLE_CHARS", 4_000)
    texts = ["He opened the door of the inn and went away."] * 400 + ["Il ouvrit la porte de l'auberge et partit."] * 3
    codes = ["en"] * 400 + ["fr"] * 3
    folder = tables(documents=[{"doc_id": k, "lang": c, "text": t} for k, (c, t) in enumerate(zip(codes, texts))], lang_codes=[{"label": c, "lang": c} for c in ("en", "fr")])
    rows = languages.drawn(spark, folder, bound=100).collect()
    assert sum(r["code"] == "fr" for r in rows) == 3 and 20 < sum(r["code"] == "en" for r in rows) < 100
    assert sorted(languages.fitted(spark, folder, bound=100).languages) == ["en", "fr"]


def test_held_out_documents(spark, data):
    """Documents that aren't in the sample get the language of their label nearly always; labels are wrong now and then."""
    folder = data.replace("sf0.001", "sf0.01")
    drawn = {r["text"] for r in languages.drawn(spark, folder, bound=300).collect()}
    codes = spark.read.parquet(f"{folder}/lang_codes.parquet").filter("lang is not null").withColumnsRenamed({"lang": "code", "label": "lang"})
    rest = [r for r in spark.read.parquet(f"{folder}/documents.parquet").join(codes, "lang").collect() if r["text"] and r["text"] not in drawn]
    found = languages.stretches(languages.fitted(spark, folder, bound=300), [r["text"] for r in rest])
    single = [(f[0][1], r["code"]) for f, r in zip(found, rest) if len(f) == 1]
    assert len(single) > 200 and sum(a == b for a, b in single) / len(single) > 0.9
