"""Misread lines planted into the given chapters, pair by pair; transitions come from the sample."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from inkloom.llm import mojibake

#: Pairs of which no case is known in the given tables.
UNSEEN = [
    ("utf-8", "cp1254"), ("utf-8", "cp1253"), ("utf-8", "iso8859-15"), ("utf-8", "mac-cyrillic"), ("utf-8", "cp874"), ("utf-8", "cp850"), ("utf-8", "koi8-u"),
    ("gb18030", "cp866"), ("gb18030", "cp1250"), ("gb18030", "iso8859-2"), ("gb18030", "cp437"), ("cp950", "koi8-r"), ("cp950", "cp932"), ("cp950", "cp1251"), ("cp950", "mac-roman"),
]


@pytest.fixture(scope="module")
def story(spark, data):
    rows = mojibake.values(spark, data.replace("sf0.001", "sf0.01")).filter("source is not null").orderBy("book_id", "number").limit(400).collect()
    lines = sorted({x for r in rows for x in re.findall(r'"((?:[^"\\]|\\.)*)"', r["source"]) if re.fullmatch("[一-鿿，。！？：“”]{12,40}", x)})
    random.seed(1)
    return mojibake.fitted(spark, data.replace("sf0.001", "sf0.01")), random.sample(lines, 40)


def test_every_pair_is_a_state():
    assert set(UNSEEN) <= set(mojibake.PAIRS) and len(set(mojibake.PAIRS)) == len(mojibake.PAIRS) > 100


@pytest.mark.parametrize("pair", UNSEEN, ids="-".join)
def test_lines_of_any_pair_are_found(story, pair):
    model, lines = story
    # Signs that the true encoding doesn't have are no case.
    garbled = [mojibake.misread(x, pair) for x in lines]
    found = sum(bool(model.find(x)) for x in garbled)
    assert found >= 0.9 * len(lines)
    if pair[1] not in mojibake.DOUBLE:
        back = sum(mojibake.repaired(g, model) == (mojibake.decode(mojibake.encode(x, pair[0]), pair[0]), True) for g, x in zip(garbled, lines))
        assert back >= 0.8 * len(lines), back


def test_lost_signs_among_rare_ones(story):
    model, _ = story
    for title in ("第二章 送��满城灯（下）", "第150�� 送信灯下客", "��信"):
        found = model.find(title)
        assert [whole for *_, whole in found] == [False], title
    assert model.find("他走到门口�") == [] and model.find("他走到门口�\"") == []


def test_clean_lines_stay(story):
    model, lines = story
    assert not any(model.find(x) for x in lines)


def test_transitions_are_estimated(story):
    """One span in so many clean signs, and of so many signs, as in the sample."""
    _, lines = story
    spans = [mojibake.misread(x, ("utf-8", "latin-1")) for x in lines[:10]]
    model = mojibake.learn(lines * 100 + spans)
    assert model.enter == pytest.approx(np.log((len(spans) + 1) / (100 * sum(map(len, lines)) + mojibake.ENTERED)), abs=0.2)
    assert model.leave == pytest.approx(np.log((len(spans) + 1) / (sum(map(len, spans)) + mojibake.LENGTH)), abs=0.2)
