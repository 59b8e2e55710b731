"""Whole results: every gate on its own, readings, terms, targets, and the table form."""

from __future__ import annotations

import json

import pytest

from inkloom.functions.glossary import Lexicon
from inkloom.operators import dedup, parallel, results
from inkloom.operators.results import Case

SOURCE = ["大海走进青石城。", "他说他有三文钱，", "还要五文。"]
NAMES = {"大海": "Đại Hải", "青石城": "thành Thanh Thạch"}
WORDS = Lexicon(["大海", "走进", "青石", "三文", "文钱"])


def result(**change):
    texts = ["Đại Hải bước vào thành Thanh Thạch.", "Hắn nói hắn có 3 văn,", "còn đòi 5 văn."]
    return {"title": "Chương 1", "continuity": "x", "issues": [], "paragraphs": [{"id": k, "text": t} for k, t in enumerate(texts, 1)]} | change


def case(given=None, **more):
    return Case(SOURCE, result() if given is None else given, NAMES, lexicon=WORDS, **more)


def kinds(given, **more):
    return [(f.level, f.kind, f.para) for f in case(given, **more).findings]


def texts(*values, **extra):
    return result(paragraphs=[{"id": k, "text": t} | (extra if k == 3 else {}) for k, t in enumerate(values, 1)])


GOOD = [p["text"] for p in result()["paragraphs"]]


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        (None, []),
        ({"title": "x"}, [("unusable", "schema", 0)]),
        (result(more=1), [("unusable", "schema", 0)]),
        (result(issues="x"), [("unusable", "issues", 0)]),
        (result(issues=[" POLICY: no", "SOURCE: odd"]), [("refused", "policy", 0)]),
        (result(issues=["unsure"]), [("quality", "issue", 0)]),
        (result(title=" "), [("unusable", "title", 0)]),
        (result(title="汉"), [("unusable", "title", 0)]),
        (result(title="x" * 301), [("unusable", "title", 0)]),
        (result(continuity="x" * 2501), [("unusable", "continuity", 0)]),
        (result(paragraphs=result()["paragraphs"][:2]), [("unusable", "coverage", 0)]),
        (result(paragraphs=result()["paragraphs"][::-1]), [("unusable", "order", 1), ("unusable", "order", 3)]),
        (texts(GOOD[0], GOOD[1], GOOD[2], join_previous=1), [("unusable", "layout", 3)]),
        (texts(GOOD[0], "", GOOD[2]), [("unusable", "empty", 2), ("quality", "number", 2)]),
        (texts("<b>" + GOOD[0], GOOD[1], GOOD[2]), [("unusable", "markup", 1)]),
        (texts(GOOD[0] + "汉", GOOD[1], GOOD[2]), [("quality", "han", 1)]),
        (texts("Biển cả vào thành Thanh Thạch.", GOOD[1], GOOD[2]), [("names", "name", 1)]),
        (texts(GOOD[0], GOOD[1], "còn đòi 6 văn."), [("quality", "number", 3)]),
        (result(terms=[{"source": "x", "translation": "y"}]), [("unusable", "terms", 0)]),
        (result(terms="x"), [("unusable", "terms", 0)]),
        ([], [("unusable", "schema", 0)]),
    ],
)
def test_gates(given, expected):
    # An empty paragraph can't have lost a number; it is only told where the source writes one.
    found = kinds(given)
    assert [f for f in found if f != ("quality", "number", 2)] == [f for f in expected if f != ("quality", "number", 2)]


def test_findings_come_by_level():
    given = texts("汉 4", "<i>", "x") | {"issues": ["POLICY: no"]}
    levels = [f.level for f in case(given).findings]
    assert levels == sorted(levels, key=results.LEVELS.index) and levels[0] == "refused" and case(given).outcome == "refused" and case().outcome is None


def test_joined_paragraphs_are_judged_together():
    split = texts(GOOD[0], "Hắn nói hắn còn đòi", "3 văn và 5 văn.", join_previous=True)
    assert case(split).groups == [[0], [1, 2]] and kinds(split) == []


def reading(**change):
    return {"paragraph_id": 1, "source": "大海", "source_start": 0, "source_quote": SOURCE[0], "translation": "biển cả", "reason": "an ordinary word here"} | change


def test_readings_need_full_evidence():
    plain = texts("Biển cả vào thành Thanh Thạch.", GOOD[1], GOOD[2])
    assert kinds(plain | {"glossary_readings": [reading()]}) == []
    bad = [reading(paragraph_id=2), reading(source_start=1), reading(source_quote="x"), reading(translation="b"), reading(reason="short"), reading(source="青石城"), reading(more=1), 5]
    for r in bad:
        assert kinds(plain | {"glossary_readings": [r]}) == [("names", "name", 1)], r
    assert len(case(plain | {"glossary_readings": [reading(), reading(reason="an ordinary word too")]}).readings) == 1
    assert case(plain | {"glossary_readings": [reading()] * 101}).readings == []


def test_reviewed_decisions_hold_for_the_same_text():
    plain = texts("Biển cả vào thành Thanh Thạch.", GOOD[1], GOOD[2])
    decision = {"paragraph_id": 1, "source": "大海", "source_start": 0, "canonical": "Đại Hải", "source_quote": SOURCE[0], "translation_quote": "biển cả"}
    assert kinds(plain, reviewed=[decision]) == []
    for change in ({"canonical": "x"}, {"source_quote": "x"}, {"translation_quote": "núi"}, {"translation_quote": " "}, {"source_start": 2}, {"paragraph_id": 9}):
        assert kinds(plain, reviewed=[decision | change]) == [("names", "name", 1)]


def test_terms_are_admitted_if_supported():
    def admitted(*terms, aliases=None):
        return [(t["source"], t["translation"]) for t in case(result(terms=[{"source": s, "translation": v} for s, v in terms]), aliases=aliases or {}).admitted]

    assert admitted(("三文", "3 văn")) == [("三文", "3 văn")]
    assert admitted(("三文", "ba xu")) == []
    assert admitted(("大海", "Biển")) == [] and admitted(("大海", "đại  hải")) == [("大海", "Đại Hải")]
    assert admitted(("青石城", "Thanh Thạch thành")) == [("青石城", "thành Thanh Thạch")]
    assert admitted(("三文", "3 văn"), ("三文", "có 3 văn")) == [("三文", "3 văn")]
    assert admitted(("大海", "Hải Đại"), aliases={"大海": ["Hải Đại"]}) == [("大海", "Đại Hải")]


def test_drafts_and_targets():
    stale = ["Paragraph 3: glossary mismatch: x", "Joined paragraphs 1,2: numeric literals changed; y", "unsure"]
    assert results.redrafted(result(issues=stale))["issues"] == ["unsure"]
    plain = texts("Biển cả vào thành Thanh Thạch.", GOOD[1], GOOD[2])
    assert case(plain).targets() == [{"para": 1, "start": 0, "term": "大海", "canonical": "Đại Hải", "previous": "", "next": SOURCE[1]}]
    assert case().targets() == [] and case(plain | {"glossary_readings": [reading()]}).targets() == []


def test_relevant_names_over_paragraph_ends():
    assert results.relevant(["他是武", "穆"], {"武穆": "Vũ Mục", "青石": "x"}) == {"武穆": "Vũ Mục"}


def test_tables(spark):
    rows = [
        ("b", 1, SOURCE, result()), ("b", 2, SOURCE, texts("Biển cả vào thành Thanh Thạch.", GOOD[1], GOOD[2])), ("b", 3, SOURCE, {"x": 1}),
        ("c", 1, SOURCE, texts("Biển cả.", GOOD[1], GOOD[2])),
    ]
    data = [(b, n, json.dumps(s, ensure_ascii=False), json.dumps(r, ensure_ascii=False)) for b, n, s, r in rows]
    data += [("b", 4, "[", "{}"), ("b", 5, None, "{}"), ("b", None, "[]", "{}"), (None, 6, "[]", None)]
    chapters = spark.createDataFrame(data, "book_id string, number long, source string, edited string")
    terms = spark.createDataFrame([("b", s, t, 2 if s == "大海" else 1) for s, t in NAMES.items()] + [("b", None, None, None)], "book_id string, source string, translation string, chapter long")
    found = sorted((r["book_id"], r["number"], r["kind"]) for r in results.judged(chapters, terms).collect())
    assert found == [("b", 2, "name"), ("b", 3, "schema"), ("b", 4, "json")]
    assert [(r["number"], r["term"]) for r in results.review_targets(chapters, terms).collect()] == [(2, "大海")]
    assert results.judged(chapters.limit(0), terms).count() == 0
    crossing = spark.createDataFrame([("b", 1, json.dumps(["大江山东", "江山"], ensure_ascii=False))], "book_id string, number long, source string")
    names = spark.createDataFrame([("b", "江山", "Giang Sơn", 1)], "book_id string, source string, translation string, chapter long")
    assert [tuple(r) for r in results.excluded(crossing, names, {"大江": 1, "山东": 1, "江山": 1}).collect()] == [("b", 1, 1, 1, "江山")]
    lines = spark.createDataFrame([("b", 1, ["大江山东", None, "江山"])], "book_id string, number long, lines array<string>")
    got = parallel.term_mentions(lines, names.select("book_id", "source"), {"大江": 1, "山东": 1}).collect()
    assert [tuple(r) for r in got] == [("b", 1, 3, 0, "江山")]


def test_rows_count_once(spark):
    rows = [("a", 1, "x"), ("a", 1, "x"), ("a", 1, "y"), (None, 1, "x"), (None, 1, "x"), ("b", None, None)]
    df = spark.createDataFrame(rows, "b string, n long, t string")
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in dedup.once(df, ["b", "n"]).collect()), key=key) == sorted(set(rows), key=key)
    assert dedup.once(df.limit(0), ["b", "n"]).count() == 0
