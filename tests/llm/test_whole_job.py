"""Operators do the whole job: nothing is left out behind a prefix, a filter or a place in an order."""

from __future__ import annotations

import json
import random

from inkloom.llm import cleaning, languages, mojibake, queries, truncation


def test_emissions_come_from_every_line():
    random.seed(4)
    first = ["".join(random.choices("霜桥旧事他把钥匙递给老人", k=40)) + "。" for _ in range(12_000)]
    late = "薔薇蝴蝶鸳鸯蜻蜓骆驼琥珀玳瑁葡萄枇杷"
    model = mojibake.learn(first + ["".join(random.choices(late, k=20)) for _ in range(50)])
    for pair in [("utf-8", "gb18030"), ("utf-8", "cp932"), ("utf-8", "cp949"), ("gb18030", "cp949")]:
        k = mojibake.PAIRS.index(pair)
        garbled = [c for c in mojibake.misread(late, pair) if ord(c) > 127 and c != mojibake.LOST and c not in late + "".join(first[:50])]
        assert garbled and all(model.odds[c][k] > mojibake.SUSPECT for c in garbled), pair
    # Signs that no line gave are judged by their block.
    assert all(chr(c) in model.odds for c in range(0x9500, 0x9600))


def test_found_paragraphs_are_taken_out(spark, tables):
    chapters = [
        ("a", 1, '["一。", "菜单", "二。\\n", "菜单"]'),
        ("a", 1, '["一。", "菜单", "二。\\n", "菜单"]'),
        ("a", 2, '[ "一。",  "“二”。"]'),
        ("a", 3, '["菜单"]'),
        ("b", 1, '["断'),
        ("b", 2, None),
        (None, 1, '["x"]'),
        (None, 1, '["y"]'),
    ]
    df = spark.createDataFrame([(*c, "t") for c in chapters], "book_id string, number long, source string, title string")
    found = spark.createDataFrame([("a", 1, 2), ("a", 1, 4), ("a", 1, 4), ("a", 3, 1)], "book_id string, number long, para long")
    out = [tuple(r) for r in cleaning.without(df, found).collect()]
    kept = {(b, n): s for b, n, s, _ in out if b}
    assert json.loads(kept["a", 1]) == ["一。", "二。\n"] and json.loads(kept["a", 3]) == []
    assert {k: v for k, v in kept.items() if k not in (("a", 1), ("a", 3))} == {("a", 2): chapters[2][2], ("b", 1): chapters[4][2], ("b", 2): None}
    assert sorted((n, r) for b, n, _, r in out if b == "a") == [(1, 2), (2, 0), (3, 1)]
    assert sorted(s for b, _, s, _ in out if b is None) == ['["x"]', '["y"]'] and len(out) == 7


def test_second_results_follow_the_found_ones(spark, tables):
    line = "手机用户请到阅读页面继续阅读本站最新章节"
    chapters = [
        {"book_id": f"b{n % 3}", "number": n, "title": f"第{n}章", "url": "https://s/x", "source": json.dumps([line, f"甲{'乙丙丁戊'[n % 4]}{n}走了。", "{{chapter.content}}"][: 3 if n == 5 else 2], ensure_ascii=False)}
        for n in range(40)
    ]
    folder = tables(chapters=chapters, sources=[{"id": "s", "source_url": "https://s/"}, {"id": "t", "source_url": "https://t/"}])
    for name, cleaned in (("p2_found", "p2_cleaned"), ("p6_found", "p6_story")):
        found = {tuple(r) for r in queries.queries()[name](spark, folder).collect()}
        assert found or name == "p6_found"
        for r in queries.queries()[cleaned](spark, folder).collect():
            before = json.loads(chapters[r["number"]]["source"])
            assert json.loads(r["source"]) == [x for k, x in enumerate(before) if (r["book_id"], r["number"], k + 1) not in found]
    residue = {tuple(r) for r in queries.queries()["p1_found"](spark, folder).collect()}
    kept = {tuple(r)[:2] for r in queries.queries()["p1_kept"](spark, folder).collect()}
    assert residue and kept == {(c["book_id"], c["number"]) for c in chapters} - residue


def test_cuts_inside_numbers_and_behind_signs(spark, tables):
    whole = ["张三推开了客栈的门，付了40文钱。", "李四看了一眼T恤上的字。", "他翻到《旧事》那一页。"]
    rows = [("a", n, whole * 3) for n in range(1, 40)]
    cuts = ["张三推开了客栈的门，付了4", "李四看了一眼T", "他翻到《", "张三说：“付了4"]
    rows += [("b", n, [text]) for n, text in enumerate(cuts)] + [("c", 1, ["李四看了一眼T恤上的字。"])]
    chapters = [{"book_id": b, "number": n, "source": json.dumps(x, ensure_ascii=False)} for b, n, x in rows]
    found = truncation.p4_found_any(spark, tables(chapters=chapters)).collect()
    assert sorted(tuple(r) for r in found) == [("b", n) for n in range(4)]


def test_long_text_does_not_end_the_sample(spark, tables, monkeypatch):
    monkeypatch.setattr(languages, "SAMPLE_CHARS", 20_000)
    monkeypatch.setattr(languages, "LONG_TEXT", 400, raising=False)
    texts = [("vi", "Anh ấy mở cửa quán trọ rồi đi về phía bến sông.\n" * 2000), ("en", "He opened the door of the inn and went away.\n" * 2000)]
    texts += [("fr", "Il ouvrit la porte de l'auberge et partit.")]
    folder = tables(
        documents=[{"doc_id": k, "lang": code, "text": text} for k, (code, text) in enumerate(texts)],
        lang_codes=[{"label": code, "lang": code} for code, _ in texts],
    )
    assert languages.fitted(spark, folder).languages == ["en", "fr", "vi"]


def test_wrong_encodings_are_fitted_on_every_value(spark, tables):
    """Each of more values than any sample would take, a long one too, as if they were learned at once."""
    random.seed(5)
    lines = ["".join(random.choices("霜桥旧事他把钥匙递给老人", k=6)) + "。" for _ in range(6500)]
    late = "薔薇蝴蝶鸳鸯蜻蜓骆驼琥珀玳瑁葡萄枇杷"
    lost = mojibake.misread("他把钥匙递给老人", ("utf-8", "latin-1"))
    chapters = [{"book_id": f"b{n % 7}", "number": n, "title": f"第{n}章", "source": json.dumps([x], ensure_ascii=False)} for n, x in enumerate(lines)]
    for n, (title, texts) in enumerate(((chr(0x20000), ["甲乙" * 40_000, lost]), (None, [late]))):
        chapters.append({"book_id": "c", "number": n, "title": title, "source": json.dumps(texts, ensure_ascii=False)})
    model = mojibake.fitted(spark, tables(chapters=chapters))
    whole = mojibake.learn([*lines, late, "甲乙" * 40_000, lost, chr(0x20000), *(c["title"] for c in chapters[: len(lines)])])
    assert set(late + "甲" + chr(0x20000)) <= set(model.usual)
    assert model.usual == whole.usual and (model.enter, model.leave) == (whole.enter, whole.leave)
    assert model.odds.keys() == whole.odds.keys() and all((model.odds[c] == whole.odds[c]).all() for c in whole.odds)
    assert [x[2] for x in model.find(lost)] == ["他把钥匙递给老人"]
