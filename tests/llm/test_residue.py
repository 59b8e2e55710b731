"""Residue by hash groups: messages that no list holds, and what speaks of them or merely recurs."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from inkloom.llm import residue
from messages import HELD, SPOKEN, TUNED

STORY = ["{}推开了客栈的门。", "{}把钥匙递给老人，转身走了。", "{}走过了桥。"]


def folder_of(tables, messages, books):
    """Each message between story lines in as many books, with other numbers each time."""
    chapters = []
    for k, text in enumerate(messages):
        for book in range(books):
            lines = [line.format(f"甲{'乙丙丁戊己庚辛壬癸子'[k % 10]}{k}子{'一二三'[book]}") for line in STORY]
            chapters.append({"book_id": f"b{book}", "number": k, "source": json.dumps([*lines[:2], text, lines[2]], ensure_ascii=False)})
    return tables(chapters=chapters)


def test_messages_that_were_not_looked_at(spark, tables):
    found = {r["number"] for r in residue.p1_found(spark, folder_of(tables, HELD, 2)).collect()}
    assert len(HELD) >= 100 and len(found) >= 0.9 * len(HELD)


def test_messages_count_from_the_second_book(spark, tables):
    assert residue.p1_found(spark, folder_of(tables, TUNED, 2)).count() == 2 * len(TUNED)
    alone = {r["number"] for r in residue.p1_found(spark, folder_of(tables, TUNED, 1)).collect()}
    assert {TUNED[k] for k in alone} == {"[INSERT TEXT HERE]"}


def test_stories_may_speak_of_messages(spark, tables):
    assert residue.p1_found(spark, folder_of(tables, SPOKEN, 3)).count() == 0


def test_masks(spark):
    def forms(*lines):
        return spark.createDataFrame([(list(lines),)], "lines array<string>").select(residue.formed(F.col("lines"))).first()[0]

    same = forms("Error 404 at 2024-01-02", "ＥＲＲＯＲ 500  at 2023-11-30!", "error 3 — at 1-2-3")
    assert len(set(same)) == 1
    assert len(set(forms("see https://a.example/x?y=1 now", "see b.example now"))) == 1
    assert len(set(forms("trace 0f8f6c600c", "trace c9bee52a14"))) == 1
    assert forms("测试测试测试", "测试测试测试测试测")[0] == "×测试" == forms("测试测试测试测试测")[0]
    assert forms("测试测试", "测试测试测试好") == ["测试测试", "测试测试测试好"]


def test_company_of_told_messages(spark, tables):
    """A line that no phrase tells, mostly on pages of told messages, is told; one of stories isn't."""
    page = ["Error 503", "quux 编号在此", "嗯。"]
    chapters = [{"book_id": f"b{k % 3}", "number": k, "source": json.dumps(page[:2], ensure_ascii=False)} for k in range(6)]
    chapters += [{"book_id": f"b{k % 3}", "number": 10 + k, "source": json.dumps([f"他走了第{'甲乙丙丁戊己'[k]}条路。", page[2]], ensure_ascii=False)} for k in range(6)]
    chapters += [{"book_id": "c", "number": 1, "source": json.dumps(["她等到天亮。", page[1]], ensure_ascii=False)}]
    found = {(r["book_id"], r["number"]) for r in residue.p1_found(spark, tables(chapters=chapters)).collect()}
    assert found == {(f"b{k % 3}", k) for k in range(6)} | {("c", 1)}
