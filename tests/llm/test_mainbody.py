"""The style tree on planted pages: menus, bylines and rare advertisements of three hosts round stories."""

from __future__ import annotations

import json
import random

import pytest

from inkloom.llm import mainbody, ngrams
from inkloom.llm.repeats import site_lines

HOSTS = {"s": ("首页 / 目录 / 书签 / 充值", "——s.example 看书不迷路——"), "t": ("『书架｜排行｜完本』", "记住 t.example 下次再来"), "u": ("[返回][目录][投票]", "© u.example 版权所有")}
ADS = "限时 {} 折 买《{}》送书币 | {} 站"


@pytest.fixture(scope="module")
def planted():
    random.seed(12)
    words = "掌柜 老人 差役 书生 渡船 铁锅 钥匙 斗笠 河滩 客栈 钟楼 药铺 走过 推开 藏在 递给 看见 想起 明白 听说".split()

    def sentence():
        return "，".join("".join(random.choices(words, k=random.randrange(2, 5))) for _ in range(random.randrange(1, 4))) + random.choice("。。。！")

    rows, truth = [], set()
    for host, (menu, sign) in HOSTS.items():
        for b in range(5):
            book = f"{host}{b}"
            for n in range(1, 25):
                lines = [("".join(sentence() for _ in range(random.randrange(1, 4))), False) for _ in range(14)]
                lines.insert(0, (menu, True))
                lines.insert(1, (f"更新于 2024-0{random.randrange(1, 9)}-{random.randrange(10, 28)}  点击 {random.randrange(999)}", True))
                lines.append((sign, True))
                if n % 4 == 0:
                    lines.append((ADS.format(random.randrange(3, 9), random.choice(words) + random.choice(words), host), True))
                rows.append({"book_id": book, "number": n, "url": f"https://www.{host}.example/{n}", "title": f"第{n}章 {random.choice(words)}", "source": json.dumps([x for x, _ in lines], ensure_ascii=False)})
                truth |= {(book, n, k) for k, (_, page) in enumerate(lines, 1) if page}
    return rows, truth


def folder_of(tables, planted):
    return tables(chapters=planted[0] + planted[0][:7], sources=[{"id": h, "source_url": f"https://www.{h}.example/"} for h in HOSTS])


def test_planted_page_lines(spark, tables, planted):
    found = {tuple(r) for r in mainbody.p6_found(spark, folder_of(tables, planted)).collect()}
    truth = planted[1]
    assert len(found & truth) >= 0.97 * len(truth) and len(found & truth) >= 0.97 * len(found)


def test_the_tree_decides_most_lines(spark, tables, planted):
    said, _ = mainbody.verdicts(site_lines(spark, folder_of(tables, planted), styles=True))
    words = [w for r in said.collect() for w in r["said"]]
    assert words.count(mainbody.OPEN) <= 0.3 * len(words) and words.count(mainbody.PAGE) > 500


def test_model_is_fitted_on_every_line(spark, tables, planted, monkeypatch):
    """The end of a line of any length, and the lines of every page, have weights; in several shards."""
    monkeypatch.setattr(mainbody, "SHARD_LINES", 1500)
    monkeypatch.setattr(mainbody, "BLOCK", 200)
    rows = [dict(r) for r in planted[0]]
    for k, row in enumerate(rows):
        lines = json.loads(row["source"])
        lines[8] += "灯火" * 3000 + chr(0x5000 + k) + "。"
        row["source"] = json.dumps(lines, ensure_ascii=False)
    folder = tables(chapters=rows + rows[:7], sources=[{"id": h, "source_url": f"https://www.{h}.example/"} for h in HOSTS])
    said, _ = mainbody.verdicts(site_lines(spark, folder, styles=True))
    chapters, terms = (mainbody.table(spark, folder, "chapters").select("book_id", "number", "source"), mainbody.book_names(spark, folder))
    model, edges, inner = mainbody.fitted_shards(mainbody.trained_pages(chapters, said, terms), mainbody.by_place, None, 4)
    assert edges and inner >= len(rows)
    for k in range(len(rows)):
        # The second feature is the character between the marks of start and end.
        (feature, _), *_ = ngrams.features(*ngrams.codes([chr(0x5000 + k)]))
        assert model.weights[feature[1]], k
    again = mainbody.trained_pages(chapters.repartition(5), said.repartition(3), terms)
    assert (mainbody.fitted_shards(again, mainbody.by_place, None, 4)[0].weights == model.weights).all()


def test_shards_are_fitted_at_once(spark, tables, planted, monkeypatch):
    """All shards are tasks of one stage, not one stage after the other."""
    monkeypatch.setattr(mainbody, "SHARD_LINES", 1500)
    folder = folder_of(tables, planted)
    said, _ = mainbody.verdicts(site_lines(spark, folder, styles=True))
    pages = mainbody.trained_pages(mainbody.table(spark, folder, "chapters").select("book_id", "number", "source"), said, mainbody.book_names(spark, folder))
    shards = pages.rdd.getNumPartitions()
    assert shards >= 3
    spark.sparkContext.setJobGroup("shards", "fitted")
    mainbody.fitted_shards(pages, mainbody.by_place, None, 1)
    status = spark.sparkContext.statusTracker()
    stages = [status.getStageInfo(k) for job in status.getJobIdsForGroup("shards") for k in status.getJobInfo(job).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert max(s.numTasks for s in stages if s) == shards


def test_lines_are_folded_alike_together():
    random.seed(6)
    signs = "汉字，。！？…ＡｂＣ①㈱ﬁ¨´ếéä​Σσ\n 　ｶﾞ가가ொ"
    for _ in range(200):
        lines = ["".join(random.choices(signs[: random.choice((9, len(signs)))], k=random.randrange(12))) for _ in range(random.randrange(30))]
        assert mainbody.folded_all(lines) == [mainbody.folded(x) for x in lines]
