"""Operators for training data: defined results for odd rows, brute force and round trips."""

from __future__ import annotations

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkloom.llm import bitext, chapters, languages, mainbody, mojibake, packing, queries, repeats, residue, tokens, truncation
from inkloom.llm.bpe import LONG, ByteBpe

VOCABULARY = os.path.exists("/opt/tokenizers/byte_bpe_50k.tiktoken")
needs_vocabulary = pytest.mark.skipif(not VOCABULARY, reason="no vocabulary files")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def chapter(book, number, source, **more):
    return {"book_id": book, "number": number, "title": f"第{number}章 名", "source": json.dumps(source, ensure_ascii=False) if isinstance(source, list) else source} | more


ODD = [
    {"book_id": None, "number": None, "source": None},
    {"book_id": "a", "number": None, "source": '["一。"]'},
    {"book_id": "a", "number": 1, "source": None},
    {"book_id": "a", "number": 2, "source": ""},
    {"book_id": "a", "number": 3, "source": "[]"},
    {"book_id": "a", "number": 4, "source": '["", null, " ", 5, {"x": 1}]'},
    {"book_id": "a", "number": 5, "source": '{"no": "list"}', "title": ""},
    {"book_id": "a", "number": 6, "source": json.dumps(["很长的一段话，没有说完" * 20_000 + "。"], ensure_ascii=False)},
    {"book_id": "a", "number": 6, "source": json.dumps(["很长的一段话，没有说完" * 20_000 + "。"], ensure_ascii=False)},
    {"book_id": "a", "number": 7, "source": "not json", "translated": "{", "edited": '{"paragraphs": 3}'},
    {"book_id": "a", "number": 9, "source": '["\\ud83d NaN", "NaN", "\\ud83d", "{{x}} \\ude00"]', "translated": '{"paragraphs": [{"id": 1, "text": "\\ud83d a."}]}'},
    {"book_id": "a", "number": 8, "source": '["他说。"]', "translated": '{"paragraphs": [{"id": "x"}, null, {"id": 1, "text": null}]}'},
]

NAMES = ["p1_found", "p2_found", "p3_found", "p3_restored", "p4_found", "p4_sites", "p5_found", "p6_found", *(["p7_ids", "p8_pack"] if VOCABULARY else []), "p9_found", "p9_languages"]


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("kind", ["empty", "odd"])
def test_odd_tables(spark, tables, name, kind):
    """Empty tables, nulls in any column, invalid values, long texts, repeated rows and extra columns don't crash."""
    if kind == "empty":
        folder = tables()
        expected = {"p4_sites": 0}
        assert queries.queries()[name](spark, folder).count() == expected.get(name, 0)
        return
    clash = {"key": "k", "line": "x", "site": "s", "item": 1, "ids": "i", "lines": "l", "para": 2, "at": 3}
    documents = [
        {"doc_id": 1, "text": None, "lang": "zh"},
        {"doc_id": 2, "text": "", "lang": None},
        {"doc_id": 3, "text": " \n\n ", "lang": "zh"},
        {"doc_id": 4, "text": "12 + 3 = 15 ★", "lang": "en"},
        {"doc_id": 5, "text": "a" * 30_000, "lang": "xx"},
        {"doc_id": 6, "text": "the old man walked home", "lang": "en"},
        {"doc_id": 6, "text": "the old man walked home", "lang": "en"},
        {"doc_id": None, "text": "the cat", "lang": "en"},
    ]
    folder = tables(
        chapters=[r | clash for r in ODD],
        documents=[d | clash for d in documents],
        lang_codes=[{"label": "en", "lang": "en"}, {"label": "zh", "lang": "zh"}, {"label": "xx", "lang": None}, {"label": None, "lang": None}],
        pack_specs=[{"spec_id": 1, "tokenizer": "byte_bpe_50k", "capacity": 64}],
        books=[{"id": "a", "title": None}, {"id": None, "title": "b"}, {"id": "a", "title": "书"}],
        sources=[{"id": "s", "source_url": "https://www.s.example/"}, {"id": None, "source_url": None}],
        source_candidates=[{"id": 1, "book_id": "a", "source_id": "s", "canonical_number": 1, "state": "accepted"}, {"id": None}],
        book_terms=[{"book_id": "a", "source": "他们"}, {"book_id": None, "source": None}],
    )
    queries.queries()[name](spark, folder).collect()


def test_residue_rules(spark):
    kinds = {
        "{{ title }}": "placeholder",
        "他把${hero}递给她。": "placeholder",
        "&lt;content&gt;": "placeholder",
        "NaN": "placeholder",
        "[object Object]": "placeholder",
        "甲乙丙丁甲乙丙丁甲乙丙丁甲乙": "filler",
        "xxxxxxxx": "filler",
        "Lorq ipsit dolum amet consec tetur elit": "filler",
        "Too many requests from your address": "message",
        "内容加载失败，点击重试！": "message",
        "联系管理员": "weak",
        "Error 503": "weak",
        "他在代码里少写了一个}，查了三遍。": None,
        "“页面不存在”这几个字，他盯了很久。": None,
        "屏幕上又跳出404，他笑着说机房该修了。": None,
        "[返回目录]": None,
        "涨了50%，又跌了30%。": None,
        "": None,
        " ": None,
        "* * *": None,
        "“哈哈哈哈哈哈哈。”": None,
    }
    df = spark.createDataFrame([(line,) for line in kinds], "line string")
    alone = {r["line"] for r in df.filter(residue.inside(F.col("line"))).collect()}
    assert alone == {line for line, kind in kinds.items() if kind == "placeholder" or line.startswith("Lorq")}
    assert {line for line in kinds if residue.classify(line)} - alone == {line for line, kind in kinds.items() if kind} - alone


def test_residue_of_broken_arrays(spark):
    df = spark.createDataFrame([('["a\\"b", "c", "{{x}}',), ('["a", "b\\u4e',), ('["a", ',), ("x",), ('{"a": "b"',), (None,)], "source string")
    assert [r[0] for r in df.select(residue.read(F.col("source"))).collect()] == [['a"b', "c", "{{x}}"], ["a", "b"], ["a", ""], None, None, None]


def test_residue_counts_recurring_messages(spark, tables):
    folder = tables(
        chapters=[chapter("a", 1, ["联系管理员"]), chapter("a", 1, ["联系管理员"]), chapter("b", 1, ["联系管理员"]), chapter("c", 1, ["返回首页"]), chapter("c", 2, ["他走了。", "{{text}}"])]
    )
    assert rows(residue.p1_found(spark, folder)) == [("a", 1), ("b", 1), ("c", 2)]


def pages(count, site="s", own="请记住本站网址", share=1):
    """Chapters of four books at three sites with the site's line in each ``share``-th of the first site's."""
    out, sites = [], []
    for book in "abcd":
        for n in range(1, count + 1):
            for where in ("s", "t", "u"):
                lines = [f"{book}{where}第{n}个人走过了桥。", "“嗯。”"]
                if where == site and n % share == 0:
                    lines.insert(0, f"{own} {n}")
                out.append(chapter(f"{book}{where}", n, lines, url=f"https://www.{where}.example/{n}"))
    for where in "stu":
        sites.append({"id": where, "source_url": f"https://www.{where}.example/"})
    return out, sites


def test_repeated_lines(spark, tables):
    out, sites = pages(8)
    found = rows(repeats.p2_found(spark, tables(chapters=out + out[:5], sources=sites)))
    assert found == sorted((f"{b}s", n, 1) for b in "abcd" for n in range(1, 9))
    # A line of one book only, or of too few chapters, is none; stock phrases at every site neither.
    out, sites = pages(8, share=9)
    assert rows(repeats.p2_found(spark, tables(chapters=out, sources=sites))) == []


def test_bitmaps_match_sets(spark):
    random.seed(5)
    lines = [("s", k, f"b{random.randrange(3)}", random.randrange(200)) for k in (1, 2, 3) for _ in range(300)]
    df = spark.createDataFrame(lines, "site string, key long, book_id string, number long")
    from pyspark.sql import functions as F

    counted = repeats.bitmaps(df).groupBy("key").agg(F.sum(F.bit_count("bits")).alias("n"))
    assert {r["key"]: r["n"] for r in counted.collect()} == {k: len({x[1:] for x in lines if x[1] == k}) for k in (1, 2, 3)}


def test_masked_lines(spark):
    df = spark.createDataFrame([("更新 2022年2月25日",), ("更新　２０２２/2/25！",), ("【更新】2021-12-03",)], "t string")
    assert df.select(chapters.masked(df["t"])).distinct().count() == 1


def test_misread_text_comes_back():
    random.seed(2)
    words = "霜桥旧事他把钥匙递给老人忽然想起往事天刚亮渡口的屋檐下挂着灯笼只剩下水声谁也没有出声"
    clean = ["".join(random.choices(words, k=30)) + "，" + "".join(random.choices(words, k=12)) + "。" for _ in range(400)]
    model = mojibake.learn(clean)
    for pair in [("utf-8", "latin-1"), ("utf-8", "cp1252"), ("gb18030", "latin-1"), ("utf-8", "cp1251"), ("utf-8", "koi8-r"), ("utf-8", "mac-roman"), ("utf-8", "latin-1", "utf-8", "latin-1")]:
        for text in clean[:8]:
            value = f'["他走了。", "{mojibake.misread(text, pair)}"]'
            spans = model.find(value)
            assert spans, pair
            out, at = "", 0
            for start, end, restored, _ in spans:
                out, at = out + value[at:start] + restored, end
            assert out + value[at:] == f'["他走了。", "{text}"]', pair
    assert not any(model.find(f'["{t}"]') for t in clean)
    assert model.find('["他把钥匙递给�"]') == []
    assert model.find('["他把��递给老人。"]')
    assert model.find(None) == model.find("") == []


def test_truncation(spark, tables):
    tails = ["忽然想起往事。", "旁人只当没看见。", "炉火噼啪作响……", "谁也没有出声。"]
    heads = ["张三推开了客栈的门，", "李四把钥匙递给老人，", "天刚亮他就走过渡口，"]
    random.seed(3)
    out = [chapter("a", n, [random.choice(heads) + random.choice(tails) for _ in range(6)] + ["霜落空山人未眠"]) for n in range(1, 60)]
    out.append(chapter("b", 1, ["张三推开了客栈的门，忽然想"]))
    out.append(chapter("b", 2, ["李四把钥匙递给"]))
    out.append(chapter("b", 3, ["天刚亮他就走�"]))
    out.append(chapter("b", 4, '["张三推开了客栈的门", "忽然'))
    out.append(chapter("b", 5, ["“你怎么——”", "霜落空山人未眠", "* * *"]))
    assert rows(truncation.p4_found(spark, tables(chapters=out + out[-2:]))) == [("b", n) for n in (1, 2, 3, 4)]


def test_sentences():
    assert bitext.source_sentences("他说：“走。”雨停了……她没动") == ["他说：“走。”", "雨停了……", "她没动"]
    assert bitext.target_sentences("Anh nói: “Đi.” Mưa tạnh… 1.250 văn") == ["Anh nói: “Đi.”", "Mưa tạnh…", "1.250 văn"]
    assert bitext.source_sentences("") == bitext.target_sentences(" ") == []
    assert [bitext.value_of(x) for x in ("一千零五", "三百四十六", "十二", "12", "二万三千")] == ["1005", "346", "12", "12", "23000"]


def corpus(count, seed):
    """Chapters of an invented language pair: each character has its own syllable."""
    random.seed(seed)
    letters = [chr(0x4E00 + k) for k in range(120)]
    syllables = {c: "".join(random.choices("bdghklmnptv", k=1)) + random.choice("aeiou") + str("").join(random.choices("nmpt", k=1)) + chr(97 + k % 26) + chr(97 + k // 26) for k, c in enumerate(letters)}
    out = []
    for _ in range(count):
        sentences = ["".join(random.choices(letters, k=random.randrange(6, 22))) for _ in range(16)]
        say = [" ".join(syllables[c] for c in s).capitalize() + "." for s in sentences]
        truth = {(i, i) for i in range(16)}
        out.append((sentences, say, truth))
    return out


def test_alignment_finds_pairs():
    made = corpus(60, 4)

    def value(sentences):
        return json.dumps([sentences[k] + "。" + sentences[k + 1] + "。" for k in range(0, len(sentences), 2)], ensure_ascii=False)

    def target(say):
        return json.dumps({"paragraphs": [{"id": k // 2 + 1, "text": " ".join(say[k : k + 2])} for k in range(0, len(say), 2)]})

    lexicon = bitext.fit([(value(s), target(t)) for s, t, _ in made])
    hit = total = given = 0
    for sentences, say, truth in made[:20]:
        order = list(range(16))
        order[4], order[5] = order[5], order[4]
        dropped = order.pop(9)
        moved = [say[k] for k in order]
        moved.insert(3, "Zuzu zozo zizi.")
        position = {k: (j if j < 3 else j + 1) for j, k in enumerate(order)}
        want = {(k, position[k]) for k in range(16) if k != dropped}
        found = set(bitext.align(lexicon, bitext.source_side(value(sentences)), bitext.target_side(target(moved))))
        hit, total, given = hit + len(found & want), total + len(want), given + len(found)
    assert hit / total > 0.95 and hit / given > 0.95


def test_main_body_keeps_story(spark, data):
    """On given rows: invalid sources have no lines, the result repeats nothing, residue and scene breaks stay."""
    found = mainbody.p6_found(spark, data)
    keys = rows(found)
    assert len(keys) == len(set(keys)) > 0
    text = {(r["book_id"], r["number"]): r["source"] for r in chapters.table(spark, data, "chapters").collect()}
    for book, number, para in keys:
        line = json.loads(text[book, number])[para - 1]
        assert not mainbody.BREAK.fullmatch(line) and residue.classify(line) is None


@needs_vocabulary
def test_ids_equal_the_librarys():
    from tokenizers import Tokenizer

    ours = ByteBpe(open("/opt/tokenizers/byte_bpe_50k.tiktoken", "rb").read())
    theirs = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    theirs.encode_special_tokens = True
    random.seed(1)
    texts = ["", " ", "\n\n a", "<|endoftext|>", "a" * (LONG + 1), "霜" * 900, "é́ ﬁ 🙂‍", "'s 'S don't  x", "ab" * 2000]
    texts += ["".join(chr(random.choice([32, 97, 98, 233, 0x4E00, 0x1EA1, 0x3042, 0x1F600, 10, 39, 48])) for _ in range(random.randrange(60))) for _ in range(400)]
    assert [list(x) for x in ours.encode([*texts, None])] == [x.ids for x in theirs.encode_batch(texts, add_special_tokens=False)] + [[]]


@needs_vocabulary
def test_ids_decode_to_the_text(spark, data):
    import base64

    pieces = {}
    for line in open("/opt/tokenizers/byte_bpe_50k.tiktoken", "rb"):
        token, rank = line.split()
        pieces[int(rank)] = base64.b64decode(token)
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for row in tokens.p7_ids(spark, data).collect():
        assert b"".join(pieces[k] for k in row["ids"]).decode() == (text[row["doc_id"]] or "")


def test_packing_places_everything_once(spark):
    random.seed(8)
    sizes = [random.choice([0, 1, 7, 40, 99, 100, 101, 250]) for _ in range(3000)]
    df = spark.createDataFrame([(k, s if s != 7 else None, 5) for k, s in enumerate(sizes)], "item long, a long, b long").repartition(5)
    out = packing.pack(df.withColumn("container", df["item"]), [(1, "a", 100), (2, "b", 64)], windows=8, group=16).collect()
    fill: dict = {}
    parts: dict = {}
    for r in out:
        fill[r["spec_id"], r["container"]] = fill.get((r["spec_id"], r["container"]), 0) + r["size"]
        parts.setdefault((r["spec_id"], r["item"]), []).append((r["part"], r["start"], r["size"]))
    assert all(v <= (100 if k[0] == 1 else 64) for k, v in fill.items())
    for k, size in enumerate(sizes):
        got = sorted(parts.get((1, k), []))
        assert sum(p[2] for p in got) == (size if size != 7 else 0)
        assert [p[1] for p in got] == [sum(q[2] for q in got[:j]) for j in range(len(got))]
        assert len(got) == (0 if size in (0, 7) else -(-size // 100))
    need = sum(s for s in sizes if s != 7)
    assert need / 100 <= sum(1 for k in fill if k[0] == 1) < need / 100 * 1.08 + 5
    with pytest.raises(ValueError):
        packing.pack(df, [(1, "a", 0)])


def test_forward_backward_is_exact():
    """Marginals against the sum over all labellings."""
    import itertools

    model = languages.Crf(["x", "y"])
    model.edges = np.log(np.array([[0.8, 0.2], [0.3, 0.7]]))
    random.seed(6)
    words = [f"w{k}" for k in range(5)]
    scores = {w: np.log(np.array(p) / sum(p)) for w in words for p in [[random.random() + 0.1, random.random() + 0.1]]}
    model.nodes = lambda ws: np.array([scores[w] for w in ws])
    got = model.marginals([words, words[:2]])
    for chain, marginal in ((words, got[0]), (words[:2], got[1])):
        total = np.zeros((len(chain), 2))
        for path in itertools.product((0, 1), repeat=len(chain)):
            p = np.exp(sum(scores[w][c] for w, c in zip(chain, path)) + sum(model.edges[a, b] for a, b in zip(path, path[1:])))
            for t, c in enumerate(path):
                total[t, c] += p
        assert np.allclose(total / total.sum(axis=1, keepdims=True), marginal)


def test_languages_of_stretches():
    en = "the old man walked home and the boat landed before dawn with nobody on it".split()
    fr = "le vieil homme marchait vers la maison et le bateau arrivait avant la nuit".split()
    random.seed(9)
    texts, labels = [], []
    for k in range(200):
        for words, label in ((en, "en"), (fr, "fr")):
            texts.append(" ".join(random.choices(words, k=12)))
            labels.append(label if k % 10 else ("fr" if label == "en" else "en"))
    model = languages.fit(texts, labels)
    mixed = "\n".join(["12", " ".join(en[:8]), "***", " ".join(fr[:8]), " ".join(fr[3:]), ""])
    assert [(line, lang) for line, lang, _ in languages.stretches(model, [mixed])[0]] == [(1, "en"), (4, "fr")]
    assert languages.stretches(model, [None, "", " \n", "12 3", "the boat"])[:4] == [[], [], [], []]
    fresh = [(" ".join(random.choices(w, k=10)), c) for w, c in ((en, "en"), (fr, "fr")) for _ in range(60)]
    right = sum(s[0][1] == c for s, (_, c) in zip(languages.stretches(model, [t for t, _ in fresh]), fresh))
    assert right / len(fresh) > 0.95


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, data, name):
    """Repeated lines and truncation against their SQL on the smallest given tables."""
    import duckdb

    connection = duckdb.connect()
    for file in os.listdir(data):
        connection.execute(f"create view {file.removesuffix('.parquet')} as select * from read_parquet('{data}/{file}')")
    result = connection.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    want = sorted(result.fetchall())
    assert rows(queries.queries()[name](spark, data).select(*columns)) == want and want
