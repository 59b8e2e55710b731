"""Operators of the reference: fixtures, brute force and round trips."""

from __future__ import annotations

import io
import json
import random
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkloom.functions import glossary as G
from inkloom.functions import numerals as N
from inkloom.functions import text as X
from inkloom.operators import align, dedup, parallel, reading
from inkloom.sources import epub, files, html
from inkloom.streaming import ledger


def one(spark, value, *columns):
    return tuple(spark.createDataFrame([value], ", ".join(f"c{k} string" for k in range(len(value)))).select(*columns).first())


# Text.


def test_keys_and_numbers(spark):
    titles = ["第１２章 归舟（上）", "正文 第三百零五章  夜雨", "第两千章", "第十章", "楔子", "", None, "第一万二千章 x"]
    df = spark.createDataFrame([(t,) for t in titles], "t string").select(
        X.chapter_number(F.col("t")).alias("n"), X.title_key(F.col("t")).alias("k"), X.matching_key(F.col("t"), True).alias("m")
    )
    got = df.collect()
    assert [r["n"] for r in got] == [12, 305, 2000, 10, None, None, None, 12000]
    assert [r["k"] for r in got][:2] == ["归舟上", "夜雨"]
    assert got[0]["m"] == "第12章归舟上" and got[6]["k"] is None


def test_gates_in_order(spark):
    texts = ["", "短", "汉" * 20, "a" * 20, "汉" * 20 + "", "汉" * 20 + "验证码", None, "a" * 20 + "�"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(X.gate(F.col("t"), least=10, most=100))
    assert [r[0] for r in df.collect()] == ["length", "length", None, "script", "obfuscated", "interstitial", "missing", "obfuscated"]


def test_failure_kinds(spark):
    messages = ["Blocked by content safety; quota", "policy: no", "HTTP 429 timed out", "Timed out", "odd", None]
    df = spark.createDataFrame([(m,) for m in messages], "m string").select(X.failure_kind(F.col("m")))
    assert [r[0] for r in df.collect()] == ["content_blocked", "content_blocked", "quota", "transient", "review", None]


def test_small_functions(spark):
    assert one(spark, ("Authorization: Bearer abc sk-12",), X.redacted(F.col("c0"))) == ("Authorization: [REDACTED] [REDACTED]",)
    assert one(spark, ("a\r\n b\t c\n\n\n d ",), X.tidy(F.col("c0"))) == ("a b c\n\nd",)
    assert one(spark, ("Ệ Phong đến", "phong"), X.contains_word(F.col("c0"), F.col("c1"))) == (True,)
    assert one(spark, ("ệphong", "phong"), X.contains_word(F.col("c0"), F.col("c1"))) == (False,)
    assert one(spark, ("<a href=\"x\">'&",), X.escaped(F.col("c0"))) == ("&lt;a href=&quot;x&quot;&gt;&#x27;&amp;",)


@pytest.mark.parametrize("size", [0, 1, 6143, 6144, 6145, 20000])
def test_chunks_concatenate(spark, size):
    import base64

    data = bytes(k * 7 % 256 for k in range(size))
    got = spark.createDataFrame([(bytearray(data),)], "b binary").select(X.chunks(F.col("b"))).first()[0]
    assert base64.urlsafe_b64decode("".join(got)) == data and len(got) == -(-size // 6144)


# Numerals.


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**12 - 1))
def test_numerals_round_trip(value):
    assert N.valued(N.spelled(value)) == value


@pytest.mark.parametrize(
    ("source", "target", "valid"),
    [
        ("欠四十贯钱。", "Nợ 40 quan.", True),
        ("三四十人。", "40 người.", False),
        ("五十两银子。", "52 lạng bạc.", False),
        ("五十两银子。", "50 lạng bạc.", True),
        ("五万大军。", "5 vạn quân.", True),
        ("五万人。", "50.000 người.", True),
        ("五万人。", "50,000 người.", False),
        ("3万人", "3 vạn người", True),
        ("3万人", "3 người", False),
        ("没有数。", "Không có.", True),
        ("一百人。", "Rất đông.", True),
        ("一人二人", "2 1", False),
        ("", "", True),
    ],
)
def test_numeric_fidelity(source, target, valid):
    assert N.faithful(source, target) is valid


def test_numeric_fidelity_nulls():
    assert N.faithful(None, "1") is None and N.faithful("一", None) is None
    assert N.spelled(-1) is None and N.spelled(10**12) is None and N.valued("") == -1 and N.valued("一亿二亿") == -1


# Alignment of catalogs.


def aligned(spark, canonical, candidate):
    can = spark.createDataFrame([("b", n, k) for n, k in canonical], "b string, n long, k string")
    cand = spark.createDataFrame([("b", "s", pos, k) for pos, k in enumerate(candidate)], "b string, s string, pos long, k string")
    return {r["pos"]: r["n"] for r in align.align(can, cand, ["b"], ["s"]).collect()}


def brute_align(canonical, candidate):
    """The rules in procedural form."""
    keys = [k for _, k in canonical]
    number = {k: n for n, k in canonical}
    anchor = [number[k] if keys.count(k) == 1 and candidate.count(k) == 1 else None for k in candidate]
    kept = {}
    for i, n in enumerate(anchor):
        near = [(j, anchor[j]) for j in (i - 1, i + 1) if n is not None and 0 <= j < len(anchor) and anchor[j] is not None]
        if near and all((j < i) == (m < n) for j, m in near) and any(abs(m - n) <= 2 for _, m in near):
            kept[i] = n
    at = sorted(kept)
    by_number = dict(canonical)
    out = dict(kept)
    for a, b in zip(at, at[1:]):
        if b - a >= 2 and b - a == kept[b] - kept[a] and all(by_number.get(kept[a] + i - a) == candidate[i] for i in range(a + 1, b)):
            out |= {i: kept[a] + i - a for i in range(a + 1, b)}
    return out


def test_alignment_cases(spark):
    titles = list("甲乙丙丁戊")
    canonical = list(enumerate(titles, 1))
    assert aligned(spark, canonical, titles) == {k: k + 1 for k in range(5)}
    assert aligned(spark, canonical, [t for t in titles if t != "丙"]) == {0: 1, 1: 2, 2: 4, 3: 5}
    assert aligned(spark, list(enumerate("起重重终", 1)), list("起重重终")) == {}
    assert aligned(spark, list(enumerate("甲乙重重丙丁", 1)), list("甲乙重重丙丁")) == {k: k + 1 for k in range(6)}
    assert aligned(spark, list(enumerate("甲乙丙丁", 1)), list("甲丙乙丁")) == brute_align(list(enumerate("甲乙丙丁", 1)), list("甲丙乙丁"))
    assert aligned(spark, [], titles) == {} and aligned(spark, canonical, []) == {}


def test_alignment_against_brute_force(spark):
    random.seed(11)
    can, cand, want = [], [], {}
    for book in range(120):
        keys = [random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(random.randrange(1, 14))]
        canonical = list(enumerate(keys, 1))
        candidate = [k for k in keys if random.random() > 0.15]
        if len(candidate) > 2 and random.random() < 0.4:
            i = random.randrange(len(candidate) - 1)
            candidate[i], candidate[i + 1] = candidate[i + 1], candidate[i]
        can += [(f"b{book}", n, k) for n, k in canonical]
        cand += [(f"b{book}", "s", pos, k) for pos, k in enumerate(candidate)]
        want |= {(f"b{book}", i): n for i, n in brute_align(canonical, candidate).items()}
    got = align.align(spark.createDataFrame(can, "b string, n long, k string"), spark.createDataFrame(cand, "b string, s string, pos long, k string"), ["b"], ["s"])
    assert {(r["b"], r["pos"]): r["n"] for r in got.collect()} == want and len(want) > 100


# Duplicates.


def test_near_duplicates_against_brute_force(spark):
    random.seed(12)
    base = ["".join(random.choices("abcdefgh", k=random.randrange(20, 90))) for _ in range(12)]
    texts = []
    for t in base:
        texts += [t, t, t[: int(len(t) * 0.9)], t[: len(t) // 2] + "zz" + t[len(t) // 2 :], t[::-1]]
    texts += [None, "", "short"]
    df = spark.createDataFrame([("x" if k % 7 else "y", k, t) for k, t in enumerate(texts)], "g string, id long, t string")
    got = {(r["g"], r["left_id"], r["right_id"]): r["score"] for r in dedup.near(df, ["g"], "id", "t", size=5).collect()}
    want = {}
    for g in "xy":
        first = {}
        for k, t in enumerate(texts):
            if ("x" if k % 7 else "y") == g and t is not None:
                first.setdefault(t, k)
        for a, i in first.items():
            for b, j in first.items():
                s, u = ({t[k : k + 5] for k in range(len(t) - 4)} for t in (a, b))
                if i < j and s and u and len(s & u) / min(len(s), len(u)) >= 0.85:
                    want[g, i, j] = round(len(s & u) / min(len(s), len(u)), 6)
    assert got == want and want


def test_overlap():
    assert dedup.overlap("", "a") == dedup.overlap(None, "a") == 0
    assert dedup.overlap("abc", "xxabcxx") == 1
    assert 0 < dedup.overlap("abcdefgh", "abcdxfgh") < 1


def test_near_all_equals_brute_force(spark):
    random.seed(11)
    base = ["".join(random.choices("天地玄黄宇宙洪荒日月盈昃", k=random.choice([1, 3, 6, 12, 25, 29, 30, 34, 60]))) for _ in range(25)]
    rows = []
    for g in ("x", "y"):
        for t in base:
            k = random.randrange(len(t))
            rows += [(g, t), (g, t[:k] + "变" + t[k + 1 :]), (g, t[k // 3 :] or t), (g, t + "尾")]
    rows = [(g, k, t) for k, (g, t) in enumerate(rows)] + [("x", 900, None), ("x", 901, ""), ("x", 902, rows[0][1])]
    df = spark.createDataFrame(rows, "g string, id long, t string")
    got = {(r["g"], r["left_id"], r["right_id"]) for r in dedup.near_all(df, ["g"], "id", "t").collect()}
    first = {}
    for g, k, t in rows:
        first.setdefault((g, t), k)
    texts = [(g, k, t) for (g, t), k in first.items() if t]
    want = {(g, min(a, b), max(a, b)) for g, a, s in texts for h, b, t in texts if g == h and a < b and dedup.overlap(s, t) >= 0.85}
    assert got == want and len(want) > 60


def test_whole_copies(spark):
    def repetition(paragraphs):
        row = spark.createDataFrame([(paragraphs,)], "p array<string>").select(dedup.without_copies(F.col("p")).alias("r")).first()["r"]
        return row["kept"], row["copies"], row["ids"]

    body = [f"第{i}段，" + "风吹过长街，灯影摇晃。" * 5 for i in range(14)]
    glued = [*body[:-1], body[-1] + body[0], *body[1:]]
    kept, copies, ids = repetition(glued)
    assert (kept, copies, ids) == (body, 2, [*range(1, 14), 27])
    orphan = [*body, body[0], *body[1:-1], body[-1] + "??"]
    assert repetition(orphan)[1] == 2
    changed = [*body, *body[:-1], body[-1] + "变"]
    assert repetition(changed)[:2] == (changed, 1)
    assert repetition(None) == ([], 1, []) and repetition(["a"] * 30)[1] == 1
    quoted = ["\\Q.*\\E" + p for p in body]
    assert repetition(quoted * 3)[1] == 3


def test_exact_copies(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "id long, h string")
    assert sorted(tuple(r) for r in dedup.exact(df, F.col("h"), "id").select("id", "first_copy").collect()) == [(1, 1), (2, 1), (3, 3), (4, 4)]


# Names.


def test_mentions_and_renderings():
    assert G.mentions("青石城城主与青石", {"青石", "青石城"}) == [(0, "青石城"), (6, "青石")]
    assert G.mentions("", {"a"}) == G.mentions("abc", set()) == []
    lexicon = frozenset({"大江", "山东", "江山"})
    assert G.mentions("大江山东", {"江山"}, lexicon) == []
    assert G.mentions("大江山", {"江山"}, lexicon) == [(1, "江山")]
    assert G.rendered("青石县", "huyện Thanh Thạch", "đến Thanh Thạch huyện")
    assert not G.rendered("青石县", "huyện Thanh Thạch", "đến Thanh Thủy huyện")
    assert "Lưu đại thiếu gia".lower() in G.renderings("刘家", "nhà họ Lưu", "刘家大少爷", 2)
    assert G.missing("青石来了", "Đá Xanh đã đến", {"青石": "Thanh Thạch"}) == ["青石 -> Thanh Thạch"]
    assert G.missing("青石来了", "THANH  thạch đã đến", {"青石": "Thanh Thạch"}) == []
    assert G.same_name("刘家", "nhà họ Lưu", "Lưu gia")


def test_aliases():
    names, aliases = {"青石": "Thanh Thạch", "白石": "Bạch Thạch"}, {"青石": ["Đá Xanh", "Đá"], "白石": ["Đá"]}
    assert G.unify_aliases("青石与白石", "đá xanh và Đá", names, aliases) == "Thanh Thạch và Đá"
    assert G.unify_aliases("无人", "Đá Xanh", names, aliases) == "Đá Xanh"


def test_findings(spark):
    assert parallel.findings(["他走了。"], [{"id": 1, "text": "Anh đi."}], {}) == []
    kinds = {k for _, k, _ in parallel.findings(["青石有三人。", "他"], [{"id": 2, "text": "<b>汉</b> 4"}], {"青石": "Thanh Thạch"})}
    assert kinds == {"coverage", "order", "markup", "han", "name", "number"}
    rows = [("b", 1, '["青石来了。"]', '{"paragraphs":[{"id":1,"text":"Thanh Thạch đến."}]}'), ("b", 2, "[", "{}"), ("b", 3, None, None)]
    chapters = spark.createDataFrame(rows, "book_id string, number long, source string, translated string")
    terms = spark.createDataFrame([("b", "青石", "Thanh Thạch", 1)], "book_id string, source string, translation string, chapter long")
    assert [(r["number"], r["kind"]) for r in parallel.validate(chapters, terms).collect()] == [(2, "json")]


# Layout, JSON and streams of events.


def test_reader_layout():
    assert reading.reader_paragraphs([("“A.” “B.”\nc", False), ("d\n\ne", True), ("", False)]) == ["“A.”", "“B.” c d", "e"]
    assert reading.groups(["他说，", "走了。", "后来"], [False, True, True]) == [[0, 1], [2]]
    assert reading.groups([], []) == []


@pytest.mark.parametrize("raw", ['{"a":1,}', '{"a":1,,"b":2}', '{"a":{"b":",}",},}'])
def test_redundant_commas_are_accepted(raw):
    assert reading.loads(raw)["a"]


@pytest.mark.parametrize("raw", ['{,"a":1}', '{"a":[1,]}', '{"a":1', '{"a":,}', '{"a":1}x', '{a:1}', '{"a":1 "b":2}', "x{}", '{"a":1' + "," * 20 + "}"])
def test_other_faults_are_rejected(raw):
    with pytest.raises(ValueError):
        reading.loads(raw)


def stream(**change):
    result = {"status": "SUCCESS", "num_turns": 1, "response": "```json\n{}\n```", "usage": {"total_tokens": 5}} | change
    return [json.dumps({"event": "init", "init": {"model": "m", "agent": "a"}}), json.dumps({"event": "result", "result": result})]


def test_event_streams(spark, tmp_path):
    assert reading.response(stream(), {"m"}, "a") == {"content": "{}", "usage": 5, "reason": None}
    for change, reason in (({"status": "ERROR"}, "status"), ({"num_turns": 2}, "turns"), ({"usage": {"total_tokens": -1}}, "usage"), ({"response": None}, "empty")):
        assert reading.response(stream(**change), {"m"}, "a")["reason"] == reason
    assert reading.response(stream()[:1], {"m"}, "a")["reason"] == "incomplete"
    assert reading.response(stream(), {"x"}, "a")["reason"] == "model"
    (tmp_path / "x.jsonl").write_text("\n".join(stream()))
    (tmp_path / "y.jsonl").write_text("{")
    got = files.streams(spark, [str(tmp_path / "x.jsonl"), str(tmp_path / "y.jsonl")], {"m"}, "a").collect()
    assert sorted((r["content"] or "", r["usage"], r["reason"]) for r in got) == [("", None, "json"), ("{}", 5, None)]


# Pages and files.

PAGE = '<html><h1>书</h1><div class="list"><a href="1.html">第一章 甲</a><a href="2.html">第2章 乙<br>丙</a><a href="http://x.example/3">第3章 丁</a><a href="2.html">第2章 他</a><a href="4">目录</a></div><div id="zw"><script>x()</script>　一 二<br>三<nav>菜单</nav><p>四</div></html>'


def test_pages():
    found = html.links(PAGE, "https://s.example/b/", ".list a[href]")
    assert [(x["number"], x["reason"]) for x in found] == [(1, None), (2, None), (3, "other host"), (2, "conflict"), (None, "no number")]
    assert found[0]["url"] == "https://s.example/b/1.html"
    assert html.body(PAGE, "#zw") == ["一 二", "三", "四"] and html.body(PAGE, ".none") == []
    assert html.between("x</H1>a<br>b </di>\n<BR/>c<br/>d<script>x<br>y</script>\ne<!--e-->", "</H1>", "<!--e-->") == ["a", "bc", "d e"]
    assert html.query_number("http://x/?novelid=1&chapterid=12") == 12 and html.query_number("http://x/?chapterid=0") is None
    assert html.decode("汉".encode("gb18030") + b"\xff", "gb18030-html").startswith("汉")
    with pytest.raises(UnicodeDecodeError):
        html.decode(b"\xff\xff", "utf-8")
    key = str.strip
    assert html.rejected(["甲"], "a", "a", key, PAGE) is None
    assert html.rejected(["甲"], "a", "b", key, PAGE) == "title"
    assert html.rejected(["第2章 乙"], "a", "a", key, "") == "merged"
    assert html.rejected(["甲"], "a", "a", key, "本章字数：100") == "short"


def test_epub_round_trip(spark):
    book = epub.Book("b", "Sách & vở", [epub.Chapter(n, f"T{n}", [("Một.\x00", False), ("Hai", True)]) for n in range(1, 46)], "A", "http://s/")
    data = epub.build(book)
    assert epub.problem(data) is None and data == epub.build(book)
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        assert sum(n.startswith("OEBPS/part-") for n in archive.namelist()) == 3
    assert epub.problem(b"") == "archive"
    changed = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as old, zipfile.ZipFile(changed, "w") as new:
        for info in old.infolist():
            new.writestr(info, old.read(info).replace(b'id="ch-7"', b'id="ch-x"'))
    assert epub.problem(changed.getvalue()) == "anchor"
    assert epub.part_size(1597) == 20 and epub.part_size(6000) == 30
    rows = [("b", "T", 2, '{"title":"x","paragraphs":[{"id":1,"text":"a"}]}'), ("b", "T", 1, "{"), ("c", None, 1, None)]
    got = epub.books(spark.createDataFrame(rows, "book_id string, title string, number long, edited string")).collect()
    assert [(r["book_id"], r["chapters"], r["problem"]) for r in got] == [("b", 1, None)]


def test_books_are_whole_or_say_what_is_missing(spark):
    edited = '{"title":"x","paragraphs":[{"id":1,"text":"a"}]}'
    rows = [("w", 1, edited, "edited", None, 2), ("w", 2, None, "missing", "Trang mất", 2), ("w", 2, None, "missing", "Trang mất", 2)]
    rows += [("g", 1, edited, "edited", None, 3), ("g", 2, "{", "edited", None, 3), ("g", 3, None, "missing", None, 3), ("m", 1, edited, "edited", None, 1), ("m", 4, edited, "edited", None, 1)]
    rows += [(None, None, edited, None, None, None)]
    df = spark.createDataFrame([(b, "T", *r) for b, *r in rows], "book_id string, title string, number long, edited string, state string, summary string, expected long")
    got = {r["book_id"]: (r["chapters"], r["problem"], r["gap"]) for r in epub.books(df).collect()}
    assert got == {"w": (2, None, None), "g": (1, None, "chapter 2"), "m": (2, None, "chapter 4 of 1")}
    final = {r["book_id"]: (r["chapters"], r["bytes"] is None) for r in epub.books(df, preview=False).collect()}
    assert final == {"w": (2, False), "g": (0, True), "m": (0, True)}


def test_pages_of_sites():
    assert html.story(["一", "作者有话要说：", "二"]) == ["一"] and html.story([]) == []
    assert html.between("<h1>x</H1>成<br></di><br>州。<br>二 &amp;\n三<table>广告</table>", "</H1>", "END") == []
    assert html.between("<h1>x</H1>成<br></di><br>州。<br>二 &amp;\n三<table>广告</table>END", "</H1>", "END") == ["成州。", "二 & 三"]
    assert html.between("</H1>成</di><br>州END", "</H1>", "END") == ["成", "州"]
    assert html.rejected(["甲"], "a", "a", str.strip, "<a href='2'> 下一页</a>") == "pagination"
    rules = "User-agent: *\nDisallow: /private/\n"
    assert html.allowed(rules, "x", "http://s/book/1") and not html.allowed(rules, "x", "http://s/private/1") and html.allowed("", "x", "http://s/")


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, t long")
    new = spark.createDataFrame([(2, "c", 1), (3, "d", 1), (3, "d", 1)], "k long, v string, t long")
    assert sorted(tuple(r)[:2] for r in files.insert_ignore(old, new, ["k"]).collect()) == [(1, "a"), (2, "b"), (3, "d")]
    assert sorted(tuple(r)[:2] for r in files.insert_replace(old, new, ["k"], "t").collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert files.with_added(old).columns == ["k", "v", "t", *files.ADDED]


def test_readers(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"original_title": "书", "author": "人", "source_url": "u", "chapters": [{"number": 1, "source_title": "一", "url": "x", "word_count": 5}]}))
    assert files.manifests(spark, str(tmp_path / "m.json")).select("number", "word_count").first() == (1, 5)
    (tmp_path / "g.json").write_text("﻿" + json.dumps({"青石": "Thanh Thạch"}, ensure_ascii=False))
    assert files.dictionaries(spark, str(tmp_path / "g.json")).first() == ("青石", "Thanh Thạch")
    (tmp_path / "c.toml").write_text('[[books]]\nid = "a-b"\nexpected_chapters = 2\n')
    assert files.config(str(tmp_path / "c.toml"))["books"][0]["id"] == "a-b"
    (tmp_path / "d.toml").write_text('[[books]]\nid = "A b"\nexpected_chapters = 2\n')
    with pytest.raises(ValueError):
        files.config(str(tmp_path / "d.toml"))


# Streams.


def test_stream_equals_batch(spark, data, tmp_path):
    calls = spark.read.parquet(f"{data}/calls.parquet")
    calls.repartition(3).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = ledger.drain(spark, ledger.daily(source), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(map(tuple, got.select("day", "calls", "tokens").collect())) == sorted(map(tuple, ledger.daily(calls).collect()))


def test_windowed_stream(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").select("ts", "user_id", "event_type", "value")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    got = ledger.drain(spark, ledger.windows(source), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert got.count() == ledger.windows(events).count()


def test_due_schedule(spark):
    df = spark.createDataFrame([("a", 10.0), ("b", 99.0)], "job string, next_due double")
    assert [tuple(r) for r in ledger.due(df, 50.0, 30.0).orderBy("job").collect()] == [("a", 80.0, True), ("b", 99.0, False)]


# Registries and databases.


def test_merged_terms(spark):
    from inkloom.operators.terms import differs, merged

    rows = [
        ("b", 1, "青石", "A", "entity", False),
        ("b", 2, "青石", "B", "entity", False),
        ("b", 3, "青石", "C", "entity", True),
        ("b", 4, "青石", "D", "entity", True),
        ("b", 1, "白石", "A", "entity", True),
        ("b", 2, "白石", "B", "entity", True),
        ("b", 1, "石", "A", "entity", True),
        ("b", 2, "石", "B", "entity", True),
        ("b", 1, "黑石", "A", "entity", False),
    ]
    df = spark.createDataFrame(rows, "b string, t long, source string, translation string, kind string, approved boolean")
    got = {r["source"]: (r["translation"], r["kind"]) for r in merged(df, ["b"], ["t"]).collect()}
    assert got == {"青石": ("C", "entity"), "白石": ("A", "entity"), "石": ("A", "preferred"), "黑石": ("A", "candidate")}
    a = spark.createDataFrame([("x", 1, "一"), ("y", 1, "一"), ("z", 1, "一"), ("z", 2, None)], "b string, pos long, t string")
    c = spark.createDataFrame([("x", 1, "一"), ("y", 1, "二"), ("z", 1, "一"), ("z", 2, None), ("w", 1, "一")], "b string, pos long, t string")
    assert sorted(r[0] for r in differs(a, c, ["b"], ["t"]).collect()) == ["w", "y"]


def test_sqlite_source(spark, tmp_path):
    import sqlite3

    from inkloom.sources import sqlite

    path = str(tmp_path / "a b?.db")
    with sqlite3.connect(path) as db:
        db.execute("create table calls (id integer primary key, name text, at real)")
        db.execute('create table "nothing" (id integer)')
        db.executemany("insert into calls values (?, ?, ?)", [(k, f"n{k}" if k % 5 else None, k / 2) for k in range(1, 1001)])
    got = sqlite.read(spark, path, "calls", 300)
    assert got.count() == 1000 and got.filter("name is null").count() == 200 and got.agg(F.sum("at")).first()[0] == 250250
    assert sqlite.read(spark, path, "nothing").count() == 0
