"""Configurations with every fault told, and recorded streams that are matched to their calls."""

from __future__ import annotations

import json

import pytest

from inkloom.sources import files

BOOK = """
[[books]]
id = "{id}"
expected_chapters = {count}
original_title = "书"
author = "人"
source_url = "https://s/"
toc_selector = "a"
content_selector = "#c"
encoding = "utf-8"
{more}
"""


def write(folder, *books, tail=""):
    (folder / "c.toml").write_text("".join(BOOK.format(**({"id": "a", "count": 2, "more": ""} | b)) for b in books) + tail, "utf-8")
    return str(folder / "c.toml")


def manifest(folder, **change):
    chapters = [{"number": n, "url": f"u{n}", "word_count": 5} for n in (1, 2)]
    (folder / "m.json").write_text(json.dumps({"original_title": "书", "author": "人", "source_url": "https://s/", "chapters": chapters} | change), "utf-8")


def test_whole_configuration(tmp_path):
    manifest(tmp_path)
    value = files.config(write(tmp_path, {"more": 'toc_mode = "ordered"\nreference_manifest = "m.json"\nliteral_titles = true'}, {"id": "b"}, tail="[limits]\ncalls_total = 0\n"))
    assert [s["id"] for b in value["books"] for s in b["sources"]] == ["primary", "primary"]
    assert [s["literal_titles"] for b in value["books"] for s in b["sources"]] == [True, False]


@pytest.mark.parametrize(
    ("book", "tail", "fault"),
    [
        ({"id": "A b"}, "", "books: ids"),
        ({"count": 0}, "", "expected_chapters"),
        ({"more": 'contextual_terms = ["x", ""]'}, "", "contextual_terms"),
        ({"more": "literal_titles = 1"}, "", "flags"),
        ({"more": 'toc_mode = "odd"'}, "", "toc_mode"),
        ({"more": 'toc_mode = "ordered"'}, "", "ordered"),
        ({"more": '[[books.sources]]\nid = "x"\nsource_url = "u"\ntoc_selector = "a"\nencoding = "utf-8"'}, "", "a/x: content_selector"),
        ({"more": '[[books.sources]]\nid = "x"\nsource_url = "u"\ntoc_selector = "a"\nencoding = "utf-8"\nadapter = "odd"'}, "", "a/x: adapter"),
        ({"more": '[[books.sources]]\nid = "x"\nsource_url = "u"\nencoding = "utf-8"\nadapter = "piaotia"'}, "", "a/x: required"),
        ({"more": '[[books.sources]]\nid = "x"\nsource_url = "u"\ntoc_selector = "a"\nencoding = "utf-8"\nadapter = "piaotia"\nreference_titles = true'}, "", "reference_titles"),
        ({}, "[limits]\ncalls_total = -1\n", "limits: calls_total"),
        ({}, "[jobs]\nbatch = 0\n", "jobs: batch"),
    ],
)
def test_faults_are_told(tmp_path, book, tail, fault):
    with pytest.raises(ValueError, match=fault):
        files.config(write(tmp_path, book, tail=tail))


@pytest.mark.parametrize("change", [{"author": "x"}, {"chapters": []}, {"chapters": [{"number": 1, "url": "u", "word_count": 5}, {"number": 2, "url": "u", "word_count": 5}]}])
def test_other_editions_are_refused(tmp_path, change):
    manifest(tmp_path, **change)
    with pytest.raises(ValueError, match="a: reference_manifest"):
        files.config(write(tmp_path, {"more": 'reference_manifest = "m.json"'}))


def test_recorded_streams_of_calls(spark, tmp_path):
    def attempt(name, request, response="{}", whole=True):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "request.json").write_text(json.dumps({"call_id": 1, "prompt_hash": "h", "model": "m", "effort": "high"} | request))
        events = [{"event": "init", "init": {"model": request.get("model", "m"), "agent": "high"}}]
        if whole:
            events.append({"event": "result", "result": {"status": "SUCCESS", "num_turns": 1, "response": response, "usage": {"total_tokens": 7}}})
        (folder / "events.jsonl").write_text("\n".join(map(json.dumps, events)))

    attempt("a1", {}, whole=False)
    attempt("a2", {}, response="second")
    attempt("a3", {}, response="third")
    attempt("b1", {"call_id": 2, "effort": "low"})
    attempt("b2", {"call_id": 2, "prompt_hash": "other"})
    attempt("b3", {"call_id": 2, "model": "n"})
    attempt("c1", {"call_id": 3}, response="x" * 3000)
    calls = spark.createDataFrame([(1, "h", "m"), (1, "h", "m"), (2, "h", "m"), (3, "h", "m"), (4, None, None)], "id long, prompt_hash string, model string")
    found = files.recovered(spark, f"{tmp_path}/*/request.json", f"{tmp_path}/*/events.jsonl", calls, most=2000).collect()
    assert [(r["id"], r["content"], r["usage"]) for r in found] == [(1, "second", 7)] and "/a2/" in found[0]["path"]
