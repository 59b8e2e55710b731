"""Reader layout, joined paragraphs and JSON with redundant commas."""

from __future__ import annotations

import json
import unicodedata
from itertools import accumulate, groupby

#: Marks that end a sentence, and marks that may close behind them (fixed values).
ENDERS, CLOSERS = "。！？!?；;.…:：", "”’\"'）)]】"
#: Ends of an utterance behind which another one may start.
UTTERED = tuple(mark + "”" for mark in ".!?…")


def tidy(text: str) -> str:
    unix = unicodedata.normalize("NFC", text).replace("\r\n", "\n").replace("\r", "\n")
    # A line of white space only is a break; other line ends are wraps.
    blocks = groupby(unix.split("\n"), key=lambda line: bool(line.strip()))
    return "\n\n".join(" ".join(" ".join(lines).split()) for shown, lines in blocks if shown)


def runs(items: list, starts: list[bool]) -> list[list]:
    """``items`` cut before each start."""
    numbered = zip(accumulate(starts, lambda n, start: n + bool(start)), items)
    return [[item for _, item in run] for _, run in groupby(numbered, key=lambda pair: pair[0])]


def open_ended(paragraph: str) -> bool:
    """Whether a paragraph has text and stops inside a sentence."""
    text = paragraph.rstrip()
    return bool(text) and text.rstrip(CLOSERS)[-1:] not in tuple(ENDERS) and "\n\n" not in paragraph


def groups(source: list[str], joined: list[bool]) -> list[list[int]]:
    """Indices of paragraphs that are judged together: a join counts only behind an unfinished source paragraph."""
    open_ = [False, *map(open_ended, source), *[False] * len(joined)]
    return runs(list(range(len(joined))), [not (join and before) for join, before in zip(joined, open_)])


def utterances(block: str) -> list[str]:
    """A block cut between one utterance's end and the next one's opening quote."""
    first, *rest = block.split("“")
    starts = [before.rstrip().endswith(UTTERED) for before in (first, *rest[:-1])]
    quoted = [first, *("“" + part for part in rest)]
    pieces = ["".join(run) for run in runs(quoted, [True, *starts])]
    return [*(piece.rstrip() for piece in pieces[:-1]), pieces[-1]]


def reader_paragraphs(paragraphs: list[tuple[str, bool]]) -> list[str]:
    """Texts as a reader sees them: utterances apart, joined paragraphs together."""
    shown = [
        (piece, not (join and k == 0))
        for text, join in paragraphs
        for k, piece in enumerate(piece for block in tidy(text or "").split("\n\n") for piece in utterances(block))
        if piece
    ]
    return [" ".join(run) for run in runs([piece for piece, _ in shown], [start for _, start in shown])]


def loads(raw: str, most: int = 16):
    """Strict JSON, but for up to ``most`` redundant commas in objects, where the parser itself points at them.

    A comma is redundant before the closing brace and before another comma;
    nothing is ever removed from arrays or strings.
    """
    removed = 0
    while True:
        try:
            return json.loads(raw)
        except json.JSONDecodeError as problem:
            at = problem.pos
            if problem.msg.startswith("Expecting property name"):
                # Points behind the comma: a second comma, or (in some versions) the brace.
                at = len(raw[:at].rstrip()) - 1
            elif not problem.msg.startswith("Illegal trailing comma before end of object"):
                raise
            rest = raw[at + 1 :].lstrip()[:1]
            if removed == most or raw[at : at + 1] != "," or rest not in ("}", ","):
                raise
            raw, removed = raw[:at] + raw[at + 1 :], removed + 1


def unfenced(text: str) -> str:
    """The content of a fenced block that is the whole text, else the text."""
    first, _, rest = text.strip().partition("\n")
    body, mark, behind = rest.rpartition("\n```")
    return body if first.rstrip() in ("```", "```json") and mark and not behind else text.strip()


def response(lines: list[str], models: set[str], agent: str) -> dict:
    """Content and usage of one recorded stream of events, or the reason why it has none.

    Events are gathered by type; the stream is good if none of the ordered
    checks over these groups fails.
    """
    by_type: dict[str, list[dict]] = {"init": [], "result": [], "step_update": []}
    for event in map(json.loads, filter(str.strip, lines)):
        kind = event.get("event") or ("step_update" if event.get("step_update") else None)
        for name in {kind, "step_update" if event.get("step_update") else kind} & by_type.keys():
            by_type[name].append(event.get(name) or {})
    init, end = ((by_type[name] + [{}])[0] for name in ("init", "result"))
    tokens = (end.get("usage") or {}).get("total_tokens")
    usage = tokens if type(tokens) is int and tokens >= 0 else None
    structured, text = end.get("structured_output"), end.get("response")
    checks = {
        "incomplete": len(by_type["init"]) == len(by_type["result"]) == 1,
        "model": init.get("model") in models,
        "agent": init.get("agent") == agent,
        "tool": all(step.get("step_type") != "tool" for step in by_type["step_update"]),
        "status": end.get("status") == "SUCCESS",
        "usage": usage is not None,
        "turns": end.get("num_turns") == 1,
        "empty": structured is not None or isinstance(text, str),
    }
    reason = next((name for name, passed in checks.items() if not passed), None)
    early = ("incomplete", "model", "agent", "tool")
    content = None if reason else json.dumps(structured, ensure_ascii=False) if structured is not None else unfenced(text)
    return {"content": content, "usage": None if reason in early else usage, "reason": reason}
