"""Scalar text functions as Column expressions; UDFs only where Spark has no built-in."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Full-width ASCII and the ideographic space with their narrow forms.
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
NARROW = "".join(map(chr, range(0x21, 0x7F))) + " "
#: Characters of numerals in chapter labels (fixed values).
NUMERAL = "[0-9零〇一二两三四五六七八九十百千万]+"
DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100, "千": 1000}


def _each(function):
    """A vectorised UDF of a function of one string; null stays null."""

    @F.pandas_udf(T.StringType())
    def udf(values: pd.Series) -> pd.Series:
        return values.map(lambda v: function(v) if isinstance(v, str) else None)

    return udf


nfkc = _each(lambda v: unicodedata.normalize("NFKC", v))


def folded(text: Column) -> Column:
    """Narrow and lower case, without Python: NFKC for what web text usually has of it."""
    return F.lower(F.translate(text, WIDE, NARROW))


def normalized(text: Column, compatible: bool = True) -> Column:
    """Letters and digits only, in lower case; after NFKC, or after `folded` if not ``compatible``."""
    ready = F.lower(nfkc(text)) if compatible else folded(text)
    return F.regexp_replace(ready, r"[^\p{L}\p{N}]", "")


def title_key(title: Column, compatible: bool = True) -> Column:
    """What identifies a chapter title: without everything up to its number, part marks kept."""
    ready = nfkc(title) if compatible else F.translate(title, WIDE, NARROW)
    return normalized(F.regexp_replace(ready, f"^.*?第{NUMERAL}章\\s*", ""), compatible=False)


def matching_key(title: Column, literal: Column | bool, compatible: bool = True) -> Column:
    """`normalized` for literal editions, else `title_key`."""
    flag = F.lit(literal) if isinstance(literal, bool) else literal
    return F.when(flag, normalized(title, compatible)).otherwise(title_key(title, compatible))


def numeral_value(numeral: Column) -> Column:
    """Value of ASCII digits or of a positional Han numeral below 10^8; null for anything else."""
    digit = F.create_map(*[F.lit(x) for pair in DIGITS.items() for x in pair])
    unit = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("section"), F.lit(0).cast("long").alias("digit"))

    def step(acc: Column, c: Column) -> Column:
        zero = F.lit(0).cast("long")
        return (
            F.when(c.isin(*DIGITS), F.struct(acc["total"].alias("total"), acc["section"].alias("section"), digit[c].cast("long").alias("digit")))
            .when(c == "万", F.struct((acc["total"] + (acc["section"] + acc["digit"]) * 10000).alias("total"), zero.alias("section"), zero.alias("digit")))
            .otherwise(F.struct(acc["total"].alias("total"), (acc["section"] + F.greatest(acc["digit"], F.lit(1).cast("long")) * unit[c]).alias("section"), zero.alias("digit")))
        )

    han = F.aggregate(F.filter(F.split(numeral, ""), lambda c: c != ""), start, step, lambda a: a["total"] + a["section"] + a["digit"])
    return F.when(numeral.rlike("^[0-9]+$"), numeral.try_cast("long")).when(numeral.rlike("^[零〇一二两三四五六七八九十百千万]+$"), han)


def chapter_number(title: Column, compatible: bool = True) -> Column:
    """Number in a chapter label like 第十二章; null where there is none."""
    ready = nfkc(title) if compatible else F.translate(title, WIDE, NARROW)
    found = F.regexp_extract(ready, f"第({NUMERAL})章", 1)
    return numeral_value(F.when(found != "", found))


def letter_ratio(text: Column, letters: str = "\\x{4e00}-\\x{9fff}") -> Column:
    """Share of the characters that are of a class (A13); 0 for empty texts."""
    return F.length(F.regexp_replace(text, f"[^{letters}]", "")) / F.greatest(F.length(text), F.lit(1))


#: Marks of an access page in place of a chapter (fixed values).
INTERSTITIAL = ("下载APP继续阅读", "请登录后阅读", "购买本章", "验证码")


def gate(text: Column, least: int = 500, most: int = 30_000, ratio: float = 0.4, letters: str = "\\x{4e00}-\\x{9fff}", marks: tuple = INTERSTITIAL) -> Column:
    """The first quality gate that a text fails, in order; null if it passes all."""
    private = text.rlike("[\\x{e000}-\\x{f8ff}\\x{fffd}]")
    access = F.lit(False)
    for mark in marks:
        access = access | F.contains(text, F.lit(mark))
    return (
        F.when(text.isNull(), "missing")
        .when(~F.length(text).between(least, most), "length")
        .when(private, "obfuscated")
        .when(letter_ratio(text, letters) < ratio, "script")
        .when(access, "interstitial")
    )


def contains_word(text: Column, phrase: Column) -> Column:
    """Whether a phrase stands in a text as whole words, whatever case and spacing."""

    @F.pandas_udf(T.BooleanType())
    def found(texts: pd.Series, phrases: pd.Series) -> pd.Series:
        def one(t, p):
            if t is None or p is None:
                return None
            a, b = (" ".join(unicodedata.normalize("NFC", x).casefold().split()) for x in (t, p))
            return re.search(r"(?<!\w)" + re.escape(b) + r"(?!\w)", a) is not None

        return pd.Series([one(t, p) for t, p in zip(texts, phrases)], dtype=object)

    return found(text, phrase)


def fingerprint(paragraphs: Column, compatible: bool = True) -> Column:
    """SHA-256 of the normalized text of an array of paragraphs (X11); null for no array or only null paragraphs."""
    whole = F.when(F.exists(paragraphs, lambda p: p.isNotNull()), F.array_join(paragraphs, ""))
    return F.sha2(normalized(whole, compatible), 256)


def tidy(text: Column) -> Column:
    """Single line ends, blank lines as paragraph breaks, other white space collapsed."""
    unix = F.regexp_replace(text, "\r\n?", "\n")
    parts = F.filter(F.transform(F.split(unix, r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")
    return F.array_join(parts, "\n\n")


def markup_gate(text: Column) -> Column:
    """Findings on a translated text: empty, markup, leftover Han (X41); null if clean."""
    return (
        F.when(text.isNull() | (F.trim(text) == ""), "empty")
        .when(text.rlike("[\\x{e000}-\\x{f8ff}]|<[^>]*>|```"), "markup")
        .when(text.rlike("[\\x{4e00}-\\x{9fff}]"), "han")
    )


def length_gate(source: Column, target: Column) -> Column:
    """Whether a translation's length is plausible for sources of over 20 characters."""
    return (F.length(source) <= 20) | (F.length(target) / F.length(source)).between(0.35, 12)


#: Messages by kind of failure, in order of precedence (fixed values).
POLICY = ("blocked by content safety", "content policy", "content_policy", "content_filter", "safety policy", "prohibited use policy", "prohibited_content", "finish_reason: safety", "finishreason: safety")
QUOTA = ("usage limit", "rate limit", "rate_limit", "quota", "resource_exhausted", "429", "out of tokens", "insufficient credits")
TRANSIENT = ("connection", "timed out", "temporarily", "503", "502", "stream disconnected")


def any_of(text: Column, phrases: tuple[str, ...]) -> Column:
    return text.rlike("|".join(re.escape(p) for p in phrases))


def failure_kind(message: Column) -> Column:
    """content_blocked, quota, transient or review, by a message's phrases in that order."""
    low = F.lower(message)
    return (
        F.when(any_of(low, POLICY) | F.ltrim(low).startswith("policy:"), "content_blocked")
        .when(any_of(low, QUOTA), "quota")
        .when(any_of(low, TRANSIENT), "transient")
        .when(message.isNotNull(), "review")
    )


def redacted(message: Column) -> Column:
    """A message without credentials."""
    return F.regexp_replace(message, "(?i)(Bearer\\s+|sk-)[^\\s\"']+", "[REDACTED]")


def is_slug(value: Column) -> Column:
    """Whether a value is a valid identifier."""
    return value.rlike("^[a-z0-9][a-z0-9-]{0,79}$")


def utc_day(epoch: Column) -> Column:
    """UTC day of epoch seconds."""
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd")


def backoff(now: Column, attempts: Column) -> Column:
    """Next permitted time after ``attempts``."""
    return now + F.lit(300.0) * F.pow(F.lit(2.0), attempts - 1)


def reservation(prompt: Column, output_tokens: int) -> Column:
    """Tokens to reserve for a prompt: its bytes and the largest output."""
    return F.octet_length(prompt) + F.lit(output_tokens)


def label(number: Column, title: Column) -> Column:
    """A chapter's heading in a book, not repeated where the title is the bare number."""
    bare = F.concat(F.lit("Chương "), number.cast("string"))
    return F.when(F.lower(F.trim(title)) == F.lower(bare), bare).otherwise(F.concat(bare, F.lit(": "), title))


def escaped(text: Column) -> Column:
    """Text for XHTML."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for sign, entity in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(sign), F.lit(entity))
    return out


def chunks(payload: Column, size: int = 6144) -> Column:
    """URL-safe base64 of each ``size`` bytes; the chunks concatenate without padding if size is a multiple of 3."""
    count = F.ceil(F.octet_length(payload) / F.lit(size)).cast("int")
    pieces = F.when(
        count > 0,
        F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda k: F.translate(F.base64(F.substring(payload, k * size + 1, F.lit(size))), "+/\r\n", "-_")),
    )
    return F.coalesce(pieces, F.array().cast("array<string>"))
