"""Queries of operators that need Python, streams or files, and that SQL can't state or not on whole tables."""

from __future__ import annotations

from html import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.functions.numerals import numbers_match
from inkloom.functions.glossary import TITLES
from inkloom.operators import dedup, parallel, reading, results
from inkloom.plans.pairs import SPACE, lines_of, paragraphs, query, targets
from inkloom.session import table
from inkloom.sources import epub, html
from inkloom.streaming import ledger


#: Words of a lexicon that is collected from names.
LEXICON = 50_000


@query("x15_whole_copies")
def x15_whole_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and how many whole copies of themselves they hold."""
    documents = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("p"))
    return documents.select("doc_id", dedup.without_copies(F.col("p")).alias("r")).select("doc_id", "r.copies", F.size("r.kept").alias("kept"))


@query("x19_numeric_fidelity")
def x19_numeric_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the numbers of paragraphs at equal positions agree."""
    source, target = paragraphs(spark, sf_dir).withColumnRenamed("t", "src"), targets(spark, sf_dir)
    return source.join(target, ["book_id", "number", "pos"]).select("book_id", "number", "pos", numbers_match(F.col("src"), F.col("t")).alias("faithful"))


@query("x20_mentions")
def x20_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of every book in every paragraph, with offsets."""
    chapters = dedup.once(table(spark, sf_dir, "chapters").select("book_id", "number", "source"), ["book_id", "number"])
    lines = chapters.select("book_id", "number", lines_of(F.col("source")).alias("lines"))
    return parallel.term_mentions(lines, table(spark, sf_dir, "book_terms").select("book_id", "source"))


def _results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    chapters = dedup.once(table(spark, sf_dir, "chapters").select("book_id", "number", "source", "edited"), ["book_id", "number"])
    return chapters, table(spark, sf_dir, "book_terms").filter("kind = 'entity'")


@query("v1_results")
def v1_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that the gates find on each edited result, by level."""
    return results.judged(*_results(spark, sf_dir))


@query("v8_targets")
def v8_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short names of edited results that wait for a review, with their surroundings."""
    return results.review_targets(*_results(spark, sf_dir))


@query("v11_excluded")
def v11_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of names that only cross two words; the lexicon is that of all names and of the words for places and titles."""
    chapters, terms = _results(spark, sf_dir)
    # Names of one book are words in another; at most so many of the most frequent ones.
    words = terms.filter(F.length("source") > 1).groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(LEXICON).collect()
    return results.excluded(chapters, terms, {r["source"]: r["n"] for r in words} | {t: 1 for t in (*TITLES, *(a + b for a in "大小老" for b in "城村镇"))})


@query(
    "x4_page_bodies",
    f"""
with r as (select row_number() over () as rid, book_id, number, source from chapters where source is not null and json_valid(source)),
l as (select rid, book_id, number, unnest(from_json(source, '["VARCHAR"]')) as line, unnest(generate_series(1, cast(json_array_length(source) as bigint))) as i from r),
s as (select *, string_split_regex(coalesce(line, ''), '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') as parts from l),
q as (select rid, book_id, number, i, unnest(parts) as part, unnest(generate_series(1, len(parts))) as k from s),
b as (select *, regexp_replace(regexp_replace(part, '^{SPACE}+|{SPACE}+$', '', 'g'), '[\\t \\x{{3000}}]+', ' ', 'g') as text from q)
select book_id, number, count(*) as paragraphs, sha256(string_agg(text, chr(10) order by i, k)) as body from b where text <> '' group by rid, book_id, number
""",
)
def x4_page_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chapter set into a page with menus and scripts round it, and read back from its content node."""

    def back(lines) -> str | None:
        inside = "<br/>".join(escape(line or "") for line in lines)
        page = f'<html><nav>目录</nav><h1>书</h1><script>if (a < b) {{}}</script><div id="c" class="text">{inside}<script>x()</script><aside>广告</aside></div><div>页脚</div></html>'
        rows = html.body(page, "#c.text")
        return "\n".join(rows).encode("utf-8", "replace").decode() if rows else None

    @F.pandas_udf("string")
    def bodies(values: pd.Series) -> pd.Series:
        return values.map(lambda lines: None if lines is None else back(lines))

    chapters = table(spark, sf_dir, "chapters").select("book_id", "number", lines_of(F.col("source")).alias("lines")).filter("lines is not null")
    read = chapters.select("book_id", "number", bodies("lines").alias("body")).filter("body is not null")
    return read.select("book_id", "number", F.size(F.split("body", "\n")).cast("long").alias("paragraphs"), F.sha2("body", 256).alias("body"))


@query("v1_findings")
def v1_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = dedup.once(table(spark, sf_dir, "chapters").select("book_id", "number", "source", "translated"), ["book_id", "number"])
    terms = table(spark, sf_dir, "book_terms").filter("kind = 'entity'")
    return parallel.validate(chapters, terms)


@query(
    "x33_reader_paragraphs",
    f"""
with r as (select row_number() over () as rid, book_id, number, edited from chapters where edited is not null and json_valid(edited)),
p as (select rid, book_id, number, edited, unnest(generate_series(0, cast(json_array_length(edited, '$.paragraphs') as bigint) - 1)) as i from r),
t as (select rid, book_id, number, i, coalesce(json_extract_string(edited, '$.paragraphs[' || i || '].join_previous') = 'true', false) as joined,
  regexp_replace(nfc_normalize(coalesce(json_extract_string(edited, '$.paragraphs[' || i || '].text'), '')), '\\r\\n?', chr(10), 'g') as text from p),
b as (select *, array_to_string(list_filter(list_transform(string_split_regex(text, '\\n{SPACE}*\\n'), lambda x: trim(regexp_replace(x, '{SPACE}+', ' ', 'g'))), lambda x: x <> ''), chr(10) || chr(10)) as tidy from t),
u as (select *, string_split(regexp_replace(tidy, '([.!?…]”)\\s*“', '\\1' || chr(10) || chr(10) || '“', 'g'), chr(10) || chr(10)) as pieces from b),
e as (select rid, book_id, number, i, joined, unnest(pieces) as piece, unnest(generate_series(0, len(pieces) - 1)) as k from u),
g as (select *, sum(case when joined and k = 0 then 0 else 1 end) over (partition by rid order by i, k) as run from e where piece <> ''),
h as (select rid, book_id, number, run, string_agg(piece, ' ' order by i, k) as text from g group by all)
select book_id, number, cast(row_number() over (partition by rid order by run) - 1 as integer) as pos, text from h
""",
)
def x33_reader_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of each edited chapter as a reader sees them."""

    def one(value: str | None) -> list[str]:
        try:
            found = reading.reader_paragraphs([(p.get("text", ""), bool(p.get("join_previous"))) for p in reading.loads(value)["paragraphs"]])
            # JSON can hold half a surrogate pair, a column can't.
            return [text.encode("utf-8", "replace").decode() for text in found]
        except (ValueError, KeyError, TypeError):
            return []

    @F.pandas_udf("array<string>")
    def layout(values: pd.Series) -> pd.Series:
        return values.map(one)

    chapters = table(spark, sf_dir, "chapters").filter("edited is not null")
    return chapters.select("book_id", "number", F.posexplode(layout("edited")).alias("pos", "text"))


@query("k2_books")
def k2_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every book's file: chapters, size, hash, what verification finds, and why it isn't whole."""
    facts = table(spark, sf_dir, "books").groupBy(F.col("id").alias("book_id")).agg(F.min("title").alias("title"), F.min("expected").alias("expected"), F.min("source_url").alias("source_url"))
    chapters = table(spark, sf_dir, "chapters").select("book_id", "number", "edited", "state", "summary")
    return epub.books(chapters.join(facts, "book_id"))


@query("a3_daily_ledger", "select day, count(*) as calls, cast(coalesce(sum(reserved), 0) as bigint) as tokens from calls group by day")
def a3_daily_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.daily(table(spark, sf_dir, "calls"))


@query(
    "stream_event_windows",
    "select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
)
def stream_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of the windowed stream (beyond the reference)."""
    return ledger.windows(table(spark, sf_dir, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "stream_sessions",
    """
with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as fresh from events),
s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows between unbounded preceding and current row) as k from e)
select user_id, min(ts) as start, max(ts) + interval 30 minutes as "end", count(*) as n from s group by user_id, k
""",
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of the session stream (beyond the reference)."""
    found = ledger.sessions(table(spark, sf_dir, "events"))
    return found.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")
