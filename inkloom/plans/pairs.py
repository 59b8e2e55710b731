"""Queries by operator: a DataFrame plan and the SQL that states the same."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkloom.functions import text as X
from inkloom.functions.numerals import scales
from inkloom.operators import align as alignment
from inkloom.operators import dedup, reading
from inkloom.operators.terms import differs, merged
from inkloom.plans.sql import NOW
from inkloom.session import small, spread, table
from inkloom.sources.files import insert_ignore

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add


#: Folding in the checking engine's SQL.
_WIDE, _NARROW = X.WIDE, X.NARROW.replace("'", "''")


def _compatible() -> str:
    """Signs and their compatibility forms (NFKC), as a table of the checking engine, which knows only NFC."""
    signs = (chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    forms = ((c, unicodedata.normalize("NFKC", c)) for c in signs)
    rows = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in pair)) for pair in forms if pair[0] != pair[1])
    return f"kc(c, d) as (values {rows})"


KC = _compatible()


def folded_sql(name: str, table_: str, column: str) -> str:
    """Tables that end in ``name``: those of ``table_`` and ``plain``, the NFKC of a column."""
    return f"""{name}0 as (select row_number() over () as rid, * from {table_}),
{name}1 as (select rid, string_agg(coalesce(kc.d, s.c), '' order by s.i) as t from (select rid, i, substr({column}, cast(i as bigint), 1) as c
  from (select rid, {column}, unnest(generate_series(1, length({column}))) as i from {name}0 where {column} is not null) x) s left join kc on kc.c = s.c group by rid),
{name} as (select o.*, case when o.{column} is not null then nfc_normalize(coalesce(n.t, '')) end as plain from {name}0 o left join {name}1 n on n.rid = o.rid)"""


def plain_key_sql(column: str = "plain") -> str:
    return f"regexp_replace(lower(regexp_replace({column}, '^.*?第{X.NUMERAL}章\\s*', '')), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


def key_sql(column: str) -> str:
    return (
        f"regexp_replace(lower(regexp_replace(translate({column}, '{_WIDE}', '{_NARROW}'), '^.*?第{X.NUMERAL}章\\s*', '')), "
        "'[^\\p{L}\\p{N}]', '', 'g')"
    )


@query(
    "x5_gate_report",
    """
with d as (select coalesce(lang, '-') as lang, text, length(text) as n,
  length(regexp_replace(text, '[^\\p{L}]', '', 'g')) / greatest(length(text), 1) as ratio from documents),
r as (select lang, n, case when text is null then 'missing' when n not between 200 and 30000 then 'length'
  when regexp_matches(text, '[\\x{e000}-\\x{f8ff}\\x{fffd}]') then 'obfuscated' when ratio < 0.4 then 'script'
  when contains(text, '下载APP继续阅读') or contains(text, '请登录后阅读') or contains(text, '购买本章') or contains(text, '验证码') then 'interstitial' else 'pass' end as reason from d)
select lang, reason, count(*) as texts, cast(coalesce(sum(n), 0) as bigint) as characters from r group by lang, reason
""",
)
def x5_gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and characters by language label and first failed gate."""
    documents = table(spark, sf_dir, "documents").select("lang", "text")
    reason = X.gate(F.col("text"), least=200, letters="\\p{L}")
    return (
        documents.select(F.coalesce("lang", F.lit("-")).alias("lang"), F.coalesce(reason, F.lit("pass")).alias("reason"), F.length("text").cast("long").alias("n"))
        .groupBy("lang", "reason")
        .agg(F.count("*").alias("texts"), F.coalesce(F.sum("n"), F.lit(0)).alias("characters"))
    )


_HAN = "零〇一二两三四五六七八九十百千万"


@query(
    "x1_chapter_number",
    f"""
with {KC}, {folded_sql("f", "chapters", "title")},
n as (select book_id, number, url, coalesce(regexp_extract(plain, '第({X.NUMERAL})章', 1), '') as t from f),
v as (select *, list_reduce(list_prepend({{'total': 0::bigint, 'section': 0::bigint, 'digit': 0::bigint, 'c': ''}}, list_transform(regexp_extract_all(t, '[{_HAN}]'), lambda x: {{'total': 0::bigint, 'section': 0::bigint, 'digit': 0::bigint, 'c': x}})),
  lambda a, b: case when b.c = '万' then {{'total': a.total + (a.section + a.digit) * 10000, 'section': 0::bigint, 'digit': 0::bigint, 'c': ''}}
    when strpos('十百千', b.c) > 0 then {{'total': a.total, 'section': a.section + greatest(a.digit, 1) * cast(pow(10, strpos('十百千', b.c)) as bigint), 'digit': 0::bigint, 'c': ''}}
    else {{'total': a.total, 'section': a.section, 'digit': cast(strpos('一二三四五六七八九', replace(b.c, '两', '二')) as bigint), 'c': ''}} end) as r from n)
select book_id, number, url, case when regexp_matches(t, '^[0-9]+$') then try_cast(t as bigint) when regexp_matches(t, '^[{_HAN}]+$') then r.total + r.section + r.digit end as labelled from v
""",
)
def x1_chapter_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of all labels, in digits and in Han numerals, after NFKC."""
    return table(spark, sf_dir, "chapters").select("book_id", "number", "url", X.chapter_number(F.col("title")).alias("labelled"))


@query("x7_title_key", f"with {KC}, {folded_sql('f', 'chapters', 'title')} select book_id, number, {plain_key_sql()} as title_key from f")
def x7_title_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chapters").select("book_id", "number", X.title_key(F.col("title")).alias("title_key"))


@query("x11_fingerprint", f"with {KC}, {folded_sql('f', 'documents', 'text')} select doc_id, case when text is not null then sha256(regexp_replace(lower(plain), '[^\\p{{L}}\\p{{N}}]', '', 'g')) end as print from f")
def x11_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.fingerprint(F.array("text")).alias("print"))


@query("a12_sum_over_map", "select model, cast(sum(reserved) as bigint) as reserved, cast(sum(coalesce(usage, 0)) as bigint) as used from calls group by model")
def a12_sum_over_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by model through a map per call, as usage records come."""
    calls = table(spark, sf_dir, "calls").select("model", F.create_map(F.lit("reserved"), "reserved", F.lit("used"), F.coalesce("usage", F.lit(0))).alias("m"))
    return calls.groupBy("model").agg(F.sum(F.col("m")["reserved"]).alias("reserved"), F.sum(F.col("m")["used"]).alias("used"))


@query(
    "a13_han_ratio",
    "select doc_id, round(length(regexp_replace(text, '[^\\x{4e00}-\\x{9fff}]', '', 'g')) / greatest(length(text), 1), 6) as ratio from documents",
)
def a13_han_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(X.letter_ratio(F.col("text")), 6).alias("ratio"))


@query(
    "a16_findings",
    "select book_id, string_agg(finding, '; ' order by finding) as findings from (select distinct book_id, state || ': ' || error as finding from chapters where error is not null) x group by book_id",
)
def a16_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = table(spark, sf_dir, "chapters").filter("error is not null")
    found = F.collect_set(F.concat("state", F.lit(": "), "error"))
    return chapters.groupBy("book_id").agg(F.array_join(F.array_sort(found), "; ").alias("findings"))


@query(
    "a17_gaps",
    """
with e as (select id as book_id, unnest(generate_series(1, expected)) as n from (select distinct id, expected from books) b),
g as (select e.book_id, e.n, row_number() over (partition by e.book_id order by e.n) as r from e
  where not exists (select 1 from source_provenance p where p.book_id = e.book_id and p.number = e.n))
select book_id, string_agg(cast(n as varchar), ',' order by n) as gaps from g where r <= 30 group by book_id
""",
)
def a17_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first thirty expected numbers without an accepted source, by book."""
    books = table(spark, sf_dir, "books").select("id", "expected").distinct().filter("expected > 0")
    expected = books.select(F.col("id").alias("book_id"), F.explode(F.sequence(F.lit(1).cast("long"), "expected")).alias("n"))
    have = table(spark, sf_dir, "source_provenance").select("book_id", F.col("number").alias("n"))
    first = F.row_number().over(Window.partitionBy("book_id").orderBy("n"))
    return (
        expected.join(have, ["book_id", "n"], "left_anti")
        .withColumn("r", first)
        .filter("r <= 30")
        .groupBy("book_id")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list("n")), lambda n: n.cast("string")), ",").alias("gaps"))
    )


@query(
    "j5_multimap",
    "select book_id, canonical_number, count(*) as candidates, string_agg(cast(id as varchar), ',' order by id) as ids from (select distinct id, book_id, canonical_number from source_candidates where canonical_number is not null) x group by book_id, canonical_number",
)
def j5_multimap(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = table(spark, sf_dir, "source_candidates").filter("canonical_number is not null").select("id", "book_id", "canonical_number").distinct()
    ids = F.array_sort(F.collect_list("id"))
    return candidates.groupBy("book_id", "canonical_number").agg(
        F.count("*").alias("candidates"), F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("ids")
    )


_ALIGN = f"""
with {KC}, {folded_sql("fh", "chapters", "title")}, {folded_sql("fc", "source_candidates", "title")},
can as (select book_id, number as n, min(k) as k from (select book_id, number, {plain_key_sql()} as k from fh where title is not null) c where k <> '' group by book_id, number),
cand as (select book_id, source_id, k, row_number() over (partition by book_id, source_id order by source_number, id) - 1 as pos
  from (select distinct book_id, source_id, id, source_number, {plain_key_sql()} as k from fc) c where k <> ''),
cu as (select book_id, k, min(n) as n from can group by book_id, k having count(*) = 1),
su as (select book_id, source_id, k from cand group by book_id, source_id, k having count(*) = 1),
a as (select c.book_id, c.source_id, c.pos, c.k, case when su.k is not null then cu.n end as n from cand c
  left join su on su.book_id = c.book_id and su.source_id = c.source_id and su.k = c.k left join cu on cu.book_id = c.book_id and cu.k = c.k),
w as (select *, lag(n) over (partition by book_id, source_id order by pos) as l, lead(n) over (partition by book_id, source_id order by pos) as r from a),
acc as (select book_id, source_id, pos, k, case when n is not null and coalesce(l < n, true) and coalesce(r > n, true)
  and (coalesce(abs(l - n) <= 2, false) or coalesce(abs(r - n) <= 2, false)) then n end as n from w),
s as (select *,
  last_value(case when n is not null then pos end ignore nulls) over (partition by book_id, source_id order by pos rows between unbounded preceding and current row) as lp,
  last_value(n ignore nulls) over (partition by book_id, source_id order by pos rows between unbounded preceding and current row) as ln,
  first_value(case when n is not null then pos end ignore nulls) over (partition by book_id, source_id order by pos rows between current row and unbounded following) as rp,
  first_value(n ignore nulls) over (partition by book_id, source_id order by pos rows between current row and unbounded following) as rn from acc),
g as (select s.*, bool_and(coalesce(can.k = s.k, false)) over (partition by s.book_id, s.source_id, lp, rp) as ok
  from s left join can on can.book_id = s.book_id and can.n = s.ln + s.pos - s.lp),
m as (select book_id, source_id, pos, case when n is not null then n when rp - lp = rn - ln and rp - lp >= 2 and ok then ln + pos - lp end as n,
  case when n is not null then '{alignment.ANCHOR}' else '{alignment.FILLED}' end as proof from g)
select book_id, source_id, cast(pos as bigint) as pos, cast(n as bigint) as n, proof from m where n is not null
"""


@query("j8_align", _ALIGN)
def j8_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every site's catalog of every book against the book's chapters."""
    chapters = table(spark, sf_dir, "chapters").filter("title is not null")
    canonical = (
        chapters.select("book_id", F.col("number").alias("n"), X.title_key(F.col("title")).alias("k"))
        .filter("k != ''")
        .groupBy("book_id", "n")
        .agg(F.min("k").alias("k"))
    )
    order = Window.partitionBy("book_id", "source_id").orderBy("source_number", "id")
    candidate = (
        table(spark, sf_dir, "source_candidates")
        .select("book_id", "source_id", "id", "source_number", X.title_key(F.col("title")).alias("k"))
        .distinct()
        .filter("k != ''")
        .withColumn("pos", (F.row_number().over(order) - 1).cast("long"))
    )
    found = alignment.align(canonical, candidate, ["book_id"], ["source_id"])
    return found.select("book_id", "source_id", "pos", F.col("n").cast("long").alias("n"), "proof")


_NEAR = """
with {kc}, src as (select book_id, number, array_to_string(from_json(source, '["VARCHAR"]'), '') as body from chapters where source is not null and json_valid(source)), {folded},
t as (select book_id, min(number) as id, norm from (select book_id, number, regexp_replace(lower(plain), '[^\\p{{L}}\\p{{N}}]', '', 'g') as norm from f) x group by book_id, norm),
g as (select distinct book_id, id, substr(norm, cast(i as bigint), 12) as gram from (select book_id, id, norm, unnest(generate_series(1, length(norm) - 11)) as i from t where length(norm) >= 12) x),
c as (select book_id, id, count(*) as n from g group by book_id, id),
p as (select a.book_id, a.id as left_id, b.id as right_id, count(*) as shared from g a join g b on a.book_id = b.book_id and a.gram = b.gram and a.id < b.id group by a.book_id, a.id, b.id)
select p.book_id, p.left_id, p.right_id, round(p.shared / least(l.n, r.n), 6) as score from p join c l on l.book_id = p.book_id and l.id = p.left_id join c r on r.book_id = p.book_id and r.id = p.right_id
where p.shared / least(l.n, r.n) >= 0.85
""".format(kc=KC, folded=folded_sql("f", "src", "body"))


@query("j9_near_duplicates", _NEAR)
def j9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters of a book whose bodies contain one another for the most part."""
    return dedup.near(_bodies(spark, sf_dir), ["book_id"], "number", "norm")


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = spread(table(spark, sf_dir, "chapters").select("book_id", "number", "source")).select("book_id", "number", F.array_join(lines_of(F.col("source")), "").alias("body"))
    return chapters.select("book_id", "number", X.normalized(F.col("body")).alias("norm"))


@query("j9_near_all")
def j9_near_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As `j9_near_duplicates`, and short bodies: those that others contain, and those alike by matching blocks."""
    return dedup.near_all(_bodies(spark, sf_dir), ["book_id"], "number", "norm")


@query(
    "j10_document_copies",
    "select doc_id, min(doc_id) over (partition by sha256(text)) as first_copy from documents where text is not null",
)
def j10_document_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    return dedup.exact(documents, F.col("h"), "doc_id").select("doc_id", "first_copy")


@query(
    "j11_range_gaps",
    """
with h as (select distinct book_id, number from chapters where state <> 'missing'),
s as (select book_id, number, lag(number) over (partition by book_id order by number) as prior from h)
select s.book_id, s.number, s.prior, count(m.number) as skipped from s left join (select distinct book_id, number from chapters where state = 'missing') m
on m.book_id = s.book_id and m.number < s.number and m.number > s.prior group by s.book_id, s.number, s.prior
""",
)
def j11_range_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing chapters strictly between a chapter and the one before it, by running counts instead of a range join."""
    states = table(spark, sf_dir, "chapters").select("book_id", "number", (F.col("state") == "missing").cast("int").alias("gone")).distinct()
    order = Window.partitionBy("book_id").orderBy("number", F.desc("gone"))
    counted = states.withColumn("sum", F.sum("gone").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kept = counted.filter("gone = 0")
    at = Window.partitionBy("book_id").orderBy("number")
    return kept.select(
        "book_id",
        "number",
        F.lag("number").over(at).alias("prior"),
        F.coalesce(F.col("sum") - F.lag("sum").over(at), F.lit(0)).cast("long").alias("skipped"),
    )


@query(
    "j12_positional_zip",
    """
with s as (select book_id, number, unnest(from_json(source, '["VARCHAR"]')) as src, generate_subscripts(from_json(source, '["VARCHAR"]'), 1) as pos from (select distinct book_id, number, source from chapters where source is not null and json_valid(source)) x),
t as (select book_id, number, unnest(from_json(json_extract(translated, '$.paragraphs[*].text'), '["VARCHAR"]')) as dst, generate_subscripts(json_extract(translated, '$.paragraphs[*].text'), 1) as pos from (select distinct book_id, number, translated from chapters where translated is not null and json_valid(translated)) x)
select book_id, number, pos, length(src) as src_chars, length(dst) as dst_chars from s join t using (book_id, number, pos)
""",
)
def j12_positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source and translated paragraphs by position."""
    chapters = dedup.once(table(spark, sf_dir, "chapters").select("book_id", "number", "source", "translated"), ["book_id", "number"])
    whole = F.trim("source").startswith("[") & F.trim("source").endswith("]")
    source = F.when(whole, F.from_json("source", "array<string>", {"allowSingleQuotes": "false"}))
    target = F.from_json("translated", "struct<paragraphs:array<struct<id:int,text:string>>>")["paragraphs"]["text"]
    pairs = F.arrays_zip(source.alias("src"), target.alias("dst"))
    return (
        chapters.select("book_id", "number", F.posexplode(pairs).alias("at", "p"))
        .filter("p.src is not null and p.dst is not null")
        .select("book_id", "number", (F.col("at") + 1).cast("long").alias("pos"), F.length("p.src").cast("long").alias("src_chars"), F.length("p.dst").cast("long").alias("dst_chars"))
    )


@query(
    "f12_term_mentions",
    "select h.book_id, h.number, count(distinct t.source) as terms from chapters h join book_terms t on t.book_id = h.book_id and contains(h.source, t.source) group by h.book_id, h.number",
)
def f12_term_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a book's terms each chapter has: one pass over the text, the terms come as a list per book."""
    terms = table(spark, sf_dir, "book_terms").groupBy("book_id").agg(F.collect_set("source").alias("terms"))
    chapters = table(spark, sf_dir, "chapters").select("book_id", "number", "source").filter("source is not null")
    found = F.size(F.filter("terms", lambda t: F.contains(F.col("source"), t)))
    return chapters.join(small(terms), "book_id").groupBy("book_id", "number").agg(F.max(found).cast("long").alias("terms")).filter("terms > 0")


@query(
    "w2_enclosing",
    """
select book_id, number, last_value(case when source is not null then number end ignore nulls) over (partition by book_id order by number rows between unbounded preceding and current row) as below,
first_value(case when source is not null then number end ignore nulls) over (partition by book_id order by number rows between current row and unbounded following) as above from (select distinct book_id, number, source from chapters) x
""",
)
def w2_enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest chapters with a source on both sides."""
    chapters = table(spark, sf_dir, "chapters").select("book_id", "number", F.col("source").isNotNull().alias("has")).distinct()
    order = Window.partitionBy("book_id").orderBy("number")
    at = F.when(F.col("has"), F.col("number"))
    return chapters.select(
        "book_id",
        "number",
        F.last(at, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("below"),
        F.first(at, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)).alias("above"),
    )


@query(
    "w5_islands",
    """
with d as (select distinct book_id, number, state from chapters),
x as (select *, case when state = lag(state) over (partition by book_id order by number) then 0 else 1 end as fresh from d),
y as (select *, sum(fresh) over (partition by book_id order by number rows between unbounded preceding and current row) as island from x)
select book_id, cast(island as bigint) as island, min(state) as state, min(number) as first_number, count(*) as chapters from y group by book_id, island
""",
)
def w5_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of neighbouring chapters in the same state."""
    chapters = table(spark, sf_dir, "chapters").select("book_id", "number", "state").distinct()
    order = Window.partitionBy("book_id").orderBy("number")
    fresh = F.when(F.col("state") == F.lag("state").over(order), 0).otherwise(1)
    island = F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")
    return (
        chapters.withColumn("fresh", fresh)
        .withColumn("island", island)
        .groupBy("book_id", "island")
        .agg(F.min("state").alias("state"), F.min("number").alias("first_number"), F.count("*").alias("chapters"))
    )


_PARAGRAPHS = """
with p as (select book_id, number, unnest(from_json(source, '["VARCHAR"]')) as t, generate_subscripts(from_json(source, '["VARCHAR"]'), 1) as pos
from (select distinct book_id, number, source from chapters where source is not null and json_valid(source)) x)
"""


def lines_of(source: Column) -> Column:
    """Paragraphs of a JSON array of strings; null where the value isn't valid JSON."""
    whole = F.trim(source).startswith("[") & F.trim(source).endswith("]")
    return F.when(whole, F.from_json(source, "array<string>", {"allowSingleQuotes": "false"}))


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = dedup.once(table(spark, sf_dir, "chapters").select("book_id", "number", "source"), ["book_id", "number"])
    return chapters.select("book_id", "number", F.posexplode(lines_of(F.col("source"))).alias("at", "t")).select("book_id", "number", (F.col("at") + 1).cast("long").alias("pos"), "t")


@query(
    "w6_offsets",
    _PARAGRAPHS + "select book_id, number, pos, cast(coalesce(sum(length(t)) over (partition by book_id, number order by pos rows between unbounded preceding and 1 preceding), 0) as bigint) as start from p",
)
def w6_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each paragraph starts in its chapter's concatenated text."""
    order = Window.partitionBy("book_id", "number").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return paragraphs(spark, sf_dir).select("book_id", "number", "pos", F.coalesce(F.sum(F.length("t")).over(order), F.lit(0)).cast("long").alias("start"))


@query(
    "w8_carry_forward",
    "select book_id, number, last_value(summary ignore nulls) over (partition by book_id order by number rows between unbounded preceding and 1 preceding) as context from (select distinct book_id, number, summary from chapters) x",
)
def w8_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last summary before each chapter."""
    chapters = dedup.once(table(spark, sf_dir, "chapters").select("book_id", "number", "summary"), ["book_id", "number"])
    before = Window.partitionBy("book_id").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return chapters.select("book_id", "number", F.last("summary", ignorenulls=True).over(before).alias("context"))


@query(
    "w9_context",
    _PARAGRAPHS + "select book_id, number, pos, right(lag(t) over (partition by book_id, number order by pos), 400) as before, left(lead(t) over (partition by book_id, number order by pos), 400) as after from p",
)
def w9_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("book_id", "number").orderBy("pos")
    return paragraphs(spark, sf_dir).select(
        "book_id",
        "number",
        "pos",
        F.right(F.lag("t").over(order), F.lit(400)).alias("before"),
        F.left(F.lead("t").over(order), F.lit(400)).alias("after"),
    )


@query(
    "o3_eligible_batch",
    f"select id, book_id, source_id from (select id, book_id, source_id, row_number() over (partition by book_id order by source_number, id) as r from (select distinct id, book_id, source_id, source_number from source_candidates where state = 'pending' and attempts < 3 and retry_at <= {NOW}) e) x where r <= 5",
)
def o3_eligible_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next five eligible candidates of each book: rows that wait don't use up the batch."""
    eligible = (
        table(spark, sf_dir, "source_candidates")
        .filter((F.col("state") == "pending") & (F.col("attempts") < 3) & (F.col("retry_at") <= NOW))
        .select("id", "book_id", "source_id", "source_number")
        .distinct()
    )
    order = Window.partitionBy("book_id").orderBy("source_number", "id")
    return eligible.withColumn("r", F.row_number().over(order)).filter("r <= 5").select("id", "book_id", "source_id")


@query(
    "o5_longest_first",
    "select book_id, string_agg(source, '|' order by length(source) desc, source) as pattern from (select distinct book_id, source from book_terms) x group by book_id",
)
def o5_longest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each book's terms as one alternation, longest first."""
    terms = F.array_sort(F.collect_set(F.struct((-F.length("source")).alias("n"), "source")))
    return table(spark, sf_dir, "book_terms").groupBy("book_id").agg(F.array_join(terms["source"], "|").alias("pattern"))


@query("o7_first_characters", "select id, left(error, 12) as error from calls where error is not null")
def o7_first_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "calls").filter("error is not null").select("id", F.left("error", F.lit(12)).alias("error"))


@query(
    "e4_map_merge",
    "select book_id, source, translation from (select *, row_number() over (partition by book_id, source order by chapter desc nulls last, translation desc nulls last) as r from book_terms) x where r = 1",
)
def e4_map_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book's terms with the later translation of a term winning; of two of one chapter the greater."""
    last = F.max_by("translation", F.struct("chapter", "translation"))
    return table(spark, sf_dir, "book_terms").groupBy("book_id", "source").agg(last.alias("translation"))


@query(
    "x18_literals",
    _PARAGRAPHS + "select book_id, number, pos, array_to_string(list_transform(regexp_extract_all(t, '[0-9]+(?:[.,][0-9]+)*[万亿]?'), lambda x: case when x like '%万' then '10000' when x like '%亿' then '100000000' else '1' end), ' ') as scales from p",
)
def x18_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scale behind each literal number of each paragraph."""

    @F.pandas_udf("string")
    def scaled(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: " ".join(map(str, scales(t))) if isinstance(t, str) else None)

    return paragraphs(spark, sf_dir).select("book_id", "number", "pos", scaled("t").alias("scales"))


#: White space of Unicode (fixed values).
SPACE = "[\\t-\\r\\x1c-\\x1f \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


@query(
    "x31_tidy",
    f"select doc_id, array_to_string(list_filter(list_transform(string_split_regex(regexp_replace(nfc_normalize(text), '\\r\\n?', chr(10), 'g'), '\\n{SPACE}*\\n'), lambda p: trim(regexp_replace(p, '{SPACE}+', ' ', 'g'))), lambda p: p <> ''), chr(10) || chr(10)) as tidy from documents where text is not null",
)
def x31_tidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph layout of every text: composed forms (NFC), all white space of Unicode."""

    @F.pandas_udf("string")
    def tidy(values: pd.Series) -> pd.Series:
        return values.map(lambda v: reading.tidy(v) if isinstance(v, str) else None)

    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", tidy("text").alias("tidy"))


@query(
    "k1_insert_ignore",
    "select book_id, number, title from chapters union all select c.book_id, c.canonical_number, min(c.title) from source_candidates c where c.canonical_number is not null and not exists (select 1 from chapters h where h.book_id = c.book_id and h.number = c.canonical_number) group by c.book_id, c.canonical_number",
)
def k1_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chapters and those numbered candidates that no chapter has yet; of equal ones the least title (K1)."""
    old = table(spark, sf_dir, "chapters").select("book_id", "number", "title")
    numbered = table(spark, sf_dir, "source_candidates").filter("canonical_number is not null")
    new = numbered.groupBy("book_id", F.col("canonical_number").alias("number")).agg(F.min("title").alias("title"))
    return insert_ignore(old, new, ["book_id", "number"])


@query("x35_json", "select book_id, number, json_extract_string(translated, '$.title') as title, cast(json_array_length(translated, '$.paragraphs') as bigint) as paragraphs from chapters where translated is not null and json_valid(translated)")
def x35_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = F.from_json("translated", "struct<title:string,paragraphs:array<struct<id:int,text:string>>>")
    return table(spark, sf_dir, "chapters").filter("translated is not null").select("book_id", "number", result.alias("r")).select("book_id", "number", "r.title", F.size("r.paragraphs").cast("long").alias("paragraphs"))


@query("x36_source_hash", "select book_id, number, sha256(source) as input_hash from chapters where source is not null")
def x36_source_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chapters").filter("source is not null").select("book_id", "number", F.sha2("source", 256).alias("input_hash"))


@query("x37_utc_day", "select id, strftime(make_timestamp(cast(floor(created * 1000000) as bigint)), '%Y-%m-%d') as utc_day, strftime(make_timestamp(cast(floor(created * 1000000) as bigint)), '%Y-%m-%d') = day as agrees from calls")
def x37_utc_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = X.utc_day(F.col("created"))
    return table(spark, sf_dir, "calls").select("id", day.alias("utc_day"), (day == F.col("day")).alias("agrees"))


@query("x38_backoff", f"select id, {NOW} + 300 * pow(2, attempts - 1) as retry_at from source_candidates where state = 'pending' and attempts between 1 and 3")
def x38_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = table(spark, sf_dir, "source_candidates").filter("state = 'pending' and attempts between 1 and 3")
    return candidates.select("id", X.backoff(F.lit(NOW), F.col("attempts")).alias("retry_at"))


@query("x39_reservation", "select book_id, number, cast(strlen(source) + 8000 as bigint) as tokens from chapters where source is not null")
def x39_reservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chapters").filter("source is not null").select("book_id", "number", X.reservation(F.col("source"), 8000).cast("long").alias("tokens"))


@query("x40_hosts", "select id, regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1) as host, nullif(regexp_extract(url, '[?&]from=([^&#]*)', 1), '') as origin from source_candidates")
def x40_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = table(spark, sf_dir, "source_candidates")
    origin = F.regexp_extract("url", "[?&]from=([^&#]*)", 1)
    return candidates.select("id", F.regexp_extract(F.lower("url"), "^[a-z]+://([^/:?#]+)", 1).alias("host"), F.when(origin != "", origin).alias("origin"))


_TARGETS = """
with p as (select book_id, number, unnest(from_json(json_extract(translated, '$.paragraphs[*].text'), '["VARCHAR"]')) as t, generate_subscripts(json_extract(translated, '$.paragraphs[*].text'), 1) as pos
from (select distinct book_id, number, translated from chapters where translated is not null and json_valid(translated)) x)
"""


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = dedup.once(table(spark, sf_dir, "chapters").filter("translated is not null").select("book_id", "number", "translated"), ["book_id", "number"])
    texts = F.from_json("translated", "struct<paragraphs:array<struct<id:int,text:string>>>")["paragraphs"]["text"]
    return chapters.select("book_id", "number", F.posexplode(texts).alias("at", "t")).select("book_id", "number", (F.col("at") + 1).cast("long").alias("pos"), "t")


@query(
    "x41_markup_gate",
    _TARGETS + "select book_id, number, pos, case when t is null or trim(t) = '' then 'empty' when regexp_matches(t, '[\\x{e000}-\\x{f8ff}]|<[^>]*>|```') then 'markup' when regexp_matches(t, '[\\x{4e00}-\\x{9fff}]') then 'han' end as finding from p",
)
def x41_markup_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets(spark, sf_dir).select("book_id", "number", "pos", X.markup_gate(F.col("t")).alias("finding"))


@query(
    "x42_length_gate",
    "select book_id, number, length(source) <= 20 or length(translated) / length(source) between 0.35 and 12 as plausible from chapters where source is not null and translated is not null",
)
def x42_length_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = table(spark, sf_dir, "chapters").filter("source is not null and translated is not null")
    return chapters.select("book_id", "number", X.length_gate(F.col("source"), F.col("translated")).alias("plausible"))


def _phrases(column: str, phrases: tuple[str, ...]) -> str:
    return " or ".join(f"contains({column}, '{p}')" for p in phrases)


@query(
    "x43_failure_kind",
    f"select id, case when {_phrases('lower(error)', X.POLICY)} or starts_with(ltrim(lower(error)), 'policy:') then 'content_blocked' when {_phrases('lower(error)', X.QUOTA)} then 'quota' when {_phrases('lower(error)', X.TRANSIENT)} then 'transient' when error is not null then 'review' end as kind from calls",
)
def x43_failure_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "calls").select("id", X.failure_kind(F.col("error")).alias("kind"))


@query(
    "x44_labels",
    "select book_id, number, case when lower(trim(title)) = lower('Chương ' || number) then 'Chương ' || number else 'Chương ' || number || ': ' || title end as label from (select book_id, number, json_extract_string(translated, '$.title') as title from chapters where translated is not null and json_valid(translated)) x",
)
def x44_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = table(spark, sf_dir, "chapters").filter("translated is not null")
    return chapters.select("book_id", "number", X.label(F.col("number"), F.get_json_object("translated", "$.title")).alias("label"))


@query("x45_redacted", "select id, regexp_replace(coalesce(error, '') || ' Bearer ' || prompt_hash, '(?i)(Bearer\\s+|sk-)[^\\s\"'']+', '[REDACTED]', 'g') as message from calls")
def x45_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "calls").select("id", X.redacted(F.concat(F.coalesce("error", F.lit("")), F.lit(" Bearer "), "prompt_hash")).alias("message"))


@query("x46_slugs", "select id, regexp_full_match(id, '[a-z0-9][a-z0-9-]{0,79}') as valid from books")
def x46_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "books").select("id", X.is_slug(F.col("id")).alias("valid"))


@query("x47_chunks", "select doc_id, cast(ceil(strlen(text) / 6144) as bigint) as pieces, replace(replace(base64(encode(text)), '+', '-'), '/', '_') as payload from documents where text is not null")
def x47_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", X.chunks(F.col("text").cast("binary")).alias("c"))
    return documents.select("doc_id", F.size("c").cast("long").alias("pieces"), F.array_join("c", "").alias("payload"))


@query(
    "x48_chapter_text",
    "select book_id, number, case when state = 'missing' then 'Chương bị thiếu' else json_extract_string(edited, '$.title') end as title, "
    "case when state = 'missing' then summary else array_to_string(json_extract_string(edited, '$.paragraphs[*].text'), chr(10)) end as text from chapters where state in ('missing', 'edited')",
)
def x48_chapter_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What books have of a chapter: its edited title and text, or the note on a missing one."""
    chapters = table(spark, sf_dir, "chapters").filter(F.col("state").isin("missing", "edited"))
    result = F.from_json("edited", "struct<title:string,paragraphs:array<struct<text:string>>>")
    gone = F.col("state") == "missing"
    return chapters.select("book_id", "number", "summary", "state", result.alias("r")).select(
        "book_id", "number", F.when(gone, "Chương bị thiếu").otherwise(F.col("r.title")).alias("title"), F.when(gone, F.col("summary")).otherwise(F.array_join("r.paragraphs.text", "\n")).alias("text")
    )


@query("x14_reference_length", "select doc_id, n_chars, length(text) between n_chars * 0.95 and n_chars * 1.10 as fits from documents where text is not null")
def x14_reference_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = F.length("text").between(F.col("n_chars") * 0.95, F.col("n_chars") * 1.10)
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "n_chars", fits.alias("fits"))


@query(
    "v6_merge_terms",
    """
with p as (select book_id, source, translation, chapter, chapter % 3 <> 0 as approved,
  case when length(source) = 1 then 'preferred' when chapter % 3 = 0 and kind = 'entity' then 'candidate' else kind end as kind from book_terms
  union all select book_id, source, translation || ' 2', chapter + 7, true, case when length(source) = 1 then 'preferred' else kind end from book_terms),
r as (select *, row_number() over (partition by book_id, source order by chapter, translation) as r from p),
f as (select *, first_value(kind) over (partition by book_id, source order by r) as first_kind from r),
c as (select *, case when first_kind = 'candidate' and r > 1 and approved then r when r = 1 then 1000000 + r end as c from f)
select book_id, source, translation, chapter, kind from (select *, min(c) over (partition by book_id, source) as b from c) x where c = b
""",
)
def v6_merge_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry left by two rounds of proposals, of which the first has unapproved ones."""
    terms = table(spark, sf_dir, "book_terms").select("book_id", "source", "translation", "chapter", "kind")
    first = terms.withColumn("approved", F.col("chapter") % 3 != 0)
    second = terms.withColumn("translation", F.concat("translation", F.lit(" 2"))).withColumn("chapter", F.col("chapter") + 7).withColumn("approved", F.lit(True))
    return merged(first.unionByName(second), ["book_id"], ["chapter", "translation"])


@query(
    "x3_pinned_catalog",
    """
with f as (select book_id, number, row_number() over (partition by book_id order by number) as pos, title from (select book_id, number, min(title) as title from chapters group by book_id, number) c),
p as (select book_id, number, row_number() over (partition by book_id order by number) as pos, title from (select book_id, number, min(title) as title from source_provenance group by book_id, number) c)
select coalesce(f.book_id, p.book_id) as book_id from f full join p on p.book_id = f.book_id and p.pos = f.pos
group by 1 having not bool_and(coalesce(f.number = p.number and f.title = p.title, false))
""",
)
def x3_pinned_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books whose chapters aren't, one by one, those of the accepted sources."""
    def catalog(name: str) -> DataFrame:
        rows = table(spark, sf_dir, name).groupBy("book_id", "number").agg(F.min("title").alias("title"))
        return rows.withColumn("pos", F.row_number().over(Window.partitionBy("book_id").orderBy("number")))

    return differs(catalog("chapters"), catalog("source_provenance"), ["book_id"], ["number", "title"])


@query(
    "g4_progress_fingerprint",
    "select book_id, sha256(string_agg(cast(number as varchar) || ':' || state, ',' order by number, state)) as fingerprint from (select distinct book_id, number, state from chapters) x group by book_id",
)
def g4_progress_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash of each book's chapter states, equal if and only if nothing changed."""
    states = table(spark, sf_dir, "chapters").select("book_id", "number", "state").distinct()
    listed = F.transform(F.array_sort(F.collect_list(F.struct("number", "state"))), lambda x: F.concat(x["number"].cast("string"), F.lit(":"), x["state"]))
    return states.groupBy("book_id").agg(F.sha2(F.array_join(listed, ","), 256).alias("fingerprint"))


@query("g11_source_signatures", "select id, sha256(concat_ws('|', source_url, encoding, toc_selector, content_selector, title_selector)) as signature from sources")
def g11_source_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash of what a site's scan depends on."""
    parts = F.concat_ws("|", "source_url", "encoding", "toc_selector", "content_selector", "title_selector")
    return table(spark, sf_dir, "sources").select("id", F.sha2(parts, 256).alias("signature"))


@query(
    "s10_sample_pairs",
    "select book_id, number, pos, src, dst from (" + SQL["j12_positional_zip"].replace("length(src) as src_chars, length(dst) as dst_chars", "src, dst") + ") x where number in (1, 2, 3)",
)
def s10_sample_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source and translated paragraphs of the first three chapters of each book, side by side: a report's own selection."""
    source = paragraphs(spark, sf_dir).filter("number in (1, 2, 3)").withColumnRenamed("t", "src")
    return source.join(targets(spark, sf_dir).withColumnRenamed("t", "dst"), ["book_id", "number", "pos"])


@query(
    "k3_status",
    """
select 'chapters' as what, state as value, count(*) as n from chapters group by state
union all select 'calls', status, count(*) from calls group by status
union all select 'candidates', state, count(*) from source_candidates group by state
""",
)
def k3_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status report's counts."""

    def counts(name: str, column: str, what: str) -> DataFrame:
        return table(spark, sf_dir, name).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "value", "n")

    return counts("chapters", "state", "chapters").unionByName(counts("calls", "status", "calls")).unionByName(counts("source_candidates", "state", "candidates"))
