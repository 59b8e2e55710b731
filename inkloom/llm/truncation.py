"""Problem 4: texts that were cut by a field limit or in transfer, in SQL.

The words of these texts are characters. Every trigram is counted over all
texts by what follows it: a letter, a closing mark, a separator or the end of
the paragraph. The last trigram of each paragraph without a closing mark is
joined to the counts and flagged if it is frequent inside and almost never
last; a paragraph that ends in dots is flagged if its last trigram is frequent
before letters and almost never before a mark. Trigrams too rare to tell back
off to bigrams, whose counts are sums of the trigrams'.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.llm.chapters import chapter_sites, lines_of, table
from inkloom.session import cut, spread

#: Occurrences from which an n-gram can tell, and the largest share at ends (besides the one at hand) of a cut.
SEEN, LAST = 20, 0.02

#: Marks that close a sentence or a line, or a template's placeholder (which is no cut; the brace is doubled for formatting), and marks inside sentences (fixed values).
CLOSED = "[。！？!?…”’」』）)\\\\]】》>～~—*＊◇◆★☆※|｜.}}$@_%›;]"
INNER = "，、；：！？…“”‘’,;:!?.．"
#: Other signs, which separate; wide digits count as digits.
SIGNS = " \t　·•《》〈〉「」『』【】〔〕（）()[]<>»«›‹/|｜~～*＊◇◆★☆※→←—-_=+#&@%©$^`\\"

_FROM = INNER + SIGNS + "0123456789０１２３４５６７８９"
_TO = "。" * len(INNER) + " " * len(SIGNS) + "0" * 20


def signs(text):
    """A text with every mark as 。, every other sign as a space and every digit as 0, of the same length."""
    return F.translate(text, _FROM, _TO)


#: Every four characters, and what ends with the paragraph.
GRAMS = """
select gram, count(*) as n from (
  select explode(regexp_extract_all(concat(text, '\\u0003'), '(?s)(?=(....))', 1)) as gram from {lines})
group by gram
"""

#: Trigrams by what follows them.
COUNTS = """
select left(gram, 3) as gram, sum(if(right(gram, 1) not in ('。', ' ', '\\u0003'), n, 0)) as mid,
  sum(if(right(gram, 1) = '。', n, 0)) as stop, sum(if(right(gram, 1) = '\\u0003', n, 0)) as final
from {grams} group by left(gram, 3)
"""

#: How each paragraph ends. Only the end and the quotes tell; numbers are folded in the last 64 signs, of which three grams' worth are read.
ENDS = f"""
select book_id, number, torn, dotted, unclosed, unquoted, tail from (
  select *, line rlike '[^�]�$' and not left(line, length(line) - 1) like '%�%' as torn,
    line rlike '([^.][.][.]+|[^…]…)$' as dotted,
    not last rlike '{CLOSED}$' and not line like '%�%' as unclosed,
    line like '%“%' and not line like '%�%' and length(replace(line, '“', '')) < length(replace(line, '”', '')) as unquoted,
    regexp_replace(right(line, 64), '(�|[.][.]+|…)$', '') as tail
  from (select book_id, number, line, right(line, 1) as last from {{exploded}}))
where torn or dotted or unclosed or unquoted
"""

#: A cut is judged by the counts of its last gram, whatever sign that ends in, in lines of prose: a stretch of more than six
#: signs before the end without a separator. An open quotation mark counts whatever the line ends in.
FLAGS = """
with ends as (
  select book_id, number, torn, dotted, unclosed, unquoted, right(rtrim('。', tail), 3) as gram,
    length(substring_index(tail, ' ', -1)) > 6 or not tail like '% %' as prose, rtrim(' ', tail) as tail from {ends}),
counts as (select gram, mid, stop, final from {counts}),
pairs as (select right(gram, 2) as gram, sum(mid) as mid, sum(stop) as stop, sum(final) as final from counts group by right(gram, 2)),
judged as (
  select e.*, if(coalesce(c.mid + c.stop, 0) >= {seen} or coalesce(c.final, 0) > {seen}, struct(c.mid, c.stop, c.final), struct(p.mid, p.stop, p.final)) as s
  from ends e left join counts c on c.gram = e.gram left join pairs p on p.gram = right(e.gram, 2))
select distinct book_id, number from judged
where (prose or length(substring_index(tail, ' ', -1)) > 6 or not tail like '% %') and tail rlike '[一-鿿]' and not gram rlike '[锟斤拷]' and (
  unquoted
  or (unclosed or torn) and s.mid + s.stop >= {seen} and s.final - 1 <= {last} * (s.mid + s.stop)
  or dotted and s.mid >= {seen} and s.stop + s.final - 1 <= {last} * s.mid)
"""


def cut_ends(pages: DataFrame, seen: int = SEEN, last: float = LAST) -> DataFrame:
    """``book_id, number`` of pages (``book_id, number, lines``) with a paragraph that breaks off.

    Null and empty lines and lines of one or two characters don't break off.
    Repeated pages count once in the result.
    """
    spark = pages.sparkSession
    exploded = pages.select("book_id", "number", F.explode("lines").alias("line")).withColumn("line", F.rtrim("line"))
    clean = exploded.filter("length(line) > 2 and not line like '%�%'")
    # What follows a number, not a digit, tells whether a text goes on behind it.
    def folded(text):
        return F.regexp_replace(signs(text), "0+", "0")

    grams = spark.sql(GRAMS, lines=clean.select(folded(F.regexp_replace("line", "([.][.]+|…)$", "")).alias("text")))
    counts = cut(spark.sql(COUNTS, grams=grams))
    ends = spark.sql(ENDS, exploded=exploded.filter("length(line) > 2")).withColumn("tail", folded(F.col("tail")))
    return spark.sql(FLAGS.replace("{seen}", str(seen)).replace("{last}", str(last)), ends=ends, counts=counts)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``book_id, number`` of every chapter that breaks off: its JSON, or a paragraph inside a sentence, a number or a word."""
    chapters = spread(table(spark, sf_dir, "chapters").select("book_id", "number", "source"))
    broken = chapters.filter("ltrim(source) like '[%'").filter(
        ~F.trim("source").endswith("]") | lines_of(F.col("source")).isNull()
    )
    pages = chapters.select("book_id", "number", lines_of(F.col("source")).alias("lines")).filter("lines is not null")
    return broken.select("book_id", "number").unionByName(cut_ends(pages)).distinct()


#: The name of round 1 for the rule that `p4_found` has now.
p4_found_any = p4_found


def p4_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``site, chapters, truncated, share``: how often each site's chapters break off."""
    sites = chapter_sites(spark, sf_dir)
    present = table(spark, sf_dir, "chapters").filter("source is not null").select("book_id", "number").distinct()
    found = p4_found(spark, sf_dir).withColumn("hit", F.lit(1))
    return (
        sites.join(present, ["book_id", "number"], "left_semi")
        .join(found, ["book_id", "number"], "left")
        .groupBy("site")
        .agg(F.count("*").alias("chapters"), F.count("hit").alias("truncated"))
        .withColumn("share", F.round(F.col("truncated") / F.col("chapters"), 6))
    )
