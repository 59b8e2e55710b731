"""Queries whose text is the same in Spark SQL and in the checking engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "books chapters sources source_candidates source_provenance calls book_terms documents lang_codes "
    "region nation customer supplier part orders lineitem events"
).split()


def run(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The query over the tables that its text names."""
    words = set(text.replace("(", " ").replace(")", " ").replace(",", " ").split())
    for name in TABLES:
        if name in words:
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(text)


#: Fixed moment that time-dependent queries take as now, in epoch seconds.
NOW = 1735689600.0

SAME = {
    # Predicates and projections.
    "f1_point_lookup": "select number, title, state, error from chapters where book_id = 'wan-gu-deng-xin' and number = 5",
    "f2_project_sort": "select book_id, number, title, url from chapters order by book_id, number",
    "f3_null_worklist": "select book_id, number, state from chapters where source is null or (translated is not null and edited is null)",
    "f4_in_states": "select id, book_id, state from source_candidates where state in ('pending', 'accepted') and proof not in ('unique-title')",
    "f5_null_safe_exclusion": "select id, failure_kind from calls where coalesce(failure_kind, '') not in ('internal', 'content_blocked', 'quota')",
    "f6_null_or_equal": "select id, status from calls where failure_kind = 'quota' or failure_kind is null",
    "f7_exists": "select distinct id from books b where exists (select 1 from calls c where c.book_id = b.id and c.status = 'failed')",
    "f8_conditional_update": "select book_id, number, case when state = 'crawl_failed' and source is null then 'discovered' else state end as state from chapters",
    "f9_case_projection": "select book_id, number, case when source is not null then 'accepted' else state end as progress from chapters",
    "f10_active_sources": "select c.id, c.source_id from source_candidates c where c.source_id in (select s.id from sources s where s.encoding <> 'gb18030-html')",
    "f11_cooldown": f"select id, book_id, attempts, retry_at from source_candidates where state = 'pending' and attempts < 3 and retry_at <= {NOW}",
    # Joins.
    "j1_inner": "select c.id, c.stage, h.state from calls c join chapters h on c.book_id = h.book_id and c.chapter = h.number where c.status = 'failed'",
    "j2_ordered_inner": "select p.book_id, p.number, p.source_id, c.id from source_provenance p join source_candidates c on c.book_id = p.book_id and c.source_id = p.source_id and c.url = p.url where c.state = 'accepted' order by p.book_id, p.number",
    "j3_two_keys": "select t.book_id, t.source, t.translation, h.title from book_terms t join chapters h on h.book_id = t.book_id and h.number = t.chapter",
    "j4_gaps_first": "select h.book_id, h.number, case when exists (select 1 from source_candidates c join books b on b.id = c.book_id where c.book_id = h.book_id and c.canonical_number = h.number and c.state = 'accepted') then 1 else 0 end as has_primary from chapters h where h.source is null order by has_primary desc, h.number, h.book_id",
    "j6_dimension": "select c.id, s.name, s.encoding from source_candidates c join sources s on s.id = c.source_id",
    # A term counts from its first chapter on: running sums over the books' chapters and first chapters, no range join.
    "j7_as_of_terms": "with t as (select book_id, first, count(*) as n from (select book_id, source, min(chapter) as first from book_terms where chapter is not null and source is not null group by book_id, source) x group by book_id, first), h as (select distinct book_id, number from chapters), e as (select book_id, number, 0 as n, 1 as asked from h union all select book_id, first, n, 0 from t), r as (select *, sum(n) over (partition by book_id order by number, asked rows between unbounded preceding and current row) as visible from e) select book_id, number, cast(visible as bigint) as visible from r where asked = 1 and visible > 0",
    "j10_exact_copies": "with b as (select source_hash, book_id, min(number) as first_number, count(*) as n from chapters where source_hash is not null group by source_hash, book_id), a as (select source_hash, sum(n) as copies from b group by source_hash) select h.book_id, h.number, b.first_number, cast(a.copies as bigint) as copies from chapters h join b on b.source_hash = h.source_hash and b.book_id = h.book_id join a on a.source_hash = h.source_hash",
    "j14_anti": "select c.book_id, c.canonical_number, c.id from source_candidates c where c.canonical_number is not null and not exists (select 1 from chapters h where h.book_id = c.book_id and h.number = c.canonical_number)",
    "j15_latest_call": "select book_id, chapter, stage, id, status from (select *, row_number() over (partition by book_id, chapter, stage order by created desc, id desc, loaded_at desc) as r from calls) x where r = 1",
    # Aggregates.
    "a1_states": "select state, count(*) as n from chapters where book_id = 'wan-gu-deng-xin' group by state",
    "a2_book_states": "select book_id, state, count(*) as n from chapters group by book_id, state",
    "a3_budget": "select day, count(*) as calls, cast(coalesce(sum(reserved), 0) as bigint) as tokens from calls group by grouping sets ((day), ())",
    "a4_attempts": "select book_id, chapter, stage, provider, model, style_revision, cast(sum(case when coalesce(failure_kind, '') not in ('quota', 'abandoned_test', 'rolled_back') then 1 else 0 end) as bigint) as attempts from calls group by book_id, chapter, stage, provider, model, style_revision",
    "a5_last_call": "select provider, max(created) as last_created, max(loaded_at) as last_loaded from calls group by provider",
    "a6_backlog": "select book_id, count(*) as backlog from chapters where translated is not null and edited is null group by book_id",
    "a7_edited_of_expected": "select b.id, max(b.expected) as expected, count(distinct case when h.edited is not null then h.number end) as edited from books b left join chapters h on h.book_id = b.id group by b.id",
    "a8_completeness": "select b.id, count(h.number) = max(b.expected) and coalesce(min(h.number), 0) = 1 and coalesce(max(h.number), 0) = max(b.expected) and count(distinct h.number) = max(b.expected) and coalesce(min(case when h.state = 'edited' and h.edited is not null or h.state = 'missing' and h.summary is not null then 1 else 0 end), 0) = 1 as complete from books b left join chapters h on h.book_id = b.id group by b.id",
    "a9_once_only": "select book_id, title, min(number) as number from chapters group by book_id, title having count(*) = 1",
    "a10_distinctness": "select book_id, source_id, count(distinct source_number) = count(source_number) as numbers_unique, count(distinct url) = count(url) as urls_unique from source_candidates group by book_id, source_id",
    "a11_any_all": "select book_id, bool_or(state = 'pending') as waiting, bool_and(attempts < 3) as open from source_candidates group by book_id",
    "a14_first_index": "select title, min(number) as first_number from chapters group by title",
    "a15_missing_list": "select book_id, number, title from chapters where state = 'missing' order by book_id, number",
    # Windows.
    "w1_neighbours": "select book_id, source_id, id, lag(canonical_number) over (partition by book_id, source_id order by source_number, id, url, title) as before, lead(canonical_number) over (partition by book_id, source_id order by source_number, id, url, title) as after from (select distinct book_id, source_id, id, canonical_number, source_number, url, title from source_candidates) x",
    "w3_contiguous_prefix": "select book_id, number from (select book_id, number, min(case when number = rn and state = 'edited' then 1 else 0 end) over (partition by book_id order by number rows between unbounded preceding and current row) as ok from (select book_id, number, state, row_number() over (partition by book_id order by number) as rn from (select distinct book_id, number, state from chapters) d) x) y where ok = 1",
    "w4_buckets": "select book_id, number, cast(floor((rn - 1) / greatest(20, ceil(n / 200.0))) as bigint) as part from (select book_id, number, row_number() over (partition by book_id order by number) as rn, count(*) over (partition by book_id) as n from (select distinct book_id, number from chapters) d) x",
    "w7_priority_pick": "select book_id, canonical_number, id, source_id from (select *, row_number() over (partition by book_id, canonical_number order by case state when 'accepted' then 0 when 'pending' then 1 else 2 end, attempts, source_id, id) as r from (select distinct id, book_id, canonical_number, source_id, state, attempts from source_candidates where canonical_number is not null) d) x where r = 1",
    # Orders, limits, sets.
    "o1_next_item": "select book_id, min(number) as number from chapters where source is null and state = 'discovered' group by book_id",
    "o2_latest_ids": "select book_id, max(id) as id from calls group by book_id",
    "o4_computed_key": "select id, book_id, case when state = 'accepted' then 0 else 1 end as k, source_number from source_candidates order by k, source_number, id",
    "o6_conditional_sort": "select c.id, c.book_id, c.source_id, case when u.uniq then c.source_number else c.id end as sort_key from source_candidates c join (select book_id, source_id, count(distinct source_number) = count(*) as uniq from source_candidates group by book_id, source_id) u on u.book_id = c.book_id and u.source_id = c.source_id",
    "e1_difference": "select book_id, canonical_number as number from source_candidates where canonical_number is not null except select book_id, number from source_provenance",
    "e2_intersection": "select book_id, number from chapters where source is not null intersect select book_id, number from source_provenance",
    "e3_union": "select book_id, title from chapters union select book_id, title from source_candidates",
    "e5_ordered_dedup": "select book_id, title, min(number) as first_number from chapters group by book_id, title",
    "e6_union_all": "select state, count(*) as n from (select state from chapters union all select state from source_candidates) x group by state",
    # Statement shapes: upserts, replacements and updates as queries.
    "q8_latest_wins": "select id, status, loaded_at from (select id, status, loaded_at, row_number() over (partition by id order by loaded_at desc, status) as r from calls) x where r = 1",
    "q9_update_by_key": "select h.book_id, h.number, coalesce(u.state, h.state) as state from (select distinct book_id, number, state from chapters) h left join (select p.book_id, p.number, 'crawled' as state from source_provenance p group by p.book_id, p.number) u on u.book_id = h.book_id and u.number = h.number",
    "q10_never_refund": "select id, greatest(reserved, coalesce(usage, 0)) as charged from calls",
    "q11_bulk_update": "select id, case when status = 'failed' and failure_kind = 'transient' then 'acknowledged' else status end as status from calls",
    "q12_fill_if_null": "select book_id, number, coalesce(summary, title) as summary from chapters",
    "q13_delete_by_key": "select c.id, c.state from source_candidates c where not exists (select 1 from source_provenance p where p.book_id = c.book_id and p.number = c.canonical_number)",
    "g5_backlog_priority": "select h.book_id, h.number, b.backlog, case when b.backlog > 5 then 'edit' else 'translate' end as stage from (select distinct book_id, number from chapters where translated is null and source is not null) h join (select book_id, count(*) as backlog from chapters where translated is not null and edited is null group by book_id) b on b.book_id = h.book_id",
    "g12_exhausted": "select h.book_id, h.number from chapters h where h.source is null and not exists (select 1 from source_candidates c where c.book_id = h.book_id and c.canonical_number = h.number and c.state = 'pending' and c.attempts < 3)",
    "v12_constraint_keys": "select book_id, number, count(*) as copies from chapters group by book_id, number having count(*) > 1",
    "v12_constraint_references": "select distinct c.book_id from calls c where not exists (select 1 from books b where b.id = c.book_id)",
    "q1_bulk_lookup": "select c.id, b.title, b.style_revision from calls c join books b on b.id = c.book_id",
    "q2_filtered_scan": "select book_id, number, title from chapters where state = 'edited' and edited is not null",
    "q3_ordered_scan": "select book_id, number, state from chapters where state in ('missing', 'source_review') order by book_id, number",
    "q4_full_scan": "select id, name, source_url, encoding, toc_selector, content_selector, title_selector from sources",
    "q5_max_probe": "select book_id, stage, max(id) as last_id, max(created) as last_created from calls group by book_id, stage",
    # An append: the calls loaded by the last day get ids behind those of all before.
    "q6_append_ids": "with o as (select id, book_id, created, loaded_at, case when cast(loaded_at as date) = (select max(cast(loaded_at as date)) from calls) then 1 else 0 end as batch from calls) select id, book_id, batch, cast(row_number() over (partition by book_id order by batch, created, id, loaded_at) as bigint) as sequence from o",
    "q7_insert_if_absent": "select book_id, number from source_provenance union all select h.book_id, min(h.number) as number from chapters h where not exists (select 1 from source_provenance p where p.book_id = h.book_id) group by h.book_id",
    # A register of yesterday's books, of which every seventh says another count and every eleventh is new: those refused, known and added.
    "t2_changed_registration": "with b as (select id, min(source_url) as source_url, min(expected) as expected, row_number() over (order by id) as r from books group by id), old as (select id, source_url, case when r % 7 = 0 then expected + 1 else expected end as expected from b where r % 11 <> 0) select b.id, case when o.id is null then 'added' when o.source_url <> b.source_url or o.expected <> b.expected then 'refused' else 'known' end as outcome from b left join old o on o.id = b.id",
    "g14_frozen_prints": "select p.book_id, p.number, p.fingerprint = h.source_hash as intact from source_provenance p join (select distinct book_id, number, source_hash from chapters) h on h.book_id = p.book_id and h.number = p.number",
}
