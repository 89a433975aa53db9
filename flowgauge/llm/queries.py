"""The corpus queries by name and, where SQL can say them, their SQL."""

from flowgauge.llm import (filter_audit, html_paths, mixing, multiset_hash, outliers, packing, pseudo_lm, resampling,
                           sentence_pieces, simhash, suffix_dedup, warc, weak_pii)
from flowgauge.llm.shared import table

QUERIES = {}
SQL = {}


def query(sql=None):
    def register(plan):
        QUERIES[plan.__name__] = plan
        if sql is not None:
            SQL[plan.__name__] = sql
        return plan
    return register


@query()
def op1_consensus_paths(spark, sf_dir):
    return html_paths.main_text(table(spark, sf_dir, "pages"))


@query()
def op2_best_two_fit(spark, sf_dir):
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents")))


@query()
def op3_robust_outliers(spark, sf_dir):
    return outliers.quality(table(spark, sf_dir, "documents"))


@query()
def op4_multiset_hash(spark, sf_dir):
    return multiset_hash.fingerprinted(table(spark, sf_dir, "documents"))


@query()
def op5_weak_supervision_pii(spark, sf_dir):
    return weak_pii.personal_data(table(spark, sf_dir, "documents"))


@query()
def op6_exact_budget_mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("""
    with payloads as (
        select page_id, encode(coalesce(html, '')) as body, sha1(coalesce(html, '')) as sha from pages),
    firsts as (select sha, min(page_id) as first from payloads group by sha),
    digits as (
        select page_id, octet_length(body) as payload_bytes, first,
               list_transform(range(8), lambda i: cast('0x' || substr(p.sha, 5 * i + 1, 5) as bigint)) as parts
        from payloads p join firsts using (sha))
    select page_id, payload_bytes,
           list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               cast((parts[k // 4 + 1] // power(32, 3 - k % 4)::bigint) % 32 + 1 as integer), 1)), 'string_agg', '') as payload_digest,
           case when page_id = first then 'response' else 'revisit' end as record_type,
           case when page_id <> first then first end as refers_to
    from digits""")
def op7_indexed_warc(spark, sf_dir):
    return warc.archived(table(spark, sf_dir, "pages"))


@query()
def op8_pseudo_likelihood(spark, sf_dir):
    return pseudo_lm.scored(table(spark, sf_dir, "documents"))


@query()
def op9_pivot_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op10_difference_cover_dedup(spark, sf_dir):
    return suffix_dedup.without_repeats(table(spark, sf_dir, "documents"))


@query("""
    with texts as (
        select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, min(doc_id) over (partition by coalesce(text, '')) as first
        from documents),
    words as (select *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as w from texts),
    marked as (
        select part, doc_id in (select doc_id from labels where quality = 1) as good, doc_id in (select doc_id from labels where toxic = 1) as toxic,
               concat(case when len(w) < 200 then 'A' else '' end,
                      case when 100 * len(list_distinct(w)) < 50 * len(w) then 'B' else '' end,
                      case when 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) then 'C' else '' end,
                      case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end,
                      case when doc_id > first then 'E' else '' end) as failed
        from words),
    cells as (select part, failed, count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic
              from marked group by part, failed),
    letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as f),
    orders as (
        select concat(a.f, b.f, c.f, d.f, e.f) as filter_order from letters a, letters b, letters c, letters d, letters e
        where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
    steps as (
        select filter_order, step, substr(filter_order, step, 1) as f, substr(filter_order, 1, step - 1) as prefix
        from orders, (select unnest(range(1, 6)) as step)),
    judged as (
        select part, filter_order, step, s.f, n, good, toxic, contains(failed, s.f) as fails,
               len(list_intersect(string_split(failed, ''), string_split(prefix, ''))) = 0 or prefix = '' or failed = '' as reaches,
               failed = s.f as alone
        from cells, steps s),
    counted as (
        select part, filter_order, step, f,
               coalesce(sum(n) filter (where reaches and not fails), 0) as kept, coalesce(sum(n) filter (where reaches and fails), 0) as removed,
               coalesce(sum(n) filter (where fails and not reaches), 0) as redundant, coalesce(sum(n) filter (where alone), 0) as unique_fails,
               coalesce(sum(good) filter (where reaches and fails), 0) as good_lost, coalesce(sum(toxic) filter (where reaches and fails), 0) as toxic_lost
        from judged group by part, filter_order, step, f)
    select part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed,
           cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost,
           cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, f) as bigint) as shapley
    from counted""")
def op11_failing_id_relations(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("""
    with crc_table as (
        select list_transform(range(256), lambda x: list_reduce(list_prepend(x::bigint, range(8)),
               lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as crc),
    texts as (
        select 'own' as kind, doc_id as id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
        union all select 'target', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') from benchmark),
    words as (select kind, id, regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from texts),
    runs as (select kind, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as feature from words),
    listed as (select distinct feature, hex(encode(feature)) as h from runs),
    bytes as (select feature, list_transform(range(len(h) // 2), lambda i: cast('0x' || substr(h, 2 * i + 1, 2) as bigint)) as b from listed),
    hashed as (
        select feature, xor(list_reduce(list_prepend(4294967295::bigint, b),
               lambda c, x: xor(c >> 8, crc[xor(c & 255, x) + 1])), 4294967295) % 10000 as bucket
        from bytes, crc_table),
    placed as (select kind, id, bucket from runs join hashed using (feature)),
    counts as (select bucket, count(*) filter (where kind = 'own') as s, count(*) filter (where kind = 'target') as t from placed group by bucket),
    sums as (select coalesce(sum(s), 0)::double + 10000 as s_all, coalesce(sum(t), 0)::double + 10000 as t_all from counts),
    gains as (select bucket, floor(1000 * ln((t + 1)::double * s_all / ((s + 1)::double * t_all)))::bigint as gain from counts, sums),
    weights as (select id, count(*) as n_features, floor(sum(gain)::double / count(*))::bigint as weight
                from placed join gains using (bucket) where kind = 'own' group by id),
    scored as (
        select id as doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, len(w) >= 20 as enough,
               coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || id), 1, 8))::bigint + 0.5) / 4294967296.0::double)))::bigint as score
        from words left join weights using (id) where kind = 'own'),
    ranked as (select *, row_number() over (partition by enough order by score desc, doc_id) as place, count(*) filter (where enough) over () as n from scored)
    select doc_id, n_features::bigint as n_features, weight, score, case when enough and place <= 25 * n // 100 then place end::bigint as rank from ranked""")
def op12_bucketed_crc_resampling(spark, sf_dir):
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op13_offset_pieces(spark, sf_dir):
    return sentence_pieces.digests(table(spark, sf_dir, "documents"))
