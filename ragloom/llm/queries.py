"""The registered queries of the training-data operators, with oracle SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from ragloom.llm import ann, chat, edit_print, fill_middle, html_text, kd_clusters, langid, mixing, packing, resharding, secrets, simhash, url_filter
from ragloom.tables import table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents", spread=True))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(rows.unionByName(more))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents", spread=True))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages", spread=True))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op8_permutation_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"))


def op9_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_print.compare(table(spark, sf_dir, "documents"))


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents", spread=True), public_tokenizers.path("word_bpe_49k.json"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(table(spark, sf_dir, "documents", spread=True))


def op12_kd_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_clusters.cluster(table(spark, sf_dir, "embeddings", spread=True))


def op13_flow_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resharding.shards(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_chat_format": op3_chat_format,
    "op4_language_id": op4_language_id,
    "op5_source_mix": op5_source_mix,
    "op6_html_text": op6_html_text,
    "op7_url_filter": op7_url_filter,
    "op8_permutation_ann": op8_permutation_ann,
    "op9_edit_fingerprint": op9_edit_fingerprint,
    "op10_pack": op10_pack,
    "op11_fill_middle": op11_fill_middle,
    "op12_kd_clusters": op12_kd_clusters,
    "op13_flow_reshard": op13_flow_reshard,
    "pipeline": corpus_pipeline.run,
}


def _span_sql(kind: str, number: int, pattern: str, least: int, value: str = "m") -> str:
    """DuckDB: doc_id, kind and bounds of one rule's findings, from the pieces between its matches."""
    quoted = pattern.replace("'", "''")
    return f"""
    select doc_id, '{kind}' as kind, {number} as kind_no, stop - length(m) as start, stop
    from (select doc_id, m, sum(length(gap) + length(m)) over (partition by doc_id order by i)::bigint as stop
          from (select doc_id, unnest(range(1, len(ms) + 1)) as i, unnest(ms) as m, unnest(gaps[1:len(ms)]) as gap
                from (select doc_id, regexp_extract_all(t, '{quoted}') as ms, string_split_regex(t, '{quoted}') as gaps
                      from (select doc_id, coalesce(text, '') as t from documents)) where len(ms) > 0))
    where length({value.replace('PATTERN', quoted)}) >= {least}"""


_RULE_SQL = " union all ".join(
    _span_sql(r.kind, k, r.pattern, r.least, f"regexp_extract(m, 'PATTERN', {r.group})") for k, r in enumerate(secrets.RULES)
)


def _lloyd_round(n: int) -> str:
    """DuckDB: from centroids c{n} (c, z) the vectors' assignment a{n} (r, d, c) and the next centroids."""
    return f"""
a{n} as materialized (
  select r, unnest(min(struct_pack(d := list_sum(list_transform(list_zip(v, z), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint, c := c))) from kept cross join c{n} group by r),
m{n} as (
  select c, list(z order by i) as z from (
    select c, i, ((s - ((s % n) + n) % n) // n)::bigint as z from (
      select c, i, sum(v[i]) as s, count(*) as n from a{n} join kept using (r) cross join unnest(range(1, 65)) as dims(i) group by c, i)) group by c),
c{n + 1} as materialized (select c{n}.c, coalesce(m{n}.z, c{n}.z) as z from c{n} left join m{n} using (c)),"""


ORACLE_SQL: dict[str, str] = {
    "op2_secret_scan": f"""
with spans as ({_RULE_SQL}),
listed as (
  select doc_id,
    count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
    coalesce(string_agg(kind || ':' || start || ':' || stop, ',' order by start, kind_no) filter (kind_no < 3), '') as base,
    string_agg(kind || ':' || start || ':' || stop, ',' order by start, kind_no) as spans
  from spans group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from documents d left join listed l on d.doc_id = l.doc_id
""",
    "op5_source_mix": r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
per_source as (select source, sum(size)::bigint as source_size from sized group by source),
weighed as (
  select *, [3.0, 1.0, 2.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as weight, 2.0::double * source_size as most,
    1.5::double * sum(source_size) over ()::double as total
  from per_source),
levels as (
  select *, (total - coalesce(sum(most) over (order by most / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by most / weight, source nulls last rows between current row and unbounded following) as level
  from weighed),
goals as (
  select *, case when most <= weight * level then most else weight * max(level) filter (most > weight * level) over () end as target from levels),
ranked as (
  select d.doc_id, d.size, d.source, g.source_size, g.target,
    row_number() over (partition by d.source order by d.size, d.doc_id nulls first) as r,
    case when g.source_size > 0 then least(2.0::double, g.target / g.source_size) else 0.0 end::double as p,
    ('0x' || sha256('7:' || coalesce(d.source, chr(0) || 'null'))[1:8])::bigint::double / 4294967296.0::double as u
  from sized d join goals g on d.source is not distinct from g.source)
select doc_id, size, source_size, target, (least(floor(p * r + u) - floor(p * (r - 1) + u), 2)::bigint * size)::bigint as taken from ranked
""",
    "op6_html_text": r"""
with cut as (
  select page_id, url, regexp_extract(html, '<article>(.*?)(</article>|$)', 1, 's') as a from pages),
blocks as (
  select page_id, url, list_transform(string_split_regex(a, '</?(p|h1)>'), lambda x:
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'),
      '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&copy;?', chr(169), 'g'), '&middot;?', chr(183), 'g'), '&amp;?', '&', 'g')) as b
  from cut),
clean as (
  select page_id, url, coalesce(array_to_string(list_filter(list_transform(b, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10) || chr(10)), '') as text
  from blocks)
select page_id, url, text, length(text)::bigint as n_chars from clean
""",
    "op11_fill_middle": r"""
with cut as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as w,
    list_transform([1, 9, 17, 25], lambda k: ('0x' || substr(sha256('42:' || coalesce(doc_id::varchar, '')), k, 8))::bigint) as h
  from documents),
drawn as (
  select doc_id, t, w, len(w)::bigint as n, least(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) as a, greatest(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) as b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h[3] % 100 >= 50 then 'plain' when h[4] % 100 < 80 then 'spm' else 'psm' end as form
  from cut),
parts as (
  select *, array_to_string(w[1:a], '') as p, array_to_string(w[a + 1:b], '') as m, array_to_string(w[b + 1:n], '') as s from drawn)
select doc_id, n, form, case when form <> 'plain' then length(p)::bigint end as prefix_chars, case when form <> 'plain' then length(m)::bigint end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(t) as restored_sha256
from parts
""",
    "op12_kd_clusters": f"""
with kept as materialized (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: isfinite(x))) = 64),
c0 as materialized (
  select row_number() over (order by sha256('2:' || vec_id) nulls last, v) - 1 as c, v as z from kept qualify c < 40),
{"".join(map(_lloyd_round, range(6)))}
inertias as (select c, sum(d)::bigint as cluster_inertia from a5 group by c)
select vec_id, c::int as cluster, d as distance, cluster_inertia, (sum(d) over ())::bigint as inertia, sha256(array_to_string(z, ',')) as centroid_sha256
from a5 join kept using (r) join inertias using (c) join c5 using (c)
""",
}
