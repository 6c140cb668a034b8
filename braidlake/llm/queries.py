"""The registered queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from braidlake.llm import decontam, exact_dedup, langid, licenses, lm_score, mixing, quality, simhash, urlfilter, warc

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(_table(spark, sf_dir, "documents"), class_col="lang")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"), shingle=3, distance=2)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(_table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_table(spark, sf_dir, "pages")).drop("url")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.url_filter(_table(spark, sf_dir, "pages"), urlfilter.rules_table(spark))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_lm_score,
        op2_quality,
        op3_simhash_dedup,
        op4_decontamination,
        op5_language_id,
        op6_warc,
        op7_license_scan,
        op8_exact_dedup,
        op9_url_filter,
        op10_source_mix,
    )
}

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE: dict[str, str] = {
    "op4_decontamination": f"""
with items as (select item_id, {_WORDS} as w from benchmark),
windows as (
  select distinct item_id, array_to_string(list_slice(w, k, k + 12), ' ') as key, least(len(w), 13) as size
  from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as k from items where len(w) > 0)),
docs as (select doc_id, {_WORDS} as w from documents),
sizes as (select distinct size from windows),
places as (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as k from docs, sizes where len(w) >= size),
found as (
  select p.doc_id, p.k, p.size, i.item_id
  from (select doc_id, k, size, array_to_string(list_slice(w, k, k + size - 1), ' ') as key from places) p
  join windows i on p.key = i.key and p.size = i.size),
hits as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(k, k + size)) as pos from found) group by doc_id),
seen as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as list
  from (select distinct doc_id, cast(item_id as varchar) as item from found) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(h.n_hit, 0) as n_hit, coalesce(s.n_items, 0) as n_items,
  sha256(coalesce(s.list, '')) as items_sha256, coalesce(h.n_hit, 0) > 0 and 20 * coalesce(h.n_hit, 0) >= len(d.w) as contaminated
from docs d left join hits h on d.doc_id = h.doc_id left join seen s on d.doc_id = s.doc_id""",
    "op6_warc": """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
g as (select page_id, octet_length(b) as payload_bytes, sha1(b) as hex, max(page_id) over (partition by b) as first from p),
bits as (
  select *, array_to_string(list_transform(string_split(hex, ''), lambda c: right(bin(instr('0123456789abcdef', c) - 1 + 16), 4)), '') as bits from g)
select page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1
    + 16 * cast(substr(bits, 5 * k + 1, 1) as int) + 8 * cast(substr(bits, 5 * k + 2, 1) as int) + 4 * cast(substr(bits, 5 * k + 3, 1) as int)
    + 2 * cast(substr(bits, 5 * k + 4, 1) as int) + cast(substr(bits, 5 * k + 5, 1) as int) as bigint), 1)), '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to
from bits""",
    "op7_license_scan": licenses.oracle(),
    "op8_exact_dedup": r"""
with n as (
  select doc_id, length(coalesce(text, '')) as cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as t from documents),
g as (
  select doc_id, t, count(*) over (partition by t) as group_size, first_value(doc_id) over (partition by t order by cp desc, doc_id) as keep_id from n)
select doc_id, keep_id, group_size, keep_id = doc_id as kept, sha256(t) as text_sha256 from g""",
    "op9_url_filter": f"""
with p as (select page_id, coalesce(url, '') as u from pages),
r as (select page_id, case when instr(u, '://') > 0 then regexp_extract(substr(u, instr(u, '://') + 3), '^[^?#]*') else '' end as rest from p),
h as (select page_id, {_LOWER.format("split_part(rest, '/', 1)")} as host, substr(rest, length(split_part(rest, '/', 1)) + 1) as path from r),
rules(verdict, rh, rp) as (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fit as (
  select h.page_id, arg_max(rh || rp, length(rh || rp)) as rule, arg_max(verdict, length(rh || rp)) as verdict
  from h join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by h.page_id)
select h.page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from h left join fit on h.page_id = fit.page_id""",
    "op10_source_mix": """
with recursive n as (select source, count(*) as n from documents group by source),
x as (select source, pow(n, 0.5) / sum(pow(n, 0.5)) over () * (1000 - count(*) over ()) as x from n),
b as (select source, cast(floor(x) as bigint) + 1 as q, round(x - floor(x), 9) as rest from x),
quota as (select source, cast(q + case when row_number() over (order by rest desc, source) <= 1000 - sum(q) over () then 1 else 0 end as bigint) as quota from b),
s as (select list(source order by quota desc, source) as names, list(quota order by quota desc, source) as qs from quota),
run(t, got, best) as (
  select cast(-1 as bigint), list_transform(qs, lambda q: cast(0 as bigint)), cast(0 as bigint) from s
  union all
  select t + 1, list_transform(range(1, len(got) + 1), lambda j: got[j] + case when j = now then 1 else 0 end), now
  from (
    select t, got, list_min(list_transform(range(1, len(qs) + 1), lambda j:
      case when got[j] * 1000 // qs[j] <= t + 1 then ((got[j] + 1) * 1000 + qs[j] - 1) // qs[j] * 100000 + j end)) % 100000 as now
    from run, s where t < 999)),
slots as (select names[best] as source, got[best] as k, t as slot from run, s where t >= 0),
ranked as (select doc_id, source, row_number() over (partition by source order by md5(cast(doc_id as varchar)), doc_id) - 1 as n from documents),
blocks as (select doc_id, r.source, n // 100 as block, n % 100 as place, quota from ranked r join quota q on r.source = q.source)
select doc_id, b.source, block, block * 1000 // quota as release, ((block + 1) * 1000 + quota - 1) // quota as deadline,
  block // quota * 1000 + slot as slot, place
from blocks b join slots l on b.source = l.source and block % quota + 1 = l.k""",
}
