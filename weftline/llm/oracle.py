"""SQL twins of the llm queries that SQL can state."""

from __future__ import annotations

from weftline.llm.languages import LANGUAGES

_LABEL = r"lower(regexp_replace({}, '[^\p{{L}}\p{{N}}]+', '', 'g'))"
_NAME = r"lower(translate(regexp_replace({}, '^\s+|\s+$', '', 'g'), '-', '_'))"

def _int32(text: str, salt: str) -> str:
    return f"cast(('0x' || substr(md5({text} || '|{salt}'), 1, 8)) as bigint)"


_P1 = f"""
with records as (
  select pool, id, min(k) as k from (
    select 'context_qa_samples' as pool, sample_id as id, {_LABEL.format('ds_label')} as k from context_qa_samples
    union all
    select 'classification_datapoints', datapoint_id, {_LABEL.format('ds_label')} from classification_datapoints)
  where id is not null and k <> '' group by pool, id),
held as (select pool, k, count(*) as n from records group by pool, k),
t as (
  select target_set, pool, category, target_share, {_LABEL.format('category')} as k, cast(round(round(target_share * sample_size, 6)) as bigint) as quota,
    cast(min_count as bigint) as floor_, greatest(cast(round(round(target_share * sample_size, 6)) as bigint), cast(min_count as bigint)) as wanted, sample_size
  from sampling_targets)
"""

P1_REPORT = f"""{_P1},
r as (select t.target_set, t.pool, t.category, t.target_share, t.wanted, coalesce(h.n, 0) as available, least(t.wanted, coalesce(h.n, 0)) as drawn,
    max(sample_size) over (partition by t.target_set) as sample_size from t left join held h on h.pool = t.pool and h.k = t.k)
select *, wanted - drawn as shortfall, cast(sum(drawn) over (partition by target_set) as bigint) as set_total,
  case when sum(drawn) over (partition by target_set) > 0 then round(drawn / cast(sum(drawn) over (partition by target_set) as double), 9) else 0.0 end as reached_share
from r
"""

P1_SAMPLE = f"""{_P1},
o as (
  select t.*, r.id, row_number() over (partition by t.target_set, t.category order by {_int32("r.id || '#' || t.target_set", '20.order')}, r.id) as rank,
    count(*) over (partition by t.target_set, t.category) as available
  from records r join t on t.pool = r.pool and t.k = r.k),
m as (
  select *, least(quota, available) as q,
    (cast(rank as hugeint) * least(quota, available) + (cast(available as hugeint) * {_int32('cast(target_set as varchar)', '20.start')}) // 4294967296) // available as upto,
    (cast(rank - 1 as hugeint) * least(quota, available) + (cast(available as hugeint) * {_int32('cast(target_set as varchar)', '20.start')}) // 4294967296) // available as before
  from o)
select target_set, pool, category, id as record_id, case when upto > before then 'systematic' else 'floor' end as drawn_by
from m where upto > before or rank - upto <= least(floor_, available) - q
"""


def _p2(size: str) -> str:
    return f"""
with records as (select point_id, min({_NAME.format('datapoint_type')}) as k, cast(max({size}) as double) as size from training_datapoints where point_id is not null group by point_id),
limits as (select {_NAME.format('dataset_name')} as k, arg_max(num_train, updated_at) as m from dataset_loader_configs group by 1),
u as (
  select * from (select r.point_id, r.k, r.size, l.m, row_number() over (partition by r.k order by md5(r.point_id || '|31.limit'), r.point_id) as rn from records r left join limits l on l.k = r.k)
  where rn <= coalesce(m, rn)),
totals as (select k, count(*) as usable, sum(size) as total from u group by k),
t as (
  select mix_id, dataset_name, target_share, {_NAME.format('dataset_name')} as k,
    cast(round(round(target_share * total_records, 6)) as bigint) as wanted, cast(max_repeats as bigint) as r
  from mix_targets),
p as (
  select t.*, coalesce(h.usable, 0) as usable, coalesce(h.total, 0.0) as total, case when h.total > 0 then least(cast(t.r as double), t.wanted / h.total) else 0.0 end as rate
  from t left join totals h on h.k = t.k),
c as (
  select p.mix_id, p.dataset_name, u.point_id, u.size,
    cast(floor(p.rate) as bigint) + case when {_int32("u.point_id || '#' || p.mix_id || '#' || p.dataset_name", '31.copy')} / 4294967296.0 < p.rate - floor(p.rate) then 1 else 0 end as copies
  from p join u on u.k = p.k),
d as (select mix_id, dataset_name, sum(copies) as drawn, sum(copies * size) as size_drawn from c where copies > 0 group by 1, 2),
s as (select p.*, cast(coalesce(d.drawn, 0) as bigint) as drawn, coalesce(d.size_drawn, 0.0) as size_drawn, sum(d.size_drawn) over (partition by p.mix_id) as all_ from p left join d on d.mix_id = p.mix_id and d.dataset_name = p.dataset_name)
"""


_P2_REPORT = """select mix_id, dataset_name, target_share, wanted, usable, total * r as capacity, round(rate * total, 9) as expected, drawn, {more}
  round(case when all_ > 0 then size_drawn / all_ else 0.0 end, 9) as share, round(case when all_ > 0 then size_drawn / all_ else 0.0 end - coalesce(target_share, 0.0), 9) as deviation from s"""
P2_SHARES = _p2("1") + _P2_REPORT.format(more="")
#: Length of a token list without its left padding.
_UNPADDED = "coalesce(len(input_ids) - (list_position(list_transform(input_ids, lambda x: coalesce(x <> 0, true)), true) - 1), 0)"
P2_TOKEN_SHARES = _p2(_UNPADDED) + _P2_REPORT.format(more="size_drawn,")
P2_MIX = _p2("1") + "select mix_id, dataset_name, point_id, unnest(range(1, copies + 1)) as copy_no from c where copies > 0"

P3_POINT_COUNTS = """
select point_id, max(coalesce(len(input_ids) - (list_position(list_transform(input_ids, lambda x: coalesce(x <> 0, true)), true) - 1), 0)) as n_tokens
from training_datapoints group by point_id
"""


def _code(lang: str) -> str:
    """The two-letter code of a label in any spelling, as the register of languages has it; else null."""
    head = f"lower(regexp_extract({lang}, '^[ \\t\\n\\r\\f\\x0B]*([A-Za-z]+)[ \\t\\n\\r\\f\\x0B]*(?:[-_].*)?$', 1))"
    known = " ".join(f"when {head} in ({', '.join(repr(x) for x in (code, *names))}) then '{code}'" for code, names in LANGUAGES.items())
    return f"case {known} end"


P3_POINT_BUDGET = f"""
with s as (select point_id, {_NAME.format('datapoint_type')} as source, {_code('lang')} as lang, domain, coalesce({_UNPADDED}, 0) as n_tokens from training_datapoints),
p as (select * from (select *, row_number() over (partition by point_id order by n_tokens desc, source desc nulls last, lang desc nulls last, domain desc nulls last) as rn from s) where rn = 1)
select 'training_datapoints' as record_table, source, lang, domain, cast(grouping(source, lang, domain) as int) as level, count(*) as n_records, cast(sum(n_tokens) as bigint) as n_tokens
from p group by cube (source, lang, domain)
"""

P7_TOTALS = """
select spec_id, (select count(*) from documents) as n_texts, (select count(distinct doc_id) from documents) as n_ids, 0 as n_overfull from container_specs
"""

P8_TOTALS = "select count(*) as n_rows, count(distinct doc_id) as n_ids, 0 as n_halves, 0 as n_outside from documents"


def sql() -> dict[str, str]:
    return {
        "p1_report": P1_REPORT,
        "p1_sample": P1_SAMPLE,
        "p1_found": f"select target_set, category from ({P1_REPORT}) where shortfall > 0",
        "p2_shares": P2_SHARES,
        "p2_mix": P2_MIX,
        "p2_token_shares": P2_TOKEN_SHARES,
        "p2_found": f"select mix_id, dataset_name from ({P2_SHARES}) where capacity < wanted",
        "p3_point_counts": P3_POINT_COUNTS,
        "p3_point_budget": P3_POINT_BUDGET,
        "p7_totals": P7_TOTALS,
        "p8_totals": P8_TOTALS,
    }
