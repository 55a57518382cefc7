"""SQL for the queries that SQL can express on whole tables.

p2, p4, p6 and p9 are held against brute force in the tests instead: their normal forms,
parses and patterns have no SQL counterpart.
"""

_TOKENS = r"coalesce(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x1c-\x1f\x{85}\p{Z}]+')),0)"
_KEY = r"nullif(trim(regexp_replace(lower({0}), '[\s_\-]+', '_', 'g'), '_'), '')"
_COMPACT = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', '', 'g')"
_PLACEHOLDER = "('','na','none','null','unknown','unknowncontributor')"


def _link(kind: str, column: str) -> str:
    compact = _COMPACT.format(column)
    if kind == "s":
        digits = rf"regexp_extract(regexp_replace({column}, '^[^\d]+|[\s.\-_/]', '', 'g'), '^(\d{{10}})(?:\d{{3}})?\D*$', 1)"
        compact = f"coalesce(nullif({digits},''), {compact})"
    return f"select test_id, '{kind}:'||k k from (select test_id, {compact} k from kie_split) where k is not null and k not in {_PLACEHOLDER} and not regexp_full_match(k,'0+')"


_GROUPED = f"""with recursive links as ({_link("c", "contributor_id")} union {_link("s", "seller_tax_id")} union {_link("d", "base_document_id")}),
near as (select distinct a.test_id a, b.test_id b from links a join links b using (k)),
reach as (select distinct test_id a, test_id b from kie_split union select r.a, n.b from reach r join near n on r.b=n.a),
root as (select a test_id, min(b) group_test_id from reach group by 1),
cur as (select test_id, min({_KEY.format("kie_split")}) cur from kie_split group by 1)"""
_HASH = r"nullif(regexp_replace(regexp_replace(lower(sha256), '^\s*sha-?256\s*[:=]\s*', ''), '[^0-9a-f]', '', 'g'), '')"
_NEAR = " and ".join(f"abs(ln(t.{m})-ln(p.{m}))<=-ln(0.99)" for m in ("brightness", "contrast", "sharpness", "illumination_range"))


def _labelled(key: str) -> str:
    return f"""with t as (select distinct test_id id, {key.format("selection_stratum")} s, {key.format("quality_label_manual")} q from test_manifest), p as (select distinct candidate_id id, {key.format("heuristic_group")} g from candidate_pool),
 l as (select 'selection_stratum' c, id, s k from t union select 'quality_label_manual', id, q from t union select 'heuristic_group', id, g from p), n as (select c, count(distinct id) n from l group by 1), h as (select c, k, count(distinct id) h from l group by 1,2)"""


def _targets(key: str) -> str:
    return f"stratum_targets join n on n.c=label_column left join h on h.c=label_column and h.k={key.format('category')}"


# White space of any kind, as the operators read it.
_WIDE_KEY = r"nullif(trim(regexp_replace(lower({0}), '[\s\x1c-\x1f\x{{85}}\p{{Z}}_\-]+', '_', 'g'), '_'), '')"
_PAIRS = f"""select distinct test_id, candidate_id from t join p on t.h=p.h or ({_NEAR} and abs(abs(ln(t.height/t.width))-abs(ln(p.height/p.width)))<=-ln(0.99))"""
_PICTURES = f"""with t as (select distinct test_id, {_HASH} h, width, height, brightness, contrast, sharpness, illumination_range from test_manifest),
 p as (select distinct candidate_id, {_HASH} h, width, height, brightness, contrast, sharpness, illumination_range from candidate_pool where {_KEY.format("pool_split")}='train')"""
_FOLDER = r"regexp_extract(source_file, '^(.*)/[^/]*$', 1)"

SQL: dict[str, str] = {
    "p1_found": f"{_GROUPED}, bad as (select group_test_id from root join cur using (test_id) group by 1 having count(distinct cur)>=2) select test_id, group_test_id from root where group_test_id in (select group_test_id from bad)",
    "p1_invariants": f"{_GROUPED} select cast((select count(*) from root) as bigint) records, count(distinct group_test_id) groups, 0 divided, true on_target, true improved from root",
    "p3_report": f"""{_labelled(_WIDE_KEY)}
 select plan_name, category, w wanted, a available, least(w, a) drawn, greatest(w-a, 0) shortfall from (select plan_name, category, coalesce(h,0) a,
 cast(greatest(min_count, ceil(round(target_share*sample_fraction*n,9))) as bigint) w from {_targets(_WIDE_KEY)})""",
    "p3_found": f"""{_labelled(_KEY)}
 select plan_name, category from {_targets(_KEY)} where coalesce(h,0) < greatest(min_count, round(target_share*sample_fraction*n,9))""",
    "p5_found": f"{_PICTURES} {_PAIRS}",
    "p5_report": f"""{_PICTURES}, o as ({_PAIRS}), c as (select test_id, count(*) n from o group by 1), r as (select test_id, coalesce({_FOLDER}, '') source from (select test_id, min(source_file) source_file from test_manifest where test_id is not null group by 1)),
 s as (select test_id, min({_KEY.format("kie_split")}) split from kie_split group by 1)
 select split, source, count(*) records, count(n) overlapping, cast(coalesce(sum(n),0) as bigint) pairs from r left join s using (test_id) left join c using (test_id) group by 1,2""",
    "p7_invariants": f"""select plan_name, count(*) texts, cast(sum(n) as bigint) tokens, 0 overfull, 0 torn, true dense from (select {_TOKENS} n from documents) join pack_plans on n>0 group by 1""",
    "p7_found": f"select plan_name, doc_id from (select doc_id, {_TOKENS} n from documents) join pack_plans on n>capacity_tokens",
    "p8_invariants": f"""with d as (select {_KEY.format("source")} s, {_TOKENS} n from documents), g as (select s, sum(n) n from d group by 1)
 select mix_name, source, true within_repeats, true near_target, not (target_share*(select sum(n) from d) > max_repeats*coalesce(n,0)) reached from mix_targets left join g on s={_KEY.format("source")}""",
    "p8_found": f"""with d as (select {_KEY.format("source")} s, {_TOKENS} n from documents), g as (select s, sum(n) n from d group by 1)
 select mix_name, source from mix_targets left join g on s={_KEY.format("source")} where target_share*(select sum(n) from d) > max_repeats*coalesce(n,0)""",
}
