"""Queries over cell pairs: metrics of both generations, slices, taxonomies and deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators import metrics
from docweave.queries.fixtures import pairs, pairs_sql

_COUNTS = """count(*) total, count(*) filter (where gs<>'UNKNOWN') scored, count(*) filter (where gs='UNKNOWN') unknown,
 count(*) filter (where gs<>'UNKNOWN' and ok) correct, count(*) filter (where gs<>'UNKNOWN' and ps='PRESENT') predicted_present, count(*) filter (where gs='PRESENT') gold_present,
 count(*) filter (where gs='PRESENT' and ok) true_positive, count(*) filter (where gs<>'UNKNOWN' and reviewed) review, count(*) filter (where gs='PRESENT' and ps<>'PRESENT') miss,
 count(*) filter (where gs='PRESENT' and ps='PRESENT' and not ok) wrong, count(*) filter (where gs not in ('UNKNOWN','PRESENT') and ps='PRESENT') false_value,
 count(*) filter (where gs<>'UNKNOWN' and ps in ('UNKNOWN','UNREADABLE','AMBIGUOUS')) unresolved"""
_RATIOS = """round(correct/nullif(scored,0),6) exact_match, round(scored/nullif(total,0),6) coverage, round(true_positive/nullif(predicted_present,0),6) "precision",
 round(true_positive/nullif(gold_present,0),6) recall, round(2*true_positive/nullif(predicted_present+gold_present,0),6) f1, round(review/nullif(scored,0),6) review_rate"""
_OK = "ok as (select *, gs=ps and gv is not distinct from pv ok from pairs)"
_WITH = f"with {pairs_sql()}, {_OK}"


def metrics_v2_headers(spark: SparkSession, folder: str) -> DataFrame:
    made = metrics.header_metrics(pairs(spark, folder), ["field"], [])
    return made.withColumn("field", F.coalesce("field", F.lit("ALL")))


def metrics_slices(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.slices(pairs(spark, folder), "input_type", "template_id")


def metrics_v1_fields(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.decision_metrics(pairs(spark, folder), "field")


def metrics_v1_macro(spark: SparkSession, folder: str) -> DataFrame:
    per_field = metrics.decision_metrics(pairs(spark, folder), "field")
    return per_field.agg(F.round(F.avg("exact_match_accuracy"), 6).alias("macro_exact_match"), F.count("*").alias("fields"))


def outcome_category_v1(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.outcome_counts(pairs(spark, folder))


def root_cause_counts(spark: SparkSession, folder: str) -> DataFrame:
    both = metrics.compared(pairs(spark, folder), pairs(spark, folder, 19))
    return both.groupBy("field", metrics.root_cause().alias("cause")).agg(F.count("*").alias("n")).where("cause is not null")


def propagation_gap(spark: SparkSession, folder: str) -> DataFrame:
    both = metrics.compared(pairs(spark, folder), pairs(spark, folder, 19)).where("gs <> 'UNKNOWN'")
    counted = both.groupBy("field").agg(F.count("*").alias("scored"), F.count_if(metrics.control_exact() & ~metrics.exact()).alias("propagated"), F.count_if(metrics.control_exact()).alias("control_right"), F.count_if(metrics.exact()).alias("right"))
    return counted.withColumn("gap", F.round(metrics.ratio(F.col("control_right") - F.col("right"), F.col("scored")), 6))


def ab_metric_delta(spark: SparkSession, folder: str) -> DataFrame:
    a, b = (metrics.header_metrics(pairs(spark, folder, w), ["field"]) for w in (17, 19))
    return metrics.metric_delta(a, b, ["field"], ["exact_match", "precision", "recall", "f1"])


def metric_unpivot_report(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.unpivoted(metrics.header_metrics(pairs(spark, folder), ["field"]), ["field"], ["exact_match", "coverage", "precision", "recall", "f1", "review_rate"])


def complete_header_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.complete_accuracy(pairs(spark, folder), "input_type")


def normalization_ablation(spark: SparkSession, folder: str) -> DataFrame:
    rows = pairs(spark, folder).where("gs = 'PRESENT'")
    before = F.lower("pv").eqNullSafe(F.col("gv"))
    counted = rows.groupBy("field").agg(F.count("*").alias("cells"), F.count_if(before).alias("before"), F.count_if(F.col("pv").eqNullSafe(F.col("gv"))).alias("after"))
    return counted.withColumn("gain", F.col("after") - F.col("before"))


def failed_inputs_in_denominator(spark: SparkSession, folder: str) -> DataFrame:
    rows = pairs(spark, folder)
    gold = rows.select("sample_id", "field", "gs", "gv")
    results = rows.where("sample_id % 23 <> 0").select("sample_id", "field", "ps", "pv", "reviewed")
    kept = metrics.with_failures(gold, results)
    failed = kept.groupBy("field").agg(F.count_if("failed").alias("failed_cells"))
    scored = metrics.header_metrics(kept, ["field"]).select("field", "total", "scored", "correct", "unresolved", "exact_match")
    return scored.join(failed, "field")


def coverage_accounting(spark: SparkSession, folder: str) -> DataFrame:
    rows = pairs(spark, folder)
    per = rows.groupBy("sample_id").agg(F.bool_or("reviewed").alias("processed"), F.bool_and(F.col("gs") != "UNKNOWN").alias("eligible"))
    counted = per.agg(F.count("*").alias("required"), F.count_if("eligible").alias("eligible"), F.count_if(F.col("eligible") & F.col("processed")).alias("evaluated"))
    return counted.withColumn("fraction", F.round(metrics.ratio("evaluated", "required"), 6))


def split_rollup(spark: SparkSession, folder: str) -> DataFrame:
    made = pairs(spark, folder).rollup("input_type").agg(F.count("*").alias("total"), F.count_if(metrics.exact()).alias("exact"), F.count_distinct("template_id").alias("templates"))
    return made.withColumn("input_type", F.coalesce("input_type", F.lit("ALL")))


QUERIES = {f.__name__: f for f in (metrics_v2_headers, metrics_slices, metrics_v1_fields, metrics_v1_macro, outcome_category_v1, root_cause_counts, propagation_gap, ab_metric_delta, metric_unpivot_report, complete_header_accuracy, normalization_ablation, failed_inputs_in_denominator, coverage_accounting, split_rollup)}

_V1 = f"""{_WITH}, c as (select field, count(*) decisions, count(*) filter (where ok) exact, count(*) filter (where gs=ps) status_correct, count(*) filter (where gs='PRESENT') gold_present,
 count(*) filter (where gs='PRESENT' and ps='PRESENT' and gv is not distinct from pv) true_positive, count(*) filter (where ps='PRESENT') predicted_present, count(*) filter (where reviewed) reviewed_count,
 count(*) filter (where ps='PRESENT' and not (gs='PRESENT' and gv is not distinct from pv)) false_positive, count(*) filter (where gs='PRESENT' and not (ps='PRESENT' and gv is not distinct from pv)) false_negative from ok group by field),
r as (select *, coalesce(round(exact/nullif(decisions,0),6),0) exact_match_accuracy, coalesce(round(status_correct/nullif(decisions,0),6),0) status_accuracy, coalesce(round(true_positive/nullif(gold_present,0),6),0) normalization_accuracy,
 coalesce(round(true_positive/nullif(true_positive+false_positive,0),6),0) "precision", coalesce(round(true_positive/nullif(true_positive+false_negative,0),6),0) recall,
 coalesce(round(predicted_present/nullif(decisions,0),6),0) coverage, coalesce(round(reviewed_count/nullif(decisions,0),6),0) review_rate from c)"""
_BOTH = f"""with {pairs_sql()}, {pairs_sql("ctl", 19)}, {_OK},
both_ as (select o.*, c.ps cs, c.pv cv, o.gs=c.ps and o.gv is not distinct from c.pv cok from ok o join ctl c using (sample_id, field))"""
_DELTA = ["exact_match", "precision", "recall", "f1"]


def _long(values: list[str]) -> str:
    return " union all ".join(f"select field, '{v}' metric, \"{v}\" \"value\" from m" for v in values)


def _metrics_of(name: str) -> str:
    return f"select field, {_RATIOS} from (select field, {_COUNTS} from (select *, gs=ps and gv is not distinct from pv ok from {name}) group by field)"


SQL = {
    "metrics_v2_headers": f"{_WITH}, c as (select coalesce(field,'ALL') field, {_COUNTS} from ok group by grouping sets ((field),())) select *, {_RATIOS} from c",
    "metrics_slices": f"{_WITH}, c as (select case when input_type is not null then 'input_type' else 'template_id' end slice, coalesce(input_type, template_id) key, {_COUNTS} from ok group by grouping sets ((input_type),(template_id))) select *, {_RATIOS} from c",
    "metrics_v1_fields": f'{_V1} select *, coalesce(round(2*"precision"*recall/nullif("precision"+recall,0),6),0) f1 from r',
    "metrics_v1_macro": f"{_V1} select round(avg(exact_match_accuracy),6) macro_exact_match, count(*) fields from r",
    "outcome_category_v1": f"""{_WITH}, k as (select case when gs<>ps then case when gs='PRESENT' then 'MISSED_PRESENT' when ps='PRESENT' then 'SPURIOUS_PRESENT' else 'STATUS_MISMATCH' end
 when gs='PRESENT' and gv is distinct from pv then 'NORMALIZATION_MISMATCH' else 'EXACT' end category from ok)
 select d.category, count(k.category) n from (select unnest(['EXACT','MISSED_PRESENT','SPURIOUS_PRESENT','STATUS_MISMATCH','NORMALIZATION_MISMATCH']) category) d left join k using (category) group by 1""",
    "root_cause_counts": f"""{_BOTH} select field, case when cok then case when pv is null and cv is not null then 'OCR_OMISSION' else 'OCR_SUBSTITUTION' end when gs='PRESENT' and cv is null then 'CANDIDATE_GENERATION_FAILURE'
 when gs='AMBIGUOUS' then 'AMBIGUITY' else 'CANDIDATE_RANKING_FAILURE' end cause, count(*) n from both_ where not ok group by all""",
    "propagation_gap": f"""{_BOTH} select field, count(*) scored, count(*) filter (where cok and not ok) propagated, count(*) filter (where cok) control_right, count(*) filter (where ok) "right",
 round((count(*) filter (where cok)-count(*) filter (where ok))/count(*),6) gap from both_ where gs<>'UNKNOWN' group by field""",
    "ab_metric_delta": f"""with {pairs_sql()}, {pairs_sql("ctl", 19)}, m as ({_metrics_of("pairs")}), a as ({_long(_DELTA)}), mb as ({_metrics_of("ctl")}), b as ({_long(_DELTA).replace(" from m", " from mb")})
 select field, metric, a."value" a, b."value" b, round(b."value"-a."value",6) delta from a full join b using (field, metric)""",
    "metric_unpivot_report": f"with {pairs_sql()}, m as ({_metrics_of('pairs')}) {_long(['exact_match', 'coverage', 'precision', 'recall', 'f1', 'review_rate'])}",
    "complete_header_accuracy": f"""{_WITH}, d as (select sample_id, input_type, bool_and(gs<>'UNKNOWN') known, bool_and(ok) "right" from ok group by all)
 select input_type, count(*) documents, count(*) filter (where known) scoreable, count(*) filter (where known and "right") complete, round(count(*) filter (where known and "right")/nullif(count(*) filter (where known),0),6) accuracy from d group by 1""",
    "normalization_ablation": f"""{_WITH}, c as (select field, count(*) cells, count(*) filter (where lower(pv) is not distinct from gv) "before", count(*) filter (where pv is not distinct from gv) "after" from ok where gs='PRESENT' group by 1) select *, "after"-"before" gain from c""",
    "failed_inputs_in_denominator": f"""{_WITH}, k as (select field, gs, sample_id%23=0 failed, case when sample_id%23=0 then 'UNKNOWN' else ps end ps, case when sample_id%23<>0 then pv end pv, gv from ok),
 j as (select *, gs=ps and gv is not distinct from pv ok from k)
 select field, count(*) total, count(*) filter (where gs<>'UNKNOWN') scored, count(*) filter (where gs<>'UNKNOWN' and ok) correct, count(*) filter (where gs<>'UNKNOWN' and ps in ('UNKNOWN','UNREADABLE','AMBIGUOUS')) unresolved,
 round(count(*) filter (where gs<>'UNKNOWN' and ok)/nullif(count(*) filter (where gs<>'UNKNOWN'),0),6) exact_match, count(*) filter (where failed) failed_cells from j group by field""",
    "coverage_accounting": f"""{_WITH}, d as (select sample_id, bool_or(reviewed) processed, bool_and(gs<>'UNKNOWN') eligible from ok group by 1)
 select count(*) required, count(*) filter (where eligible) eligible, count(*) filter (where eligible and processed) evaluated, round(count(*) filter (where eligible and processed)/count(*),6) fraction from d""",
    "split_rollup": f"{_WITH} select coalesce(input_type,'ALL') input_type, count(*) total, count(*) filter (where ok) exact, count(distinct template_id) templates from ok group by rollup(input_type)",
}
