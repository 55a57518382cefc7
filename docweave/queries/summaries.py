"""Queries over formats, lists, run tables and completeness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.functions import formats
from docweave.functions.text import fold
from docweave.operators import metrics, summary
from docweave.queries.fixtures import BLOCKS_SQL, ROWS_SQL, blocks, evidence_rows, pairs, pairs_sql
from docweave.sources.tables import table

ORDER = ["customer", "status", "priority"]
CELLS = ["amount", "description", "quantity", "unit", "unit_price"]


def control_strip(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.md5(formats.without_controls(F.col("text"))).alias("text_md5"))


def note_codes(spark: SparkSession, folder: str) -> DataFrame:
    notes = table(spark, folder, "test_manifest").select(F.concat(F.coalesce("quality_label_manual", F.lit("")), F.lit(": "), F.coalesce("notes", F.lit(""))).alias("note"))
    return notes.groupBy(formats.note_code(F.col("note")).alias("code")).agg(F.count("*").alias("n"))


def display_forms(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select("o_orderkey", formats.dong(F.floor("o_totalprice")).alias("total"), formats.day_first(F.col("o_orderdate")).alias("day"))


def utc_stamps(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", formats.utc_stamp(F.col("ts")).alias("stamp"))


def zoned_stamps(spark: SparkSession, folder: str) -> DataFrame:
    way = F.col("o_orderkey") % 4
    end = F.when(way == 0, "Z").when(way == 1, "+07:00").when(way == 2, "").otherwise("Zx")
    stamp = F.concat(F.date_format(F.col("o_orderdate").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss"), end)
    return table(spark, folder, "orders").select("o_orderkey", formats.is_zoned(stamp).alias("zoned"))


def scale_check(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem")
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), *[F.count_if(~formats.within_scale(F.col("l_extendedprice"), d)).alias(f"beyond_{d}") for d in (0, 1, 2)])


def render_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "candidate_pool").select("candidate_id", formats.pixels(F.col("width"), 200).alias("width_px"), formats.pixels(F.col("height"), 200).alias("height_px")).distinct()


def unit_coordinates(spark: SparkSession, folder: str) -> DataFrame:
    return blocks(spark, folder).select("doc_id", "ix", formats.unit(F.col("left_x"), F.lit(960)).alias("x0"), formats.unit(F.col("right_x"), F.lit(960)).alias("x1"))


def sequential_ids(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    return rows.withColumn("n", F.row_number().over(w)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", formats.numbered("line-", F.col("n"), 4).alias("line_id"), formats.numbered("R", F.col("n"), 3).alias("short_id"))


def seeded_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Sixteen candidates in the order of a seeded hash: the same for the same seed, whatever the order of rows."""
    pool = table(spark, folder, "candidate_pool").where("candidate_id is not null").select("candidate_id").distinct()
    return pool.orderBy(F.md5(F.concat("candidate_id", F.lit("|20"))), "candidate_id").limit(16)


def canonical_order(spark: SparkSession, folder: str) -> DataFrame:
    """The place of each field in the canonical order, from a small table of names."""
    places = spark.createDataFrame([(f, i) for i, f in enumerate(ORDER, 1)], "field string, place long")
    return pairs(spark, folder).join(F.broadcast(places), "field").select("sample_id", "field", "place")


def failed_ids(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents")
    lists = [rows.where("lang is null").select("doc_id"), rows.where("source is null").select("doc_id"), rows.where("n_chars < 40").select("doc_id")]
    return lists[0].union(lists[1]).union(lists[2]).distinct()


def unmatched_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = blocks(spark, folder)
    return summary.unmatched(rows.where("ix % 5 <> 4"), rows.where("ix % 3 <> 2"), ["doc_id", "ix"])


def ordered_id_union(spark: SparkSession, folder: str) -> DataFrame:
    return summary.ordered_union(evidence_rows(spark, folder), "doc_id", "line", "part_id")


def error_summary(spark: SparkSession, folder: str) -> DataFrame:
    return summary.by_category(pairs(spark, folder), "field", metrics.outcome(), list(metrics.OUTCOMES))


def omission_rates(spark: SparkSession, folder: str) -> DataFrame:
    return summary.omission(pairs(spark, folder), "field", F.col("gs") == "PRESENT", F.col("pv").isNull())


def mean_confidence(spark: SparkSession, folder: str) -> DataFrame:
    return summary.mean_or_zero(table(spark, folder, "documents"), blocks(spark, folder).where("ix > 0"), "doc_id", "confidence")


def run_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Receipts expected, attempted and succeeded, from headers, evidence runs and results."""
    runs = table(spark, folder, "machine_runs").where("receipt_id is not null")
    per = runs.groupBy("receipt_id").agg(F.bool_or(F.col("kind") == "ocr").alias("tried"), F.bool_or(F.col("kind") == "kie").alias("done"))
    expected = table(spark, folder, "invoice_headers").where("receipt_id is not null").select("receipt_id").distinct().join(per, "receipt_id", "left")
    counted = expected.agg(F.count("*").alias("expected"), F.count_if("tried").alias("attempted"), F.count_if(F.col("tried") & F.col("done")).alias("succeeded"))
    return counted.withColumn("failed", F.col("attempted") - F.col("succeeded")).withColumn("success_rate", F.round(metrics.ratio("succeeded", "expected"), 6))


def counts_by_kind(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "machine_runs").groupBy("kind").agg(F.count_distinct("run_id").alias("runs"), F.count("*").alias("deliveries"))


def registry_presence(spark: SparkSession, folder: str) -> DataFrame:
    return summary.presence(table(spark, folder, "kie_split").where("test_id is not null"), table(spark, folder, "test_manifest").where("test_id is not null"), "test_id")


def baseline_mapping(spark: SparkSession, folder: str) -> DataFrame:
    manifest = table(spark, folder, "test_manifest").select("test_id", "candidate_id").distinct()
    pool = table(spark, folder, "candidate_pool").select("candidate_id", "width", "height").distinct()
    return manifest.join(pool, "candidate_id").select("test_id", "candidate_id", "width", "height")


def live_documents(spark: SparkSession, folder: str) -> DataFrame:
    headers = table(spark, folder, "invoice_headers").where("total_amount is not null").select("receipt_id")
    return table(spark, folder, "documents").join(headers, "receipt_id", "left_semi").select("doc_id", "receipt_id")


def list_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Receipts of a status whose seller's name holds a word, created in a span of days; the latest delivery counts."""
    rows = table(spark, folder, "invoice_headers").select("receipt_id", "status", "seller_name", "created_at").distinct()
    span = F.col("created_at").between(F.to_timestamp_ntz(F.lit("2026-02-01 00:00:00")), F.to_timestamp_ntz(F.lit("2026-08-31 23:59:59")))
    return rows.where((F.col("status") == "VERIFIED") & F.contains(fold(F.col("seller_name")), F.lit("cong ty")) & span).select("receipt_id", "seller_name").distinct()


def sort_orders(spark: SparkSession, folder: str) -> DataFrame:
    """The place of every receipt in the four sort orders; a null total counts as -1."""
    rows = table(spark, folder, "invoice_headers").where("receipt_id is not null").groupBy("receipt_id").agg(F.min("created_at").alias("at"), F.max(F.coalesce("total_amount", F.lit(-1))).alias("total"))
    orders = {"newest": [F.desc("at")], "oldest": [F.asc("at")], "total_high": [F.desc("total")], "total_low": [F.asc("total")]}
    ranked = [rows.orderBy(*order, F.asc("receipt_id")).limit(50).select(F.lit(name).alias("sorting"), "receipt_id", "total") for name, order in orders.items()]
    return ranked[0].union(ranked[1]).union(ranked[2]).union(ranked[3])


def column_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    gold = blocks(spark, folder).where("ix % 5 <> 4").select("doc_id", "row_ix", "col_ix", "score")
    found = blocks(spark, folder).where("ix % 3 <> 2").select("doc_id", "row_ix", "col_ix", F.when(F.col("score") % 4 != 0, F.col("score")).alias("score"))
    return summary.column_correctness(gold, found, ["doc_id", "row_ix"], "col_ix", "score")


def complete_table_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    gold = blocks(spark, folder).select("doc_id", "row_ix", "col_ix", "score")
    found = gold.where("not (doc_id % 3 = 0 and row_ix = 1)").withColumn("score", F.when((F.col("doc_id") % 4 == 0) & (F.col("row_ix") == 2), -1).otherwise(F.col("score")))
    return summary.complete_tables(gold, found, "doc_id", ["row_ix", "col_ix"], "score")


def geometry_equality(spark: SparkSession, folder: str) -> DataFrame:
    box = blocks(spark, folder).select("doc_id", "ix", "left_x", "top_y", "right_x", "bottom_y")
    return summary.same_rows(box, box.withColumn("right_x", F.when(F.col("ix") % 41 == 40, F.col("right_x") + 1).otherwise(F.col("right_x"))))


def run_histories(spark: SparkSession, folder: str) -> DataFrame:
    runs = table(spark, folder, "machine_runs").where("receipt_id is not null and run_id is not null")
    return summary.histories(runs, "receipt_id", "kind", ["ocr", "kie"], "created_at", "run_id")


def exact_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Lines by whether they have exactly the five cells."""
    per = table(spark, folder, "line_cells").groupBy("receipt_id", "row_id").agg(F.sort_array(F.collect_set("field")).alias("names"))
    return per.groupBy((F.col("names") == F.array(*map(F.lit, CELLS))).alias("exact")).agg(F.count("*").alias("lines"))


def page_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks of each document in order as one text, as error rates are taken of it."""
    ordered = F.array_sort(F.collect_list(F.struct("ix", "text")))
    return blocks(spark, folder).groupBy("doc_id").agg(F.md5(F.array_join(F.transform(ordered, lambda x: x["text"]), " ")).alias("text_md5"))


def citing_fields(spark: SparkSession, folder: str) -> DataFrame:
    return summary.citing(evidence_rows(spark, folder), "part_id", "doc_id", "line")


def selection_faults(spark: SparkSession, folder: str) -> DataFrame:
    """Test records whose candidate is not in the pool or stands in the manifest under several ids."""
    chosen = table(spark, folder, "test_manifest").where("test_id is not null").select("test_id", "candidate_id").distinct()
    pool = table(spark, folder, "candidate_pool").select("candidate_id").distinct()
    unknown = chosen.join(pool, "candidate_id", "left_anti").select("test_id", F.lit("UNKNOWN_CANDIDATE").alias("fault"))
    many = chosen.groupBy("candidate_id").agg(F.count_distinct("test_id").alias("n")).where("n > 1")
    return unknown.union(chosen.join(many, "candidate_id").select("test_id", F.lit("CHOSEN_TWICE").alias("fault")))


QUERIES = {f.__name__: f for f in (
    control_strip, note_codes, display_forms, utc_stamps, zoned_stamps, scale_check, render_sizes, unit_coordinates, sequential_ids, seeded_sample, canonical_order, failed_ids, unmatched_rows,
    ordered_id_union, error_summary, omission_rates, mean_confidence, run_metrics, counts_by_kind, registry_presence, baseline_mapping, live_documents, list_filter, sort_orders, column_accuracy,
    complete_table_accuracy, geometry_equality, run_histories, exact_cells, page_texts, citing_fields, selection_faults,
)}

_B = f"with {BLOCKS_SQL}"
_FOLD = r"replace(strip_accents(lower(trim(regexp_replace({0}, '[\s\x1c-\x1f\x{{85}}\p{{Z}}]+', ' ', 'g')))), 'đ', 'd')"
_BOX = "doc_id, ix, left_x, top_y, right_x, bottom_y"
_SHIFTED = "doc_id, ix, left_x, top_y, case when ix%41=40 then right_x+1 else right_x end right_x, bottom_y"
SQL = {
    "control_strip": r"select doc_id, md5(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]', '', 'g')) text_md5 from documents",
    "note_codes": "select nullif(upper(trim(split_part(coalesce(quality_label_manual,'')||': '||coalesce(notes,''), ':', 1))), '') code, count(*) n from test_manifest group by 1",
    "display_forms": "select o_orderkey, replace(format('{:,}', cast(floor(o_totalprice) as bigint)), ',', '.')||' ₫' total, strftime(o_orderdate, '%d/%m/%Y') \"day\" from orders",
    "utc_stamps": "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') stamp from events",
    "zoned_stamps": "select o_orderkey, o_orderkey%4<2 zoned from orders",
    "scale_check": "select l_returnflag, count(*) n, count(*) filter (where v<>round(v,0)) beyond_0, count(*) filter (where v<>round(v,1)) beyond_1, count(*) filter (where v<>round(v,2)) beyond_2 from (select l_returnflag, cast(l_extendedprice as decimal(28,8)) v from lineitem) group by 1",
    "render_sizes": "select distinct candidate_id, cast(ceil(width*200/72.0) as bigint) width_px, cast(ceil(height*200/72.0) as bigint) height_px from candidate_pool",
    "unit_coordinates": f"{_B} select doc_id, ix, round(greatest(0e0,least(1e0,left_x/960e0)),6) x0, round(greatest(0e0,least(1e0,right_x/960e0)),6) x1 from blocks",
    "sequential_ids": """with d as (select distinct l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem), n as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) n from d)
 select l_orderkey, l_linenumber, l_partkey, l_suppkey, 'line-'||lpad(n::varchar, greatest(4,length(n::varchar))::int, '0') line_id, 'R'||lpad(n::varchar, greatest(3,length(n::varchar))::int, '0') short_id from n""",
    "seeded_sample": "select candidate_id from (select distinct candidate_id from candidate_pool where candidate_id is not null) order by md5(candidate_id||'|20'), candidate_id limit 16",
    "canonical_order": f"with {pairs_sql()} select sample_id, field, case field when 'customer' then 1 when 'status' then 2 else 3 end place from pairs",
    "failed_ids": "select doc_id from documents where lang is null union select doc_id from documents where source is null union select doc_id from documents where n_chars<40",
    "unmatched_rows": f"{_B} select doc_id, ix, 'gold' side from blocks where ix%5<>4 and ix%3=2 union all select doc_id, ix, 'predicted' from blocks where ix%3<>2 and ix%5=4",
    "ordered_id_union": f"with {ROWS_SQL}, f as (select doc_id, part_id, min(line) l from rows_ group by 1,2) select doc_id, string_agg(part_id::varchar, ',' order by l, part_id::varchar) ids, count(*) n from f group by 1",
    "error_summary": f"""with {pairs_sql()}, k as (select field, case when gs<>ps then case when gs='PRESENT' then 'MISSED_PRESENT' when ps='PRESENT' then 'SPURIOUS_PRESENT' else 'STATUS_MISMATCH' end when gs='PRESENT' and gv is distinct from pv then 'NORMALIZATION_MISMATCH' else 'EXACT' end c from pairs)
 select field, count(*) filter (where c='EXACT') exact, count(*) filter (where c='MISSED_PRESENT') missed_present, count(*) filter (where c='SPURIOUS_PRESENT') spurious_present, count(*) filter (where c='STATUS_MISMATCH') status_mismatch, count(*) filter (where c='NORMALIZATION_MISMATCH') normalization_mismatch from k group by 1""",
    "omission_rates": f"with {pairs_sql()}, c as (select field, count(*) filter (where gs='PRESENT') expected, count(*) filter (where gs='PRESENT' and pv is null) omitted from pairs group by 1) select *, round(omitted/nullif(expected,0),6) omission_rate from c",
    "mean_confidence": f"{_B}, m as (select doc_id, avg(confidence) c from blocks where ix>0 group by 1) select d.doc_id, coalesce(round(c,6),0) mean_confidence from (select distinct doc_id from documents) d left join m using (doc_id)",
    "run_metrics": """with r as (select receipt_id, bool_or(kind='ocr') t, bool_or(kind='kie') d from machine_runs where receipt_id is not null group by 1), e as (select distinct receipt_id from invoice_headers where receipt_id is not null),
 c as (select count(*) expected, count(*) filter (where t) attempted, count(*) filter (where t and d) succeeded from e left join r using (receipt_id)) select *, attempted-succeeded failed, round(succeeded/nullif(expected,0),6) success_rate from c""",
    "counts_by_kind": "select kind, count(distinct run_id) runs, count(*) deliveries from machine_runs group by 1",
    "registry_presence": """with a as (select distinct test_id from kie_split where test_id is not null), b as (select distinct test_id from test_manifest where test_id is not null)
 select case when a.test_id is null then 'only_b' when b.test_id is null then 'only_a' else 'both' end status, count(*) n from a full join b on a.test_id=b.test_id group by 1""",
    "baseline_mapping": "select test_id, candidate_id, width, height from (select distinct test_id, candidate_id from test_manifest) join (select distinct candidate_id, width, height from candidate_pool) using (candidate_id)",
    "live_documents": "select doc_id, receipt_id from documents d where exists (select 1 from invoice_headers h where h.receipt_id=d.receipt_id and total_amount is not null)",
    "list_filter": f"select distinct receipt_id, seller_name from invoice_headers where status='VERIFIED' and contains({_FOLD.format('seller_name')}, 'cong ty') and created_at between timestamp '2026-02-01 00:00:00' and timestamp '2026-08-31 23:59:59'",
    "sort_orders": "with r as (select receipt_id, min(created_at) made, max(coalesce(total_amount,-1)) total from invoice_headers where receipt_id is not null group by 1) "
    + " union all ".join(f"(select '{n}' sorting, receipt_id, total from r order by {o}, receipt_id limit 50)" for n, o in (("newest", "made desc"), ("oldest", "made"), ("total_high", "total desc"), ("total_low", "total"))),
    "column_accuracy": f"{_B}, j as (select col_ix, score, case when score%4<>0 then score end other from blocks where ix%5<>4 and ix%3<>2), c as (select col_ix, count(*) matched, count(*) filter (where score is not distinct from other) correct from j group by 1) select *, round(correct/nullif(matched,0),6) accuracy from c",
    "complete_table_accuracy": f"{_B}, d as (select doc_id, bool_and(not (doc_id%3=0 and row_ix=1) and not (doc_id%4=0 and row_ix=2)) ok from blocks group by 1) select count(*) documents, count(*) filter (where ok) complete, round(count(*) filter (where ok)/count(*),6) accuracy from d",
    "geometry_equality": f"{_B} select (select count(*) from (select {_BOX} from blocks except all select {_SHIFTED} from blocks)) only_a, (select count(*) from (select {_SHIFTED} from blocks except all select {_BOX} from blocks)) only_b",
    "run_histories": """with o as (select receipt_id, kind, run_id, min(created_at) made from machine_runs where receipt_id is not null and run_id is not null group by 1,2,3)
 select receipt_id, coalesce(string_agg(run_id, ',' order by made, run_id) filter (where kind='ocr'),'') ocr_runs, coalesce(string_agg(run_id, ',' order by made, run_id) filter (where kind='kie'),'') kie_runs from o group by 1""",
    "exact_cells": "with p as (select receipt_id, row_id, count(distinct field)=5 exact from line_cells group by 1,2) select exact, count(*) lines from p group by 1",
    "page_texts": f"""{_B} select doc_id, md5(string_agg("text", ' ' order by ix)) text_md5 from blocks group by 1""",
    "citing_fields": f"with {ROWS_SQL}, d as (select distinct part_id, doc_id, line from rows_) select part_id, count(*) fields from d group by 1",
    "selection_faults": """with c as (select distinct test_id, candidate_id from test_manifest where test_id is not null) select test_id, 'UNKNOWN_CANDIDATE' fault from c where not exists (select 1 from candidate_pool p where p.candidate_id=c.candidate_id)
 union all select test_id, 'CHOSEN_TWICE' from c where candidate_id in (select candidate_id from c group by 1 having count(distinct test_id)>1)""",
}
