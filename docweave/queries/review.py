"""Queries for review reasons, categories, bands, records and row detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators import layout, review, sequential
from docweave.queries.fixtures import BLOCKS_SQL, blocks
from docweave.sources.tables import table

LADDER = [("NO_CANDIDATE", "NO_CANDIDATE"), ("SOURCE_ROLE_UNCLEAR", "ROLE_CONFUSION"), ("MULTIPLE_CANDIDATES", "MULTIPLE_CANDIDATES")]
BANDS = [(0.3, 1.0), (0.5, 0.6), (0.8, 0.3)]


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    rules = {"NO_CANDIDATE": F.col("score") == 0, "SOURCE_ROLE_UNCLEAR": F.col("role") == 1, "LOW_CONFIDENCE": F.col("confidence") < 0.3, "MULTIPLE_CANDIDATES": F.col("score") % 7 == 3}
    return blocks(spark, folder).withColumn("reasons", review.reasons(rules))


def review_decision(spark: SparkSession, folder: str) -> DataFrame:
    return _judged(spark, folder).select("doc_id", "ix", F.array_join("reasons", ",").alias("reasons"), (F.size("reasons") > 0).alias("needs_review"))


def error_category_v2(spark: SparkSession, folder: str) -> DataFrame:
    wrong = _judged(spark, folder).where("score % 3 = 0")
    return wrong.groupBy(review.first_category(F.col("reasons"), LADDER, "WRONG_CANDIDATE").alias("category")).agg(F.count("*").alias("n"))


def layout_band_score(spark: SparkSession, folder: str) -> DataFrame:
    center = (F.col("top_y") + F.col("bottom_y")) / 2000.0
    return blocks(spark, folder).select("doc_id", "ix", review.band_score(center, BANDS, 0.1).alias("band_score"))


def record_assembly(spark: SparkSession, folder: str) -> DataFrame:
    cells = blocks(spark, folder).withColumn("field", F.concat(F.lit("c"), F.col("col_ix").cast("string")))
    return review.assemble(cells, "doc_id", "row_ix", "field", "score")


def line_metrics_v2(spark: SparkSession, folder: str) -> DataFrame:
    rows = blocks(spark, folder).select("doc_id", "ix", "left_x", "top_y", "right_x", "bottom_y")
    gold, found = rows.where("ix % 5 <> 4"), rows.where("doc_id % 7 <> 0 and ix % 3 <> 2")
    edges = layout.spatial_join(gold, found, "doc_id", 40).select("doc_id", F.col("ix").alias("row_a"), F.col("o_ix").alias("row_b"), F.lit(1).cast("long").alias("shared"))
    return review.line_metrics(gold, found, sequential.match_rows(edges), "doc_id")


def tax_inline_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select("l_orderkey", F.floor(F.col("l_tax") * 100 + 0.5).cast("long").alias("r"), F.floor("l_extendedprice").cast("long").alias("p")).distinct()
    text = F.concat(F.lit("VAT: "), F.col("r").cast("string"), F.lit("%; taxable "), F.col("p").cast("string"), F.lit("; tax "), F.floor(F.col("p") * F.col("r") / 100).cast("string"))
    return rows.select("l_orderkey", F.inline(review.inline_rates(text)))


QUERIES = {f.__name__: f for f in (review_decision, error_category_v2, layout_band_score, record_assembly, line_metrics_v2, tax_inline_rows)}

_R = """r as (select doc_id, ix, score, list_filter([case when score=0 then 'NO_CANDIDATE' end, case when "role"=1 then 'SOURCE_ROLE_UNCLEAR' end, case when confidence<0.3 then 'LOW_CONFIDENCE' end, case when score%7=3 then 'MULTIPLE_CANDIDATES' end], lambda x: x is not null) rs from blocks)"""
SQL = {
    "review_decision": f"with {BLOCKS_SQL}, {_R} select doc_id, ix, coalesce(array_to_string(rs, ','),'') reasons, len(rs)>0 needs_review from r",
    "error_category_v2": f"with {BLOCKS_SQL}, {_R} select case when list_contains(rs,'NO_CANDIDATE') then 'NO_CANDIDATE' when list_contains(rs,'SOURCE_ROLE_UNCLEAR') then 'ROLE_CONFUSION' when list_contains(rs,'MULTIPLE_CANDIDATES') then 'MULTIPLE_CANDIDATES' else 'WRONG_CANDIDATE' end category, count(*) n from r where score%3=0 group by 1",
    "layout_band_score": f"with {BLOCKS_SQL}, c as (select doc_id, ix, (top_y+bottom_y)/2000e0 c from blocks) select doc_id, ix, case when c<=0.3 then 1e0 when c<=0.5 then 0.6e0 when c<=0.8 then 0.3e0 else 0.1e0 end band_score from c",
    "record_assembly": f"""with {BLOCKS_SQL}, r as (select doc_id, row_ix, '{{'||string_agg('"c'||col_ix||'":'||score, ',' order by col_ix)||'}}' j from blocks group by 1,2) select doc_id, '['||string_agg(j, ',' order by row_ix)||']' record, count(*) "rows" from r group by 1""",
    "line_metrics_v2": f"""with {BLOCKS_SQL}, g as (select * from blocks where ix%5<>4), p as (select * from blocks where doc_id%7<>0 and ix%3<>2), m as (select g.doc_id, g.ix from g join p using (doc_id, ix)), d as (select doc_id from g union select doc_id from p)
 select (select count(*) from d) documents, (select count(*) from g) gold_rows, (select count(*) from p) predicted_rows, (select count(*) from m) matched_rows, (select count(*) from p)-(select count(*) from m) extra_rows,
 round((select count(*) from m)/(select count(*) from p),6) detection_precision, round((select count(*) from m)/(select count(*) from g),6) detection_recall, round(2*(select count(*) from m)/((select count(*) from p)+(select count(*) from g)),6) detection_f1""",
    "tax_inline_rows": "with r as (select distinct l_orderkey, cast(floor(l_tax*100+0.5) as bigint) r, cast(floor(l_extendedprice) as bigint) p from lineitem) select l_orderkey, r::varchar rate, p::varchar taxable, cast(floor(p*r/100e0) as bigint)::varchar tax from r",
}
