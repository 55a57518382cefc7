"""Queries over positioned blocks: candidates, neighbours, columns, islands and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators import layout, ranking, sequential
from docweave.queries.fixtures import BLOCKS_SQL, ROWS_SQL, blocks, evidence_rows

_BOX = ["left_x", "top_y", "right_x", "bottom_y"]


def candidate_rank(spark: SparkSession, folder: str) -> DataFrame:
    rows = blocks(spark, folder)
    return ranking.rank(rows, ["doc_id", "row_ix"], F.desc("role"), F.desc("score"), F.asc("ix")).select("doc_id", "ix", "role", "score", "rank")


def candidate_margin(spark: SparkSession, folder: str) -> DataFrame:
    ranked = ranking.rank(blocks(spark, folder), ["doc_id"], F.desc("role"), F.desc("score"), F.asc("ix"))
    return ranking.margins(ranked, ["doc_id"], "role", "score", 10).select("doc_id", "ix", "role", "score", "margin", "competitor")


def confidence_score(spark: SparkSession, folder: str) -> DataFrame:
    rows = blocks(spark, folder)
    parts = {"evidence": F.col("confidence"), "rank": F.col("score") / 50.0, "role": F.col("role") / 2.0, "place": (F.lit(3) - F.col("col_ix")) / 3.0}
    score = ranking.weighted(parts, {"evidence": 0.4, "rank": 0.3, "role": 0.2, "place": 0.1})
    return rows.select("doc_id", "ix", F.round(score, 6).alias("confidence_score"), ranking.candidate_score(F.col("role") == 2, F.col("col_ix") == 0, F.col("score") > 10, F.col("confidence") < 0.5).alias("heuristic_score"))


def select_cell_v2(spark: SparkSession, folder: str) -> DataFrame:
    rows = blocks(spark, folder).withColumn("s", F.col("score") / 50.0).withColumn("value", F.when(F.col("ix") % 7 != 0, F.col("score") % 5))
    return ranking.select(rows, ["doc_id", "row_ix"], "s", "value", [F.asc("ix")], 0.1)


def prev_block_context(spark: SparkSession, folder: str) -> DataFrame:
    w = layout.window(["doc_id"], ["ix"])
    rows = blocks(spark, folder).withColumn("prev_role", F.lag("role").over(w)).withColumn("prev_text_length", F.lag(F.length("text")).over(w).cast("long"))
    return rows.select("doc_id", "ix", "role", "prev_role", "prev_text_length", F.when((F.col("role") == 0) & (F.col("prev_role") > 0), F.col("prev_role")).alias("context_role"))


def address_islands(spark: SparkSession, folder: str) -> DataFrame:
    rows = blocks(spark, folder).withColumn("address", F.col("ix") % 5 < 3).withColumn("continues", F.col("ix") % 5 > 0)
    w = layout.window(["doc_id"], ["ix"])
    chained = layout.islands(rows, ["doc_id"], ["ix"], ~(F.col("continues") & F.lag("address").over(w)))
    return chained.where("address").groupBy("doc_id", "island").agg(F.min("ix").alias("first_ix"), F.count("*").alias("n_blocks"), F.round(F.avg("confidence"), 6).alias("mean_confidence")).drop("island")


def word_span_merge(spark: SparkSession, folder: str) -> DataFrame:
    rows = blocks(spark, folder)
    w = layout.window(["doc_id", "row_ix"], ["ix"])
    far = F.col("left_x") - F.lag("right_x").over(w) > 50
    merged = layout.islands(rows, ["doc_id", "row_ix"], ["ix"], far)
    return layout.box_union(merged, "doc_id", "row_ix", "island")


def continuation_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = layout.box_union(blocks(spark, folder), "doc_id", "row_ix")
    w = layout.window(["doc_id"], ["row_ix"])
    joined = layout.islands(rows.withColumn("only", F.col("row_ix") % 3 > 0), ["doc_id"], ["row_ix"], ~(F.col("only") & (F.col("top_y") - F.lag("bottom_y").over(w) <= 25)))
    return joined.groupBy("doc_id", "island").agg(F.count("*").alias("n_rows"), F.min("row_ix").alias("first_row"))


def right_neighbor(spark: SparkSession, folder: str) -> DataFrame:
    rows = blocks(spark, folder).select("doc_id", "ix", *_BOX, "row_ix")
    # The rows of the grid are disjoint bands, so the join may stay within a row.
    found = layout.right_neighbor(rows.withColumn("doc_id", F.concat_ws(":", "doc_id", "row_ix")), "doc_id", "ix")
    return found.select(F.split_part("doc_id", F.lit(":"), F.lit(1)).cast("long").alias("doc_id"), "ix", F.col("o_ix").alias("neighbor_ix"), "distance")


def nearest_anchor(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest block of role 0 above each block of role 1."""
    rows = blocks(spark, folder).select("doc_id", "ix", *_BOX, "role")
    anchors = rows.where("role = 0")
    above = (F.col("o_top_y") <= F.col("top_y")) & (F.col("o_ix") != F.col("ix"))
    distance = F.abs(F.col("left_x") - F.col("o_left_x")) + F.abs(F.col("top_y") - F.col("o_top_y"))
    found = layout.nearest(rows.where("role = 1"), anchors, "doc_id", "ix", distance, above, ["o_ix"])
    return found.select("doc_id", "ix", F.col("o_ix").alias("anchor_ix"), "distance")


def _headers(rows: DataFrame) -> DataFrame:
    return rows.where("row_ix = 0").select("doc_id", "ix", *_BOX)


def column_assign_nearest(spark: SparkSession, folder: str) -> DataFrame:
    rows = blocks(spark, folder)
    found = layout.nearest_column(rows.where("row_ix >= 1").select("doc_id", "ix", *_BOX), _headers(rows), "doc_id", "ix")
    return found.select("doc_id", "ix", F.col("o_ix").alias("column_ix"), "distance")


def column_assign_interval(spark: SparkSession, folder: str) -> DataFrame:
    rows = blocks(spark, folder)
    wide = _headers(rows).withColumn("left_x", F.col("left_x") - 15).withColumn("right_x", F.col("right_x") + 15)
    found = layout.contained_column(rows.where("row_ix >= 1").select("doc_id", "ix", *_BOX), wide, "doc_id", "ix")
    return found.select("doc_id", "ix", F.col("o_ix").alias("column_ix"))


def table_rows_pivot(spark: SparkSession, folder: str) -> DataFrame:
    rows = blocks(spark, folder).withColumn("field", F.concat(F.lit("c"), F.col("col_ix").cast("string")))
    return rows.groupBy("doc_id", "row_ix").pivot("field", ["c0", "c1", "c2", "c3"]).agg(F.max("score"))


def bbox_union(spark: SparkSession, folder: str) -> DataFrame:
    return layout.box_union(blocks(spark, folder), "doc_id", "row_ix")


def iou_spatial_join(spark: SparkSession, folder: str) -> DataFrame:
    gold = blocks(spark, folder).select("doc_id", "ix", *_BOX)
    shifted = gold.withColumns({"left_x": F.col("left_x") + 30, "right_x": F.col("right_x") + 30, "top_y": F.col("top_y") + 5, "bottom_y": F.col("bottom_y") + 5})
    return layout.spatial_join(gold, shifted, "doc_id", 40).select("doc_id", "ix", F.col("o_ix").alias("pred_ix"), F.round("iou", 6).alias("iou"))


def evidence_text_join(spark: SparkSession, folder: str) -> DataFrame:
    rows = blocks(spark, folder)
    cited = rows.select("doc_id", (F.col("ix") % 5).alias("cell"), "ix").where("ix % 4 <> 3")
    made = layout.evidence_text(cited, rows, "doc_id", "cell", "ix", "ix", "text")
    return made.select("doc_id", "cell", F.md5("raw_text").alias("raw_md5"), "blocks")


def unknown_evidence_ids(spark: SparkSession, folder: str) -> DataFrame:
    rows = evidence_rows(spark, folder)
    return layout.dangling(rows.select("doc_id", "line", (F.col("part_id") + F.col("supp_id") % 3 * 1000).alias("part_id")), rows, ["doc_id", "part_id"]).distinct()


def _ids(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.xxhash64("line", "part_id", "supp_id").alias("row"), F.array("part_id", F.col("supp_id") + 10_000_000).alias("ids"))


def row_overlap_edges(spark: SparkSession, folder: str) -> DataFrame:
    rows = evidence_rows(spark, folder)
    edges = layout.overlap_edges(_ids(rows.where("line % 2 = 0")), _ids(rows.where("line % 2 = 1")), "doc_id", "row", "ids")
    return edges.groupBy("doc_id").agg(F.count("*").alias("edges"), F.sum("shared").alias("shared"))


def shared_evidence_pairs(spark: SparkSession, folder: str) -> DataFrame:
    rows = _ids(evidence_rows(spark, folder))
    edges = layout.overlap_edges(rows, rows, "doc_id", "row", "ids").where("row_a < row_b")
    return edges.groupBy("doc_id").agg(F.count("*").alias("pairs"))


def bipartite_row_match(spark: SparkSession, folder: str) -> DataFrame:
    rows = blocks(spark, folder)
    gold, shifted = rows.select("doc_id", "ix", *_BOX), rows.select("doc_id", "ix", *_BOX).withColumns({"left_x": F.col("left_x") + 120, "right_x": F.col("right_x") + 120, "top_y": F.col("top_y") + 8, "bottom_y": F.col("bottom_y") + 8})
    edges = layout.spatial_join(gold, shifted, "doc_id", 40).select("doc_id", F.col("ix").alias("row_a"), F.col("o_ix").alias("row_b"), F.round(F.col("iou") * 1000).cast("long").alias("shared"))
    return sequential.match_rows(edges)


def row_cluster_anchor(spark: SparkSession, folder: str) -> DataFrame:
    return sequential.anchored_rows(blocks(spark, folder))


def vertical_chain(spark: SparkSession, folder: str) -> DataFrame:
    return sequential.continuation_chain(blocks(spark, folder))


QUERIES = {f.__name__: f for f in (
    candidate_rank, candidate_margin, confidence_score, select_cell_v2, prev_block_context, address_islands, word_span_merge, continuation_rows, right_neighbor, nearest_anchor, column_assign_nearest,
    column_assign_interval, table_rows_pivot, bbox_union, iou_spatial_join, evidence_text_join, unknown_evidence_ids, row_overlap_edges, shared_evidence_pairs, bipartite_row_match, row_cluster_anchor, vertical_chain,
)}

_W = f"with {BLOCKS_SQL}"
_IDS = f"with {ROWS_SQL}, ids as (select doc_id, hash(line, part_id, supp_id) row_, line, unnest([part_id, supp_id+10000000]) id from rows_)"
SQL = {
    "candidate_rank": f'{_W} select doc_id, ix, "role", score, row_number() over (partition by doc_id, row_ix order by "role" desc, score desc, ix) "rank" from blocks',
    "candidate_margin": f"""{_W}, r as (select *, row_number() over (partition by doc_id order by "role" desc, score desc, ix) n from blocks), b as (select * from r where n=1)
 select b.doc_id, b.ix, b."role", b.score, b.score-o.m margin, coalesce(b.score-o.m<10,false) competitor from b left join (select r.doc_id, max(r.score) m from r join b on r.doc_id=b.doc_id and r."role"=b."role" and r.n>1 group by 1) o on o.doc_id=b.doc_id""",
    "confidence_score": f"""{_W} select doc_id, ix, round(greatest(0e0,least(1e0,confidence::double*0.4e0+score/50e0*0.3e0+"role"/2e0*0.2e0+(3-col_ix)/3e0*0.1e0)),6) confidence_score,
 round(greatest(0e0,0.35e0+case when "role"=2 then 0.25e0 else 0e0 end+case when col_ix=0 then 0.2e0 else 0e0 end+case when score>10 then 0.15e0 else 0e0 end-case when confidence<0.5 then 0.2e0 else 0e0 end),4) heuristic_score from blocks""",
    "select_cell_v2": f"""{_W}, c as (select doc_id, row_ix, ix, score/50.0 s, case when ix%7<>0 then score%5 end v, row_number() over (partition by doc_id, row_ix order by score desc, ix) n from blocks),
 b as (select doc_id, row_ix, s bs, v bv from c where n=1), j as (select doc_id, row_ix, count(*) candidates, count(*) filter (where n>1 and bs-s<=0.1 and v is distinct from bv) rivals, any_value(bs) best_score, max(bv) best_value from c join b using (doc_id,row_ix) group by 1,2)
 select *, case when rivals>0 then 'AMBIGUOUS' when best_value is null then 'UNKNOWN' else 'PRESENT' end status from j""",
    "prev_block_context": f"""{_W}, l as (select doc_id, ix, "role", lag("role") over w prev_role, lag(length("text")) over w prev_text_length from blocks window w as (partition by doc_id order by ix))
 select *, case when "role"=0 and prev_role>0 then prev_role end context_role from l""",
    "address_islands": f"""{_W}, l as (select doc_id, ix, confidence, ix%5<3 address, case when ix%5>0 and coalesce(lag(ix%5<3) over (partition by doc_id order by ix),false) then 0 else 1 end s from blocks),
 i as (select *, sum(s) over (partition by doc_id order by ix) island from l) select doc_id, min(ix) first_ix, count(*) n_blocks, round(avg(confidence),6) mean_confidence from i where address group by doc_id, island""",
    "word_span_merge": f"""{_W}, l as (select *, case when left_x-lag(right_x) over (partition by doc_id,row_ix order by ix)<=50 then 0 else 1 end s from blocks), i as (select *, sum(s) over (partition by doc_id,row_ix order by ix) island from l)
 select doc_id, row_ix, cast(island as bigint) island, min(left_x) left_x, min(top_y) top_y, max(right_x) right_x, max(bottom_y) bottom_y, count(*) boxes from i group by 1,2,3""",
    "continuation_rows": f"""{_W}, r as (select doc_id, row_ix, min(top_y) t, max(bottom_y) b from blocks group by 1,2), l as (select *, case when row_ix%3>0 and t-lag(b) over (partition by doc_id order by row_ix)<=25 then 0 else 1 end s from r),
 i as (select *, sum(s) over (partition by doc_id order by row_ix) island from l) select doc_id, cast(island as bigint) island, count(*) n_rows, min(row_ix) first_row from i group by 1,2""",
    "right_neighbor": f"""{_W}, j as (select a.doc_id, a.ix, b.ix neighbor_ix, b.left_x-a.right_x distance, row_number() over (partition by a.doc_id,a.ix order by b.left_x-a.right_x, b.ix) n from blocks a join blocks b on a.doc_id=b.doc_id and a.row_ix=b.row_ix and a.ix<>b.ix
 and least(a.bottom_y,b.bottom_y)-greatest(a.top_y,b.top_y)>=0.35*least(a.bottom_y-a.top_y,b.bottom_y-b.top_y) and b.left_x>=a.right_x) select doc_id, ix, neighbor_ix, distance from j where n=1""",
    "nearest_anchor": f"""{_W}, j as (select a.doc_id, a.ix, b.ix anchor_ix, abs(a.left_x-b.left_x)+abs(a.top_y-b.top_y) distance, row_number() over (partition by a.doc_id,a.ix order by abs(a.left_x-b.left_x)+abs(a.top_y-b.top_y), b.ix) n
 from blocks a join blocks b on a.doc_id=b.doc_id and a."role"=1 and b."role"=0 and b.top_y<=a.top_y) select doc_id, ix, anchor_ix, distance from j where n=1""",
    "column_assign_nearest": f"""{_W}, j as (select a.doc_id, a.ix, h.ix column_ix, least(abs(a.left_x-h.left_x),abs((a.left_x+a.right_x)/2.0-(h.left_x+h.right_x)/2.0)) distance, h.left_x hl from blocks a join blocks h on a.doc_id=h.doc_id and h.row_ix=0 and a.row_ix>=1),
 k as (select *, row_number() over (partition by doc_id,ix order by distance, hl, column_ix) n from j) select doc_id, ix, column_ix, distance from k where n=1""",
    "column_assign_interval": f"""{_W}, j as (select a.doc_id, a.ix, h.ix column_ix, count(*) over (partition by a.doc_id,a.ix) n from blocks a join blocks h on a.doc_id=h.doc_id and h.row_ix=0 and a.row_ix>=1 and a.left_x>=h.left_x-15 and a.right_x<=h.right_x+15)
 select doc_id, ix, column_ix from j where n=1""",
    "table_rows_pivot": f"{_W} select doc_id, row_ix, max(score) filter (where col_ix=0) c0, max(score) filter (where col_ix=1) c1, max(score) filter (where col_ix=2) c2, max(score) filter (where col_ix=3) c3 from blocks group by 1,2",
    "bbox_union": f"{_W} select doc_id, row_ix, min(left_x) left_x, min(top_y) top_y, max(right_x) right_x, max(bottom_y) bottom_y, count(*) boxes from blocks group by 1,2",
    "iou_spatial_join": f"""{_W}, j as (select a.doc_id, a.ix, b.ix pred_ix, greatest(least(a.right_x,b.right_x+30)-greatest(a.left_x,b.left_x+30),0)*greatest(least(a.bottom_y,b.bottom_y+5)-greatest(a.top_y,b.top_y+5),0) s from blocks a join blocks b on a.doc_id=b.doc_id and abs(a.row_ix-b.row_ix)<=2)
 select doc_id, ix, pred_ix, round(s/(2*200*14-s),6) iou from j where s>0""",
    "evidence_text_join": f"""{_W} select doc_id, ix%5 cell, md5(string_agg("text", chr(10) order by ix)) raw_md5, count(*) blocks from blocks where ix%4<>3 group by 1,2""",
    "unknown_evidence_ids": f"with {ROWS_SQL}, c as (select distinct doc_id, line, part_id+supp_id%3*1000 part_id from rows_) select * from c where not exists (select 1 from rows_ r where r.doc_id=c.doc_id and r.part_id=c.part_id)",
    "row_overlap_edges": f"{_IDS}, e as (select a.doc_id, a.row_ ra, b.row_ rb, count(*) shared from ids a join ids b on a.doc_id=b.doc_id and a.id=b.id and a.line%2=0 and b.line%2=1 group by all) select doc_id, count(*) edges, cast(sum(shared) as bigint) shared from e group by 1",
    "shared_evidence_pairs": f"{_IDS}, e as (select distinct a.doc_id, a.row_ ra, b.row_ rb from ids a join ids b on a.doc_id=b.doc_id and a.id=b.id and a.row_<b.row_) select doc_id, count(*) pairs from e group by 1",
}
