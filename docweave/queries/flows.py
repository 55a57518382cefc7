"""Whole plans: extraction from evidence payloads, and streams replayed from the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.text import collapse
from docweave.operators import metrics
from docweave.plans import extract as plan
from docweave.plans import receipts
from docweave.queries import p6
from docweave.queries.fixtures import EVENTS_SQL
from docweave.session import cut
from docweave.sources import evidence
from docweave.sources.tables import table
from docweave.streaming import jobs

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def evidence_blocks(spark: SparkSession, folder: str) -> DataFrame:
    runs = table(spark, folder, "machine_runs").where("kind = 'ocr'")
    return evidence.flatten(runs.select("run_id", "payload"))


def extract_cells(spark: SparkSession, folder: str) -> DataFrame:
    return plan.extract(cut(evidence_blocks(spark, folder))).withColumns({c: F.array_join(c, "|") for c in ("review_reasons", "block_ids")})


def extract_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """Cells by interval columns, with nearest columns as the fallback."""
    made = plan.extract(cut(evidence_blocks(spark, folder)), grouping="interval")
    return made.withColumns({c: F.array_join(c, "|") for c in ("review_reasons", "block_ids")})


def extract_completed(spark: SparkSession, folder: str) -> DataFrame:
    """Every header field of every document and every field of every item, unknown where nothing was found."""
    blocks = cut(evidence_blocks(spark, folder))
    made = plan.completed(plan.extract(blocks), blocks)
    return made.withColumns({c: F.array_join(c, "|") for c in ("review_reasons", "block_ids")})


def extract_consistency(spark: SparkSession, folder: str) -> DataFrame:
    return plan.consistency(plan.extract(cut(evidence_blocks(spark, folder))))


def extract_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """Extracted header values against the results delivered for the same runs, by field."""
    ours = plan.extract(cut(evidence_blocks(spark, folder))).where("section = 'header'").select(F.col("run_id").alias("sample_id"), "field", F.col("value_status").alias("ps"), F.col("predicted_value").alias("pv"), F.lit(False).alias("reviewed"))
    return _agreement(spark, folder, ours)


def _agreement(spark: SparkSession, folder: str, ours: DataFrame) -> DataFrame:
    given = p6.cells(spark, folder).where("section = 'header' and value_status is not null")
    text = F.from_json(F.concat(F.lit('{"t":'), "predicted_value", F.lit("}")), "t string")["t"]
    gold = given.groupBy(F.col("source_ocr_run_id").alias("sample_id"), "field").agg(F.min(F.regexp_replace("value_status", '"', "")).alias("gs"), F.min(collapse(text)).alias("gv"))
    return metrics.header_metrics(metrics.with_failures(gold, ours), ["field"]).select("field", "total", "scored", "gold_present", "predicted_present", "true_positive", "precision", "recall", "f1")


def extract_receipts(spark: SparkSession, folder: str) -> DataFrame:
    """First-generation fields of every evidence run."""
    made = receipts.extract(cut(evidence_blocks(spark, folder)))
    return made.withColumns({c: F.array_join(c, "|") for c in ("review_reasons", "block_ids")})


def receipt_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """How many candidates of each kind there are for each first-generation field, and their mean score."""
    made = receipts.candidates(cut(evidence_blocks(spark, folder)))
    return made.groupBy("field", "kind").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


def receipt_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """First-generation values against the results delivered for the same runs, by field."""
    found = receipts.extract(cut(evidence_blocks(spark, folder)))
    ours = found.select(F.col("run_id").alias("sample_id"), "field", F.col("value_status").alias("ps"), F.col("predicted_value").alias("pv"), F.col("machine_needs_review").alias("reviewed"))
    return _agreement(spark, folder, ours).where(F.col("field").isin(receipts.FIELDS))


def telemetry_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Active and paused time by user from a stream; the last update of each user holds."""
    events = jobs.source(spark, f"{folder}/events.parquet", EVENTS).where("event_type in ('view', 'click', 'purchase')").select("event_id", "user_id", "event_type", F.unix_micros("at").alias("us"))
    updates = jobs.run_once(jobs.active_time(events, "user_id", {"view": 1, "click": -1}), "update")
    return updates.groupBy("user_id").agg(F.max_by("active", "batch").alias("active"), F.max_by("paused", "batch").alias("paused"))


def window_counts_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly counts by event type from a stream without repeated deliveries, for the windows the watermark has passed."""
    events = jobs.first_deliveries(jobs.source(spark, f"{folder}/events.parquet", EVENTS), "event_id", "1 hour")
    made = jobs.run_once(events.groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.unix_micros("w.start").alias("start_us"), "event_type", "n"))
    return made


QUERIES = {f.__name__: f for f in (evidence_blocks, extract_cells, extract_intervals, extract_completed, extract_consistency, extract_agreement, extract_receipts, receipt_candidates, receipt_agreement, telemetry_stream, window_counts_stream)}
_C = "case event_type when 'view' then 1 when 'click' then -1 else 0 end"
SQL = {
    "telemetry_stream": f"""with {EVENTS_SQL}, c as (select *, {_C} ch from ev where event_type in ('view','click','purchase')), s as (select *, sum(ch) over w d, lead(us) over w-us span from c window w as (partition by user_id order by us, event_id)),
 m as (select *, d-least(0,min(d) over (partition by user_id order by us, event_id rows unbounded preceding)) lv from s) select user_id, cast(coalesce(sum(span) filter (where lv<=0),0) as bigint) active, cast(coalesce(sum(span) filter (where lv>0),0) as bigint) paused from m group by 1""",
    "window_counts_stream": """with w as (select time_bucket(interval 1 hour, ts) b, event_type, count(distinct event_id) n from events group by 1,2)
 select epoch_us(b) start_us, event_type, n from w where b + interval 1 hour <= (select max(ts) from events) - interval 1 hour""",
}
