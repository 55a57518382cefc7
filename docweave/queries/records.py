"""Queries over logs, lists, registries and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.text import fold
from docweave.operators import governance, sequential, store
from docweave.queries.fixtures import BLOCKS_SQL, EVENTS_SQL, blocks, event_log, pairs, pairs_sql
from docweave.sources.tables import table

LEGAL = [("signup", "view"), ("view", "click"), ("click", "purchase"), ("click", "view"), ("view", "error"), ("error", "view")]


def _clicks(spark: SparkSession, folder: str) -> DataFrame:
    """The last click of each user, as a correction of that user's first order."""
    clicks = event_log(spark, folder).where("event_type = 'click'")
    last = store.latest(clicks, ["user_id"], "us", "event_id")
    return last.select(F.col("user_id").alias("sample_id"), F.lit("status").alias("field"), F.when(F.col("event_id") % 10 != 0, F.col("value").cast("decimal(18,4)").cast("string")).alias("corrected"))


def effective_overlay(spark: SparkSession, folder: str) -> DataFrame:
    cells = pairs(spark, folder).select("sample_id", "field", "pv")
    return store.overlay(cells, _clicks(spark, folder), ["sample_id", "field"], "pv", "corrected").select("sample_id", "field", "effective", "reviewed")


def latest_event(spark: SparkSession, folder: str) -> DataFrame:
    return store.latest(event_log(spark, folder).select("user_id", "us", "event_id", "event_type"), ["user_id"], "us", "event_id")


def complete_groups(spark: SparkSession, folder: str) -> DataFrame:
    cells = pairs(spark, folder).where("not (sample_id % 9 = 0 and ix = 2)")
    return store.complete_groups(cells, ["sample_id"], "field", ["status", "priority", "customer"], (F.col("ps") == "UNKNOWN") & ~F.col("reviewed"))


def unexpected_transitions(spark: SparkSession, folder: str) -> DataFrame:
    found = store.transitions(event_log(spark, folder), "user_id", ["us", "event_id"], "event_type", LEGAL)
    return found.groupBy(F.col("before"), F.col("event_type").alias("after")).agg(F.count("*").alias("n"))


def cas_fold(spark: SparkSession, folder: str) -> DataFrame:
    events = event_log(spark, folder).withColumn("expected", F.col("event_id") % 4)
    return sequential.compare_and_set(events, "user_id", "event_id", "expected")


def pending_messages(spark: SparkSession, folder: str) -> DataFrame:
    """The hundred oldest messages that were not followed by an answer within a minute."""
    log = event_log(spark, folder)
    sent = log.where("event_type = 'view'").select("event_id", "user_id", "us")
    answers = log.where("event_type = 'click'").select(F.col("user_id").alias("u"), F.col("us").alias("answered"))
    open_ = sent.join(answers, (F.col("user_id") == F.col("u")) & F.col("answered").between(F.col("us"), F.col("us") + 60_000_000), "left_anti")
    return open_.orderBy("us", "event_id").limit(100)


def list_page(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"))
    return store.page(orders, [F.desc("us"), F.asc("o_orderkey")], 50, 100)


def page_envelope(spark: SparkSession, folder: str) -> DataFrame:
    return store.envelope(table(spark, folder, "orders"), 20)


def status_tabs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").agg(F.count("*").alias("all_"), *[F.count_if(F.col("o_orderstatus") == s).alias(f"n_{s.lower()}") for s in "FOP"], F.count_if(F.col("o_orderstatus").isin("O", "P")).alias("in_progress"))


def recent_window(spark: SparkSession, folder: str) -> DataFrame:
    return store.recent(table(spark, folder, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", 7).select("o_orderkey")


def search_filter(spark: SparkSession, folder: str) -> DataFrame:
    headers = table(spark, folder, "invoice_headers").select("receipt_id", "seller_name").distinct()
    return headers.where(F.contains(fold(F.col("seller_name")), F.lit("dien may")))


def sort_null_total(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "invoice_headers").select("receipt_id", "total_amount", "updated_at")
    last = store.latest(rows.withColumn("t", F.coalesce("total_amount", F.lit(-1))), ["receipt_id"], "updated_at", "t")
    return last.orderBy(F.desc("t"), "receipt_id").select("receipt_id", F.col("t").alias("total"))


def audit_history(spark: SparkSession, folder: str) -> DataFrame:
    """The whole history of each user, oldest first."""
    return event_log(spark, folder).select("user_id", "event_id", "us", "event_type").orderBy("user_id", "us", "event_id")


def telemetry_active_time(spark: SparkSession, folder: str) -> DataFrame:
    log = event_log(spark, folder).where("event_type in ('view', 'click', 'purchase')")
    change = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", -1).otherwise(0)
    return store.active_time(log, "user_id", "us", change)


def split_leakage(spark: SparkSession, folder: str) -> DataFrame:
    registry = table(spark, folder, "documents").select(F.sha2("text", 256).alias("source_hash"), "batch_id", F.when(F.col("doc_id") % 5 == 0, "validation").otherwise("train").alias("split"))
    return governance.leakage(registry, ["source_hash", "batch_id"], "split")


def dedup_by_hash(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"))
    return governance.first_by(docs, F.col("digest"), "doc_id")


def stratified_exclusive_topk(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "n_chars", F.size(F.split("text", "\n")).alias("n_lines"), F.length(F.regexp_replace("text", r"[^0-9]", "")).alias("n_digits"))
    return governance.exclusive_top(docs, "doc_id", [("long", [F.desc("n_chars")]), ("many_lines", [F.desc("n_lines")]), ("digits", [F.desc("n_digits")])], 16)


def manifest_set_ops(spark: SparkSession, folder: str) -> DataFrame:
    return governance.set_sizes(table(spark, folder, "orders").select("o_orderkey"), table(spark, folder, "lineitem").select("l_orderkey"))


def line_sum_vs_total(spark: SparkSession, folder: str) -> DataFrame:
    """Sum of line amounts against the total in cents: PASS, WARNING, or SKIPPED where a line is missing."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.when(F.col("l_quantity") <= 49, cents)).alias("known"), F.bool_and(F.col("l_quantity") <= 49).alias("whole"))
    orders = table(spark, folder, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("total"))
    joined = orders.join(lines, "o_orderkey", "left").withColumn("line_sum", F.when(F.col("whole"), F.col("known")))
    difference = F.col("line_sum") - F.col("total")
    return joined.select("o_orderkey", "total", "line_sum", difference.alias("difference"), F.when(difference.isNull(), "SKIPPED").when(F.abs(difference) <= 1, "PASS").otherwise("WARNING").alias("status"))


def schema_violations(spark: SparkSession, folder: str) -> DataFrame:
    rows = blocks(spark, folder).withColumn("right_x", F.when(F.col("ix") % 31 == 30, F.col("left_x")).otherwise(F.col("right_x"))).withColumn("confidence", F.when(F.col("ix") % 37 == 36, F.col("confidence") + 1).otherwise(F.col("confidence")))
    rules = {"degenerate_box": F.col("right_x") <= F.col("left_x"), "confidence_range": ~F.col("confidence").between(0, 1), "empty_text": F.trim("text") == "", "too_long": F.length("text") > 500}
    return governance.violations(rows, ["doc_id", "ix"], rules)


def order_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return governance.contiguous(blocks(spark, folder).where("ix % 50 <> 49"), "doc_id", "ix")


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of a user's events, a new one after 30 minutes of silence."""
    from docweave.operators.layout import islands, window

    log = event_log(spark, folder)
    gap = F.col("us") - F.lag("us").over(window(["user_id"], ["us", "event_id"])) > 1_800_000_000
    made = islands(log, ["user_id"], ["us", "event_id"], gap)
    return made.groupBy("user_id", "island").agg(F.count("*").alias("events"), (F.max("us") - F.min("us")).alias("duration_us"))


QUERIES = {f.__name__: f for f in (
    effective_overlay, latest_event, complete_groups, unexpected_transitions, cas_fold, pending_messages, list_page, page_envelope, status_tabs, recent_window, search_filter, sort_null_total, audit_history,
    telemetry_active_time, split_leakage, dedup_by_hash, stratified_exclusive_topk, manifest_set_ops, line_sum_vs_total, schema_violations, order_gaps, sessions,
)}

_E = f"with {EVENTS_SQL}"
_LEGAL = ",".join(f"'{a}>{b}'" for a, b in LEGAL)
SQL = {
    "effective_overlay": f"""with {pairs_sql()}, {EVENTS_SQL}, c as (select user_id sample_id, case when arg_max(event_id, (us,event_id))%10<>0 then cast(cast(arg_max("value", (us,event_id)) as decimal(18,4)) as varchar) end corrected from ev where event_type='click' group by 1)
 select p.sample_id, p.field, case when c.sample_id is not null then c.corrected else pv end effective, c.sample_id is not null reviewed from pairs p left join c on c.sample_id=p.sample_id and p.field='status'""",
    "latest_event": f"{_E} select user_id, max(us) us, arg_max(event_id, (us,event_id)) event_id, arg_max(event_type, (us,event_id)) event_type from ev group by 1",
    "complete_groups": f"""with {pairs_sql()} select sample_id, 3-count(distinct field) missing, count(*) filter (where ps='UNKNOWN' and not reviewed) "open", count(distinct field)=3 and count(*) filter (where ps='UNKNOWN' and not reviewed)=0 complete from pairs where not (sample_id%9=0 and ix=2) group by 1""",
    "unexpected_transitions": f"""{_E}, s as (select event_type, lag(event_type) over (partition by user_id order by us, event_id) before from ev) select before, event_type "after", count(*) n from s where before is not null and before<>event_type and before||'>'||event_type not in ({_LEGAL}) group by 1,2""",
    "pending_messages": f"{_E} select event_id, user_id, us from ev e where event_type='view' and not exists (select 1 from ev a where a.event_type='click' and a.user_id=e.user_id and a.us between e.us and e.us+60000000) order by us, event_id limit 100",
    "list_page": "select o_orderkey, o_custkey, epoch_us(o_orderdate) us from orders order by us desc, o_orderkey limit 50 offset 100",
    "page_envelope": "select count(*) total_items, cast(ceil(count(*)/20.0) as bigint) total_pages from orders",
    "status_tabs": "select count(*) all_, count(*) filter (where o_orderstatus='F') n_f, count(*) filter (where o_orderstatus='O') n_o, count(*) filter (where o_orderstatus='P') n_p, count(*) filter (where o_orderstatus in ('O','P')) in_progress from orders",
    "recent_window": "select o_orderkey from orders where o_orderdate >= (select max(o_orderdate) from orders) - interval 7 days",
    "search_filter": "select distinct receipt_id, seller_name from invoice_headers where contains(replace(strip_accents(lower(trim(regexp_replace(seller_name,'\\s+',' ','g')))),'đ','d'), 'dien may')",
    "sort_null_total": "with l as (select receipt_id, arg_max(coalesce(total_amount,-1), (updated_at, coalesce(total_amount,-1))) total from invoice_headers where receipt_id is not null group by 1) select receipt_id, total from l order by total desc, receipt_id",
    "audit_history": f"{_E} select user_id, event_id, us, event_type from ev order by user_id, us, event_id",
    "telemetry_active_time": f"""{_E}, c as (select *, case event_type when 'view' then 1 when 'click' then -1 else 0 end ch from ev where event_type in ('view','click','purchase')), s as (select *, sum(ch) over w d, lead(us) over w-us span from c window w as (partition by user_id order by us, event_id)),
 m as (select *, d-least(0,min(d) over (partition by user_id order by us, event_id rows unbounded preceding)) lv from s) select user_id, cast(coalesce(sum(span) filter (where lv<=0),0) as bigint) active, cast(coalesce(sum(span) filter (where lv>0),0) as bigint) paused, count(*) events from m group by 1""",
    "split_leakage": """with r as (select sha256(text) source_hash, batch_id, case when doc_id%5=0 then 'validation' else 'train' end split from documents), l as (select 'source_hash' key_name, source_hash key, split from r union all select 'batch_id', batch_id, split from r)
 select key_name, key, count(distinct split) splits, count(*) records from l where key is not null group by 1,2 having count(distinct split)>1""",
    "dedup_by_hash": "select min(doc_id) doc_id, sha256(text) digest, count(*) copies from documents where text is not null group by 2",
    "stratified_exclusive_topk": r"""with d as (select doc_id, n_chars, len(string_split(text, chr(10))) n_lines, length(regexp_replace(text,'[^0-9]','','g')) n_digits from documents), a as (select doc_id, 'long' stratum from d order by n_chars desc nulls last, doc_id limit 16),
 b as (select doc_id, 'many_lines' stratum from d where doc_id not in (select doc_id from a) order by n_lines desc nulls last, doc_id limit 16), c as (select doc_id, 'digits' stratum from d where doc_id not in (select doc_id from a) and doc_id not in (select doc_id from b) order by n_digits desc nulls last, doc_id limit 16)
 select * from a union all select * from b union all select * from c""",
    "manifest_set_ops": "with a as (select distinct o_orderkey k from orders), b as (select distinct l_orderkey k from lineitem) select count(*) filter (where b.k is null) only_a, count(*) filter (where a.k is null) only_b, count(*) filter (where a.k is not null and b.k is not null) \"both\", count(*) either from a full join b on a.k=b.k",
    "line_sum_vs_total": """with l as (select l_orderkey o_orderkey, sum(cast(round(l_extendedprice*100) as bigint)) filter (where l_quantity<=49) known, bool_and(l_quantity<=49) whole from lineitem group by 1),
 j as (select o.o_orderkey, cast(round(o_totalprice*100) as bigint) total, cast(case when whole then known end as bigint) line_sum from orders o left join l using (o_orderkey))
 select o_orderkey, total, line_sum, line_sum-total difference, case when line_sum is null then 'SKIPPED' when abs(line_sum-total)<=1 then 'PASS' else 'WARNING' end status from j""",
    "schema_violations": f"""with {BLOCKS_SQL} select doc_id, ix, 'degenerate_box' rule from blocks where ix%31=30 union all select doc_id, ix, 'confidence_range' from blocks where case when ix%37=36 then confidence+1 else confidence end not between 0 and 1
 union all select doc_id, ix, 'empty_text' from blocks where trim("text")='' union all select doc_id, ix, 'too_long' from blocks where length("text")>500""",
    "order_gaps": f"with {BLOCKS_SQL} select doc_id, count(*) n, count(distinct ix) different from blocks where ix%50<>49 group by 1 having min(ix)<>0 or max(ix)<>count(*)-1 or count(distinct ix)<>count(*)",
    "sessions": f"""{_E}, s as (select *, case when us-lag(us) over w<=1800000000 then 0 else 1 end n from ev window w as (partition by user_id order by us, event_id)), i as (select *, sum(n) over (partition by user_id order by us, event_id) island from s)
 select user_id, cast(island as bigint) island, count(*) events, max(us)-min(us) duration_us from i group by 1,2""",
}
