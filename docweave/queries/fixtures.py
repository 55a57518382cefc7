"""Deterministic views of the plain tables in the shape the evaluation and layout operators take.

Each view exists twice: as a DataFrame and as SQL.  Integer arithmetic keeps them equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.sources.tables import table


def pairs(spark: SparkSession, folder: str, wrong: int = 17) -> DataFrame:
    """Gold and predicted cells: three fields for each order.

    ``sample_id``, ``ix``, ``field``, statuses ``gs`` and ``ps``, values ``gv`` and ``pv``,
    ``reviewed``, and ``input_type`` and ``template_id`` to slice by.
    """
    orders = table(spark, folder, "orders")
    parts = [("status", F.col("o_orderstatus")), ("priority", F.col("o_orderpriority")), ("customer", F.col("o_custkey").cast("string"))]
    fields = F.explode(F.array(*[F.struct(F.lit(i).alias("ix"), F.lit(name).alias("field"), col.alias("v")) for i, (name, col) in enumerate(parts)]))
    rows = orders.select(F.col("o_orderkey").alias("sample_id"), F.col("o_orderstatus").alias("input_type"), F.col("o_orderpriority").alias("template_id"), fields.alias("c")).select("*", "c.*").drop("c")
    gold = (F.col("sample_id") * 7 + F.col("ix") * 3) % 11
    pred = (F.col("sample_id") * 5 + F.col("ix")) % 13
    rows = rows.withColumn("gs", F.when(gold == 0, "UNKNOWN").when(gold == 1, "NOT_PRESENT").when(gold == 2, "AMBIGUOUS").otherwise("PRESENT"))
    rows = rows.withColumn("ps", F.when(pred == 0, "UNKNOWN").when(pred == 1, "AMBIGUOUS").when(pred == 2, "NOT_PRESENT").otherwise("PRESENT"))
    value = F.when((F.col("sample_id") + F.col("ix")) % wrong == 0, "WRONG").otherwise(F.col("v"))
    rows = rows.withColumn("gv", F.when(F.col("gs") == "PRESENT", F.col("v"))).withColumn("pv", F.when(F.col("ps") == "PRESENT", value))
    return rows.withColumn("reviewed", (F.col("sample_id") + F.col("ix")) % 5 == 0).drop("v")


def pairs_sql(name: str = "pairs", wrong: int = 17) -> str:
    """The CTEs of :func:`pairs`, ending in one called ``name``."""
    return f"""
{name}_b as (select o_orderkey sample_id, o_orderstatus input_type, o_orderpriority template_id, 0 ix, 'status' field, o_orderstatus v from orders
 union all select o_orderkey, o_orderstatus, o_orderpriority, 1, 'priority', o_orderpriority from orders
 union all select o_orderkey, o_orderstatus, o_orderpriority, 2, 'customer', cast(o_custkey as varchar) from orders),
{name}_s as (select *, case (sample_id*7+ix*3)%11 when 0 then 'UNKNOWN' when 1 then 'NOT_PRESENT' when 2 then 'AMBIGUOUS' else 'PRESENT' end gs,
 case (sample_id*5+ix)%13 when 0 then 'UNKNOWN' when 1 then 'AMBIGUOUS' when 2 then 'NOT_PRESENT' else 'PRESENT' end ps from {name}_b),
{name} as (select sample_id, ix, field, input_type, template_id, gs, ps, case when gs='PRESENT' then v end gv,
 case when ps='PRESENT' then case when (sample_id+ix)%{wrong}=0 then 'WRONG' else v end end pv, (sample_id+ix)%5=0 reviewed from {name}_s)"""


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Positioned text blocks: the lines of each document on a grid of four columns."""
    lines = table(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ix", "text"))
    return place(lines)


def place(lines: DataFrame) -> DataFrame:
    """Geometry, confidence, role and score for ``doc_id``, ``ix``, ``text``."""
    ix, doc = F.col("ix"), F.col("doc_id")
    left = (ix % 4) * 250 + 10 * ((doc + ix) % 3)
    top = F.floor(ix / 4) * 20 + ix % 3
    return lines.select(
        "doc_id", F.col("ix").cast("long").alias("ix"), "text", (((doc * 31 + ix * 17) % 100) / 100.0).alias("confidence"),
        left.cast("long").alias("left_x"), top.cast("long").alias("top_y"), (left + 200).cast("long").alias("right_x"), (top + 14).cast("long").alias("bottom_y"),
        (ix % 3).cast("long").alias("role"), ((doc * 13 + ix * 29) % 50).cast("long").alias("score"), (F.floor(ix / 4)).cast("long").alias("row_ix"), (ix % 4).cast("long").alias("col_ix"),
    )


BLOCKS_SQL = """
lines as (select doc_id, unnest(range(0, len(string_split(text, chr(10))))) ix, unnest(string_split(text, chr(10))) "text" from documents where text is not null),
blocks as (select doc_id, ix, "text", ((doc_id*31+ix*17)%100)/100.0 confidence, (ix%4)*250+10*((doc_id+ix)%3) left_x, (ix//4)*20+ix%3 top_y,
 (ix%4)*250+10*((doc_id+ix)%3)+200 right_x, (ix//4)*20+ix%3+14 bottom_y, ix%3 "role", (doc_id*13+ix*29)%50 score, ix//4 row_ix, ix%4 col_ix from lines)"""


def evidence_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows with evidence ids: one for each different line item, its ids the part and the supplier."""
    item = table(spark, folder, "lineitem")
    return item.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("line"), F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("supp_id")).distinct()


ROWS_SQL = "rows_ as (select distinct l_orderkey doc_id, cast(l_linenumber as bigint) line, l_partkey part_id, l_suppkey supp_id from lineitem)"


def event_log(spark: SparkSession, folder: str) -> DataFrame:
    """``event_id``, ``us`` (microseconds), ``user_id``, ``event_type``, ``value`` of the events table."""
    return table(spark, folder, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "user_id", "event_type", "value")


EVENTS_SQL = "ev as (select event_id, epoch_us(ts) us, user_id, event_type, \"value\" from events)"


def div(a: Column, b: Column) -> Column:
    """Ratio rounded to six digits, null on a zero denominator."""
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), 6)
