"""Problem 6: flat tables of blocks, cells and citations from ``machine_runs.payload``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators import shred
from docweave.session import cut, spread
from docweave.sources.tables import table

#: Names of the parts of a result payload that hold lines and tax groups.
SECTIONS = {"line_items": "line", "tax_breakdown": "tax", "fields": "header"}


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs with their payload parsed, once for all tables."""
    rows = table(spark, folder, "machine_runs").where(F.col("kind").isin("ocr", "kie")).select("run_id", "kind", "payload")
    return cut(shred.documents(spread(rows), "payload"))


def _of(runs: DataFrame, kind: str) -> DataFrame:
    return runs.where(F.col("kind") == kind).select("run_id", "payload")


def _section() -> F.Column:
    """The section a node stands in, by the nearest of its steps that names one."""
    named = F.filter("steps", lambda s: s.isin(*SECTIONS))
    part = F.try_element_at(named, F.lit(1))
    return F.create_map(*[F.lit(x) for pair in SECTIONS.items() for x in pair])[part]


def _row_id() -> F.Column:
    """``line_id`` or else the position for lines, the position for tax groups, empty for header."""
    at = F.array_position("steps", F.when(F.col("section") == "line", "line_items").otherwise("tax_breakdown"))
    position = F.try_element_at("steps", (at + 1).cast("int"))
    return F.when(F.col("section") == "header", "").when(F.col("section") == "line", F.coalesce("line_id", position)).otherwise(position)


def _table_of(graph: shred.SchemaGraph, member: str, values: bool = False) -> list[str]:
    """Tables that hold ``member``: inlined, or as their own value table."""
    if values:
        return [n for n in graph.relations if n == f"{member}_values"]
    return [n for n, r in graph.relations.items() if member in r.columns and not r.values]


def _all(df: DataFrame, graph: shred.SchemaGraph, names: list[str], inherit: list[str], *columns: str) -> DataFrame:
    made = None
    for name in names:
        rows = shred.populate(df, graph, name, "run_id", "payload", inherit)
        rows = rows.withColumns({c: F.lit(None).cast("string") for c in columns if c not in rows.columns}).select("record", "steps", "node_id", "parent_id", *inherit, *columns)
        made = rows if made is None else made.unionByName(rows)
    if made is None:
        fields = ", ".join(f"`{c}` string" for c in (*inherit, *columns))
        made = df.sparkSession.createDataFrame([], f"record string, steps array<string>, node_id string, parent_id string, {fields}")
    return made


def blocks_of(runs: DataFrame) -> DataFrame:
    """One row for each block of an evidence run: ``ocr_run_id``, ``page_index``, ``block_id`` and its text.

    The page is the payload's ``page_index``, else the page's position, 0 without pages;
    repeated deliveries of a run give their blocks once, each whole (the smallest by text,
    confidence and order where deliveries differ).
    """
    runs = _of(runs, "ocr")
    graph = shred.infer(runs, "payload")
    found = _all(runs, graph, _table_of(graph, "block_id"), ["ocr_run_id", "page_index", "block_id"], "text", "confidence", "reading_order")
    position = F.try_element_at("steps", (F.array_position("steps", "pages") + 1).cast("int"))
    paged = F.array_contains("steps", "pages")
    page = F.when(paged, F.coalesce(F.expr("try_cast(page_index as int)"), position.cast("int"))).otherwise(0)
    text = F.from_json(F.concat(F.lit('{"t":'), "text", F.lit("}")), "t string")["t"]
    made = found.where("block_id is not null").select(
        F.coalesce("ocr_run_id", "record").alias("ocr_run_id"), page.alias("page_index"), "block_id",
        text.alias("text"), F.expr("try_cast(confidence as double)").alias("confidence"), F.expr("try_cast(reading_order as int)").alias("reading_order"),
    )
    best = made.groupBy("ocr_run_id", "page_index", "block_id").agg(F.min(F.struct("text", "confidence", "reading_order")).alias("b"))
    return best.select("ocr_run_id", "page_index", "block_id", "b.*")


def cells_of(runs: DataFrame) -> DataFrame:
    """One row for each cell of a result: section, row and field with the value's JSON text kept."""
    runs = _of(runs, "kie")
    graph = shred.infer(runs, "payload")
    found = _all(runs, graph, _table_of(graph, "normalized_value"), ["kie_run_id", "source_ocr_run_id", "line_id", "field_name"], "raw_text", "predicted_value", "normalized_value", "value_status")
    keyed = found.withColumn("section", _section()).withColumn("field", F.coalesce("field_name", F.element_at("steps", -1))).withColumn("row_id", _row_id())
    return keyed.select(F.coalesce("kie_run_id", "record").alias("kie_run_id"), "source_ocr_run_id", "section", "row_id", "field", "raw_text", "predicted_value", "normalized_value", "value_status").distinct()


def citations_of(runs: DataFrame) -> DataFrame:
    """One row for each block id a cell or a line cites, with the run that is cited."""
    runs = _of(runs, "kie")
    graph = shred.infer(runs, "payload")
    found = _all(runs, graph, _table_of(graph, "source_block_ids", values=True), ["kie_run_id", "source_ocr_run_id", "line_id", "field_name"], "value")
    # .../<cell>/source_block_ids, or .../<position>/source_block_ids for a row's own ids
    holder = F.try_element_at("steps", F.lit(-2))
    own = F.try_element_at("steps", F.lit(-3)).isin("line_items", "tax_breakdown")
    named = found.withColumn("section", _section()).withColumn("field", F.when(own, "row").otherwise(F.coalesce("field_name", holder))).withColumn("row_id", _row_id())
    return named.select(F.coalesce("kie_run_id", "record").alias("kie_run_id"), "source_ocr_run_id", "section", "row_id", "field", F.col("value").alias("block_id")).distinct()


def found_of(runs: DataFrame) -> DataFrame:
    """Citations whose block exists in the evidence of the run that the payload names."""
    known = blocks_of(runs).select("ocr_run_id", "page_index", "block_id").distinct()
    cited = citations_of(runs).withColumnRenamed("source_ocr_run_id", "ocr_run_id")
    return cited.join(known, ["ocr_run_id", "block_id"]).select("kie_run_id", "section", "row_id", "field", "ocr_run_id", "page_index", "block_id")


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    return blocks_of(_runs(spark, folder))


def cells(spark: SparkSession, folder: str) -> DataFrame:
    return cells_of(_runs(spark, folder))


def found(spark: SparkSession, folder: str) -> DataFrame:
    return found_of(_runs(spark, folder))


QUERIES = {"p6_blocks": blocks, "p6_cells": cells, "p6_found": found}
