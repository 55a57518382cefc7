"""Review reasons, error categories, score bands and the assembly of cells into records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reasons(rules: dict[str, Column]) -> Column:
    """The names of the rules that hold, in order, each once."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(holds, F.lit(name)) for name, holds in rules.items()])))


def first_category(found: Column, ladder: list[tuple[str, str]], otherwise: str) -> Column:
    """The category of the first reason of ``ladder`` that was found."""
    made = F.lit(otherwise)
    for reason, category in reversed(ladder):
        made = F.when(F.array_contains(found, reason), category).otherwise(made)
    return made


def band_score(position: Column, bands: list[tuple[float, float]], beyond: float) -> Column:
    """The score of the first band whose upper end is not below ``position``."""
    made = F.lit(beyond)
    for end, score in reversed(bands):
        made = F.when(position <= end, F.lit(score)).otherwise(made)
    return made


def assemble(cells: DataFrame, doc: str, row: str, field: str, value: str) -> DataFrame:
    """One JSON text a document: its rows in order, each an object of its fields in order of name."""
    per_row = cells.groupBy(doc, row).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(field, value)))).alias("cells"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct(row, F.to_json("cells").alias("json")))), lambda r: r["json"])
    return per_row.groupBy(doc).agg(F.concat(F.lit("["), F.array_join(rows, ","), F.lit("]")).alias("record"), F.count("*").alias("rows"))


def line_metrics(gold: DataFrame, predicted: DataFrame, matches: DataFrame, doc: str) -> DataFrame:
    """Row detection counts and ratios over all documents; a document on one side only still counts."""
    count = lambda df, name: df.groupBy(doc).agg(F.count("*").alias(name))
    per = count(gold, "gold_rows").join(count(predicted, "predicted_rows"), doc, "full_outer").join(count(matches, "matched_rows"), doc, "left").fillna(0)
    total = per.agg(F.count("*").alias("documents"), *[F.sum(c).alias(c) for c in ("gold_rows", "predicted_rows", "matched_rows")])
    ratio = lambda a, b: F.round(F.try_divide(a.cast("double"), b.cast("double")), 6)
    g, p, m = F.col("gold_rows"), F.col("predicted_rows"), F.col("matched_rows")
    return total.withColumns({"extra_rows": p - m, "detection_precision": ratio(m, p), "detection_recall": ratio(m, g), "detection_f1": ratio(2 * m, p + g)})


def inline_rates(text: Column) -> Column:
    """``(rate, taxable, tax)`` of each ``;``-separated part like ``VAT: 8%; taxable 1.000; tax 80``: one struct a rate."""
    parts = F.filter(F.transform(F.split(text, r"(?i)(?=\b(?:vat|thuế suất)\b)"), lambda p: F.trim(p)), lambda p: F.rlike(p, F.lit(r"(?i)^(?:vat|thuế suất)\b")))
    number = lambda p, word: F.nullif(F.regexp_extract(p, rf"(?i)\b(?:{word})\D{{0,12}}?(\d[\d.,]*\d|\d)", 1), F.lit(""))
    return F.transform(parts, lambda p: F.struct(F.nullif(F.regexp_extract(p, r"(\d+(?:[.,]\d+)?)\s*%", 1), F.lit("")).alias("rate"), number(p, "taxable|tính thuế").alias("taxable"), number(F.regexp_replace(p, r"(?i)taxable|tính thuế", "base"), "tax|tiền thuế").alias("tax")))
