"""Evidence payloads as one row for each positioned block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.operators.shred import parsed

_BLOCK = "struct<block_id:string,text:string,confidence:double,polygon:array<struct<x:double,y:double>>,reading_order:int>"
_PAGE = f"struct<engine:struct<name:string,version:string>,blocks:array<{_BLOCK}>>"
#: Engines whose confidence says nothing about reading quality.
TEXT_ENGINES = ("pdfium-text",)


def box(polygon: Column) -> list[Column]:
    """``left_x``, ``top_y``, ``right_x``, ``bottom_y`` of an array of points."""
    xs, ys = F.transform(polygon, lambda p: p["x"]), F.transform(polygon, lambda p: p["y"])
    return [F.array_min(xs).alias("left_x"), F.array_min(ys).alias("top_y"), F.array_max(xs).alias("right_x"), F.array_max(ys).alias("bottom_y")]


def flatten(runs: DataFrame, key: str = "run_id", payload: str = "payload") -> DataFrame:
    """Blocks of single-page and document evidence: ``key``, ``page``, reading order, text, confidence and box.

    Repeated deliveries of a run count once; payloads that cannot be read and blocks
    without an id give no rows.  ``evidence_confidence`` is null for born-digital text.
    """
    root = runs.select(key, F.explode(F.array(parsed(F.col(payload)))).alias("v"))
    single = F.array(F.struct(F.lit(0).alias("page_index"), F.try_variant_get("v", "$", _PAGE).alias("evidence")))
    pages = F.coalesce(F.try_variant_get("v", "$.pages", f"array<struct<page_index:int,evidence:{_PAGE}>>"), single)
    paged = root.select(key, F.posexplode(pages).alias("at", "p")).select(key, F.coalesce("p.page_index", "at").alias("page"), F.col("p.evidence.engine.name").alias("engine"), F.explode("p.evidence.blocks").alias("b"))
    rows = paged.where("b.block_id is not null").select(key, "page", "engine", "b.block_id", "b.text", "b.confidence", "b.reading_order", *box(F.col("b.polygon")))
    first = rows.groupBy(key, "block_id").agg(F.min(F.struct("page", "engine", "text", "confidence", "reading_order", "left_x", "top_y", "right_x", "bottom_y")).alias("r")).select(key, "block_id", "r.*")
    return first.withColumn("evidence_confidence", F.when(~F.coalesce(F.col("engine").isin(*TEXT_ENGINES), F.lit(False)), F.col("confidence")))


def ordered_polygon(polygon: Column) -> Column:
    """Points clockwise in image axes from the one nearest the top left corner."""
    center = lambda axis: F.aggregate(polygon, F.lit(0.0), lambda s, p: s + p[axis]) / F.size(polygon)
    cx, cy = center("x"), center("y")
    around = F.array_sort(F.transform(polygon, lambda p: F.struct(F.atan2(p["y"] - cy, p["x"] - cx).alias("angle"), p["x"].alias("x"), p["y"].alias("y"))))
    least = F.array_min(F.transform(around, lambda p: p["x"] + p["y"]))
    start = F.array_position(F.transform(around, lambda p: p["x"] + p["y"]), least).cast("int")
    turned = F.concat(F.slice(around, start, F.size(around)), F.slice(around, F.lit(1), start - 1))
    return F.transform(turned, lambda p: F.struct(p["x"], p["y"]))


def unrotated(x: Column, y: Column, degrees: Column) -> Column:
    """A point of a page turned by 0, 90, 180 or 270 degrees, in the page as it was; unit coordinates."""
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    return F.when(degrees == 90, point(y, 1 - x)).when(degrees == 180, point(1 - x, 1 - y)).when(degrees == 270, point(1 - y, x)).otherwise(point(x, y))


def legacy(rows: DataFrame) -> DataFrame:
    """Older artefacts in today's columns: ``blocks`` or ``detections``, ``polygon`` or ``box``, ``image_size`` or ``image``."""
    have = set(rows.columns)
    first = lambda *names: F.coalesce(*[F.col(n) for n in names if n in have], F.lit(None))
    return rows.withColumns({"blocks": first("blocks", "detections"), "polygon": first("polygon", "box"), "image": first("image", "image_size")})
