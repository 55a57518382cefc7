"""Relations between positioned blocks: neighbours, columns, islands, overlaps, evidence.

Every join is an equi-join on the document (and page or row where there is one) with the
geometric predicate on top, so no pair of different documents is ever formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefixed(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    """``df`` with all columns but ``keep`` prefixed."""
    return df.select(*keep, *[F.col(c).alias(prefix + c) for c in df.columns if c not in keep])


def same_row(a: str = "", b: str = "o_", least: float = 0.35) -> Column:
    """Whether two boxes overlap vertically by ``least`` of the lower height."""
    shared = F.least(F.col(f"{a}bottom_y"), F.col(f"{b}bottom_y")) - F.greatest(F.col(f"{a}top_y"), F.col(f"{b}top_y"))
    return shared >= F.least(F.col(f"{a}bottom_y") - F.col(f"{a}top_y"), F.col(f"{b}bottom_y") - F.col(f"{b}top_y")) * least


def nearest(asked: DataFrame, offered: DataFrame, doc: str, key: str, distance: Column, condition: Column, tie: list[str]) -> DataFrame:
    """For each row of ``asked`` the row of ``offered`` (prefix ``o_``) in its document with the least ``distance``."""
    joined = asked.join(prefixed(offered, "o_", [doc]), doc).where(condition)
    order = Window.partitionBy(doc, key).orderBy(distance, *tie)
    return joined.withColumn("distance", distance).withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def right_neighbor(blocks: DataFrame, doc: str, key: str) -> DataFrame:
    """The next block to the right on the same row."""
    to_right = same_row() & (F.col("o_left_x") >= F.col("right_x")) & (F.col("o_" + key) != F.col(key))
    return nearest(blocks, blocks, doc, key, F.col("o_left_x") - F.col("right_x"), to_right, ["o_" + key])


def nearest_column(blocks: DataFrame, headers: DataFrame, doc: str, key: str) -> DataFrame:
    """The header whose left edge or centre is nearest; ties go to the leftmost."""
    center = lambda p: (F.col(p + "left_x") + F.col(p + "right_x")) / 2.0
    distance = F.least(F.abs(F.col("left_x") - F.col("o_left_x")).cast("double"), F.abs(center("") - center("o_")))
    return nearest(blocks, headers, doc, key, distance, F.lit(True), ["o_left_x", "o_" + key])


def contained_column(blocks: DataFrame, headers: DataFrame, doc: str, key: str) -> DataFrame:
    """The only header whose span holds the block; blocks in none or several spans are left out."""
    inside = (F.col("left_x") >= F.col("o_left_x")) & (F.col("right_x") <= F.col("o_right_x"))
    joined = blocks.join(prefixed(headers, "o_", [doc]), doc).where(inside)
    only = joined.withColumn("spans", F.count("*").over(Window.partitionBy(doc, key)))
    return only.where("spans = 1").drop("spans")


def islands(df: DataFrame, within: list[str], order: list[str], breaks: Column) -> DataFrame:
    """``island`` numbers rows in order, starting a new one where ``breaks`` is true or null.

    ``breaks`` may use ``F.lag`` over :func:`window`.
    """
    w = window(within, order)
    started = df.withColumn("starts", F.when(F.coalesce(breaks, F.lit(True)), 1).otherwise(0))
    return started.withColumn("island", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("starts")


def window(within: list[str], order: list[str]) -> Window:
    """The window of :func:`islands`."""
    return Window.partitionBy(*within).orderBy(*order)


def box_union(df: DataFrame, *by: str) -> DataFrame:
    """The box around each group's boxes."""
    return df.groupBy(*by).agg(F.min("left_x").alias("left_x"), F.min("top_y").alias("top_y"), F.max("right_x").alias("right_x"), F.max("bottom_y").alias("bottom_y"), F.count("*").alias("boxes"))


def iou(a: str = "", b: str = "o_") -> Column:
    """Intersection over union of two boxes; 0 if the union is."""
    c = lambda p, n: F.col(p + n)
    area = lambda p: (c(p, "right_x") - c(p, "left_x")) * (c(p, "bottom_y") - c(p, "top_y"))
    wide = F.least(c(a, "right_x"), c(b, "right_x")) - F.greatest(c(a, "left_x"), c(b, "left_x"))
    high = F.least(c(a, "bottom_y"), c(b, "bottom_y")) - F.greatest(c(a, "top_y"), c(b, "top_y"))
    shared = F.greatest(wide, F.lit(0)) * F.greatest(high, F.lit(0))
    return F.coalesce(F.try_divide(shared.cast("double"), (area(a) + area(b) - shared).cast("double")), F.lit(0.0))


def spatial_join(a: DataFrame, b: DataFrame, doc: str, band: int) -> DataFrame:
    """Pairs of boxes of one document that overlap, with their ``iou``.

    Boxes are spread over horizontal bands of ``band`` height, so only boxes that share a
    band meet; a pair is kept in the band its intersection starts in.
    """
    spread = lambda df: df.withColumn("band", F.explode(F.sequence(F.floor(F.col("top_y") / band), F.floor((F.col("bottom_y") - 1) / band))))
    joined = spread(a).join(prefixed(spread(b), "o_", [doc, "band"]), [doc, "band"])
    starts = F.floor(F.greatest("top_y", "o_top_y") / band) == F.col("band")
    return joined.where(starts).withColumn("iou", iou()).where("iou > 0").drop("band")


def evidence_text(citations: DataFrame, blocks: DataFrame, doc: str, cell: str, block: str, order: str, text: str) -> DataFrame:
    """Texts of the blocks a cell cites, in reading order, joined by line ends."""
    joined = citations.join(blocks.select(doc, block, order, text), [doc, block])
    entries = F.array_sort(F.collect_list(F.struct(order, text)))
    return joined.groupBy(doc, cell).agg(F.array_join(F.transform(entries, lambda e: e[text]), "\n").alias("raw_text"), F.count("*").alias("blocks"))


def dangling(citations: DataFrame, blocks: DataFrame, on: list[str]) -> DataFrame:
    """Citations of blocks that do not exist."""
    return citations.join(blocks.select(*on).distinct(), on, "left_anti")


def overlap_edges(a: DataFrame, b: DataFrame, doc: str, row: str, ids: str) -> DataFrame:
    """``row_a``, ``row_b``, ``shared``: rows of two sides that cite common ids, counted from the exploded ids."""
    one = a.select(doc, F.col(row).alias("row_a"), F.explode(F.array_distinct(ids)).alias("id"))
    two = b.select(doc, F.col(row).alias("row_b"), F.explode(F.array_distinct(ids)).alias("id"))
    return one.join(two, [doc, "id"]).groupBy(doc, "row_a", "row_b").agg(F.count("*").alias("shared"))
