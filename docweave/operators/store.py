"""Operators over append-only logs: overlays, latest rows, versions, intervals, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, key: list[str], *order: str) -> DataFrame:
    """The last row of each key; ``order`` must be total within a key.

    One partial aggregation (``max_by`` of whole rows) instead of a window, so a key with
    a third of the rows is reduced before the shuffle.
    """
    rest = [c for c in log.columns if c not in key]
    best = log.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last"))
    return best.select(*key, "last.*")


def overlay(machine: DataFrame, corrections: DataFrame, key: list[str], value: str, corrected: str) -> DataFrame:
    """``effective``: the correction where there is one, even a null one, else the machine value."""
    joined = machine.join(corrections.withColumn("has__", F.lit(True)), key, "left")
    effective = F.when(F.col("has__"), F.col(corrected)).otherwise(F.col(value))
    return joined.withColumn("effective", effective).withColumn("reviewed", F.coalesce("has__", F.lit(False))).drop("has__")


def complete_groups(cells: DataFrame, key: list[str], name: str, required: list[str], open_cell: Column) -> DataFrame:
    """``complete``: whether a group has exactly the required names and no open cell; ``missing`` and ``open`` say why not."""
    names = F.sort_array(F.collect_set(name))
    wanted = F.array(*map(F.lit, sorted(required)))
    made = cells.groupBy(*key).agg(names.alias("names"), F.count_if(open_cell).alias("open"))
    return made.select(*key, F.size(F.array_except(wanted, "names")).cast("long").alias("missing"), "open", ((F.col("names") == wanted) & (F.col("open") == 0)).alias("complete"))


def transitions(log: DataFrame, key: str, order: list[str], state: str, legal: list[tuple[str, str]]) -> DataFrame:
    """Steps from one state to another that are not in ``legal``."""
    w = Window.partitionBy(key).orderBy(*order)
    steps = log.withColumn("before", F.lag(state).over(w)).where(F.col("before").isNotNull() & (F.col("before") != F.col(state)))
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, b in legal])
    return steps.where(~F.array_contains(allowed, F.concat_ws(">", "before", state)))


def active_time(log: DataFrame, key: str, at: str, change: Column) -> DataFrame:
    """``active`` and ``paused`` time of each key: the clock stands while the running sum of ``change`` is positive.

    ``change`` is +1 for a pause and -1 for its end; ends without a pause do not count.
    """
    w = Window.partitionBy(key).orderBy(at, "event_id")
    moved = log.withColumn("change__", change)
    depth = F.sum("change__").over(w.rowsBetween(Window.unboundedPreceding, 0))
    level = moved.withColumn("sum__", depth).withColumn("low__", F.least(F.lit(0), F.min("sum__").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    spans = level.withColumn("paused__", F.col("sum__") - F.col("low__") > 0).withColumn("span__", F.lead(at).over(w) - F.col(at))
    return spans.groupBy(key).agg(F.coalesce(F.sum(F.when(~F.col("paused__"), F.col("span__"))), F.lit(0)).alias("active"), F.coalesce(F.sum(F.when(F.col("paused__"), F.col("span__"))), F.lit(0)).alias("paused"), F.count("*").alias("events"))


def page(df: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """One page of a total order."""
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit must be 1 to 1000 and offset not negative")
    return df.orderBy(*order).offset(offset).limit(limit)


def envelope(df: DataFrame, size: int) -> DataFrame:
    """``total_items`` and ``total_pages``."""
    return df.agg(F.count("*").alias("total_items")).withColumn("total_pages", F.ceil(F.col("total_items") / size).cast("long"))


def recent(df: DataFrame, at: str, days: int) -> DataFrame:
    """Rows at most ``days`` older than the newest row of the table; the newest time is a scalar subquery."""
    newest = df.agg(F.max(at)).scalar()
    return df.where(F.col(at) >= newest - F.expr(f"interval {days} days"))
