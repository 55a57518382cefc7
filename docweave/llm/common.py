"""Helpers the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def once(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row for each ``key``; repeated deliveries count once.

    Of rows that differ the smallest by all ``columns`` is kept (nulls last), so the
    result does not depend on the order of the rows.  Null keys are dropped.
    """
    kept = F.struct(*[F.struct(F.col(c).isNull().alias(f"n{i}"), F.col(c).alias("v")).alias(f"c{i}") for i, c in enumerate(columns)])
    best = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(kept).alias("kept"))
    return best.select(F.col("key").alias(key), *[F.col(f"kept.c{i}.v").alias(c) for i, c in enumerate(columns)])


def share(col: Column, salt: str, seed: int) -> Column:
    """A number in [0, 1) drawn from the hash of ``col``; the same for the same seed."""
    return F.pmod(F.xxhash64(col, F.lit(salt), F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))


#: Slots summed up in one piece by :func:`earlier`.
BLOCK = 1024


def earlier(counts: DataFrame, by: list[str], order: list[str], slot: str = "slot", n: str = "n") -> DataFrame:
    """``counts`` with ``before``: the sum of ``n`` over the rows of the same ``by`` that lie earlier.

    Rows are ordered by ``order`` and then by ``slot``.  Slots are summed in blocks of
    ``BLOCK`` first and then within their block, so that no group, whatever its share of
    the slots, is ordered as a whole in one task.
    """
    placed = counts.withColumn("block__", F.floor(F.col(slot) / BLOCK))
    blocks = placed.groupBy(*by, *order, "block__").agg(F.sum(n).alias("n__"))
    across = Window.partitionBy(*by).orderBy(*order, "block__")
    started = blocks.withColumn("start__", F.sum("n__").over(across) - F.col("n__")).drop("n__")
    within = Window.partitionBy(*by, *order, "block__").orderBy(slot)
    inner = placed.withColumn("inner__", F.sum(n).over(within) - F.col(n))
    keys = [*by, *order, "block__"]
    return inner.join(started, keys).withColumn("before", F.col("start__") + F.col("inner__")).drop("block__", "start__", "inner__")


def empty_like(df: DataFrame, **columns: str) -> DataFrame:
    """No rows, with the given columns."""
    schema = T.StructType().fromDDL(", ".join(f"{k} {v}" for k, v in columns.items()))
    return df.sparkSession.createDataFrame([], schema)
