"""Ranking of candidates, margins, ties and selection.

Candidates stand in one row each with the document they belong to; every window is
partitioned by document, so a document's candidates are the largest unit in memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank(df: DataFrame, within: list[str], *order: Column) -> DataFrame:
    """``rank`` from 1 by ``order``, which must be total."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*within).orderBy(*order)).cast("long"))


def margins(ranked: DataFrame, within: list[str], role: str, score: str, close: float) -> DataFrame:
    """The best candidate of each group with the margin to the next one of its role (null without one)."""
    whole = Window.partitionBy(*within)
    best_role = F.first(role).over(whole.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rival = F.max(F.when((F.col("rank") > 1) & (F.col(role) == F.col("best_role")), F.col(score))).over(whole)
    best = ranked.withColumn("best_role", best_role).withColumn("rival", rival).where("rank = 1")
    margin = F.col(score) - F.col("rival")
    return best.withColumn("margin", margin).withColumn("competitor", F.coalesce(margin < close, F.lit(False))).drop("best_role", "rival")


def weighted(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted sum clamped to [0, 1]; the weights must sum to 1."""
    if abs(sum(weights.values()) - 1) > 1e-9 or set(parts) != set(weights):
        raise ValueError("weights must cover the parts and sum to 1")
    total = sum((parts[k] * F.lit(w) for k, w in weights.items()), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def candidate_score(explicit: Column, aligned: Column, normalizable: Column, low_quality: Column) -> Column:
    """Second-generation heuristic score: four signals, floor 0, four digits."""
    signal = lambda c, w: F.when(c, F.lit(w)).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.lit(0.35) + signal(explicit, 0.25) + signal(aligned, 0.2) + signal(normalizable, 0.15) - signal(low_quality, 0.2)), 4)


def select(candidates: DataFrame, within: list[str], score: str, value: str, order: list[Column], tie: float) -> DataFrame:
    """One row a group: the best candidate, and whether another within ``tie`` has another value.

    ``status`` is AMBIGUOUS then, UNKNOWN if the best has no value, else PRESENT.
    """
    whole = Window.partitionBy(*within).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = rank(candidates, within, F.desc(score), *order)
    seen = ranked.withColumn("best", F.first(F.struct(F.col(score).alias("s"), F.col(value).alias("v"))).over(whole))
    near = (F.col("rank") > 1) & (F.col("best.s") - F.col(score) <= tie) & ~F.col(value).eqNullSafe(F.col("best.v"))
    picked = seen.groupBy(*within).agg(F.count("*").alias("candidates"), F.count_if(near).alias("rivals"), F.first(F.col("best.s")).alias("best_score"), F.first(F.col("best.v")).alias("best_value"))
    return picked.withColumn("status", F.when(F.col("rivals") > 0, "AMBIGUOUS").when(F.col("best_value").isNull(), "UNKNOWN").otherwise("PRESENT"))
