"""Dataset checks: leakage, duplicates, exclusive selections, set comparisons and rule violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def leakage(records: DataFrame, keys: list[str], split: str) -> DataFrame:
    """``key_name``, ``key``, ``splits``: keys that stand in more than one split, of each kind of key."""
    kinds = F.array(*[F.struct(F.lit(k).alias("key_name"), F.col(k).cast("string").alias("key")) for k in keys])
    long = records.select(F.inline(kinds), F.col(split)).where(f"key is not null and {split} is not null")
    return long.groupBy("key_name", "key").agg(F.count_distinct(split).alias("splits"), F.count("*").alias("records")).where("splits > 1")


def first_by(df: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first row of each key; keys are reduced before the shuffle."""
    rows = df.withColumn("key__", key)
    best = rows.groupBy("key__").agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("first"), F.count("*").alias("copies"))
    return best.select("first.*", "copies")


def exclusive_top(df: DataFrame, key: str, strata: list[tuple[str, list[Column]]], k: int) -> DataFrame:
    """The top ``k`` of each stratum in turn, later strata without what earlier ones took.

    Taken keys number at most ``k`` for each stratum, so the anti-joins broadcast.
    """
    taken = None
    for name, order in strata:
        left = df if taken is None else df.join(F.broadcast(taken.select(key)), key, "left_anti")
        top = left.orderBy(*order, key).limit(k).select(key, F.lit(name).alias("stratum"))
        taken = top if taken is None else taken.unionByName(top)
    return taken


def set_sizes(a: DataFrame, b: DataFrame) -> DataFrame:
    """``only_a``, ``only_b``, ``both``, ``either``: sizes of the set differences, intersection and union of one-column tables."""
    x, y = a.toDF("k").distinct().withColumn("a", F.lit(1)), b.toDF("k").distinct().withColumn("b", F.lit(1))
    marked = x.unionByName(y, allowMissingColumns=True).groupBy("k").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return marked.agg(F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"), F.count("*").alias("either"))


def violations(df: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """``key``, ``rule`` for every row that breaks a rule; a rule is the condition of a fault.

    All rules are judged in one pass.
    """
    broken = F.array_compact(F.array(*[F.when(fault, F.lit(name)) for name, fault in rules.items()]))
    return df.select(*key, F.explode(broken).alias("rule"))


def contiguous(df: DataFrame, within: str, position: str) -> DataFrame:
    """Groups whose positions are not 0, 1, 2 ... without gaps and repeats."""
    made = df.groupBy(within).agg(F.count("*").alias("n"), F.count_distinct(position).alias("different"), F.min(position).alias("least"), F.max(position).alias("most"))
    return made.where("least <> 0 or most <> n - 1 or different <> n").select(within, "n", "different")


def signed_area(points: Column) -> Column:
    """Shoelace area of an array of ``(x, y)``; positive if the corners run clockwise in image axes."""
    n = F.size(points)
    terms = F.transform(points, lambda p, i: p["x"] * F.element_at(points, (i + 1) % n + 1)["y"] - F.element_at(points, (i + 1) % n + 1)["x"] * p["y"])
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t) / 2


def rank_sample(df: DataFrame, by: Column, k: int, *within: str) -> DataFrame:
    """The first ``k`` rows of each group in the order of ``by``."""
    return df.withColumn("n__", F.row_number().over(Window.partitionBy(*within).orderBy(by))).where(F.col("n__") <= k).drop("n__")
