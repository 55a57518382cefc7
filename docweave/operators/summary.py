"""Summaries of evaluation and run tables: shares, completeness, unmatched rows, histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.operators.metrics import ratio


def by_category(rows: DataFrame, key: str, category: Column, domain: list[str]) -> DataFrame:
    """One row for each ``key`` with a count for every category of a closed ``domain``, 0 where there is none."""
    named = rows.withColumn("category__", category)
    return named.groupBy(key).agg(*[F.count_if(F.col("category__") == c).alias(c.lower()) for c in domain])


def omission(rows: DataFrame, key: str, expected: Column, missed: Column) -> DataFrame:
    """Expected and omitted cells of each key; the rate is null where nothing is expected."""
    counted = rows.groupBy(key).agg(F.count_if(expected).alias("expected"), F.count_if(expected & missed).alias("omitted"))
    return counted.withColumn("omission_rate", F.round(ratio("omitted", "expected"), 6))


def mean_or_zero(documents: DataFrame, rows: DataFrame, key: str, value: str) -> DataFrame:
    """The mean of ``value`` for every document; 0 for one without rows."""
    means = rows.groupBy(key).agg(F.avg(value).alias("mean__"))
    return documents.select(key).distinct().join(means, key, "left").select(key, F.coalesce(F.round("mean__", 6), F.lit(0.0)).alias(f"mean_{value}"))


def unmatched(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand on one side only, with the ``side`` that has them; a repeated key counts once."""
    a, b = gold.select(*keys).distinct(), predicted.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("gold")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("predicted")))


def ordered_union(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The different values of each key in the order of their first appearance, joined by commas."""
    first = rows.groupBy(key, value).agg(F.min(order).alias("at"))
    listed = F.array_sort(F.collect_list(F.struct("at", F.col(value).cast("string").alias("v"))))
    return first.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x["v"]), ",").alias("ids"), F.count("*").alias("n"))


def column_correctness(gold: DataFrame, predicted: DataFrame, keys: list[str], column: str, value: str) -> DataFrame:
    """Of the cells on both sides, how many of each column are right; null equals null."""
    both = gold.join(predicted.withColumnRenamed(value, "other__"), [*keys, column])
    counted = both.groupBy(column).agg(F.count("*").alias("matched"), F.count_if(F.equal_null(value, "other__")).alias("correct"))
    return counted.withColumn("accuracy", F.round(ratio("correct", "matched"), 6))


def complete_tables(gold: DataFrame, predicted: DataFrame, doc: str, keys: list[str], value: str) -> DataFrame:
    """``documents`` and ``complete``: those whose cells are the same on both sides, no more, no fewer and all right."""
    cells = [doc, *keys]
    both = gold.select(*cells, F.col(value).alias("a"), F.lit(1).alias("g")).join(predicted.select(*cells, F.col(value).alias("b"), F.lit(1).alias("p")), cells, "full_outer")
    right = F.col("g").isNotNull() & F.col("p").isNotNull() & F.equal_null("a", "b")
    per = both.groupBy(doc).agg(F.bool_and(right).alias("complete"))
    return per.agg(F.count("*").alias("documents"), F.count_if("complete").alias("complete")).withColumn("accuracy", F.round(ratio("complete", "documents"), 6))


def presence(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """``status`` (both, only_a, only_b) and how many keys have it."""
    left, right = a.select(key).distinct().withColumn("a__", F.lit(1)), b.select(key).distinct().withColumn("b__", F.lit(1))
    status = F.when(F.col("a__").isNull(), "only_b").when(F.col("b__").isNull(), "only_a").otherwise("both")
    return left.join(right, key, "full_outer").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many rows of each side the other lacks, repeated rows counted each; 0 and 0 if both are equal."""
    tagged = a.withColumn("w__", F.lit(1)).unionByName(b.withColumn("w__", F.lit(-1)))
    net = tagged.groupBy(*a.columns).agg(F.sum("w__").alias("net"))
    more = lambda sign: F.coalesce(F.sum(F.greatest(F.lit(0), sign * F.col("net"))), F.lit(0)).cast("long")
    return net.agg(more(F.lit(1)).alias("only_a"), more(F.lit(-1)).alias("only_b"))


def histories(rows: DataFrame, key: str, kind: str, kinds: list[str], at: str, name: str) -> DataFrame:
    """For each key the names of every kind from the oldest to the latest, joined by commas; deliveries of a name count once."""
    once = rows.groupBy(key, kind, name).agg(F.min(at).alias("at"))
    listed = lambda k: F.array_join(F.transform(F.array_sort(F.array_compact(F.collect_list(F.when(F.col(kind) == k, F.struct("at", F.col(name).alias("v")))))), lambda x: x["v"]), ",")
    return once.groupBy(key).agg(*[listed(k).alias(f"{k}_runs") for k in kinds])


def citing(citations: DataFrame, cited: str, *fields: str) -> DataFrame:
    """The inverse of a citation table: how many different fields cite each id."""
    return citations.select(cited, *fields).distinct().groupBy(cited).agg(F.count("*").alias("fields"))
