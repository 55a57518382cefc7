"""Evaluation kernels over gold and predicted cells.

A cell pair has ``gs``/``ps`` (gold and predicted status) and ``gv``/``pv`` (values).  Two
cells are equal if status and value are, null equalling null.  Unknown gold stays in
``total`` and leaves every other count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNRESOLVED = ("UNKNOWN", "UNREADABLE", "AMBIGUOUS")
OUTCOMES = ("EXACT", "MISSED_PRESENT", "SPURIOUS_PRESENT", "STATUS_MISMATCH", "NORMALIZATION_MISMATCH")


def exact() -> Column:
    """Whether prediction and gold are equal in status and value."""
    return F.col("gs").eqNullSafe(F.col("ps")) & F.col("gv").eqNullSafe(F.col("pv"))


def ratio(a: str | Column, b: str | Column) -> Column:
    """Null on a zero denominator."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.try_divide(a.cast("double"), b.cast("double"))


def ratio0(a: str | Column, b: str | Column) -> Column:
    """0 on a zero denominator, six digits."""
    return F.coalesce(F.round(ratio(a, b), 6), F.lit(0.0))


def _count(condition: Column, name: str) -> Column:
    return F.count_if(condition).alias(name)


def known_counts() -> list[Column]:
    """The counters of cells whose gold is known, as aggregates."""
    known, ok = F.col("gs") != "UNKNOWN", exact()
    expected, present = F.col("gs") == "PRESENT", F.col("ps") == "PRESENT"
    return [
        F.count("*").alias("total"), _count(known, "scored"), _count(~known, "unknown"), _count(known & ok, "correct"), _count(known & present, "predicted_present"),
        _count(known & expected, "gold_present"), _count(known & ok & expected, "true_positive"), _count(known & F.col("reviewed"), "review"),
        _count(known & expected & ~present, "miss"), _count(known & expected & present & ~ok, "wrong"), _count(known & ~expected & present, "false_value"),
        _count(known & F.col("ps").isin(*UNRESOLVED), "unresolved"),
    ]


def known_ratios(digits: int = 6) -> dict[str, Column]:
    """Ratios over :func:`known_counts`; F1 from the counts, not from rounded ratios."""
    made = {
        "exact_match": ratio("correct", "scored"), "coverage": ratio("scored", "total"), "precision": ratio("true_positive", "predicted_present"), "recall": ratio("true_positive", "gold_present"),
        "f1": ratio(2 * F.col("true_positive"), F.col("predicted_present") + F.col("gold_present")), "review_rate": ratio("review", "scored"),
    }
    return {name: F.round(col, digits) for name, col in made.items()}


def header_metrics(pairs: DataFrame, *sets: list[str]) -> DataFrame:
    """Counters and ratios for each of the grouping ``sets``; columns outside a set are null."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    return pairs.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(*known_counts()).withColumns(known_ratios())


def slices(pairs: DataFrame, *columns: str) -> DataFrame:
    """:func:`header_metrics` for each column alone, as ``slice``, ``key``; null keys are UNSPECIFIED."""
    filled = pairs.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("UNSPECIFIED")) for c in columns})
    made = header_metrics(filled, *[[c] for c in columns])
    slot = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in columns])
    return made.withColumn("slice", slot).withColumn("key", F.coalesce(*columns)).drop(*columns)


def decision_metrics(pairs: DataFrame, *groups: str) -> DataFrame:
    """First-generation counters: every decision counts, ratios are 0 on zero denominators, F1 comes from rounded ratios."""
    ok = exact()
    expected, present = F.col("gs") == "PRESENT", F.col("ps") == "PRESENT"
    hit = expected & present & F.col("gv").eqNullSafe(F.col("pv"))
    counted = pairs.groupBy(*groups).agg(
        F.count("*").alias("decisions"), _count(ok, "exact"), _count(F.col("gs").eqNullSafe(F.col("ps")), "status_correct"), _count(expected, "gold_present"),
        _count(hit, "true_positive"), _count(present, "predicted_present"), _count(F.col("reviewed"), "reviewed_count"), _count(present & ~hit, "false_positive"), _count(expected & ~hit, "false_negative"),
    )
    rated = counted.withColumns({
        "exact_match_accuracy": ratio0("exact", "decisions"), "status_accuracy": ratio0("status_correct", "decisions"), "normalization_accuracy": ratio0("true_positive", "gold_present"),
        "precision": ratio0("true_positive", F.col("true_positive") + F.col("false_positive")), "recall": ratio0("true_positive", F.col("true_positive") + F.col("false_negative")),
        "coverage": ratio0("predicted_present", "decisions"), "review_rate": ratio0("reviewed_count", "decisions"),
    })
    return rated.withColumn("f1", ratio0(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def outcome() -> Column:
    """Outcome category of a cell pair."""
    expected, present = F.col("gs") == "PRESENT", F.col("ps") == "PRESENT"
    other = F.when(expected, "MISSED_PRESENT").when(present, "SPURIOUS_PRESENT").otherwise("STATUS_MISMATCH")
    return F.when(~F.col("gs").eqNullSafe(F.col("ps")), other).when(expected & ~F.col("gv").eqNullSafe(F.col("pv")), "NORMALIZATION_MISMATCH").otherwise("EXACT")


def zero_filled(counted: DataFrame, column: str, domain: tuple[str, ...]) -> DataFrame:
    """``column``, ``n`` for every value of a closed ``domain``, 0 where none was counted."""
    spark = counted.sparkSession
    names = spark.createDataFrame([(x,) for x in domain], f"{column} string")
    return names.join(counted, column, "left").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def outcome_counts(pairs: DataFrame) -> DataFrame:
    """How often each outcome occurs, zero-filled."""
    return zero_filled(pairs.groupBy(outcome().alias("category")).agg(F.count("*").alias("n")), "category", OUTCOMES)


def compared(real: DataFrame, control: DataFrame) -> DataFrame:
    """Cell pairs of two runs over the same gold, the control's prediction as ``cs``, ``cv``."""
    other = control.select("sample_id", "field", F.col("ps").alias("cs"), F.col("pv").alias("cv"))
    return real.join(other, ["sample_id", "field"])


def control_exact() -> Column:
    """Whether the control's prediction equals gold."""
    return F.col("gs").eqNullSafe(F.col("cs")) & F.col("gv").eqNullSafe(F.col("cv"))


def root_cause() -> Column:
    """Why the real run is wrong, by what the control run did with perfect input; null if it is right."""
    lost = F.when(F.col("pv").isNull() & F.col("cv").isNotNull(), "OCR_OMISSION").otherwise("OCR_SUBSTITUTION")
    return F.when(exact(), F.lit(None)).when(control_exact(), lost).when((F.col("gs") == "PRESENT") & F.col("cv").isNull(), "CANDIDATE_GENERATION_FAILURE").when(F.col("gs") == "AMBIGUOUS", "AMBIGUITY").otherwise("CANDIDATE_RANKING_FAILURE")


def unpivoted(metrics: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Long form: ``key``, ``metric``, ``value``."""
    return metrics.unpivot(key, values, "metric", "value")


def metric_delta(a: DataFrame, b: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """``a``, ``b`` and ``b - a`` of each metric, from a full outer join of the long forms."""
    left = unpivoted(a, key, values).withColumnRenamed("value", "a")
    right = unpivoted(b, key, values).withColumnRenamed("value", "b")
    joined = left.join(right, [*key, "metric"], "full_outer")
    return joined.withColumn("delta", F.round(F.col("b") - F.col("a"), 6))


def complete_accuracy(pairs: DataFrame, *groups: str) -> DataFrame:
    """Share of documents all of whose cells are right, of those all of whose gold is known."""
    per = pairs.groupBy("sample_id", *groups).agg(F.bool_and(F.col("gs") != "UNKNOWN").alias("known"), F.bool_and(exact()).alias("right"))
    counted = per.groupBy(*groups).agg(F.count("*").alias("documents"), F.count_if("known").alias("scoreable"), F.count_if(F.col("known") & F.col("right")).alias("complete"))
    return counted.withColumn("accuracy", F.round(ratio("complete", "scoreable"), 6))


def with_failures(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """Gold left-joined to predictions: a document without a result keeps its cells, as UNKNOWN."""
    joined = gold.join(predictions, ["sample_id", "field"], "left")
    return joined.withColumn("failed", F.col("ps").isNull()).withColumn("ps", F.coalesce("ps", F.lit("UNKNOWN"))).withColumn("reviewed", F.coalesce("reviewed", F.lit(False)))
