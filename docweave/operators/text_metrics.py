"""Character and word error rates."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import collapse


def _character_edits(a: str, b: str) -> int:
    """Edits between two texts, a column of the matrix at a time as the bits of whole numbers.

    ``up`` and ``down`` hold where a cell is one more or one less than the cell above it.
    """
    least = min(len(a), len(b))
    start = next((i for i in range(least) if a[i] != b[i]), least)
    end = next((i for i in range(least - start) if a[-1 - i] != b[-1 - i]), least - start)
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    whole, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, edits = whole, 0, len(a)
    for c in b:
        same = places.get(c, 0)
        level = same | down
        across = (((same & up) + up) ^ up) | same
        more, less = down | (whole & ~(across | up)), up & across
        edits += bool(more & last) - bool(less & last)
        more, less = (more << 1 | 1) & whole, less << 1 & whole
        up, down = less | (whole & ~(level | more)), more & level
    return edits


def _character_series(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else _character_edits(a, b) for a, b in zip(reference, hypothesis, strict=True)], dtype="Int64")


def character_errors(reference: Column, hypothesis: Column) -> tuple[Column, Column]:
    """Character edits and reference length, white space collapsed.

    Equal texts are settled in the JVM; the others, of any length, go to the bit form in
    Arrow batches: the JVM's own distance fills a row for every character and takes ten times
    as long on texts of some thousand characters.
    """
    a, b = collapse(reference), collapse(hypothesis)
    far = a != b
    edits = F.pandas_udf(_character_series, "long")(F.when(far, a), F.when(far, b))
    return F.when(a == b, F.lit(0).cast("long")).otherwise(edits), F.length(a).cast("long")


def _word_edits(a: list[str], b: list[str]) -> int:
    """Edits between token lists, one vectorised row at a time; what both begin and end with is passed over."""
    least = min(len(a), len(b))
    start = next((i for i in range(least) if a[i] != b[i]), least)
    end = next((i for i in range(least - start) if a[-1 - i] != b[-1 - i]), least - start)
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    codes: dict[str, int] = {}
    x, y = (np.array([codes.setdefault(w, len(codes)) for w in words], dtype=np.int64) for words in (a, b))
    row, offsets = np.arange(len(y) + 1), np.arange(len(y) + 1)
    for i, token in enumerate(x, 1):
        best = np.empty_like(row)
        best[0] = i
        best[1:] = np.minimum(row[1:] + 1, row[:-1] + (y != token))
        row = np.minimum.accumulate(best - offsets) + offsets  # insertions, cheapest first
    return int(row[-1])


def word_edits() -> Callable[[Column, Column], Column]:
    """A vectorised function of two texts: edits between their words; null if either is."""

    def run(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else _word_edits(a.split(), b.split()) for a, b in zip(reference, hypothesis, strict=True)], dtype="Int64")

    return F.pandas_udf(run, "long")


def error_rates(rows: DataFrame, condition: str, errors: str, length: str) -> DataFrame:
    """Micro and macro rates in percent by ``condition`` and for all: sums of errors over sums of lengths, and means of rounded rates."""
    rated = rows.withColumn("rate__", F.round(F.try_divide(F.lit(100.0) * F.col(errors), F.col(length)), 2))
    made = rated.groupingSets([[F.col(condition)], []], condition).agg(
        F.count("*").alias("samples"), F.sum(errors).alias("errors"), F.sum(length).alias("length"), F.round(F.try_divide(F.lit(100.0) * F.sum(errors), F.sum(length)), 6).alias("micro"), F.round(F.avg("rate__"), 2).alias("macro")
    )
    return made.withColumn(condition, F.coalesce(condition, F.lit("all")))
