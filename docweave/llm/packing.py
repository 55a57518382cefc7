"""Problem 7: texts combined into containers of fixed capacity.

Method: bounded-space online best-fit.  Lengths in tokens are spread over shards by a hash
(texts are not shuffled); each shard reads its items in a fixed order and keeps a fixed
number of open bins, indexed by a bitset over free space.  An item goes to the open bin
with the least free space that holds it; if none does and all places are taken, the fullest
bin closes.  A text longer than the capacity is split into full pieces and one rest; no
other text is split.

Defined results: null and empty texts have no tokens and are packed nowhere; a token is a
run of letters, digits and underscores or a run of other signs; the shard count depends on
the number of texts only, so equal input gives equal bins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import token_count
from docweave.session import cut

#: Bins a shard keeps open for each plan, and texts for each shard.
OPEN, SHARD = 64, 10_000
PIECES = "plan_name string, doc_id long, piece int, pieces int, tokens long, bin string"


class OpenBins:
    """At most ``places`` open bins of one capacity, indexed by free space in a bitset."""

    def __init__(self, capacity: int, places: int, name: str) -> None:
        self.capacity, self.places, self.name = capacity, places, name
        self.free = 0  # bit i is set if a bin with i tokens of free space is open
        self.at: dict[int, list[int]] = {}
        self.open = self.made = 0

    def _take(self, space: int) -> int:
        bins = self.at[space]
        number = bins.pop()
        if not bins:
            del self.at[space]
            self.free &= ~(1 << space)
        return number

    def put(self, size: int) -> str:
        """The bin for an item of ``size`` tokens, at most the capacity."""
        fitting = self.free >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            number = self._take(space)
        else:
            if self.open == self.places:  # the fullest closes
                self._take((self.free & -self.free).bit_length() - 1)
                self.open -= 1
            number, space = self.made, self.capacity
            self.made += 1
            self.open += 1
        left = space - size
        if left:
            self.at.setdefault(left, []).append(number)
            self.free |= 1 << left
        else:
            self.open -= 1
        return f"{self.name}-{number}"


def _packer(plans: list[tuple[str, int]], places: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, bins = None, {}
        for batch in batches:
            rows = []
            for s, doc, tokens in zip(batch["shard"], batch["doc_id"], batch["tokens"], strict=True):
                if s != shard:
                    shard, bins = s, {p: OpenBins(c, places, f"{p}-{s}") for p, c in plans}
                for name, capacity in plans:
                    pieces = -(-tokens // capacity)
                    for piece in range(pieces):
                        size = min(capacity, tokens - piece * capacity)
                        rows.append((name, doc, piece, pieces, size, bins[name].put(int(size))))
            yield pd.DataFrame(rows, columns=["plan_name", "doc_id", "piece", "pieces", "tokens", "bin"])

    return pack


def pack(documents: DataFrame, plans: DataFrame, places: int = OPEN) -> DataFrame:
    """``plan_name``, ``doc_id``, ``piece``, ``pieces``, ``tokens``, ``bin``: where each text goes, for each plan."""
    wished = [(r["plan_name"], int(r["capacity_tokens"])) for r in plans.where("capacity_tokens > 0").select("plan_name", "capacity_tokens").distinct().orderBy("plan_name").collect()]  # fixed small table
    sized = documents.select("doc_id", token_count(F.col("text")).alias("tokens"))
    shards = max(1, documents.select("doc_id").count() // SHARD)
    spread = sized.where("tokens > 0").withColumn("shard", F.pmod(F.xxhash64("doc_id", "tokens"), F.lit(shards)).cast("int"))
    # The shard's number is the partition, so that every task has one shard.
    ordered = spread.repartitionById(shards, "shard").sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "tokens")
    return ordered.mapInPandas(_packer(wished, places), PIECES)


def report(packed: DataFrame, plans: DataFrame) -> DataFrame:
    """``plan_name``, ``bins``, ``tokens``, ``fill``: containers used and the share of them that is filled."""
    total = packed.groupBy("plan_name").agg(F.count_distinct("bin").alias("bins"), F.sum("tokens").alias("tokens"))
    return total.join(F.broadcast(plans.select("plan_name", "capacity_tokens").distinct()), "plan_name").select("plan_name", "bins", "tokens", (F.col("tokens") / (F.col("bins") * F.col("capacity_tokens"))).alias("fill"))


def invariants(packed: DataFrame, plans: DataFrame) -> DataFrame:
    """One row for each plan on what a packing holds.

    ``texts`` and ``tokens`` placed, ``overfull`` bins above the capacity, ``torn`` texts that
    are split though they would fit or whose pieces are not whole, and ``dense`` (bins are
    filled to nine tenths, but for the open ones).
    """
    rows = cut(packed).join(F.broadcast(plans.select("plan_name", "capacity_tokens").distinct()), "plan_name")
    bins = rows.groupBy("plan_name", "bin").agg(F.sum("tokens").alias("filled"), F.max("capacity_tokens").alias("capacity"))
    by_bin = bins.groupBy("plan_name").agg(
        F.count_if(F.col("filled") > F.col("capacity")).alias("overfull"),
        (F.sum("filled") >= 0.9 * F.greatest(F.count("*") - OPEN, F.lit(0)) * F.max("capacity")).alias("dense"),
    )
    texts = rows.groupBy("plan_name", "doc_id").agg(F.sum("tokens").alias("n"), F.max("pieces").alias("pieces"), F.count("*").alias("made"), F.max("capacity_tokens").alias("capacity"))
    torn = (F.col("pieces") != F.col("made")) | (F.col("pieces") != F.ceil(F.col("n") / F.col("capacity")))
    by_text = texts.groupBy("plan_name").agg(F.count("*").alias("texts"), F.sum("n").alias("tokens"), F.count_if(torn).alias("torn"))
    return by_text.join(by_bin, "plan_name").select("plan_name", "texts", "tokens", "overfull", "torn", "dense")


def split_texts(packed: DataFrame) -> DataFrame:
    """``plan_name``, ``doc_id`` of texts that alone exceed the capacity."""
    return packed.where("pieces > 1").select("plan_name", "doc_id").distinct()
