"""Problem 8: a mixture of sources at target shares of the total size.

Method: systematic sampling.  A source's rate is its target size over its size, at most
its number of repeats; each text expects that many copies.  The expected copies are summed
up within the source, one random offset is added, and a copy is emitted for each integer
boundary a text crosses.  Texts run in order of size class and hash, so the copies keep
the source's mix of lengths.

The prefix sums come from counts of small slots (source, size class, hash slot), summed in
two levels: no source, whatever its share of the rows, is ordered in one place.

The size of a mixture is the size of all documents; a source that cannot reach its share
then leaves the others above theirs.  With ``feasible`` the size shrinks to the largest at
which every source that has texts reaches its share.

What can be reached is judged by what was taken: a target is out of reach if every text of
its source was taken as often as allowed and the tokens taken still fall short of it.

Defined results: null and empty texts have size 0 and are in no mixture; a null source
counts in the total and belongs to no target; source spelling does not matter; a source
without texts reaches nothing unless its target is 0; a null number of repeats sets no
limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.text import label_key, token_count
from docweave.llm.common import earlier, share
from docweave.session import cut

#: Texts for each slot of the prefix sums.
SLOT = 20_000


def sizes(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``source`` (one spelling), ``tokens`` of each text."""
    return documents.select("doc_id", label_key(F.col("source")).alias("source"), token_count(F.col("text")).alias("tokens"))


def rates(sized: DataFrame, targets: DataFrame, feasible: bool = False) -> DataFrame:
    """One row for each target: ``target_tokens``, its source's size and the ``rate`` of copies.

    ``source_texts`` and ``largest_text`` say how many texts with tokens the source has and
    how long the longest is; ``reached`` is what the sizes promise, which :func:`report`
    judges by what was taken.
    """
    filled = F.when(F.col("tokens") > 0, F.col("tokens"))
    by_source = cut(
        sized.groupBy("source").agg(
            F.coalesce(F.sum("tokens"), F.lit(0)).alias("source_tokens"),
            F.count(filled).alias("source_texts"),
            F.coalesce(F.max(filled), F.lit(0)).alias("largest_text"),
        )
    )
    all_tokens = float(by_source.agg(F.coalesce(F.sum("source_tokens"), F.lit(0))).first()[0])
    wished = targets.select("mix_name", F.col("source").alias("name"), label_key(F.col("source")).alias("source"), "target_share", "max_repeats")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("source_tokens", "source_texts", "largest_text")}
    held = wished.join(by_source, "source", "left").withColumns(zero)
    most = F.col("max_repeats") * F.col("source_tokens")
    whole = F.lit(all_tokens)
    if feasible:
        room = F.when((F.col("target_share") > 0) & (F.col("source_tokens") > 0), most / F.col("target_share"))
        whole = F.least(whole, F.min(room).over(Window.partitionBy("mix_name")))
    sized_targets = held.withColumn("target_tokens", F.col("target_share") * whole)
    wanted = F.coalesce(F.try_divide("target_tokens", "source_tokens"), F.lit(0.0))
    rated = sized_targets.withColumn("rate", F.least(wanted, F.col("max_repeats").cast("double")))
    return rated.withColumn("reached", F.coalesce(F.col("target_tokens") <= most, F.lit(True)))


def mix(sized: DataFrame, rated: DataFrame, seed: int = 20) -> DataFrame:
    """``mix_name``, ``source``, ``doc_id``, ``tokens``, ``copies`` of the texts that each mixture takes."""
    texts = sized.where("tokens > 0 and source is not null")
    slots = max(1, sized.count() // SLOT)
    size_class = F.floor(F.log2(F.col("tokens").cast("double"))).cast("int")
    luck = F.xxhash64("doc_id", "tokens", F.lit(seed))
    placed = texts.withColumn("size_class", size_class).withColumn("luck", luck).withColumn("slot", F.pmod("luck", F.lit(slots)))
    counts = placed.groupBy("source", "size_class", "slot").agg(F.count("*").alias("n"))
    before = earlier(counts, ["source"], ["size_class"]).drop("n")
    within = Window.partitionBy("source", "size_class", "slot").orderBy("luck", "doc_id")
    ranked = placed.withColumn("rank", F.row_number().over(within)).join(before, ["source", "size_class", "slot"])
    numbered = ranked.select("source", "doc_id", "tokens", (F.col("before") + F.col("rank")).alias("place"))
    # The targets are a fixed small table.
    joined = numbered.join(F.broadcast(rated.where("rate > 0").select("mix_name", "source", "rate")), "source")
    offset = share(F.concat_ws("|", "mix_name", "source"), "mix", seed)
    copies = F.floor(F.col("place") * F.col("rate") + offset) - F.floor((F.col("place") - 1) * F.col("rate") + offset)
    return joined.select("mix_name", "source", "doc_id", "tokens", copies.cast("int").alias("copies")).where("copies > 0")


def report(mixed: DataFrame, rated: DataFrame) -> DataFrame:
    """One row for each target: wished and actual share, tokens and copies taken, and whether it can be reached.

    ``largest_text`` is the source's longest text as a part of the target: how far the
    tokens of a source with few, long texts may miss it.
    """
    taken = mixed.groupBy("mix_name", "source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("tokens"),
        F.sum("copies").alias("copies"),
        F.max("copies").alias("most"),
    )
    whole = taken.groupBy("mix_name").agg(F.sum("tokens").alias("mix_tokens"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("tokens", "copies", "most")}
    rows = rated.drop("reached").join(taken, ["mix_name", "source"], "left").join(whole, "mix_name", "left").withColumns(zero)
    actual = F.coalesce(F.try_divide(F.col("tokens").cast("double"), F.col("mix_tokens")), F.lit(0.0))
    at_most = F.coalesce(F.col("copies") >= F.col("max_repeats") * F.col("source_texts"), F.lit(False))
    reached = ~(at_most & (F.col("tokens") < F.col("target_tokens")))
    return rows.select(
        "mix_name", F.col("name").alias("source"), "target_share", actual.alias("actual_share"), "target_tokens", "tokens", "copies", F.col("most").alias("most_copies"), "max_repeats",
        F.coalesce(F.try_divide(F.col("largest_text").cast("double"), F.col("target_tokens")), F.lit(0.0)).alias("largest_text"), reached.alias("reached"),
    )


def invariants(reported: DataFrame) -> DataFrame:
    """``mix_name``, ``source``, ``within_repeats``, ``near_target``, ``reached`` of each target.

    A target is near if the tokens taken are no further from it than four of the source's
    longest texts, or fall short with every text taken as often as allowed.
    """
    within = F.coalesce(F.col("most_copies") <= F.col("max_repeats"), F.lit(True))
    off = F.abs(F.col("tokens") - F.col("target_tokens")) <= 4 * F.col("largest_text") * F.col("target_tokens") + 1e-6
    return reported.select("mix_name", "source", within.alias("within_repeats"), (off | ~F.col("reached")).alias("near_target"), "reached")
