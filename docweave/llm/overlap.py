"""Problem 5: pictures of the evaluation records that also lie, exactly or almost, in the training rows.

Method: a weighted cosine join between the splits.  Every record has up to two vectors: one
of its content hash, one of its measures.  The terms of a measure vector are the cells its
point - the logarithms of the sides' ratio, either way up, and of the four measures - lies
in, in each of ``GRIDS`` grids that are shifted against each other by the tolerance.  Two
points that agree within the tolerance are parted by at most one grid in each of the five
coordinates, so they share at least ``GRIDS - 5`` terms.  A term's squared weight is
between 1 and 2 and falls with the number of training vectors that hold it, so agreeing
vectors have a cosine of at least ``THRESHOLD``: nothing is lost above it.

Both sides are pruned.  Terms are ordered from the rarest; of a vector only the first ones
are listed or probed, up to where what remains cannot reach the threshold with any vector
of the other side: neither by its residual norm nor by the largest weights the other side
can have on it.  A pair above the threshold then shares a listed and probed term.
Candidates get their exact dot product over both norms, and those at the threshold are held
against the tolerance itself.

Records with the same values are one vector, so a group of copies costs one and is expanded
only where pairs of records are asked for; :func:`linked` gives one row for each record
with its class and its number of links instead.

Defined results: without a hash there is no hash vector, and without all four measures and
both sides, all positive, no measure vector; repeated rows count once; nothing is dropped
for being frequent.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import label_key
from docweave.llm.common import once
from docweave.session import cut

MEASURES = ["brightness", "contrast", "sharpness", "illumination_range"]
#: Relative difference up to which measures and ratios agree.
TOLERANCE = 0.01
#: Shifted grids, each as wide as the tolerance times their number, and coordinates of a point.
GRIDS, SIDES = 8, 5
_REACH = -math.log(1 - TOLERANCE) + 1e-9
_SHIFT = _REACH * (1 + 1e-6)
#: Bounds of a squared weight.
LIGHT, HEAVY = 1.0, 2.0
#: Least cosine of agreeing vectors: all terms they share are light, all others heavy.
THRESHOLD = (GRIDS - SIDES) * LIGHT / ((GRIDS - SIDES) * LIGHT + SIDES * HEAVY) - 1e-9


def content_hash(col: Column) -> Column:
    """A hash's digits without a scheme label, blanks and letter case; null if there are none."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(col), r"^\s*sha-?256\s*[:=]\s*", ""), r"[^0-9a-f]", "")
    return F.nullif(plain, F.lit(""))


def features(df: DataFrame, key: str, *keep: str) -> DataFrame:
    """``id``, ``hash``, logarithms ``x`` of ratio and measures (null unless all are there), and ``keep``."""
    rows = once(df, key, "sha256", "width", "height", *MEASURES, *keep)
    ratio = F.abs(F.ln(F.col("height") / F.col("width")))
    positive = F.least(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("width", "height", *MEASURES)]) > 0
    logs = F.array(ratio, *[F.ln(F.col(m).cast("double")) for m in MEASURES])
    return rows.select(F.col(key).alias("id"), content_hash(F.col("sha256")).alias("hash"), F.when(positive, logs).alias("x"), *keep)


def _vectors(rows: DataFrame, side: int) -> DataFrame:
    """``side``, ``v``, ``hash``, ``x``: the different vectors of the records; ``v`` names one."""
    hashes = rows.where("hash is not null").select(_name("hash").alias("v"), "hash", F.lit(None).cast("array<double>").alias("x"))
    measures = rows.where("x is not null").select(_name("x").alias("v"), F.lit(None).cast("string").alias("hash"), "x")
    return hashes.union(measures).distinct().withColumn("side", F.lit(side))


def _name(column: str) -> Column:
    """The name of a record's hash or measure vector; null if it has none."""
    return F.unhex(F.md5(F.concat(F.lit(f"{column}:"), F.col(column) if column == "hash" else F.to_json(column))))


def _terms() -> Column:
    """Terms of a vector: its hash, or its cell in each of the shifted grids."""

    def cell(shift: Column) -> Column:
        moved = F.transform("x", lambda v: F.floor((v + shift * _SHIFT) / (GRIDS * _SHIFT)))
        return F.xxhash64(shift, moved)

    return F.when(F.col("hash").isNotNull(), F.array(F.xxhash64("hash"))).otherwise(F.transform(F.array(*[F.lit(float(i)) for i in range(GRIDS)]), cell))


def weighed(vectors: DataFrame) -> DataFrame:
    """``side``, ``v``, ``terms``, rarest first, and their squared ``norm``, of each vector.

    A term is ``(order, term)``; ``order`` is its squared weight, negative so that arrays sort
    from the rarest term.
    """
    postings = vectors.select("side", "v", F.explode(_terms()).alias("term"))
    held = postings.groupBy("term").agg(F.sum("side").alias("n"))
    weight = LIGHT + (HEAVY - LIGHT) / (1 + F.ln(F.greatest("n", F.lit(1)).cast("double")))
    weights = held.select("term", F.negate(weight).alias("order"))
    entries = F.array_sort(F.collect_list(F.struct("order", "term")))
    joined = postings.join(weights, "term")
    return joined.groupBy("side", "v").agg(entries.alias("terms"), F.negate(F.sum("order")).alias("norm"))


def _leading() -> Column:
    """The terms of a vector to list or probe.

    A term is left out if it and all after it add less to any dot product than the threshold
    asks for: by the largest weights they can meet (they count once, the other norm is at
    least that of a vector of light terms), or by their residual norm.
    """
    least = F.size("terms") * LIGHT
    enough = F.greatest(THRESHOLD * F.sqrt(F.col("norm") * least), THRESHOLD**2 * F.col("norm"))

    def rest(i: Column) -> Column:
        return F.aggregate(F.slice("terms", i + 1, F.lit(GRIDS)), F.lit(0.0), lambda s, t: s - t["order"])

    return F.transform(F.filter("terms", lambda t, i: rest(i) >= enough), lambda t: t["term"])


def candidates(full: DataFrame) -> DataFrame:
    """``v_a``, ``v_b``: vectors of side 0 and 1 that share a leading term (see :func:`weighed`)."""
    listed = full.select("side", "v", F.explode(_leading()).alias("term"))
    a = listed.where("side = 0").select(F.col("v").alias("v_a"), "term")
    b = listed.where("side = 1").select(F.col("v").alias("v_b"), "term")
    return a.join(b, "term").select("v_a", "v_b").distinct()


def vector_pairs(full: DataFrame) -> DataFrame:
    """``v_a``, ``v_b``, ``cosine`` of the candidates at the threshold."""
    side = lambda n, s: full.where(F.col("side") == n).select(*[F.col(c).alias(f"{c}_{s}") for c in ("v", "terms", "norm")])
    both = candidates(full).join(side(0, "a"), "v_a").join(side(1, "b"), "v_b")
    dot = F.aggregate(F.array_intersect("terms_a", "terms_b"), F.lit(0.0), lambda s, t: s - t["order"])
    return both.select("v_a", "v_b", (dot / F.sqrt(F.col("norm_a") * F.col("norm_b"))).alias("cosine")).where(F.col("cosine") >= THRESHOLD)


def agreeing(asked: DataFrame, known: DataFrame) -> DataFrame:
    """``v_a``, ``v_b``, ``by_hash``: vectors of ``asked`` and ``known`` that are the same picture (see :func:`features`)."""
    vectors = cut(_vectors(asked, 0).unionByName(_vectors(known, 1)))
    value = lambda n, s: vectors.where(F.col("side") == n).select(*[F.col(c).alias(f"{c}_{s}") for c in ("v", "hash", "x")])
    near = F.forall(F.arrays_zip(F.col("x_a").alias("p"), F.col("x_b").alias("q")), lambda z: F.abs(z["p"] - z["q"]) <= _REACH)
    same = F.coalesce(F.col("hash_a") == F.col("hash_b"), F.lit(False))
    pairs = vector_pairs(cut(weighed(vectors))).join(value(0, "a"), "v_a").join(value(1, "b"), "v_b")
    return pairs.where(same | F.coalesce(near, F.lit(False))).select("v_a", "v_b", same.alias("by_hash"))


def _members(rows: DataFrame, s: str) -> DataFrame:
    """``id``, ``hash`` and ``v`` of each record's vectors, named with the suffix ``s``."""
    return rows.select(F.col("id").alias(f"id_{s}"), F.col("hash").alias(f"hash_{s}"), F.explode(F.array_compact(F.array(_name("hash"), _name("x")))).alias(f"v_{s}"))


def overlaps(asked: DataFrame, known: DataFrame) -> DataFrame:
    """``id_a``, ``id_b``: records of ``asked`` and ``known`` that hold the same picture (see :func:`features`).

    Records with the same hash meet by it alone, so no pair is made twice.
    """
    asked, known = cut(asked), cut(known)
    pairs = cut(agreeing(asked, known))
    met = pairs.join(_members(asked, "a"), "v_a").join(_members(known, "b"), "v_b")
    once_only = F.col("by_hash") | F.coalesce(F.col("hash_a") != F.col("hash_b"), F.lit(True))
    return met.where(once_only).select("id_a", "id_b")


def linked(asked: DataFrame, known: DataFrame) -> DataFrame:
    """``id``, ``class_id``, ``links`` of every record of ``asked``: no pair of records is made.

    A class is the records with the same hash and measures, named by its smallest id;
    ``links`` is the number of records of ``known`` with the same picture.
    """
    asked, known = cut(asked), cut(known)
    pairs = agreeing(asked, known)
    classes = cut(asked.groupBy("hash", "x").agg(F.min("id").alias("class_id")))
    held = _members(known, "b").groupBy("v_b", "hash_b").agg(F.count("*").alias("n"))
    counted = pairs.join(held.groupBy("v_b").agg(F.sum("n").alias("n")), "v_b")
    by_class = _members(classes.withColumnRenamed("class_id", "id"), "a").join(counted, "v_a")
    # Of those met by measures, the ones with the same hash are met by it already.
    same = held.select("v_b", F.col("hash_b").alias("hash_a"), F.col("n").alias("same"))
    netted = by_class.join(same, ["v_b", "hash_a"], "left")
    links = F.col("n") - F.when(F.col("by_hash"), 0).otherwise(F.coalesce("same", F.lit(0)))
    total = netted.groupBy(F.col("id_a").alias("class_id")).agg(F.sum(links).alias("links"))
    named = classes.join(total, "class_id", "left").select(F.col("hash").alias("h"), F.col("x").alias("y"), "class_id", F.coalesce("links", F.lit(0)).alias("links"))
    return asked.join(named, F.equal_null("hash", "h") & F.equal_null("x", "y")).select("id", "class_id", "links")


def _sides(manifest: DataFrame, pool: DataFrame) -> tuple[DataFrame, DataFrame]:
    training = features(pool, "candidate_id", "pool_split").where(label_key(F.col("pool_split")) == "train").drop("pool_split")
    return features(manifest, "test_id"), training


def found(manifest: DataFrame, pool: DataFrame) -> DataFrame:
    """``test_id``, ``candidate_id`` of pictures that lie in the training rows of the pool."""
    return overlaps(*_sides(manifest, pool)).select(F.col("id_a").alias("test_id"), F.col("id_b").alias("candidate_id"))


def links(manifest: DataFrame, pool: DataFrame) -> DataFrame:
    """``test_id``, ``class_id``, ``links`` of every record of the manifest (see :func:`linked`)."""
    return linked(*_sides(manifest, pool)).withColumnRenamed("id", "test_id")


def report(counted: DataFrame, manifest: DataFrame, splits: DataFrame) -> DataFrame:
    """From :func:`links`: ``split``, ``source``, ``records``, ``overlapping``, ``pairs``: overlaps counted per evaluation split and source."""
    source = F.coalesce(F.nullif(F.regexp_extract("source_file", r"^(.*)/[^/]*$", 1), F.lit("")), F.lit(""))
    records = once(manifest, "test_id", "source_file").select("test_id", source.alias("source"))
    split = once(splits.withColumn("split", label_key(F.col("kie_split"))), "test_id", "split")
    held = counted.select("test_id", F.nullif("links", F.lit(0)).alias("n"))
    rows = records.join(split, "test_id", "left").join(held, "test_id", "left")
    return rows.groupBy("split", "source").agg(F.count("*").alias("records"), F.count("n").alias("overlapping"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"))
