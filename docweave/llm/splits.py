"""Problem 1: splits in which records that share an author, seller or source stay together.

1. *Groups.*  Records and the keys they share form a graph; its connected components are
   found by alternating star contraction (large star, small star).  A key held by a third
   of all rows is a star around its smallest record from the start, so no key's records
   are ever listed in one place, and no links or components reach the driver.
2. *Component swap search.*  Every component starts in the split its hash falls into.
   Components larger than a fixed share of the whole - at most ``1 / LARGE`` of them - are
   arranged first, against the targets of the whole; the rest are spread over shards of
   bounded size, and each shard anneals on its own towards its share of what remains,
   moving and exchanging whole components to reduce the deviation of sizes and of label
   counts.  Several chains with different temperatures run for each shard, each as a task
   of its own; the best is kept.  The draws depend on ``seed`` alone, so the result is
   reproducible.  The steps grow with the components of a shard, so that every component
   is tried equally often whatever the input's size.

Labels are balanced by ``LABELS`` hash classes, counted exactly whatever the labels are, so
their counts are bounded (two labels that fall into one class are balanced together).

Defined results: null, blank and placeholder keys link nothing, so a record without keys
is a group of its own; rows repeated for a ``test_id`` count once; an empty table gives no
rows; other columns of the input are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import compact_key, label_key
from docweave.llm.common import share
from docweave.session import cut

#: The splits and their wished proportions.
PROPORTIONS = {"development": 0.5, "validation": 0.1, "held_out": 0.4}
# Spellings of a missing key, as compact_key writes them.
PLACEHOLDERS = ["na", "none", "null", "nil", "nan", "unknown", "unknowncontributor", "unknownseller", "unknownsource", "undefined", "missing", "notavailable", "tbd", "anonymous"]
#: Components above this share of all records are arranged on the whole.
LARGE = 1 / 500
#: Components for each shard of the search, its chains, and steps for each component.
SHARD, CHAINS, TRIES = 2_000, 3, 20
#: Hash classes of the labels.
LABELS = 512


def person_key(col: Column) -> Column:
    """A contributor or source key without separators; null for placeholders and all zeros."""
    key = compact_key(col)
    return F.when(~key.isin(PLACEHOLDERS) & ~F.rlike(key, F.lit(r"^0+$")), key)


def seller_key(col: Column) -> Column:
    """The ten digits of a tax id, without label and branch number; null for placeholders.

    A key without digits in that form counts as it stands.
    """
    digits = F.regexp_replace(col, r"^[^\d]+|[\s.\-_/]", "")
    number = F.nullif(F.regexp_extract(digits, r"^(\d{10})(?:\d{3})?\D*$", 1), F.lit(""))
    return person_key(F.coalesce(number, col))


def records(split_table: DataFrame) -> DataFrame:
    """``test_id``, ``label``, ``current`` split and ``keys`` of each delivery of a record."""
    keys = F.array_compact(F.array(
        F.concat(F.lit("c:"), person_key(F.col("contributor_id"))),
        F.concat(F.lit("s:"), seller_key(F.col("seller_tax_id"))),
        F.concat(F.lit("d:"), person_key(F.col("base_document_id"))),
    ))
    return split_table.where("test_id is not null").select("test_id", label_key(F.col("selection_stratum")).alias("label"), label_key(F.col("kie_split")).alias("current"), keys.alias("keys"))


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """``node``, ``root``: the smallest node of each connected component, from ``a``, ``b`` links.

    Alternates large-star and small-star steps until the links are stars; each step is one
    partial aggregation and one join, and the rows never exceed the links.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def large(e: DataFrame) -> DataFrame:
        around = both(e)
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        near = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        return near.union(least.select("a", F.col("m").alias("b"))).distinct()

    def state(e: DataFrame) -> tuple:
        links = F.xxhash64("a", "b"), F.xxhash64("b", "a", F.lit(1))
        return tuple(e.agg(F.count("*"), *[F.sum(x.cast("decimal(38,0)")) for x in links]).first())

    links = cut(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = state(links)
    for _ in range(most):
        links = cut(small(large(links)))
        after = state(links)
        if after == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after
    raise RuntimeError(f"components did not settle in {most} rounds")


def grouped(rows: DataFrame) -> DataFrame:
    """One row a record with ``group_test_id``, the smallest ``test_id`` linked directly or through others.

    The keys of all deliveries of a record link it.
    """
    held = rows.select("test_id", F.explode("keys").alias("key")).distinct()
    hubs = held.groupBy("key").agg(F.min("test_id").alias("hub"))
    links = held.join(hubs, "key").select(F.col("test_id").alias("a"), F.col("hub").alias("b"))
    roots = components(links).withColumnRenamed("node", "test_id")
    once = rows.groupBy("test_id").agg(F.min("label").alias("label"), F.min("current").alias("current"))
    return once.join(roots, "test_id", "left").withColumn("group_test_id", F.coalesce("root", "test_id")).drop("root")


def _search(sizes: list[float], labels: list[dict[int, float]], start: list[int], goal: list[float], goal_labels: list[list[float]], seed: int, chain: int) -> tuple[list[int], float]:
    """Splits for components and their energy, by one chain of moves and exchanges of whole components.

    ``labels`` has the label counts of each component, ``goal`` the wished records of each
    split and ``goal_labels`` those of each label in it.  The energy is the squared
    deviation of sizes and of label counts, each scaled by its goal.
    """
    n, k, kinds = len(sizes), len(goal), max(1, len(goal_labels[0]) if goal_labels else 1)
    scale = [1 / max(g, 1.0) for g in goal]
    scale_labels = [[1 / max(g, 1.0) / kinds for g in row] for row in goal_labels]
    draw, at = np.random.default_rng([seed, chain]), list(start)
    size, count = [0.0] * k, [[0.0] * len(row) for row in goal_labels]
    for i, s in enumerate(at):
        size[s] += sizes[i]
        for x, m in labels[i].items():
            count[s][x] += m
    now = sum((size[s] - goal[s]) ** 2 * scale[s] for s in range(k))
    now += sum((c - g) ** 2 * w for a, b, d in zip(count, goal_labels, scale_labels, strict=True) for c, g, w in zip(a, b, d, strict=True))
    best, since = now, []  # the moves since the best state, to be taken back at the end
    steps = TRIES * n
    heat, cold = max(now, 1e-9) * (0.02 * 4.0**-chain), (1e-4) ** (1 / max(steps, 1))
    first, second = draw.integers(0, n, steps).tolist(), draw.integers(0, n, steps).tolist()
    target, exchange, luck = draw.integers(0, k, steps).tolist(), (draw.random(steps) < 0.5).tolist(), draw.random(steps).tolist()
    for i in range(steps):
        heat *= cold
        x = first[i]
        a, y = at[x], second[i] if exchange[i] else -1
        b = at[y] if y >= 0 else target[i]
        if a == b:
            continue
        moved, kinds_moved = sizes[x], dict(labels[x])
        if y >= 0:
            moved -= sizes[y]
            for c, m in labels[y].items():
                kinds_moved[c] = kinds_moved.get(c, 0.0) - m
        # (v + d)^2 - v^2 = d * (2 v + d), of both splits
        change = moved * ((moved - 2 * (size[a] - goal[a])) * scale[a] + (moved + 2 * (size[b] - goal[b])) * scale[b])
        for c, m in kinds_moved.items():
            change += m * ((m - 2 * (count[a][c] - goal_labels[a][c])) * scale_labels[a][c] + (m + 2 * (count[b][c] - goal_labels[b][c])) * scale_labels[b][c])
        if change <= 0 or luck[i] < math.exp(-change / max(heat, 1e-12)):
            since.append((x, a))
            at[x] = b
            if y >= 0:
                since.append((y, b))
                at[y] = a
            size[a] -= moved
            size[b] += moved
            for c, m in kinds_moved.items():
                count[a][c] -= m
                count[b][c] += m
            now += change
            if now < best - 1e-9:
                best, since = now, []
    for x, was in reversed(since):
        at[x] = was
    return at, best


def _arrange(pdf: pd.DataFrame, shares: np.ndarray, label_shares: dict[int, np.ndarray], whole: float | None, totals: dict[int, float], seed: int, chain: int) -> tuple[pd.DataFrame, float]:
    """Split numbers for the components of ``pdf``, which has ``size``, ``labels`` and ``luck`` for each, and the energy.

    The goals are ``shares`` of the records at hand - or of ``whole`` - and ``label_shares``
    of each label's - or of its ``totals``; labels without shares of their own take ``shares``.
    """
    pdf = pdf.sort_values("group_test_id", kind="stable").reset_index(drop=True)
    kinds = sorted({x["label"] for m in pdf["labels"] for x in m})
    place = {x: i for i, x in enumerate(kinds)}
    labels = [{place[x["label"]]: float(x["n"]) for x in m} for m in pdf["labels"]]
    have = [0.0] * len(kinds)
    for m in labels:
        for x, n in m.items():
            have[x] += n
    sizes = [float(x) for x in pdf["size"]]
    wished = [totals.get(x, have[i]) if totals else have[i] for i, x in enumerate(kinds)]
    goal = [float(s * (sum(sizes) if whole is None else whole)) for s in shares]
    goal_labels = [[float(label_shares.get(x, shares)[s] * wished[i]) for i, x in enumerate(kinds)] for s in range(len(shares))]
    start = np.searchsorted(np.cumsum(shares)[:-1], pdf["luck"].to_numpy(float), side="right").tolist()
    done, energy = _search(sizes, labels, start, goal, goal_labels, seed, chain)
    return pd.DataFrame({"group_test_id": pdf["group_test_id"], "at": done}), energy


def _rest(wished: np.ndarray, taken: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
    """The shares in which what is left goes to the splits."""
    lack = np.maximum(wished - taken, 0)
    return lack / lack.sum() if lack.sum() > 0 else otherwise


def assign(rows: DataFrame, proportions: dict[str, float] | None = None, seed: int = 20) -> DataFrame:
    """``rows`` (see :func:`records`) with ``group_test_id``, ``n_current``, ``start`` and ``split``.

    ``n_current`` is the number of different current splits in the record's group, ``start``
    the split its group's hash falls into, from which the search starts.
    """
    proportions = proportions or PROPORTIONS
    names, shares = list(proportions), np.array(list(proportions.values())) / sum(proportions.values())
    known = cut(grouped(rows))
    kind = F.when(F.col("label").isNull(), -1).otherwise(F.pmod(F.xxhash64("label"), F.lit(LABELS))).cast("int")
    per_label = known.groupBy("group_test_id", kind.alias("label")).agg(F.count("*").alias("n"))
    parts = per_label.groupBy("group_test_id").agg(F.sum("n").alias("size"), F.collect_list(F.struct("label", "n")).alias("labels"))
    spans = known.groupBy("group_test_id").agg(F.count_distinct("current").alias("n_current"))
    parts = cut(parts.join(spans, "group_test_id").withColumn("luck", share(F.col("group_test_id"), "split", seed)))
    total, count = parts.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    limit = max(2, int(total * LARGE))
    # At most 1 / LARGE components are larger than the limit; label classes are at most LABELS + 1.
    large = [r.asDict(recursive=True) for r in parts.where(F.col("size") > limit).select("group_test_id", "size", "labels", "luck").collect()]
    by_kind = parts.select(F.inline("labels")).groupBy("label").agg(F.sum("n").alias("n")).collect()
    totals = {r["label"]: float(r["n"]) for r in by_kind}
    fixed, taken, taken_labels = None, np.zeros(len(names)), {x: np.zeros(len(names)) for x in totals}
    if large:
        tried = [_arrange(pd.DataFrame(large), shares, {}, float(total), totals, seed, chain) for chain in range(CHAINS)]
        fixed = min(tried, key=lambda t: t[1])[0]
        placed = dict(zip(fixed["group_test_id"], fixed["at"], strict=True))
        for c in large:
            taken[placed[c["group_test_id"]]] += c["size"]
            for x in c["labels"]:
                taken_labels[x["label"]][placed[c["group_test_id"]]] += x["n"]
    left = _rest(shares * total, taken, shares)
    left_labels = {x: _rest(shares * n, taken_labels[x], left) for x, n in totals.items()}
    shards = max(1, -(-count // SHARD))

    def chain_search(pdf: pd.DataFrame) -> pd.DataFrame:
        shard, chain = int(pdf["shard"].iloc[0]), int(pdf["chain"].iloc[0])
        done, energy = _arrange(pdf, left, left_labels, None, {}, seed + shard, chain)
        return done.assign(shard=shard, chain=chain, energy=energy)

    rest = parts.where(F.col("size") <= limit).withColumn("shard", F.pmod(F.xxhash64("group_test_id", F.lit(seed)), F.lit(shards)))
    chains = rest.drop("n_current").withColumn("chain", F.explode(F.array(*map(F.lit, range(CHAINS)))))
    searched = cut(chains.groupBy("shard", "chain").applyInPandas(chain_search, "group_test_id string, at int, shard long, chain int, energy double"))
    best = searched.groupBy("shard").agg(F.min(F.struct("energy", "chain"))["chain"].alias("chain"))
    chosen = searched.join(best, ["shard", "chain"]).select("group_test_id", "at")
    if fixed is not None:
        chosen = chosen.union(known.sparkSession.createDataFrame(list(fixed.itertuples(index=False, name=None)), "group_test_id string, at int"))
    bounds = np.cumsum(shares)[:-1].tolist()
    start = sum((F.when(F.col("luck") >= b, 1).otherwise(0) for b in bounds), F.lit(0))
    named = lambda at: F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))
    placed = chosen.join(parts.select("group_test_id", "n_current", named(start).alias("start")), "group_test_id").withColumn("split", named(F.col("at")))
    return known.join(placed, "group_test_id").select("test_id", "label", "current", "group_test_id", "n_current", "start", "split")


def report(assigned: DataFrame, proportions: dict[str, float] | None = None, column: str = "split") -> DataFrame:
    """``split``, ``records``, ``groups``, ``share``, ``target`` and the largest label deviation of each split."""
    proportions = proportions or PROPORTIONS
    rows = assigned.select("group_test_id", "label", F.col(column).alias("split"))
    cells = rows.groupBy("split", "label").agg(F.count("*").alias("n"))
    total = rows.count()
    sizes = rows.groupBy("split").agg(F.count("*").alias("records"), F.count_distinct("group_test_id").alias("groups"))
    overall = cells.groupBy("label").agg(F.sum("n").alias("all"))
    held = cells.join(overall, F.equal_null(cells["label"], overall["label"])).select("split", "n", "all").join(sizes, "split")
    off = F.abs(F.col("n") / F.col("records") - F.col("all") / F.lit(max(total, 1)))
    deviation = held.groupBy("split").agg(F.max(off).alias("label_deviation"))
    wished = F.create_map(*[F.lit(x) for s, p in proportions.items() for x in (s, p / sum(proportions.values()))])
    return sizes.join(deviation, "split").select("split", "records", "groups", (F.col("records") / F.lit(max(total, 1))).alias("share"), wished[F.col("split")].alias("target"), "label_deviation")


def invariants(assigned: DataFrame) -> DataFrame:
    """One row on what a good assignment holds.

    ``records``, ``groups``, ``divided`` (groups in more than one split), ``on_target`` (no
    share is further from its target than the largest group or a hundredth) and ``improved``
    (sizes and labels deviate no more than from the hashed start).
    """
    rows = cut(assigned)
    per = rows.groupBy("group_test_id").agg(F.count_distinct("split").alias("splits"), F.count("*").alias("n"))
    counted = per.agg(F.sum("n").alias("records"), F.count("*").alias("groups"), F.count_if(F.col("splits") > 1).alias("divided"), F.max("n").alias("largest"))
    off = lambda name: F.max(F.abs(F.col("share") - F.col("target"))).alias(name)
    after = report(rows).agg(off("off"), F.max("label_deviation").alias("label_off"))
    before = report(rows, column="start").agg(off("off_before"), F.max("label_deviation").alias("label_off_before"))
    # Three tables of one row each.
    one = [df.withColumn("k", F.lit(1)) for df in (counted, after, before)]
    joined = one[0].join(one[1], "k").join(one[2], "k")
    on_target = F.col("off") <= F.greatest(F.lit(0.01), F.col("largest") / F.col("records"))
    improved = F.col("off") + F.col("label_off") <= F.col("off_before") + F.col("label_off_before")
    return joined.select("records", "groups", "divided", on_target.alias("on_target"), improved.alias("improved"))


def straddling(assigned: DataFrame) -> DataFrame:
    """``test_id``, ``group_test_id`` of records whose group stands in two or more current splits."""
    return assigned.where("n_current >= 2").select("test_id", "group_test_id")
