"""Problem 3: a sample that matches target shares, with floors, and a report of what cannot be met.

Method: for each plan a min-cost flow over the cross-classified cell counts.  The source
feeds each target category what it needs (its share or its floor, whichever is more); a
category feeds the cells it is made of - its label crossed with a second label - up to
their availability; cells feed the second label's margins, which are wished targets too:
the shares the second label has among all records of the plan's categories.  Slack arcs
expose what cannot be had: one from a category past its cells, at a high cost, takes what
no record can fill - the shortfall; one from a second label, at a lower cost, takes what
goes beyond its margin.  So records are exchanged between cells of different categories
until both margins fit, which no sort by one label does.  The unit costs of the cells are
drawn at random from the seed, so the integer quotas are drawn randomly.  The records of a
cell are then taken in hash order up to its quota.

Only cell counts reach the driver.  The second label counts by ``CLASSES`` hash classes,
exactly and whatever its values, so the cells are bounded by the targets times ``CLASSES``
(two values that fall into one class share a margin).  A cell that holds a third of all
rows is cut at a hash value found from counts, never sorted as a whole.

Defined results: rows repeated for a record count once; records without a label count in
the table's total and fill no target; label spelling does not matter; a plan over an empty
table needs its floors; categories the data lack are available 0 times.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.text import label_key
from docweave.llm.common import earlier, once, share
from docweave.session import cut

#: Hash classes of the second label's values; null is a class of its own.
CLASSES = 256
#: Costs of a record short of a category's need, and of one beyond a second label's margin.
SHORT, BEYOND = 1_000_000, 10.0


def min_cost_flow(arcs: list[tuple[str, str, int, float]], source: str, sink: str) -> list[int]:
    """Flow on each ``(from, to, capacity, cost)`` arc of a largest flow at the least cost (successive shortest paths)."""
    names = sorted({n for a in arcs for n in a[:2]})
    place = {n: i for i, n in enumerate(names)}
    head = np.array([place[b] for _, b, _, _ in arcs for _ in (0, 1)])
    tail = np.array([place[a] for a, _, _, _ in arcs for _ in (0, 1)])
    head[1::2], tail[1::2] = tail[0::2].copy(), head[0::2].copy()
    room = np.array([x for *_, c, _ in arcs for x in (c, 0)], dtype=np.int64)
    cost = np.array([x for *_, c in arcs for x in (c, -c)])
    s, t = place[source], place[sink]
    while True:
        dist, via = np.full(len(names), np.inf), np.full(len(names), -1)
        dist[s] = 0
        for _ in names:
            open_arcs = np.flatnonzero(room > 0)
            reach = dist[tail[open_arcs]] + cost[open_arcs]
            order = np.argsort(-reach, kind="stable")  # the cheapest way into a node is written last
            better = order[reach[order] < dist[head[open_arcs[order]]] - 1e-9]
            if not len(better):
                break
            dist[head[open_arcs[better]]] = reach[better]
            via[head[open_arcs[better]]] = open_arcs[better]
        if not np.isfinite(dist[t]):
            return [int(room[2 * i + 1]) for i in range(len(arcs))]
        path, node = [], t
        while node != s:
            path.append(via[node])
            node = tail[via[node]]
        most = min(room[e] for e in path)
        for e in path:
            room[e] -= most
            room[e ^ 1] += most


def _margins(held: dict[str, int], drawn: int) -> dict[str, int]:
    """``drawn`` divided in proportion to ``held``, rounded by largest remainder."""
    whole = sum(held.values())
    exact = {x: Fraction(drawn * n, whole) for x, n in held.items()} if whole else {}
    made = {x: int(e) for x, e in exact.items()}
    for x in sorted(exact, key=lambda x: (made[x] - exact[x], x))[: drawn - sum(made.values())]:
        made[x] += 1
    return made


def solve(targets: list[dict], cells: dict[tuple[str, str], int], total: int, seed: int) -> tuple[list[dict], dict[tuple[str, str], int]]:
    """Report rows and cell quotas of one plan; ``cells`` counts (label, second label)."""
    draw, arcs, needs = np.random.default_rng(seed), [], []
    by_label: dict[str, list[tuple[str, int]]] = {}
    for (label, other), n in sorted(cells.items()):
        by_label.setdefault(label, []).append((other, n))
    held: dict[str, int] = {}
    drawn = 0
    for t in targets:
        wish = Fraction(str(t["target_share"])) * Fraction(str(t["sample_fraction"])) * total
        needs.append(need := max(int(t["min_count"]), math.ceil(wish)))
        key, c = t["key"], f"c:{t['key']}"
        mine = by_label.get(key, [])
        whole = sum(n for _, n in mine)
        drawn += min(need, whole)
        arcs.append(("source", c, need, 0.0))
        arcs.append((c, "sink", need, float(SHORT)))
        for other, n in mine:
            held[other] = held.get(other, 0) + n
            # The even part of a cell is free; what exceeds it costs a random unit.
            even = min(n, need * n // max(whole, 1))
            arcs.append((c, f"x:{key}\x1f{other}", even, 0.0))
            arcs.append((c, f"x:{key}\x1f{other}", n - even, 1.0 + float(draw.random())))
            arcs.append((f"x:{key}\x1f{other}", f"o:{other}", n, 0.0))
    for other, margin in _margins(held, drawn).items():
        arcs.append((f"o:{other}", "sink", margin, 0.0))
        arcs.append((f"o:{other}", "sink", held[other], BEYOND))
    flow = min_cost_flow(arcs, "source", "sink") if arcs else []
    quotas: dict[tuple[str, str], int] = {}
    short: dict[str, int] = {}
    for (a, b, _, _), f in zip(arcs, flow, strict=True):
        if a.startswith("c:") and b == "sink":
            short[a[2:]] = f
        elif a.startswith("c:"):
            cell = tuple(b[2:].split("\x1f"))
            quotas[cell] = quotas.get(cell, 0) + f
    rows = []
    for t, need in zip(targets, needs, strict=True):
        available = sum(n for _, n in by_label.get(t["key"], []))
        missing = short[t["key"]]
        rows.append({"plan_name": t["plan_name"], "category": t["category"], "wanted": need, "available": available, "drawn": need - missing, "shortfall": missing})
    return rows, quotas


def _tables(manifest: DataFrame, pool: DataFrame) -> dict[str, DataFrame]:
    """``id``, ``label``, ``other`` by label column: the table it stands in, crossed with a second label."""
    def rows(df: DataFrame, key: str, label: str, other: str) -> DataFrame:
        keyed = df.select(F.col(key).alias("id"), label_key(F.col(label)).alias("label"), label_key(F.col(other)).alias("other"))
        return once(keyed, "id", "label", "other")

    return {
        "selection_stratum": rows(manifest, "test_id", "selection_stratum", "quality_label_manual"),
        "quality_label_manual": rows(manifest, "test_id", "quality_label_manual", "selection_stratum"),
        "heuristic_group": rows(pool, "candidate_id", "heuristic_group", "pool_split"),
    }


def _class(other: Column) -> Column:
    """The hash class of a second label, as text; empty for null."""
    return F.when(other.isNull(), "").otherwise(F.pmod(F.xxhash64(other), F.lit(CLASSES)).cast("string"))


def plan(manifest: DataFrame, pool: DataFrame, targets: DataFrame, seed: int = 20) -> tuple[list[dict], dict[str, tuple[DataFrame, dict[str, dict]]]]:
    """Report rows of all plans, and by label column its records and each plan's cell quotas."""
    wished = [r.asDict() for r in targets.withColumn("key", label_key(F.col("category"))).orderBy("plan_name", "category").collect()]  # fixed small table
    report, drawn = [], {}
    for column, records in _tables(manifest, pool).items():
        of_column = [t for t in wished if t["label_column"] == column]
        if not of_column:
            continue
        keys = sorted({t["key"] for t in of_column})
        records = cut(records)
        crossed = records.withColumn("other", _class(F.col("other")))
        counts = crossed.groupBy(F.when(F.col("label").isin(keys), F.col("label")).alias("label"), "other").count().collect()
        cells = {(r["label"], r["other"]): r["count"] for r in counts if r["label"] is not None}
        total = sum(r["count"] for r in counts)
        quotas = {}
        for i, name in enumerate(sorted({t["plan_name"] for t in of_column})):
            rows, quotas[name] = solve([t for t in of_column if t["plan_name"] == name], cells, total, seed + i)
            report += rows
        drawn[column] = (crossed, quotas)
    return report, drawn


REPORT = "plan_name string, category string, wanted long, available long, drawn long, shortfall long"


def report(manifest: DataFrame, pool: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each target: records wanted, available, drawn, and short."""
    rows, _ = plan(manifest, pool, targets)
    return targets.sparkSession.createDataFrame([tuple(r[c.split()[0]] for c in REPORT.split(", ")) for r in rows], REPORT)


def sample(manifest: DataFrame, pool: DataFrame, targets: DataFrame, seed: int = 20) -> DataFrame:
    """``plan_name``, ``id``, ``label`` of the drawn records: each cell's first ones in hash order, up to its quota."""
    spark = targets.sparkSession
    _, drawn = plan(manifest, pool, targets, seed)
    taken = None
    for records, quotas in drawn.values():
        slots = max(1, records.count() // 50_000)
        wanted = spark.createDataFrame([(p, a, b, n) for p, cells in quotas.items() for (a, b), n in cells.items() if n], "plan_name string, label string, other string, quota long")
        placed = records.withColumn("luck", share(F.col("id"), "quota", seed)).withColumn("slot", F.floor(F.col("luck") * slots))
        # How many records of the cell lie in earlier slots.
        slot_counts = placed.groupBy("label", "other", "slot").agg(F.count("*").alias("n"))
        asked = earlier(slot_counts, ["label", "other"], []).join(F.broadcast(wanted), ["label", "other"]).where("before < quota").select("plan_name", "label", "other", "slot", (F.col("quota") - F.col("before")).alias("left"))
        rows = placed.join(asked, ["label", "other", "slot"])
        order = Window.partitionBy("plan_name", "label", "other", "slot").orderBy("luck", "id")
        chosen = rows.withColumn("rank", F.row_number().over(order)).where("rank <= left").select("plan_name", "id", "label")
        taken = chosen if taken is None else taken.union(chosen)
    return taken if taken is not None else spark.createDataFrame([], "plan_name string, id string, label string")
