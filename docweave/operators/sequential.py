"""Operators whose steps depend on the step before: folds and matchings, one document at a time.

They run as grouped functions on Arrow tables, read as plain lists; a document is the unit,
so partitions hold many and none is larger than a document.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame


def _kinds(df: DataFrame, *columns: str) -> str:
    """The DDL of columns of ``df``."""
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def match_rows(edges: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Largest one-to-one matching of ``row_a`` to ``row_b`` in each document.

    ``edges`` has ``shared``, the strength of a pair.  Rows are placed in order; each
    prefers its strongest partner, then the first; a taken partner is freed if its owner
    can move (augmenting paths), so the number of matched rows is the largest possible.
    """

    def run(group: pa.Table) -> pa.Table:
        wishes: dict[int, list[int]] = {}
        shared, row_b, row_a = (group.column(c).to_pylist() for c in ("shared", "row_b", "row_a"))
        for _, b, a in sorted(zip([-s for s in shared], row_b, row_a, strict=True)):
            wishes.setdefault(a, []).append(b)
        owner: dict[int, int] = {}
        held: dict[int, int] = {}
        for a in sorted(wishes):
            # Iterative search for a free partner; came[b] is the row that asked for b.
            came: dict[int, int] = {}
            stack, end = [(a, iter(wishes[a]))], None
            while stack and end is None:
                row, rest = stack[-1]
                for b in rest:
                    if b in came:
                        continue
                    came[b] = row
                    if b not in owner:
                        end = b
                    else:
                        stack.append((owner[b], iter(wishes[owner[b]])))
                    break
                else:
                    stack.pop()
            while end is not None:
                row = came[end]
                freed = held.get(row)
                owner[end], held[row] = row, end
                end = freed
        rows = sorted((a, b) for b, a in owner.items())
        ids = group.column(doc).slice(0, len(rows))
        return pa.table({doc: ids, "row_a": pa.array([a for a, _ in rows], pa.int64()), "row_b": pa.array([b for _, b in rows], pa.int64())})

    return edges.select(doc, "row_a", "row_b", "shared").groupBy(doc).applyInArrow(run, f"{_kinds(edges, doc)}, row_a long, row_b long")


def anchored_rows(blocks: DataFrame, doc: str = "doc_id", key: str = "ix", least: float = 0.35) -> DataFrame:
    """``visual_row`` of each block: it joins the row whose *first* block overlaps it vertically.

    Blocks are taken from top to bottom and left to right; of several rows that fit, the
    one whose first block's top is nearest wins.  The extent of a row never grows, so rows
    that end more than the greatest height above a block are not looked at again.
    """

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("top_y", "ascending"), ("left_x", "ascending"), (key, "ascending")])
        tops, bottoms = group.column("top_y").to_pylist(), group.column("bottom_y").to_pylist()
        anchors: list[tuple[int, int]] = []
        rows, first = [], 0
        highest = max([0, *[b - t for t, b in zip(tops, bottoms, strict=True)]])
        for top, bottom in zip(tops, bottoms, strict=True):
            while first < len(anchors) and anchors[first][0] + highest < top:  # tops only grow
                first += 1
            near = enumerate(anchors[first:], first)
            fitting = [(abs(top - t), i) for i, (t, b) in near if min(bottom, b) - max(top, t) >= least * min(bottom - top, b - t)]
            if fitting:
                rows.append(min(fitting)[1])
            else:
                anchors.append((top, bottom))
                rows.append(len(anchors) - 1)
        return pa.table({doc: group.column(doc), key: group.column(key), "visual_row": pa.array(rows, pa.int64())})

    return blocks.select(doc, key, "top_y", "bottom_y", "left_x").groupBy(doc).applyInArrow(run, f"{_kinds(blocks, doc, key)}, visual_row long")


def continuation_chain(blocks: DataFrame, doc: str = "doc_id", key: str = "ix", gap: float = 1.1, shift: int = 20) -> DataFrame:
    """``head``: the block a block continues, following left-aligned blocks below with small gaps.

    Each block extends the chain whose *last* block ends above it within ``gap`` heights
    and starts within ``shift`` of it; otherwise it heads a chain.
    """

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("top_y", "ascending"), ("left_x", "ascending"), (key, "ascending")])
        keys, lefts, tops, bottoms = (group.column(c).to_pylist() for c in (key, "left_x", "top_y", "bottom_y"))
        tails: list[list[int]] = []  # head, left, bottom, height
        heads = []
        highest = max([0, *[b - t for t, b in zip(tops, bottoms, strict=True)]])
        for k, left, top, bottom in zip(keys, lefts, tops, bottoms, strict=True):
            tails = [t for t in tails if top - t[2] <= gap * highest]  # the others end too far above all that follow
            fitting = [(top - t[2], abs(left - t[1]), i) for i, t in enumerate(tails) if 0 <= top - t[2] <= gap * t[3] and abs(left - t[1]) <= shift]
            if fitting:
                tail = tails[min(fitting)[2]]
                tail[1:] = [left, bottom, bottom - top]
                heads.append(tail[0])
            else:
                tails.append([k, left, bottom, bottom - top])
                heads.append(k)
        return pa.table({doc: group.column(doc), key: group.column(key), "head": pa.array(heads, pa.int64())})

    return blocks.select(doc, key, "top_y", "bottom_y", "left_x").groupBy(doc).applyInArrow(run, f"{_kinds(blocks, doc)}, {key} long, head long")


def compare_and_set(events: DataFrame, key: str, order: str, expected: str) -> DataFrame:
    """``accepted`` and ``version``: an event is accepted if it expects the current version, which it then raises."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        version, accepted, versions = 0, [], []
        for wanted in pdf[expected]:
            accepted.append(bool(wanted == version))
            version += accepted[-1]
            versions.append(version)
        return pd.DataFrame({key: pdf[key], order: pdf[order], "accepted": accepted, "version": versions})

    return events.select(key, order, expected).groupBy(key).applyInPandas(run, f"{_kinds(events, key, order)}, accepted boolean, version long")
