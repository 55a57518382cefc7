"""Relational operators on hand-made rows."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from docweave.operators import governance, layout, metrics, ranking, sequential, store, text_metrics
from tests.conftest import rows


def test_zero_denominators(spark):
    df = spark.createDataFrame([(1, "f", "UNKNOWN", "PRESENT", None, "x", False)], "sample_id int, field string, gs string, ps string, gv string, pv string, reviewed boolean")
    made = metrics.header_metrics(df, ["field"]).first()
    assert made["total"] == 1 and made["scored"] == 0 and made["precision"] is None and made["f1"] is None
    assert metrics.decision_metrics(df.where("false"), "field").count() == 0
    assert metrics.ratio0(F.lit(0), F.lit(0)) is not None


def test_failed_input_stays(spark):
    gold = spark.createDataFrame([(1, "f", "PRESENT", "a"), (2, "f", "PRESENT", "b")], "sample_id int, field string, gs string, gv string")
    pred = spark.createDataFrame([(1, "f", "PRESENT", "a", False)], "sample_id int, field string, ps string, pv string, reviewed boolean")
    made = metrics.header_metrics(metrics.with_failures(gold, pred), ["field"]).first()
    assert (made["scored"], made["correct"], made["recall"]) == (2, 1, 0.5)


def _best(edges):
    """Largest matching by trying all."""
    best = 0
    for n in range(len(edges), 0, -1):
        for pick in itertools.combinations(edges, n):
            if len({a for a, _ in pick}) == len({b for _, b in pick}) == n:
                return n
    return best


def test_matching_is_largest(spark):
    draw, data, expected = random.Random(1), [], {}
    for doc in range(25):
        edges = {(draw.randrange(4), draw.randrange(4)) for _ in range(draw.randrange(1, 9))}
        expected[doc] = _best(sorted(edges))
        data += [(doc, a, b, draw.randrange(1, 3)) for a, b in edges]
    got = sequential.match_rows(spark.createDataFrame(data, "doc_id long, row_a long, row_b long, shared long")).collect()
    for doc, n in expected.items():
        mine = [(r["row_a"], r["row_b"]) for r in got if r["doc_id"] == doc]
        assert len(mine) == n and len({a for a, _ in mine}) == len({b for _, b in mine}) == n
        assert set(mine) <= {(a, b) for d, a, b, _ in data if d == doc}


def test_matching_prefers_overlap(spark):
    edges = spark.createDataFrame([(1, 0, 0, 1), (1, 0, 1, 5), (1, 1, 1, 9)], "doc_id long, row_a long, row_b long, shared long")
    assert rows(sequential.match_rows(edges)) == {(1, 0, 0), (1, 1, 1)}


def test_anchor_does_not_grow(spark):
    boxes = [(1, 0, 0, 10, 0), (1, 1, 6, 16, 100), (1, 2, 12, 22, 200)]
    df = spark.createDataFrame(boxes, "doc_id long, ix long, top_y long, bottom_y long, left_x long")
    got = {r["ix"]: r["visual_row"] for r in sequential.anchored_rows(df).collect()}
    assert got[0] == got[1] and got[2] != got[0]


def test_shuffled_input_gives_the_same(spark, small):
    from docweave.queries.fixtures import blocks

    df = blocks(spark, small).where("doc_id <= 20")
    assert rows(sequential.anchored_rows(df)) == rows(sequential.anchored_rows(df.orderBy(F.rand(3)).repartition(3)))


def test_compare_and_set(spark):
    events = spark.createDataFrame([(1, 1, 0), (1, 2, 0), (1, 3, 1), (2, 1, 1)], "k long, o long, e long")
    got = {(r["k"], r["o"]): r["accepted"] for r in sequential.compare_and_set(events, "k", "o", "e").collect()}
    assert got == {(1, 1): True, (1, 2): False, (1, 3): True, (2, 1): False}


def test_overlay_null_correction_wins(spark):
    cells = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    fixes = spark.createDataFrame([(1, None)], "id int, c string")
    assert {(r["id"], r["effective"], r["reviewed"]) for r in store.overlay(cells, fixes, ["id"], "v", "c").collect()} == {(1, None, True), (2, "b", False)}


def test_page_limits(spark):
    with pytest.raises(ValueError):
        store.page(spark.range(3), [F.asc("id")], 0, 0)
    assert [r[0] for r in store.page(spark.range(9), [F.desc("id")], 2, 3).collect()] == [5, 4]


def test_weights(spark):
    with pytest.raises(ValueError):
        ranking.weighted({"a": F.lit(1.0)}, {"a": 0.5})


def test_margin_same_role(spark):
    df = spark.createDataFrame([(1, 0, 2, 9), (1, 1, 1, 8), (1, 2, 2, 4)], "d int, ix int, role int, score int")
    made = ranking.margins(ranking.rank(df, ["d"], F.desc("role"), F.desc("score"), F.asc("ix")), ["d"], "role", "score", 10).first()
    assert made["margin"] == 5 and made["competitor"]


def test_spatial_join_is_complete(spark, small):
    from docweave.queries.fixtures import blocks

    a = blocks(spark, small).where("doc_id <= 30").select("doc_id", "ix", "left_x", "top_y", "right_x", "bottom_y")
    b = a.withColumn("top_y", F.col("top_y") + 9).withColumn("bottom_y", F.col("bottom_y") + 9)
    banded = rows(layout.spatial_join(a, b, "doc_id", 7).select("doc_id", "ix", "o_ix"))
    plain = a.join(layout.prefixed(b, "o_", ["doc_id"]), "doc_id").where(layout.iou() > 0).select("doc_id", "ix", "o_ix")
    assert banded == rows(plain)


def test_word_edits(spark):
    df = spark.createDataFrame([("a b c", "a c"), ("", "x"), ("a b", "b a"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(text_metrics.word_edits()("a", "b")).collect()] == [1, 1, 2, None]


def test_violations_and_gaps(spark):
    df = spark.createDataFrame([(1, 0), (1, 2), (2, 0), (2, 1)], "d int, i int")
    assert rows(governance.violations(df, ["d", "i"], {"big": F.col("i") > 1})) == {(1, 2, "big")}
    assert [r["d"] for r in governance.contiguous(df, "d", "i").collect()] == [1]


def test_polygons(spark):
    from docweave.sources import evidence

    pts = [(0.9, 0.1), (0.9, 0.5), (0.1, 0.5), (0.1, 0.1)]
    df = spark.createDataFrame([([{"x": x, "y": y} for x, y in pts],)], "p array<struct<x:double,y:double>>")
    made = df.select(evidence.ordered_polygon(F.col("p")).alias("o"), governance.signed_area(evidence.ordered_polygon(F.col("p"))).alias("a")).first()
    assert [tuple(p) for p in made["o"]] == [(0.1, 0.1), (0.9, 0.1), (0.9, 0.5), (0.1, 0.5)] and abs(made["a"] - 0.32) < 1e-9
    turned = spark.range(1).select(evidence.unrotated(F.lit(0.2), F.lit(0.3), F.lit(90)).alias("q")).first()["q"]
    assert (turned["x"], turned["y"]) == (0.3, 0.8)


def test_character_edits_by_bits(spark):
    """The bit form against the plain matrix and against the JVM, near and far, with and without common ends."""
    import random

    from docweave.operators import text_metrics

    draw = random.Random(6)
    word = lambda n: "".join(draw.choice("abcế 𝄞") for _ in range(n))
    pairs = [(word(draw.randrange(90)), word(draw.randrange(90))) for _ in range(60)] + [("", ""), ("", "abc"), ("abc", ""), ("a" * 200, "b" * 70), ("xx" + "a" * 80 + "yy", "xx" + "b" * 75 + "yy")]
    for a, b in pairs:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        assert text_metrics._character_edits(a, b) == row[-1]
    df = spark.createDataFrame([*pairs, (None, "a"), ("a", None)], "a string, b string")
    edits, length = text_metrics.character_errors(F.col("a"), F.col("b"))
    for r in df.select("a", "b", edits.alias("e"), length.alias("n")).collect():
        if r["a"] is None or r["b"] is None:
            assert r["e"] is None
        else:
            a, b = " ".join(r["a"].split()), " ".join(r["b"].split())
            assert (r["e"], r["n"]) == (text_metrics._character_edits(a, b), len(a))
