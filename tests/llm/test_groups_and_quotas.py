"""Problems 1 and 3 against brute force, and their edge cases."""

import random

from docweave.llm import quotas, splits
from tests.conftest import rows

SPLIT = "test_id string, selection_stratum string, kie_split string, contributor_id string, seller_tax_id string, base_document_id string, label string, group_test_id string, size int"


def table(spark, data):
    # The last columns clash with names used inside; they must not matter.
    return spark.createDataFrame([(*r, "x", "y", 3) for r in data], SPLIT)


def test_groups(spark):
    data = [
        ("A", "s", "development", "ctr-01", "0123456789", None), ("B", "s", " Held_Out", "CTR 01", None, "n/a"), ("C", "s", None, "unknown", "MST: 0123456789-002", "-"),
        ("D", "s", "held_out", "N/A", "0000000000", ""), ("E", "s", "validation", "none", "0000000000", " "), ("B", "s", " Held_Out", "CTR 01", None, "n/a"), ("F", None, "development", None, "01 2345 6780", "bd-9"), ("G", None, "DEVELOPMENT", None, None, "BD_9"), (None, "s", "x", "ctr-01", None, None),
    ]
    assigned = splits.assign(splits.records(table(spark, data)))
    assert rows(splits.straddling(assigned)) == {("A", "A"), ("B", "A"), ("C", "A")}
    got = {r["test_id"]: r["group_test_id"] for r in assigned.collect()}
    assert got == {"A": "A", "B": "A", "C": "A", "D": "D", "E": "E", "F": "F", "G": "F"}


def test_components_of_a_long_chain(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("z1", "z2"), ("z2", "z1"), ("z1", "z1")]
    random.Random(2).shuffle(chain)
    got = {r["node"]: r["root"] for r in splits.components(spark.createDataFrame(chain, "a string, b string")).collect()}
    assert set(got[f"n{i:03d}"] for i in range(1, 61)) == {"n000"} and got["z2"] == "z1"


def test_hot_key_proportions_and_seed(spark):
    draw = random.Random(3)
    data = [(f"T{i:04d}", draw.choice(["a", "b"]), None, "hot" if i < 130 else f"c{draw.randrange(150)}", None, None) for i in range(400)]
    assigned = splits.assign(splits.records(table(spark, data)), seed=5)
    got = assigned.toPandas()
    assert got.groupby("group_test_id")["split"].nunique().max() == 1 and len(got) == 400
    share = got["split"].value_counts(normalize=True)
    assert abs(share["development"] - 0.5) < 0.03 and abs(share["held_out"] - 0.4) < 0.03
    again = splits.assign(splits.records(table(spark, data).repartition(7)), seed=5)
    assert rows(again.select("test_id", "split")) == rows(assigned.select("test_id", "split"))
    report = splits.report(assigned).collect()
    assert sum(r["records"] for r in report) == 400


def test_no_records(spark):
    assigned = splits.assign(splits.records(table(spark, [])))
    assert assigned.count() == 0 and splits.straddling(assigned).count() == 0


def test_flow_is_cheapest():
    arcs = [("s", "a", 3, 0.0), ("s", "b", 2, 0.0), ("a", "x", 2, 1.0), ("a", "y", 5, 4.0), ("b", "x", 2, 2.0), ("b", "t", 9, 50.0), ("x", "t", 2, 0.0), ("y", "t", 5, 0.0)]
    flow = quotas.min_cost_flow(arcs, "s", "t")
    assert flow[6] + flow[7] + flow[5] == 5
    assert sum(f * c for f, (*_, c) in zip(flow, arcs, strict=True)) == 2 * 2 + 3 * 4.0


MANIFEST = "test_id string, selection_stratum string, quality_label_manual string, label string, other string"
POOL = "candidate_id string, heuristic_group string, pool_split string, id string"
TARGETS = "plan_name string, label_column string, category string, target_share double, min_count int, sample_fraction double"


def quota_tables(spark, n=40):
    manifest = [(f"T{i}", ["Big one", "big_one", "BIG-ONE", None][i % 4], ["good", "poor"][i % 2], "l", "o") for i in range(n)] + [("T0", "Big one", "good", "l", "o")]
    pool = [(f"C{i}", "rare" if i < 2 else "general", "train", "z") for i in range(n)]
    targets = [("p", "selection_stratum", "big_one", 0.5, 1, 0.5), ("p", "selection_stratum", "absent", 0.5, 1, 0.5), ("q", "heuristic_group", "rare", 0.1, 3, 0.2), ("q", "heuristic_group", "general", 0.9, 1, 0.5), ("e", "quality_label_manual", "good", 0.5, 1, 1.0)]
    return spark.createDataFrame(manifest, MANIFEST), spark.createDataFrame(pool, POOL), spark.createDataFrame(targets, TARGETS)


def test_quota_report_and_sample(spark):
    tables = quota_tables(spark)
    got = {(r["plan_name"], r["category"]): (r["wanted"], r["available"], r["shortfall"]) for r in quotas.report(*tables).collect()}
    # 40 records, 30 labelled big one, 20 good; a target that is met exactly is met.
    assert got == {("p", "big_one"): (10, 30, 0), ("p", "absent"): (10, 0, 10), ("q", "rare"): (3, 2, 1), ("q", "general"): (18, 38, 0), ("e", "good"): (20, 20, 0)}
    drawn = quotas.sample(*tables).collect()
    assert len(drawn) == len({(r["plan_name"], r["id"]) for r in drawn}) == 10 + 2 + 18 + 20
    assert {(r["plan_name"], r["id"]) for r in drawn} == {(r["plan_name"], r["id"]) for r in quotas.sample(*tables).collect()}
    assert {(r["plan_name"], r["id"]) for r in drawn} != {(r["plan_name"], r["id"]) for r in quotas.sample(*tables, seed=99).collect()}


def test_quota_of_empty_tables(spark):
    manifest, pool, targets = quota_tables(spark)
    got = {r["category"]: r["shortfall"] for r in quotas.report(manifest.limit(0), pool.limit(0), targets).collect()}
    assert got == {"big_one": 1, "absent": 1, "rare": 3, "general": 1, "good": 1}
    assert quotas.sample(manifest.limit(0), pool.limit(0), targets).count() == 0
    assert quotas.report(manifest, pool, targets.limit(0)).count() == 0


