"""Shredding of nested payloads against a plain reading of them."""

import json

from docweave.operators import shred
from docweave.queries import p6
from tests.conftest import rows

CELL = {"raw_text": "a", "predicted_value": "a", "normalized_value": 5, "value_status": "PRESENT", "score": 1}


def _cell(**more):
    return {**CELL, **more}


def _evidence(run, pages):
    return {"schema_version": "document-2.0", "ocr_run_id": run, "pages": pages}


RUNS = [
    ("o1", "ocr", json.dumps(_evidence("o1", [{"evidence": {"blocks": [{"block_id": "x", "text": "é"}, {"block_id": "y", "text": "q"}]}}, {"page_index": 7, "evidence": {"blocks": [{"block_id": "z", "text": None}]}}]))),
    ("o1", "ocr", json.dumps(json.dumps(_evidence("o1", [{"page_index": 0, "evidence": {"blocks": [{"block_id": "x", "text": "é"}, {"block_id": "y", "text": "q"}]}}, {"page_index": 7, "evidence": {"blocks": [{"block_id": "z"}]}}])))),
    ("o2", "ocr", json.dumps({"ocr_run_id": "o2", "blocks": [{"block_id": "x", "text": "w"}]})),
    ("o3", "ocr", '{"ocr_run_id": "o3", "blocks": [{"block_id": "x"'),
    ("k1", "kie", json.dumps({"kie_run_id": "k1", "source_ocr_run_id": "o1", "fields": {"a": _cell(source_block_ids=["x", None, "x"]), "b": _cell(source_block_ids="y", normalized_value=["5"]), "c": _cell(source_block_ids=None), "d": None},
                              "line_items": [{"line_id": "L", "source_block_ids": ["z"], "amount": _cell(source_block_ids=["z", "gone"])}, {"amount": _cell(source_block_ids=["x"]), "unit": None}], "tax_breakdown": [{"rate": _cell(source_block_ids=["y"])}]})),
    ("k2", "kie", json.dumps({"envelope": 1, "result": {"kie_run_id": "k2", "source_ocr_run_id": "o2", "fields": [_cell(field_name="a", source_block_ids=["x"])], "tax_breakdown": None}})),
    ("k3", "kie", None),
    ("k4", "kie", ""),
    ("k5", "kie", "[1, 2]"),
]
EXPECTED = {
    ("k1", "header", "", "a", "o1", 0, "x"), ("k1", "header", "", "b", "o1", 0, "y"), ("k1", "line", "L", "row", "o1", 7, "z"), ("k1", "line", "L", "amount", "o1", 7, "z"),
    ("k1", "line", "1", "amount", "o1", 0, "x"), ("k1", "tax", "0", "rate", "o1", 0, "y"), ("k2", "header", "", "a", "o2", 0, "x"),
}


def _write(spark, tmp_path, data):
    path = tmp_path / "machine_runs.parquet"
    # Extra columns with names the operator uses inside must not matter.
    spark.createDataFrame([(*r, "k", 1, None) for r in data], "run_id string, kind string, payload string, record string, node int, root string").write.parquet(str(path))
    return str(tmp_path)


def test_found(spark, tmp_path):
    assert rows(p6.found(spark, _write(spark, tmp_path, RUNS))) == EXPECTED


def test_cells_keep_value_text(spark, tmp_path):
    got = {(r["kie_run_id"], r["field"], r["row_id"]): r["normalized_value"] for r in p6.cells(spark, _write(spark, tmp_path, RUNS)).collect()}
    assert got["k1", "a", ""] == "5" and got["k1", "b", ""] == '["5"]' and got["k2", "a", ""] == "5"


def test_empty_and_unreadable(spark, tmp_path):
    folder = _write(spark, tmp_path, [r for r in RUNS if r[0] in ("o3", "k3", "k4")])
    assert p6.found(spark, folder).count() == p6.blocks(spark, folder).count() == p6.cells(spark, folder).count() == 0


def test_foreign_keys_hold(spark, tmp_path):
    folder = _write(spark, tmp_path, RUNS)
    runs = spark.read.parquet(f"{folder}/machine_runs.parquet").where("kind = 'kie'").select("run_id", "payload")
    graph = shred.infer(runs, "payload")
    assert sum("*" in p for r in graph.relations.values() for p in r.paths) == 0 or graph.relations
    tables = {n: shred.populate(runs, graph, n, "run_id", "payload") for n in graph.relations}
    nodes = set().union(*({r[0] for r in t.select("node_id").collect()} for n, t in tables.items() if not graph.relations[n].values))
    for t in tables.values():
        for r in t.select("node_id", "parent_id").collect():
            assert r["parent_id"] in nodes or r["node_id"] == r["parent_id"] or "/" not in r["parent_id"]


def test_against_tables(spark, small):
    """The small test tables, read plainly."""
    import pyarrow.parquet as pq

    def load(text):
        try:
            made = json.loads(text)
            return json.loads(made) if isinstance(made, str) else made
        except (TypeError, ValueError):
            return None

    table = pq.read_table(f"{small}/machine_runs.parquet").to_pylist()
    known = {}
    for r in table:
        if r["kind"] == "ocr" and (o := load(r["payload"])):
            pages = [(p["page_index"] if p.get("page_index") is not None else i, p.get("evidence") or {}) for i, p in enumerate(o["pages"])] if "pages" in o else [(0, o)]
            known.setdefault(o["ocr_run_id"], set()).update((i, b["block_id"]) for i, e in pages for b in e.get("blocks") or [])
    expected = set()
    for r in table:
        if r["kind"] != "kie" or (o := load(r["payload"])) is None:
            continue
        o = o.get("result", o)
        fields = o.get("fields") or {}
        cells = [("header", "", f, c) for f, c in ([(c["field_name"], c) for c in fields] if isinstance(fields, list) else fields.items())]
        for section, part in (("line", "line_items"), ("tax", "tax_breakdown")):
            for i, item in enumerate(o.get(part) or []):
                row = item.get("line_id", str(i)) if section == "line" else str(i)
                cells += [(section, row, "row", item), *((section, row, f, c) for f, c in item.items() if isinstance(c, dict))]
        for section, row, field, cell in cells:
            ids = (cell or {}).get("source_block_ids")
            for b in [ids] if isinstance(ids, str) else ids or []:
                expected |= {(o["kie_run_id"], section, row, field, o["source_ocr_run_id"], i, x) for i, x in known.get(o["source_ocr_run_id"], ()) if x == b}
    assert rows(p6.found(spark, small)) == expected


def test_maps_keyed_by_data_are_folded(spark):
    """Ids as member names and wide objects give wildcard paths, so the graph does not grow with the rows."""
    data = [(f"r{i}", json.dumps({"parts": {f"id-{i:05d}-{j}": {"name": f"n{j}", "qty": j} for j in range(2)}, "wide": {f"k{chr(97 + j // 26)}{chr(97 + j % 26)}": j for j in range(70)}})) for i in range(40)]
    runs = spark.createDataFrame(data, "run_id string, payload string")
    graph = shred.infer(runs, "payload")
    assert len(graph.kinds) < 12 and ("parts", shred.ANY, "name") in graph.kinds
    (name,) = [n for n, r in graph.relations.items() if "name" in r.columns]
    found = shred.populate(runs, graph, name, "run_id", "payload").collect()
    assert len(found) == 80 and {r["steps"][-1] for r in found if r["record"] == "r3"} == {"id-00003-0", "id-00003-1"}
    values = shred.populate(runs, graph, "wide_values", "run_id", "payload")
    assert values.count() == 40 * 70
