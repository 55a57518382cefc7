"""Sources, sinks and the extraction plan on hand-authored files."""

import hashlib
import json

import pytest

from docweave.plans import extract as plan
from docweave.sources import evidence, files


def _block(i, text, x, y, width=0.1):
    return {"block_id": f"b{i}", "text": text, "confidence": 0.9, "reading_order": i, "polygon": [{"x": x, "y": y}, {"x": x + width, "y": y}, {"x": x + width, "y": y + 0.01}, {"x": x, "y": y + 0.01}]}


PAGE = [
    ("Mẫu số: 01GTKT0/001", 0.05, 0.02), ("Ngày: 21-04-2026", 0.05, 0.05), ("Số hóa đơn", 0.05, 0.08), ("0012", 0.3, 0.081), ("Tiền tệ: VND", 0.05, 0.11), ("Tên hàng", 0.05, 0.3), ("SL", 0.5, 0.3), ("Thành tiền", 0.8, 0.301),
    ("Bút bi", 0.05, 0.34), ("2", 0.5, 0.34), ("1.000", 0.8, 0.34), ("Giấy A4", 0.05, 0.38), ("1", 0.501, 0.381), ("2.500", 0.799, 0.38), ("Cộng tiền hàng: 3.500", 0.05, 0.6), ("Tiền thuế: 350", 0.05, 0.64), ("Tổng thanh toán: 3.851", 0.05, 0.68),
]


@pytest.fixture(scope="module")
def cells(spark):
    payload = json.dumps({"ocr_run_id": "r", "engine": {"name": "e"}, "blocks": [_block(i, *b) for i, b in enumerate(PAGE)]})
    runs = spark.createDataFrame([("r", payload), ("r", payload), ("bad", payload[:90])], "run_id string, payload string")
    return plan.extract(evidence.flatten(runs)).cache()


def test_header(cells):
    got = {r["field"]: (r["normalized_value"], r["value_status"]) for r in cells.where("section = 'header'").collect()}
    assert got == {"invoice_template_number": ("01GTKT0/001", "PRESENT"), "invoice_date": ("2026-04-21", "PRESENT"), "invoice_number": ("0012", "PRESENT"), "currency": ("VND", "PRESENT"), "subtotal": ("3500", "PRESENT"), "tax_amount": ("350", "PRESENT"), "total_amount": ("3851", "PRESENT")}


def test_lines(cells):
    got = {(r["row_index"], r["field"]): r["normalized_value"] for r in cells.where("section = 'line'").collect()}
    assert got == {(1, "description"): "Bút bi", (1, "quantity"): "2", (1, "amount"): "1000", (2, "description"): "Giấy A4", (2, "quantity"): "1", (2, "amount"): "2500"}


def test_consistency(cells):
    got = {r["check"]: (r["status"], int(r["difference"])) for r in plan.consistency(cells).collect()}
    assert got == {"line_sum_subtotal": ("PASS", 0), "subtotal_tax_total": ("PASS", -1)}


def test_manifest(spark, tmp_path):
    good = tmp_path / "m.csv"
    good.write_text("id,split\na,dev\nb,test\n")
    assert files.read_manifest(spark, str(good), ["id", "split"], "id", {"split": ["dev", "test"]}).count() == 2
    for body in ("id,split\n", "id,split\na,dev\na,dev\n", "id,split\na,other\n", "id,x\na,dev\n"):
        bad = tmp_path / f"{hashlib.md5(body.encode()).hexdigest()}.csv"
        bad.write_text(body)
        with pytest.raises(ValueError):
            files.read_manifest(spark, str(bad), ["id", "split"], "id", {"split": ["dev", "test"]})


def test_artifacts(spark, tmp_path):
    root = tmp_path / "root"
    root.mkdir()
    (root / "a.bin").write_bytes(b"one")
    digest = hashlib.sha256(b"one").hexdigest()
    manifest = spark.createDataFrame([("a.bin", digest.upper()), ("b.bin", digest), ("../a.bin", digest)], "path string, sha256 string")
    assert {r["path"]: r["status"] for r in files.verify_artifacts(manifest, str(root)).collect()} == {"a.bin": "OK", "b.bin": "MISSING", "../a.bin": "ESCAPES"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "=x"), (2, 'a"b')], "id int, v string")
    files.write_once(df, str(tmp_path / "once"))
    with pytest.raises(Exception, match="already exists"):
        files.write_once(df, str(tmp_path / "once"))
    files.write_tables({"t": df}, str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out/t"), header=True, escape='"')
    assert sorted(r["v"] for r in back.collect()) == ["'=x", 'a"b']
    files.write_report(df.limit(1), str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report")).count() == 1
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts/R1.txt").write_text("a\nb")
    assert [tuple(r) for r in files.read_texts(spark, str(tmp_path / "texts")).collect()] == [("R1", "a\nb")]
