"""The extraction plan on hand-made pages: roles, tables, currencies, continuations and groupings."""

import json

import pytest

from docweave.plans import extract as plan
from docweave.sources import evidence


def page(blocks):
    made = []
    for i, (text, x, y, *more) in enumerate(blocks):
        width, confidence = [*more, 0.1, 0.9][:2] if len(more) == 2 else ([*more, 0.9] if more else [0.1, 0.9])
        corners = [(x, y), (x + width, y), (x + width, y + 0.01), (x, y + 0.01)]
        made.append({"block_id": f"b{i}", "text": text, "confidence": confidence, "reading_order": i, "polygon": [{"x": a, "y": b} for a, b in corners]})
    return made


def run(spark, *pages, grouping="nearest"):
    data = [(f"d{i}", json.dumps({"ocr_run_id": f"d{i}", "engine": {"name": "e"}, "blocks": page(p)})) for i, p in enumerate(pages)]
    return plan.extract(evidence.flatten(spark.createDataFrame(data, "run_id string, payload string")), grouping=grouping)


INVOICE = [
    ("HÓA ĐƠN GIÁ TRỊ GIA TĂNG", 0.3, 0.01, 0.3), ("Ngày", 0.3, 0.03, 0.04), ("21 tháng", 0.345, 0.03, 0.05), ("04 năm 2026", 0.4, 0.03, 0.06),
    ("Đơn vị bán hàng: Công ty Một", 0.05, 0.06, 0.4), ("Mã số thuế: 0101234567", 0.05, 0.075, 0.3), ("Địa chỉ: 12 Lê Lợi,", 0.05, 0.09, 0.3), ("Phường 1, Đà Lạt", 0.052, 0.102, 0.3),
    ("Khách hàng: Bà Hai", 0.05, 0.13, 0.3), ("Mã số thuế: 0307654321", 0.05, 0.145, 0.3),
    ("Số hóa đơn", 0.6, 0.06, 0.1), ("AB-12", 0.72, 0.061, 0.05),
    ("Tên hàng", 0.05, 0.3), ("ĐVT", 0.4, 0.3), ("SL", 0.5, 0.3), ("Đơn giá", 0.65, 0.3), ("Thành tiền", 0.85, 0.3),
    ("Bút bi", 0.05, 0.32), ("cây", 0.4, 0.32), ("2", 0.5, 0.32), ("1.000", 0.65, 0.32), ("2.000", 0.85, 0.32), ("màu xanh", 0.05, 0.334),
    ("Giấy", 0.05, 0.36), ("1", 0.5, 0.36), ("500", 0.65, 0.36), ("5", 0.85, 0.36, 0.03), ("00", 0.89, 0.36, 0.03),
    ("Cộng tiền hàng: 2.500", 0.6, 0.42, 0.2), ("Tiền thuế GTGT: 250", 0.6, 0.44, 0.2), ("Tổng cộng: 2.750", 0.6, 0.46, 0.2),
    ("Thuế suất", 0.05, 0.5), ("Tiền tính thuế", 0.4, 0.5), ("Tiền thuế", 0.7, 0.5), ("10%", 0.05, 0.52), ("2.500", 0.4, 0.52), ("250", 0.7, 0.52),
    ("Ký tên", 0.05, 0.6, 0.3),
]
DOLLARS = [
    ("INVOICE", 0.3, 0.1), ("Acme Trading Limited", 0.05, 0.02, 0.3), ("of Singapore", 0.05, 0.033, 0.2), ("Tax Code: 12345", 0.05, 0.05, 0.2), ("To: Bob", 0.05, 0.14, 0.2), ("Invoice Date: 3 March 2026", 0.05, 0.17, 0.3),
    ("Total: 1,234.50", 0.05, 0.3, 0.2), ("Currency: USD", 0.05, 0.33, 0.2), ("Beneficiary: Acme", 0.05, 0.7, 0.3), ("Address: 1 Bank Street", 0.05, 0.72, 0.3),
]


@pytest.fixture(scope="module")
def cells(spark):
    return run(spark, INVOICE, DOLLARS).cache()


def header(cells, doc):
    return {r["field"]: r for r in cells.where(f"section = 'header' and run_id = '{doc}'").collect()}


def test_roles_and_chains(cells):
    got = header(cells, "d0")
    value = lambda f: got[f]["normalized_value"]
    assert value("seller_name") == "Công ty Một" and value("buyer_name") == "Bà Hai"
    assert (value("seller_tax_id"), value("buyer_tax_id")) == ("0101234567", "0307654321")
    assert value("seller_address") == "12 Lê Lợi, Phường 1, Đà Lạt" and value("invoice_number") == "AB-12"
    assert value("invoice_date") == "2026-04-21"
    # Dong is inferred from title and grouped total, and reviewed.
    assert value("currency") == "VND" and got["currency"]["review_reasons"] == ["AMBIGUOUS_FORMAT"]
    assert (value("subtotal"), value("tax_amount"), value("total_amount")) == ("2500", "250", "2750")


def test_lines_and_taxes(cells):
    got = {(r["section"], r["row_index"], r["field"]): r for r in cells.where("section <> 'header' and run_id = 'd0'").collect()}
    assert got["line", 1, "description"]["raw_text"] == "Bút bi\nmàu xanh" and got["line", 1, "description"]["review_reasons"] == ["AMBIGUOUS_FORMAT"]
    assert [got["line", 1, f]["normalized_value"] for f in ("unit", "quantity", "unit_price", "amount")] == ["cây", "2", "1000", "2000"]
    assert got["line", 2, "amount"]["value_status"] == "AMBIGUOUS" and "MULTIPLE_CANDIDATES" in got["line", 2, "amount"]["review_reasons"]
    assert [got["tax", 1, f]["normalized_value"] for f in ("rate", "taxable_amount", "tax_amount")] == ["10%", "2500", "250"]
    assert max(r for s, r, _ in got if s == "line") == 2


def test_dollars_letterhead_and_bank(cells):
    got = header(cells, "d1")
    assert got["seller_name"]["normalized_value"] == "Acme Trading Limited of Singapore" and got["seller_name"]["review_reasons"] == ["SOURCE_ROLE_UNCLEAR"]
    assert got["total_amount"]["normalized_value"] == "1234.50" and got["seller_tax_id"]["normalized_value"] == "12345"
    assert got["buyer_name"]["normalized_value"] == "Bob" and got["invoice_date"]["normalized_value"] == "2026-03-03"
    assert "seller_address" not in got


def test_completed_and_consistency(spark, cells):
    whole = plan.completed(cells, cells.select("run_id"))
    assert whole.where("section = 'header'").count() == 26 and whole.where("section = 'line'").count() == 10
    (unit,) = whole.where("section = 'line' and row_index = 2 and field = 'unit'").collect()
    assert (unit["value_status"], unit["review_reasons"], unit["block_ids"]) == ("UNKNOWN", ["NO_CANDIDATE"], [])
    got = {(r["run_id"], r["check"]): r["status"] for r in plan.consistency(cells).collect()}
    # One amount is unclear; dollar documents are not checked.
    assert got == {("d0", "line_sum_subtotal"): "SKIPPED", ("d0", "subtotal_tax_total"): "PASS", ("d1", "line_sum_subtotal"): "SKIPPED", ("d1", "subtotal_tax_total"): "SKIPPED"}


def test_interval_grouping(spark):
    heads = [("Tên hàng / dịch vụ", 0.05, 0.3, 0.3), ("SL", 0.36, 0.3, 0.14), ("Đơn giá", 0.5, 0.3, 0.2), ("Thành tiền", 0.71, 0.3, 0.2), ("Tiền tệ", 0.05, 0.1), ("VND", 0.3, 0.1)]
    # The amount is right-aligned: nearer the next heading's left edge than its own centre.
    data = [("Bút", 0.05, 0.32), ("2", 0.47, 0.32, 0.02), ("1.000", 0.66, 0.32, 0.03), ("2.000", 0.86, 0.32, 0.04)]
    got = {r["field"]: r["normalized_value"] for r in run(spark, heads + data, grouping="interval").where("section = 'line'").collect()}
    assert got == {"description": "Bút", "quantity": "2", "unit_price": "1000", "amount": "2000"}
    with pytest.raises(ValueError, match="grouping"):
        run(spark, heads, grouping="other")


def test_nothing(spark):
    assert run(spark, []).count() == 0
