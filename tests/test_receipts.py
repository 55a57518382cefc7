"""First-generation fields on hand-made receipts."""

import pytest

from docweave.plans import receipts

SCHEMA = "run_id string, block_id string, page int, reading_order int, text string, confidence double, left_x double, top_y double, right_x double, bottom_y double, evidence_confidence double"


def run(spark, *pages):
    rows = []
    for d, page in enumerate(pages):
        for i, (text, y, *confidence) in enumerate(page):
            c = confidence[0] if confidence else 0.9
            rows.append((f"d{d}", f"b{i}", 0, i, text, c, 0.1, y, 0.5, y + 0.02, c))
    return spark.createDataFrame(rows, SCHEMA)


def fields(spark, page):
    return {r["field"]: r for r in receipts.extract(run(spark, page)).collect()}


RECEIPT = [
    ("SIÊU THỊ BÌNH AN", 0.05), ("ĐỊA CHỈ: 12 LÊ LỢI", 0.09), ("PHƯỜNG 3, QUẬN 5", 0.12), ("ĐT: 0901234567", 0.15), ("SỐ HĐ", 0.2), ("HD-000123", 0.22), ("NGÀY BÁN: 08/09/2026", 0.3),
    ("Bánh mì 15.000", 0.5), ("THUẾ", 0.62), ("2.000 VND", 0.63), ("TỔNG CỘNG: 325.000 VND", 0.8), ("Cảm ơn", 0.95),
]


def test_a_clear_receipt(spark):
    got = fields(spark, RECEIPT)
    assert {f: (r["normalized_value"], r["value_status"]) for f, r in got.items()} == {
        "merchant_name": ("SIÊU THỊ BÌNH AN", "PRESENT"), "merchant_address": ("12 LÊ LỢI, PHƯỜNG 3, QUẬN 5", "PRESENT"), "invoice_id": ("HD-000123", "PRESENT"),
        "receipt_date": ("2026-09-08", "PRESENT"), "total_amount": ("325000", "PRESENT"),
    }
    assert got["invoice_id"]["block_ids"] == ["b4", "b5"] and got["invoice_id"]["raw_text"] == "SỐ HĐ\nHD-000123"
    assert got["total_amount"]["currency"] == "VND" and got["total_amount"]["block_ids"] == ["b9", "b10"]


def test_scores_by_hand(spark):
    rows = {(r["field"], r["value"]): r for r in receipts.candidates(run(spark, RECEIPT)).collect()}
    total = rows["total_amount", "325.000 VND"]
    assert (total["pattern_score"], total["context_score"], total["layout_score"]) == (1.0, 1.0, 1.0)
    assert total["score"] == pytest.approx(0.3 + 0.3 + 0.25 + 0.15 * 0.9)
    tax = rows["total_amount", "2.000 VND"]
    assert tax["context_score"] == 0.0 and rows["invoice_id", "HD-000123"]["pattern_score"] == 0.9
    # A bare amount counts only where a word for a total is near.
    assert ("total_amount", "15.000") not in rows
    assert rows["merchant_address", "12 LÊ LỢI\nPHƯỜNG 3, QUẬN 5"]["pattern_score"] == 1.0


@pytest.mark.parametrize(
    ("text", "field", "reason", "status"),
    [
        ("Date: 08/09/2026", "receipt_date", "AMBIGUOUS_FORMAT", "AMBIGUOUS"), ("Date: 19/08/26", "receipt_date", "UNSUPPORTED_TWO_DIGIT_YEAR", "AMBIGUOUS"), ("Date: 14/08", "receipt_date", "MISSING_DATE_COMPONENT", "AMBIGUOUS"),
        ("Total: 12 USD", "total_amount", "UNSUPPORTED_CURRENCY", "AMBIGUOUS"), ("Tổng cộng: -5.000 VND", "total_amount", "NEGATIVE_AMOUNT", "AMBIGUOUS"), ("Tổng cộng: 32O.000 VND", "total_amount", "NORMALIZATION_FAILED", "AMBIGUOUS"),
        ("Mã giao dịch: �GD12", "invoice_id", "NO_CANDIDATE", "UNKNOWN"), ("Invoice No: A�1", "invoice_id", "UNREADABLE_SOURCE", "UNREADABLE"), ("Xin chào quý vị", "merchant_name", "SOURCE_ROLE_UNCLEAR", "AMBIGUOUS"),
    ],
)
def test_reasons(spark, text, field, reason, status):
    r = fields(spark, [(text, 0.1)])[field]
    assert reason in r["review_reasons"] and r["value_status"] == status and r["normalized_value"] is None and r["machine_needs_review"]


def test_fallback_and_rivals(spark):
    got = fields(spark, [("Mã GD: T77", 0.4), ("Số hóa đơn: A1", 0.5, 0.1), ("Tổng cộng: 5.000 VND", 0.8), ("Tổng cộng: 6.000 VND", 0.85)])
    # A primary label wins over a better-read fallback; near rivals are both evidence.
    assert got["invoice_id"]["normalized_value"] == "A1"
    assert got["total_amount"]["value_status"] == "AMBIGUOUS" and "MULTIPLE_CANDIDATES" in got["total_amount"]["review_reasons"]
    assert got["total_amount"]["block_ids"] == ["b1", "b2", "b3"]


def test_no_text(spark):
    assert receipts.extract(run(spark, [])).count() == 0
    empty = fields(spark, [("", 0.1), (None, 0.2)])
    assert {r["value_status"] for r in empty.values()} == {"UNKNOWN"} and len(empty) == 5
