"""Column functions against Python."""

import unicodedata
import uuid

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docweave.functions import ids, normalize, text


def apply(spark, function, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(function(F.col("v"))).collect()]


TEXTS = [None, "", " a 　 b\n", "Đường Nguyễn", "Hóa", "MÃ SỐ", "\x1fa\x85b", "x" * 100_000]


def test_collapse_and_fold(spark):
    expected = [None if t is None else " ".join(t.split()) for t in TEXTS]
    assert apply(spark, text.collapse, TEXTS) == expected
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFD", " ".join(t.split()).lower()) if not unicodedata.combining(c)).replace("đ", "d")
    assert apply(spark, text.fold, TEXTS) == [None if t is None else plain(t) for t in TEXTS]


def test_nfc(spark):
    assert apply(spark, text.nfc, TEXTS) == [None if t is None else unicodedata.normalize("NFC", t) for t in TEXTS]


def test_keys(spark):
    assert apply(spark, text.label_key, [" Low-contrast ", "LOW_CONTRAST", "low  contrast", "", " - ", None]) == ["low_contrast"] * 3 + [None] * 3
    assert apply(spark, text.compact_key, ["ctr - 01", "CTR_01", "--", None]) == ["ctr01", "ctr01", None, None]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", max_codepoint=0x2FF, exclude_categories=("Cs", "Cn", "Co", "Mn", "Mc", "Me", "No", "Lo")), max_size=40), min_size=20, max_size=40))
def test_tokens(spark, values):
    import re

    assert apply(spark, text.token_count, values) == [len(re.findall(r"\w+|[^\w\s]+", v)) for v in values]


def test_safe_csv(spark):
    assert apply(spark, text.safe_csv, ["=1", " +2", "a=1", "-x", None, "@"]) == ["'=1", "' +2", "a=1", "'-x", None, "'@"]


def test_uuid5(spark):
    space = uuid.NAMESPACE_URL
    values = ["", "a|b", "é"]
    assert apply(spark, lambda c: ids.uuid5(space, c), values) == [str(uuid.uuid5(space, v)) for v in values]


def test_amounts(spark):
    values = ["1.234.567", "1,234 VND", "1 234 đ", "12345", "1.234,5", "VND 5 VND", "1.23", "-5", None, ""]
    assert [r["value"] for r in apply(spark, normalize.amount_vnd, values)] == ["1234567", "1234", "1234", "12345", None, None, None, None, None, None]
    assert [r["value"] for r in apply(spark, normalize.amount_usd, ["1,234.50", "USD 7", "12.345"])] == ["1234.50", "7.00", None]


def test_dates(spark):
    values = ["2026-02-31", "2026-2-3", "13/02/2026", "02/13/2026", "03/04/2026", "05/05/2026", "ngày 7 tháng 3 năm 2026", "3rd March 2026", "3 Mar. 2026", "1/2/26", None]
    assert [r["value"] for r in apply(spark, normalize.date, values)] == [None, "2026-02-03", "2026-02-13", "2026-02-13", None, "2026-05-05", "2026-03-07", "2026-03-03", "2026-03-03", None, None]


def test_other_normalizers(spark):
    assert [r["value"] for r in apply(spark, normalize.tax_id, ["0123456789", "01 2345-6789.123", "123", "MST 0123456789"])] == ["0123456789", "0123456789123", None, None]
    assert [r["value"] for r in apply(spark, normalize.rate, ["8 %", "7,5%", "KCT", "x"])] == ["8%", "7.5%", "KCT", None]
    assert [r["value"] for r in apply(spark, normalize.currency, ["VNĐ", "usd", "EUR"])] == ["VND", "USD", None]
    assert [r["value"] for r in apply(spark, normalize.quantity, ["1,5", "2", "1.000,5"])] == ["1.5", "2", None]
    assert [r["value"] for r in apply(spark, normalize.address, ["a  b\n\n c", "\n"])] == ["a b, c", None]
