"""Label words of invoices, and the patterns made of them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, folded: words that introduce a header field.
HEADER = {
    "invoice_template_number": ["mau so", "invoice template", "invoice template number"],
    "invoice_symbol": ["ky hieu", "invoice symbol", "serial"],
    "invoice_number": [
        "so hoa don", "so phieu", "sophieu", "s phieu", "sphieu", "invoice number", "invoice no", "invoice no.",
        "so", "so (no)", "so (no.)", "so(no)", "so(no.)",
    ],
    "invoice_date": ["ngay lap", "ngay lap hoa don", "ngay hoa don", "invoice date", "date", "ngay"],
    "seller_name": ["don vi ban hang", "ten don vi ban hang", "nguoi ban", "ten nguoi ban", "ben ban", "ten ben ban", "seller", "seller name"],
    "buyer_name": [
        "nguoi mua", "nguoi mua hang", "ho ten nguoi mua", "ho ten nguoi mua hang", "don vi mua hang", "ten don vi mua hang",
        "ben mua", "ten ben mua", "buyer", "buyer name", "khach hang", "bill to",
    ],
    "seller_tax_id": ["ma so thue nguoi ban", "ma so thue ben ban", "mst nguoi ban", "mst ben ban", "seller tax id", "seller tax code"],
    "buyer_tax_id": ["ma so thue nguoi mua", "ma so thue ben mua", "mst nguoi mua", "mst ben mua", "buyer tax id", "buyer tax code"],
    "seller_address": ["dia chi nguoi ban", "dia chi ben ban", "seller address"],
    "subtotal": ["cong tien hang", "tien hang", "tong truoc thue", "tong tien truoc thue", "tam tinh", "subtotal", "sub total"],
    "tax_amount": ["tong tien thue", "tong tien thue gtgt", "tien thue", "tien thue gtgt", "tax amount", "total tax", "vat amount"],
    "total_amount": ["tong cong", "tong cong tien thanh toan", "tong tien thanh toan", "tong thanh toan", "grand total", "total", "total amount"],
    "currency": ["don vi tien te", "loai tien", "currency"],
}
# Further words of the same kind, met in documents.
MORE = {"seller_name": ["don vi ban", "ten don vi ban"], "currency": ["tien te"]}
# Fixed values, folded: words that do so only before a colon; those of the second group also alone.
BEFORE_COLON = {"buyer_name": ["to"]}
BEFORE_COLON_OR_END = {"total_amount": ["tong"]}
# Fixed values, folded: words that introduce a part of whichever party is meant.
PARTY = {
    "tax_id": ["ma so thue", "mst", "tax id", "tax code", "taxid", "taxcode"],
    "address": ["dia chi", "address", "d c", "d c.", "dc", "dc."],
    "name": ["ten don vi", "company name"],
}
# Fixed values, folded: headings of line tables.
LINE = {
    "description": [
        "ten hang", "ten hang hoa", "ten hang dich vu", "ten hang, dich vu", "ten hang hoa dich vu", "ten hang hoa, dich vu", "mat hang",
        "hang hoa", "hang hoa dich vu", "hang hoa, dich vu", "description", "item", "revenue sharing of service", "revenue sharing of the service",
    ],
    "unit": ["don vi tinh", "dvt", "unit"],
    "quantity": ["so luong", "sl", "quantity", "qty"],
    "unit_price": ["don gia", "gia", "unit price", "price"],
    "amount": ["thanh tien", "t tien", "ttien", "amount"],
}
# Fixed values, folded: further headings where columns are taken as intervals.
INTERVAL_DESCRIPTION = ["ten hang/dich vu", "ten hang / dich vu", "ten hang hoa/dich vu", "ten hang hoa / dich vu"]
# Fixed values, folded: headings of tax tables.
TAX = {
    "rate": ["thue suat", "thue suat gtgt", "tax rate", "vat"],
    "taxable_amount": ["tien tinh thue", "gia tri tinh thue", "taxable amount"],
    "tax_amount": ["tien thue", "tien thue gtgt", "tax amount"],
}
# Fixed values, folded: how a row starts that ends a table, and one that ends a line table read by intervals.
TABLE_END = r"^(?:tong sl\b|nguoi |ky ten|signature|ghi chu|notes?\b|chi dung de\b|cam on\b|thank you\b)"
INTERVAL_END = r"^thue suat(?: gtgt)?\s*[:：]"
# Fixed values, folded: company words, and how lines start that are no part of a name or address, or tell of a bank.
COMPANY = r"\b(?:company|corporation|limited|ltd|jsc)\b|^cong ty"
NO_LETTERHEAD = r"^(?:dt|tel|phone|attn)\b"
NO_CONTINUATION = r"^(?:attn|contract|invoice|bank|beneficiary|dt|tel)(?=\W|\d|$)"
BANK = r"^(?:please remit|beneficiary|bank\s*:)"
# How a line is marked that goes on with the one above, often repeating its end.
CARRIED = r"(?i)^\((?:tiếp(?: theo)?|tiep(?: theo)?|continued|cont\.)\)\s*"
# Currency marks.
CURRENCY = r"(?i)(?<![\p{L}\p{N}_])(?:VND|VNĐ|USD|EUR|GBP|JPY|CNY|đ)(?![\p{L}\p{N}_])|[₫$€¥]"
# Fixed values, folded: values that say there is none.
NONE = ["khong co", "khong ap dung", "n/a", "none"]


def pattern(words: list[str], colon: list[str] = (), colon_or_end: list[str] = ()) -> str:
    """A pattern of any of the words, longest first."""
    plain = lambda w: re.sub(r"([.()])", r"\\\1", w)
    made = [(w, plain(w)) for w in words] + [(w, plain(w) + r"(?=\s*:)") for w in colon] + [(w, plain(w) + r"(?=\s*:|$)") for w in colon_or_end]
    return "|".join(p for _, p in sorted(made, key=lambda x: (-len(x[0]), x[0])))


def header_patterns() -> dict[str, str]:
    """Patterns of the header fields."""
    return {f: pattern([*words, *MORE.get(f, [])], BEFORE_COLON.get(f, []), BEFORE_COLON_OR_END.get(f, [])) for f, words in HEADER.items()}


def patterns(table: dict[str, list[str]], **more: list[str]) -> dict[str, str]:
    """Patterns of a table of words, with ``more`` words for some fields."""
    return {f: pattern([*words, *more.get(f, [])]) for f, words in table.items()}


def labelled(text: Column, plain: Column, labels: dict[str, str]) -> Column:
    """``(size, field, rest)`` of the label a text starts with: the longest, then the last by name; size 0 without one.

    ``plain`` is the folded text.  The rest is cut from the text itself, which folding
    keeps in step: it maps each composed character to one.
    """
    size = lambda p: F.length(F.regexp_extract(plain, rf"^(?:{p})(?=[\s:#：]|\d|$)\s*[:#：]?\s*", 0))
    best = F.array_max(F.array(*[F.struct(size(p).alias("size"), F.lit(f).alias("field")) for f, p in sorted(labels.items())]))
    return F.struct(best["size"].alias("size"), F.when(best["size"] > 0, best["field"]).alias("field"), F.substring(text, best["size"] + 1, F.length(text)).alias("rest"))
