"""Normalisers of extracted text: each returns a struct ``(value, rule, failure)`` of strings.

They are JVM expressions that never repair what is printed: an unclear form gives a null
value and a failure code.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import collapse, fold

# Names of rules and failures, month names, and the printed forms the rules below accept.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _result(value: Column, rule: str | Column, failure: str = "NORMALIZATION_FAILED") -> Column:
    rule = F.lit(rule) if isinstance(rule, str) else rule
    return once(value, lambda v: F.struct(v.alias("value"), F.when(v.isNotNull(), rule).alias("rule"), F.when(v.isNull(), F.lit(failure)).alias("failure")))


def _full(col: Column, pattern: str) -> Column:
    return F.rlike(col, F.lit(f"^(?:{pattern})$"))


def amount_vnd(col: Column) -> Column:
    """Whole dong: plain digits or groups of three split by one kind of separator, with at most one currency mark at either end."""
    text = collapse(col)
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, r"(?i)^(?:vnd|vnđ|đ|₫)\s*", ""), r"(?i)\s*(?:vnd|vnđ|đồng|đ|₫)$", ""))
    both = F.rlike(text, F.lit(r"(?i)^(?:vnd|vnđ|đ|₫)")) & F.rlike(text, F.lit(r"(?i)(?:vnd|vnđ|đồng|đ|₫)$"))
    plain, grouped = _full(bare, r"\d+"), _full(bare, r"\d{1,3}(?:\.\d{3})+|\d{1,3}(?:,\d{3})+|\d{1,3}(?: \d{3})+")
    value = F.when(~both & (plain | grouped), F.regexp_replace(F.regexp_replace(bare, r"[., ]", ""), r"^0+(?=\d)", ""))
    return _result(value, F.when(plain, "vnd_plain_integer").otherwise("vnd_grouped_integer"))


def amount_usd(col: Column) -> Column:
    """Dollars with at most two decimals, groups split by commas, an optional code at either end."""
    bare = F.trim(F.regexp_replace(collapse(col), r"(?i)^usd\s*|\s*usd$", ""))
    value = F.when(_full(bare, r"(?:\d+|\d{1,3}(?:,\d{3})+)(?:\.\d{1,2})?"), F.regexp_replace(bare, ",", ""))
    return _result(F.try_to_number(value, F.lit("999999999999999D99")).cast("decimal(18,2)").cast("string"), "usd_explicit_decimal")


def date(col: Column) -> Column:
    """ISO date from year-first, unambiguous day-first or month-first, and worded dates; two-digit years are refused."""
    iso, dmy = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$", r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})$"
    words, english = r"^ngay (\d{1,2}) thang (\d{1,2}) nam (\d{4})$", r"^(\d{1,2})(?:st|nd|rd|th)? ([a-z]+)\.? (\d{4})$"
    join = lambda y, m, d: F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))

    def numeric(text: Column) -> Column:
        parts = [F.regexp_extract(text, dmy, i) for i in (1, 2, 3)]
        return once(F.array(*parts), lambda p: F.when((p[0].cast("int") > 12) | (p[0].cast("int") == p[1].cast("int")), join(p[2], p[1], p[0])).when(p[1].cast("int") > 12, join(p[2], p[0], p[1])))

    def worded(plain: Column) -> Column:
        name = F.regexp_extract(plain, english, 2)
        month = once(name, lambda n: F.coalesce(*[F.when(n.isin(m, m[:3]), F.lit(f"{i:02d}")) for i, m in enumerate(MONTHS, 1)]))
        return once(month, lambda m: F.when(m.isNotNull(), join(F.regexp_extract(plain, english, 3), m, F.regexp_extract(plain, english, 1))))

    def made(both: Column) -> Column:
        text, plain = both["text"], both["plain"]
        pick = lambda source, pattern, *order: join(*[F.regexp_extract(source, pattern, i) for i in order])
        return F.when(F.rlike(text, F.lit(iso)), pick(text, iso, 1, 2, 3)).when(F.rlike(text, F.lit(dmy)), numeric(text)).when(F.rlike(plain, F.lit(words)), pick(plain, words, 3, 2, 1)).when(F.rlike(plain, F.lit(english)), worded(plain))

    read = once(F.struct(collapse(col).alias("text"), fold(col).alias("plain")), made)
    return _result(once(read, lambda d: F.when(F.try_to_date(d, "yyyy-MM-dd").isNotNull(), d)), "calendar_date", "AMBIGUOUS_FORMAT")


def tax_id(col: Column, foreign: Column | None = None) -> Column:
    """Ten or thirteen digits, printed separators removed; five to twenty where ``foreign`` holds."""
    text = collapse(col)
    digits = F.regexp_replace(text, r"[ .\-]", "")
    printed, own = _full(text, r"[0-9 .\-]+"), F.length(digits).isin(10, 13)
    allowed = own if foreign is None else own | (F.coalesce(foreign, F.lit(False)) & F.length(digits).between(5, 20))
    return _result(F.when(printed & allowed, digits), F.when(own, "tax_id_printed_separators").otherwise("foreign_printed_taxcode"))


def money(col: Column, currency: Column) -> Column:
    """An amount in the document's currency: dong, dollars with cents, and no guess for any other or an unknown one."""
    unclear = lambda reason: F.struct(F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("rule"), F.lit(reason).alias("failure"))
    dong, dollar = amount_vnd(col), amount_usd(col)
    return F.when(currency == "VND", dong).when(currency == "USD", dollar).when(currency.isNull(), unclear("AMBIGUOUS_FORMAT")).otherwise(unclear("UNSUPPORTED_CURRENCY"))


def identifier(col: Column) -> Column:
    """An identifier that starts with a letter or digit and holds only those and ``._/-`` or blanks."""
    text = collapse(col)
    return _result(F.when(_full(text, r"[\p{L}\p{N}][\p{L}\p{N}._/ \-]*"), text), "identifier_safe")


def quantity(col: Column) -> Column:
    """A number without grouping, comma or dot as decimal sign."""
    text = collapse(col)
    return _result(F.when(_full(text, r"[0-9]+(?:[.,][0-9]+)?"), F.regexp_replace(text, ",", ".")), "quantity_decimal_no_grouping")


def rate(col: Column) -> Column:
    """A printed percentage or a printed exemption."""
    text = collapse(col)
    percent = _full(text, r"[0-9]+(?:[.,][0-9]+)?\s*%")
    exempt = fold(col).isin("kct", "khong chiu thue", "kkkt")
    value = F.when(percent, F.regexp_replace(F.regexp_replace(text, " ", ""), ",", ".")).when(exempt, text)
    return _result(value, F.when(percent, "printed_percent").otherwise("printed_tax_category"))


def currency(col: Column) -> Column:
    """VND or USD from an explicit mark."""
    value = F.when(fold(col).isin("vnd", "vndong", "d", "₫", "dong"), "VND").when(F.upper(collapse(col)) == "USD", "USD")
    return _result(value, F.when(value == "VND", "explicit_vnd_marker").otherwise("explicit_usd_code"), "UNSUPPORTED_CURRENCY")


def address(col: Column) -> Column:
    """Lines collapsed, empty ones dropped, joined by commas."""
    lines = F.filter(F.transform(F.split(col, r"\R"), collapse), lambda x: x != "")
    return _result(F.nullif(F.array_join(lines, ", "), F.lit("")), "address_lines")


#: Normaliser of each field.
FIELDS = {
    **dict.fromkeys(("total_amount", "subtotal", "tax_amount", "taxable_amount", "amount", "unit_price"), amount_vnd),
    **dict.fromkeys(("invoice_date", "receipt_date"), date),
    **dict.fromkeys(("seller_tax_id", "buyer_tax_id"), tax_id),
    **dict.fromkeys(("invoice_number", "invoice_symbol", "invoice_template_number", "invoice_id"), identifier),
    **dict.fromkeys(("seller_address", "merchant_address"), address),
    "quantity": quantity,
    "rate": rate,
    "currency": currency,
}


def name(col: Column) -> Column:
    """NFC-free white-space normalisation of a name."""
    return _result(F.nullif(collapse(col), F.lit("")), "nfc_whitespace")


def normalized(df: DataFrame, field: str, value: str, into: str, currency: str | None = None, raw: str | None = None) -> DataFrame:
    """``df`` with the struct of each field's normaliser in ``into``; unknown fields are names.

    With the column ``currency`` amounts are read in it (see :func:`money`), and with ``raw``,
    the text a value stands in, tax codes of other countries are read in dollar documents;
    without them amounts are dong.  One branch for each normaliser keeps the generated code
    small; ``df`` should be cheap to read again.
    """

    def read(kind: Callable[[Column], Column]) -> Column:
        if kind is amount_vnd and currency:
            return money(F.col(value), F.col(currency))
        if kind is tax_id and currency and raw:
            return tax_id(F.col(value), (F.col(currency) == "USD") & F.rlike(raw, F.lit(r"(?i)tax\s*code")))
        return kind(F.col(value))

    kinds = list(dict.fromkeys(FIELDS.values()))
    parts = [df.where(F.col(field).isin([f for f, k in FIELDS.items() if k is kind])).withColumn(into, read(kind)) for kind in kinds]
    parts.append(df.where(~F.col(field).isin(list(FIELDS))).withColumn(into, name(F.col(value))))
    return reduce(DataFrame.unionByName, parts)
