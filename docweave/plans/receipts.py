"""Receipt fields of the first generation, as one plan: candidates, scores, ranking, normal forms, review and status.

Every field's candidates come from the blocks in reading order, with the block before as
context where the field's rule says so, into one long table (one row for each candidate).
From there all fields share the steps: score, rank within the document, margin to the next
of the same role, normal form, confidence, review reasons, status, evidence.

Candidates are row-wise expressions over one window (the previous block) and one
gaps-and-islands pass for addresses over several lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions import normalize
from docweave.functions.text import collapse, nfc, strip_accents, unreadable
from docweave.operators import layout, ranking, review
from docweave.session import cut

FIELDS = ["merchant_name", "receipt_date", "total_amount", "invoice_id", "merchant_address"]
# Words that speak for a candidate and against it, in its context.
FOR = {
    "total_amount": [
        "tổng tiền phải thanh toán", "tổng tiền thanh toán", "tổng thanh toán", "tiền khách trả", "phải trả", "thành tiền", "tổng cộng",
        "grand total", "amount due", "total due", "total",
    ],
    "receipt_date": ["ngày bán", "ngày giao dịch", "ngày thanh toán", "thời gian", "datetime", "date", "transaction date"],
    "primary_id": ["số hóa đơn", "số hđ", "mã hóa đơn", "invoice no", "invoice number", "receipt no", "receipt number"],
    "fallback_id": [
        "mã giao dịch", "số giao dịch", "mã gd", "số gd", "mã tham chiếu", "số tham chiếu", "transaction id", "transaction no",
        "transaction number", "reference id", "reference no", "reference number", "ref id", "ref no",
    ],
    "merchant_name": [
        "cửa hàng", "siêu thị", "minimart", "mart", "nhà thuốc", "hiệu thuốc", "quán", "nhà hàng", "cà phê", "coffee", "chi nhánh",
        "công ty", "cty", "doanh nghiệp",
    ],
    "merchant_address": [
        "địa chỉ", "địa điểm", "chi nhánh", "address", "đường", "phố", "phường", "xã", "quận", "huyện", "tỉnh", "thành phố", "tp.",
    ],
}
AGAINST = {
    "total_amount": [
        "tạm tính", "subtotal", "giảm giá", "discount", "tiền khách đưa", "cash received", "tiền trả lại", "change", "thuế", "vat",
        "đơn giá", "số lượng",
    ],
    "receipt_date": ["hạn sử dụng", "ngày hết hạn", "hạn đổi trả", "ngày sinh", "valid thru", "expiry"],
    "invoice_id": [
        "mã số thuế", "tax code", "mst", "mã sản phẩm", "barcode", "số điện thoại", "terminal id", "pos id", "batch no",
        "authorization code", "mã khách hàng",
    ],
    "merchant_name": [
        "khách hàng", "người mua", "thu ngân", "nhân viên", "ngân hàng", "ví điện tử", "đơn vị vận chuyển", "mã số thuế", "mst",
        "điện thoại", "hotline", "website", "email",
    ],
    "merchant_address": [
        "địa chỉ khách hàng", "địa chỉ giao hàng", "shipping address", "billing address", "ngân hàng", "website", "email", "điện thoại",
        "hotline", "mã số thuế", "mst",
    ],
}
# Titles that are no merchant.
TITLES = ["hóa đơn bán hàng", "phiếu thanh toán", "hóa đơn", "phiếu tính tiền", "bill", "receipt", "invoice"]
# Scores of a context with words for, against, both, or none.
CONTEXT = {
    "merchant_name": (1.0, 0.0, 0.3, 0.5), "total_amount": (1.0, 0.0, 0.4, 0.5), "receipt_date": (1.0, 0.0, 0.4, 0.5),
    "invoice_id": (1.0, 0.0, 0.3, 0.2), "merchant_address": (1.0, 0.0, 0.3, 0.5),
}
# Scores by the height of a block's centre on the page, and beyond the last band.
BANDS = {
    "merchant_name": ([(0.15, 1.0), (0.30, 0.8)], 0.3), "receipt_date": ([(0.35, 0.8), (0.75, 1.0)], 0.5),
    "invoice_id": ([(0.40, 0.8), (0.80, 1.0)], 0.5), "merchant_address": ([(0.35, 1.0), (0.75, 0.7)], 0.3),
}
# The amount's bands begin, not end, at these heights.
AMOUNT_BANDS = ((0.55, 1.0), (0.35, 0.7), 0.3)
# Scores by what a candidate is made of.
PATTERN = {
    "explicit_vnd_marker": 1.0, "grouped_without_currency": 0.7, "iso_date": 1.0, "four_digit_year": 0.9, "two_digit_year": 0.5, "missing_component": 0.3,
    "labeled_primary_id": 1.0, "split_label_value": 0.9, "labeled_fallback_id": 0.65, "split_fallback_label_value": 0.55,
    "explicit_store": 1.0, "header_text": 0.9, "legal_entity": 0.6, "labeled_address": 1.0, "administrative_context": 0.9, "street_number": 0.8, "unsupported": 0.0,
}
# Weights of the ranking score and of the confidence, the margin that counts as full, the near margin, and the review threshold.
RANKING = {"pattern": 0.30, "context": 0.30, "layout": 0.25, "ocr_quality": 0.15}
CONFIDENCE = {"ranking_score": 0.70, "candidate_separation": 0.10, "normalization_certainty": 0.15, "ambiguity_evidence": 0.05}
FULL_MARGIN, NEAR_MARGIN, THRESHOLD = 0.25, 0.10, 0.75
# Reasons that make a field ambiguous.
AMBIGUOUS = [
    "MULTIPLE_CANDIDATES", "AMBIGUOUS_FORMAT", "UNSUPPORTED_CURRENCY", "NEGATIVE_AMOUNT", "MISSING_DATE_COMPONENT", "UNSUPPORTED_TWO_DIGIT_YEAR",
    "SOURCE_ROLE_UNCLEAR", "NORMALIZATION_FAILED",
]
# Printed forms.  Java flags: u for all letters' case, U for Unicode classes.
_MARK = r"(?:VND|VNĐ|₫|Đ|USD|EUR|GBP|JPY|CNY|KRW|THB|SGD|AUD|CAD|[$€£¥])"
_GROUPS = r"(?:\d{1,3}(?:[.,\s]\d{3})+|\d+)"
WITH_MARK = rf"(?iuU)(?<![\w.,])-?{_GROUPS}\s*{_MARK}(?!\w)"
MISREAD = rf"(?iuU)(?<![\w.,])-?(?=[\dO.,\s]*O)(?:[\dO]{{1,3}}(?:[.,\s][\dO]{{3}})+|[\dO]+)\s*{_MARK}(?!\w)"
BARE = rf"(?U)(?<![\w.,])-?{_GROUPS}(?![\w.,])"
_DAY = r"(?:0?[1-9]|[12]\d|3[01])"
DATES = {
    "iso_date": r"\b(?:19|20)\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])\b",
    "four_digit_year": rf"\b{_DAY}[/.-]{_DAY}[/.-](?:19|20)\d{{2}}\b",
    "two_digit_year": rf"\b{_DAY}[/.-]{_DAY}[/.-]\d{{2}}\b",
    "missing_component": rf"(?<![\d./-]){_DAY}[/\-](?:0?[1-9]|1[0-2])(?![/\-]\d)",
}
_ID = r"\s*[:#-]?\s*([A-Z0-9][A-Z0-9._/-]*)"
PRIMARY_ID = rf"(?iu)(?:SO\s*(?:HOA\s*DON|HD)|MA\s*HOA\s*DON|INVOICE\s*(?:NO|NUMBER)|RECEIPT\s*(?:NO|NUMBER)){_ID}"
FALLBACK_ID = rf"(?iu)(?:(?:MA|SO)\s*(?:GIAO\s*DICH|GD|THAM\s*CHIEU)|TRANSACTION\s*(?:ID|NO|NUMBER)|REFERENCE\s*(?:ID|NO|NUMBER)|REF\s*(?:ID|NO|NUMBER)){_ID}"
ONLY_ID = r"(?i)^[A-Z0-9][A-Z0-9._/-]*$"
LEGAL = r"(?iuU)\b(?:CÔNG\s+TY|CTY|DOANH\s+NGHIỆP)\b"
STORE = r"(?iuU)\b(?:CỬA\s+HÀNG|SIÊU\s+THỊ|NHÀ\s+THUỐC|CHI\s+NHÁNH)\b"
CONTACT = r"(?iu)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b|(?:https?://|www\.)\S+"
PHONE = r"^(?:\+?84|0)\s*(?:\d[\s.-]*){8,10}\d$"
NO_NAME = r"^[\d\s.,:/#()\-+]+$"
NO_ADDRESS = r"(?iu)^\s*(?:\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4}-\d{1,2}-\d{1,2}|[\d.,\s]+\s*(?:VND|VNĐ|₫|Đ)?)\s*$"
ADDRESS_LABEL = r"(?iu)(?:ĐỊA\s*CHỈ|ADDRESS)\s*[:#-]?\s*(.{5,160})"
ADMINISTRATIVE = r"(?iuU)(?<!\w)(?:ĐƯỜNG|PHỐ|PHƯỜNG|XÃ|QUẬN|HUYỆN|TỈNH|THÀNH\s+PHỐ|TP\.)(?!\w)"
STREET_NUMBER = r"(?iu)^\s*\d{1,5}[A-Z]?(?:[/-]\d{1,5}[A-Z]?)?\s+.*[A-ZÀ-Ỹ]"
SALE_DATE = r"(?iuU)(?<!\w)NGÀY\s+(?:BÁN|GIAO\s+DỊCH|THANH\s+TOÁN)(?!\w)|(?:^|\n)\s*NGÀY\s*(?=[:#-]|\d)"
OTHER_MONEY = r"(?iu)\b(?:USD|EUR|GBP|JPY|CNY|RMB|THB|SGD|AUD|CAD)\b|[$€£¥]"
HEADER_END = 0.30


def _any(text: Column, words: list[str]) -> Column:
    """Whether the lower-cased text holds one of the words."""
    low = F.lower(text)
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))


def _holds(text: Column, pattern: str) -> Column:
    return F.rlike(text, F.lit(pattern))


def ordered(blocks: DataFrame, doc: str) -> DataFrame:
    """Blocks with the one before in reading order, and the height of their centre."""
    w = Window.partitionBy(doc).orderBy("page", "reading_order", "block_id")
    rows = blocks.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("center", (F.col("top_y") + F.col("bottom_y")) / 2)
    own = F.struct("page", "reading_order", "block_id", "text")
    return rows.select(doc, own.alias("b"), "text", "center", F.coalesce("confidence", F.lit(0.0)).alias("ocr"), F.lag(own).over(w).alias("before"), F.row_number().over(w).alias("ix"))


def _made(rows: DataFrame, doc: str, field: str, context: Column, candidates: Column, words: str | None = None) -> DataFrame:
    """Candidates in the common form: ``candidates`` is an array of (value, kind, role, doubts) of each block, ``context`` of its blocks."""
    spoken = F.array_join(context["text"], "\n")
    pro = FOR["primary_id"] + FOR["fallback_id"] if field == "invoice_id" else FOR[field]
    plain = (lambda x: strip_accents(x)) if field == "invoice_id" else (lambda x: x)
    bare = (lambda ws: [_fold(w) for w in ws]) if field == "invoice_id" else (lambda ws: ws)
    judged = rows.withColumn("context", context).withColumn("raw", spoken)
    marked = judged.withColumn("pro", _any(plain(F.col("raw")), bare(pro))).withColumn("con", _any(plain(F.col("raw")), bare(AGAINST[field])))
    exploded = marked.select(doc, "ix", "context", "raw", "pro", "con", "center", "ocr", F.posexplode(candidates).alias("n", "c"))
    doubts = F.array_union(F.when(unreadable(F.col("raw")), F.array(F.lit("unreadable_source"))).otherwise(F.array().cast("array<string>")), F.col("c.doubts"))
    return exploded.select(doc, F.lit(field).alias("field"), "ix", F.col("n").alias("n"), F.trim("c.value").alias("value"), F.col("c.kind").alias("kind"), F.col("c.role").alias("role"), "raw", "pro", "con", "center", "ocr", "context", doubts.alias("doubts"))


def _fold(word: str) -> str:
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c)).replace("đ", "d")


def _candidate(value: Column, kind: str | Column, role: str = "primary", doubts: Column | None = None) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    none = F.array().cast("array<string>")
    return F.struct(value.alias("value"), kind.alias("kind"), F.lit(role).alias("role"), (none if doubts is None else F.coalesce(doubts, none)).alias("doubts"))


def _with_before(condition: Column) -> Column:
    """The block before and the block itself, or the block alone."""
    return F.when(F.col("before").isNotNull() & condition, F.array("before", "b")).otherwise(F.array("b"))


def amounts(rows: DataFrame, doc: str) -> DataFrame:
    """Amounts with a currency mark, misread ones too, and bare ones where a word for a total stands near."""
    context = _with_before(F.lit(True))
    speaks = _any(F.array_join(context["text"], "\n"), FOR["total_amount"])
    marked, misread, bare = (p.split(")", 1)[1] if p.startswith("(?") else p for p in (WITH_MARK, MISREAD, BARE))
    both = F.regexp_extract_all("text", F.lit(f"(?iuU){marked}|{misread}"), F.lit(0))
    every = F.regexp_extract_all("text", F.lit(f"(?iuU){marked}|{misread}|{bare}"), F.lit(0))
    found = F.when(speaks, every).otherwise(both)

    def make(value: Column) -> Column:
        v = F.trim(value)
        vnd, grouped = _holds(v, r"(?iu)VND|VNĐ|₫|Đ"), _holds(v, r"^\s*\d{1,3}(?:[.,\s]\d{3})+\s*$")
        kind = F.when(vnd, "explicit_vnd_marker").when(grouped, "grouped_without_currency").otherwise("unsupported")
        confused = _holds(v, rf"{MISREAD}$") & _holds(v, r"(?i)^-?[\dO.,\s]+\D*$")
        return _candidate(value, kind, doubts=F.when(confused, F.array(F.lit("digit_letter_confusion"))))

    return _made(rows, doc, "total_amount", context, F.transform(found, make))


def dates(rows: DataFrame, doc: str) -> DataFrame:
    """Dates in four printed forms; a block without date words takes those of the block before."""
    words = FOR["receipt_date"] + AGAINST["receipt_date"]
    context = _with_before(~_any(F.col("text"), words) & _any(F.col("before.text"), words))
    always = {"two_digit_year": "two_digit_year", "missing_component": "missing_date_component"}

    def found(kind: str) -> Column:
        def make(value: Column) -> Column:
            if kind in always:
                return _candidate(value, kind, doubts=F.array(F.lit(always[kind])))
            part = lambda i: F.split(value, "[./-]")[i].cast("int")
            either = F.when((part(0) <= 12) & (part(1) <= 12), F.array(F.lit("day_month_order_requires_context")))
            return _candidate(value, kind, doubts=either if kind == "four_digit_year" else None)

        return F.transform(F.regexp_extract_all("text", F.lit(DATES[kind]), F.lit(0)), make)

    return _made(rows, doc, "receipt_date", context, F.concat(*map(found, DATES)))


def identifiers(rows: DataFrame, doc: str) -> DataFrame:
    """At most one identifier a block: after a primary label, else after a fallback label, else alone under a label."""
    plain, before = strip_accents(F.col("text")), strip_accents(F.col("before.text"))
    every = [_fold(w) for w in FOR["primary_id"] + FOR["fallback_id"]]
    against = [_fold(w) for w in AGAINST["invoice_id"]]
    split = F.col("before").isNotNull() & ~_any(plain, every + against) & _any(before, every)
    primary, fallback = F.regexp_extract(plain, PRIMARY_ID, 1), F.regexp_extract(plain, FALLBACK_ID, 1)
    alone = split & _holds(F.trim("text"), ONLY_ID)
    under = _any(before, [_fold(w) for w in FOR["primary_id"]])
    one = lambda c: F.array(c)
    made = F.when(primary != "", one(_candidate(primary, "labeled_primary_id"))).when(fallback != "", one(_candidate(fallback, "labeled_fallback_id", "fallback"))).when(
        alone & under, one(_candidate(F.col("text"), "split_label_value"))).when(alone, one(_candidate(F.col("text"), "split_fallback_label_value", "fallback")))
    return _made(rows, doc, "invoice_id", _with_before(split), made)


def names(rows: DataFrame, doc: str) -> DataFrame:
    """Company and shop names anywhere, and readable text at the top of the page."""
    t = F.trim("text")
    dull = (t == "") | F.lower(collapse(t)).isin(TITLES) | _any(t, AGAINST["merchant_name"]) | _holds(t, CONTACT) | _holds(t, PHONE) | _holds(t, NO_NAME) | ~_holds(t, r"\p{L}")
    legal, store = _holds(t, LEGAL), _holds(t, STORE)
    kind = F.when(legal, "legal_entity").when(store, "explicit_store").otherwise("header_text")
    unclear = ~legal & ~store & ~_any(t, FOR["merchant_name"])
    one = F.array(_candidate(t, kind, doubts=F.when(unclear, F.array(F.lit("source_role_unclear")))))
    return _made(rows, doc, "merchant_name", F.array("b"), F.when(~dull & (legal | store | (F.col("center") <= HEADER_END)), one))


def addresses(rows: DataFrame, doc: str) -> DataFrame:
    """Addresses over one or several lines: a line goes on with the one before if it is one of places or numbers itself."""
    t = F.trim("text")
    dull = (t == "") | _any(t, AGAINST["merchant_address"]) | _holds(t, CONTACT) | _holds(t, PHONE) | _holds(t, NO_ADDRESS)
    goes_on = ~dull & (_holds(t, ADMINISTRATIVE) | _holds(t, STREET_NUMBER))
    marked = rows.withColumn("address", ~dull & (goes_on | _holds(t, ADDRESS_LABEL))).withColumn("goes_on", goes_on)
    w = layout.window([doc], ["ix"])
    chained = layout.islands(marked, [doc], ["ix"], ~(F.col("goes_on") & F.lag("address").over(w))).where("address")
    lines = F.array_sort(F.collect_list(F.struct("ix", "b")))["b"]
    joined = chained.groupBy(doc, "island").agg(lines.alias("context"), F.min("ix").alias("ix"), F.avg("ocr").alias("ocr"), F.min_by("center", "ix").alias("center"))
    first = F.trim(F.col("context")[0]["text"])
    own = F.coalesce(F.nullif(F.trim(F.regexp_extract(first, ADDRESS_LABEL, 1)), F.lit("")), first)
    rest = F.transform(F.slice("context", 2, F.greatest(F.size("context") - 1, F.lit(1))), lambda b: F.trim(b["text"]))
    valued = joined.withColumn("value", F.array_join(F.concat(F.array(own), rest), "\n"))
    raw = F.array_join(F.col("context")["text"], "\n")
    kind = F.when(_holds(raw, r"(?iu)(?:ĐỊA\s*CHỈ|ADDRESS)\s*[:#-]?"), "labeled_address").when(_holds(F.col("value"), ADMINISTRATIVE), "administrative_context").when(_holds(F.col("value"), STREET_NUMBER), "street_number").otherwise("unsupported")
    return _made(valued, doc, "merchant_address", F.col("context"), F.array(_candidate(F.col("value"), kind)))


def candidates(blocks: DataFrame, doc: str = "run_id") -> DataFrame:
    """All candidates of all fields with their part scores and ``score``."""
    rows = cut(ordered(blocks.withColumn("text", nfc(F.col("text"))), doc))
    made = amounts(rows, doc).unionByName(dates(rows, doc)).unionByName(identifiers(rows, doc)).unionByName(names(rows, doc)).unionByName(addresses(rows, doc))
    pattern = F.create_map(*[F.lit(x) for pair in PATTERN.items() for x in pair])[F.col("kind")]
    context, bands = F.lit(None).cast("double"), F.lit(None).cast("double")
    for field in FIELDS:
        own = F.col("field") == field
        pro, con, both, none = CONTEXT[field]
        context = F.when(own, F.when(F.col("pro") & F.col("con"), both).when(F.col("pro"), pro).when(F.col("con"), con).otherwise(none)).otherwise(context)
        if field == "total_amount":
            (low, low_score), (middle, middle_score), high_score = AMOUNT_BANDS
            band = F.when(F.col("center") >= low, low_score).when(F.col("center") >= middle, middle_score).otherwise(high_score)
        else:
            band = review.band_score(F.col("center"), *BANDS[field])
        bands = F.when(own, band).otherwise(bands)
    scored = made.withColumns({"pattern_score": pattern, "context_score": context, "layout_score": bands})
    parts = {"pattern": F.col("pattern_score"), "context": F.col("context_score"), "layout": F.col("layout_score"), "ocr_quality": F.col("ocr")}
    return scored.withColumn("score", ranking.weighted(parts, RANKING))


def _dated(value: Column, raw: Column, con: Column) -> Column:
    """A date's normal form: day first also where both could be months, if a Vietnamese sale-date label says so."""
    day_first = r"^(\d{1,2})([./-])(\d{1,2})\2(\d{4})$"
    part = lambda i: F.regexp_extract(value, day_first, i)
    both = _holds(value, day_first) & part(1).cast("int").between(1, 12) & part(3).cast("int").between(1, 12)
    said = both & ~con & _holds(raw, SALE_DATE)
    iso = F.concat_ws("-", part(4), F.lpad(part(3), 2, "0"), F.lpad(part(1), 2, "0"))
    plain = F.when(both | ~(_holds(value, day_first) | _holds(value, r"^\d{4}-\d{1,2}-\d{1,2}$")), None).otherwise(normalize.date(value)["value"])
    return F.when(said & F.try_to_date(iso, "yyyy-MM-dd").isNotNull(), iso).otherwise(plain)


def judged(ranked: DataFrame, doc: str) -> DataFrame:
    """The best candidate of each field with normal form, confidence, reasons, status and evidence."""
    whole = Window.partitionBy(doc, "field").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    second = F.max(F.when(F.col("rank") == 2, F.struct("context"))).over(whole)["context"]
    seen = ranked.withColumn("second", second)
    best = ranking.margins(seen, [doc, "field"], "role", "score", NEAR_MARGIN - 1e-12)
    kinds = {"total_amount": normalize.amount_vnd, "invoice_id": normalize.identifier, "merchant_name": normalize.name, "merchant_address": normalize.address}
    normal = F.when(F.col("field") == "receipt_date", _dated(F.col("value"), F.col("raw"), F.col("con")))
    for field, kind in kinds.items():
        normal = F.when(F.col("field") == field, kind(F.col("value"))["value"]).otherwise(normal)
    done = best.withColumn("normal", normal).withColumn("ok", F.col("normal").isNotNull())
    separation = F.when(F.col("margin").isNull(), 1.0).otherwise(F.least(F.lit(1.0), F.col("margin") / FULL_MARGIN))
    doubted = F.when(F.size("doubts") == 0, 1.0).when(F.col("ok"), 0.5).otherwise(0.0)
    parts = {"ranking_score": F.col("score"), "candidate_separation": separation, "normalization_certainty": F.col("ok").cast("double"), "ambiguity_evidence": doubted}
    sure = done.withColumn("confidence", F.round(ranking.weighted(parts, CONFIDENCE), 6))
    is_date, is_amount, v = F.col("field") == "receipt_date", F.col("field") == "total_amount", F.trim("value")
    day_first = r"^(?:0?[1-9]|1[0-2])([./-])(?:0?[1-9]|1[0-2])\1\d{4}$"
    known = (
        F.when(is_date & _holds(v, r"^\d{1,2}[./-]\d{1,2}[./-]\d{2}$"), "UNSUPPORTED_TWO_DIGIT_YEAR").when(is_date & _holds(v, rf"^{_DAY}[/\-](?:0?[1-9]|1[0-2])$"), "MISSING_DATE_COMPONENT")
        .when(is_date & _holds(v, day_first), "AMBIGUOUS_FORMAT").when(is_amount & _holds(v, r"^-\s*\d"), "NEGATIVE_AMOUNT").when(is_amount & _holds(v, OTHER_MONEY), "UNSUPPORTED_CURRENCY").otherwise("NORMALIZATION_FAILED")
    )
    reasons = F.array_distinct(F.array_compact(F.array(
        F.when(F.array_contains("doubts", "unreadable_source"), "UNREADABLE_SOURCE"), F.when(F.array_contains("doubts", "source_role_unclear"), "SOURCE_ROLE_UNCLEAR"),
        F.when(F.col("confidence") < THRESHOLD, "LOW_CONFIDENCE"), F.when(F.col("competitor"), "MULTIPLE_CANDIDATES"), F.when(~F.col("ok"), known),
    )))
    reviewed = sure.withColumn("review_reasons", reasons)
    status = F.when(F.array_contains("review_reasons", "UNREADABLE_SOURCE"), "UNREADABLE").when(F.arrays_overlap("review_reasons", F.array(*map(F.lit, AMBIGUOUS))) | ~F.col("ok"), "AMBIGUOUS").otherwise("PRESENT")
    both = F.when(F.array_contains("review_reasons", "MULTIPLE_CANDIDATES") & F.col("second").isNotNull(), F.concat("context", "second")).otherwise(F.col("context"))
    evidence = F.array_sort(F.array_distinct(both))
    return reviewed.select(
        doc, "field", F.array_join(evidence["text"], "\n").alias("raw_text"), F.col("value").alias("predicted_value"), F.when(status == "PRESENT", F.col("normal")).alias("normalized_value"),
        status.alias("value_status"), "confidence", (F.size("review_reasons") > 0).alias("machine_needs_review"), "review_reasons", evidence["block_id"].alias("block_ids"),
    )


def extract(blocks: DataFrame, doc: str = "run_id") -> DataFrame:
    """One row for each document and field; fields without a candidate are UNKNOWN with confidence 0.

    Documents without blocks give no rows.  Equal scores keep the order in which candidates
    were found; primary candidates come before fallback ones.
    """
    found = candidates(blocks, doc)
    order = [F.asc(F.when(F.col("role") == "primary", 0).otherwise(1)), F.desc("score"), F.asc("ix"), F.asc("n")]
    cells = judged(ranking.rank(found, [doc, "field"], *order), doc)
    frame = blocks.select(doc).distinct().select(doc, F.explode(F.array(*map(F.lit, FIELDS))).alias("field"))
    unknown = {
        "value_status": F.coalesce("value_status", F.lit("UNKNOWN")), "confidence": F.coalesce("confidence", F.lit(0.0)), "machine_needs_review": F.coalesce("machine_needs_review", F.lit(True)),
        "review_reasons": F.coalesce("review_reasons", F.array(F.lit("NO_CANDIDATE"))), "block_ids": F.coalesce("block_ids", F.array().cast("array<string>")),
    }
    money = F.when(F.col("field") == "total_amount", "VND")
    return frame.join(cells, [doc, "field"], "left").withColumns(unknown).withColumn("currency", money)
