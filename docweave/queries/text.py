"""Queries over text: normalisation, labels, candidates and error rates."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import ids, normalize, text
from docweave.operators import text_metrics
from docweave.queries.fixtures import BLOCKS_SQL, blocks
from docweave.session import spread
from docweave.sources.tables import table

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
KEYWORDS = ["Hóa đơn", "Tổng thanh toán", "Mã số thuế", "invoice", "total", "tax"]
# Fixed values, folded: labels of header fields.
LABELS = {"tax_id": r"ma so thue|tax code", "number": r"so hoa don|so|invoice no", "total": r"tong thanh toan|tong cong|grand total", "address": r"dia chi|address", "seller": r"don vi ban hang|seller"}


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text")


def text_ws_normalize(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", F.md5(text.collapse(F.col("text"))).alias("text_md5"))


def text_fold(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", F.md5(text.fold(F.col("text"))).alias("text_md5"))


def text_nfc(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "transcriptions").select("transcript_id", text.nfc(F.col("text")).alias("text")).distinct()


def keyword_match(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", F.array_join(text.matched_keywords(F.col("text"), KEYWORDS), "|").alias("keywords"))


def label_match(spark: SparkSession, folder: str) -> DataFrame:
    """The label a block's text starts with: the longest match, then the last field name; and what follows it."""
    plain = text.fold(F.regexp_replace("text", r"(?<=[a-z])(?=[A-Z])", " "))
    rows = blocks(spark, folder).select("doc_id", "ix", plain.alias("plain"))
    hits = F.array(*[F.struct(F.length(F.regexp_extract("plain", rf"^(?:{p})(?![\p{{L}}\p{{N}}])", 0)).alias("size"), F.lit(f).alias("field")) for f, p in sorted(LABELS.items())])
    best = rows.withColumn("best", F.array_max(hits)).where("best.size > 0")
    return best.select("doc_id", "ix", F.col("best.field").alias("field"), F.expr("substring(plain, best.size + 1)").alias("suffix"))


def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", text.token_count(F.col("text")).alias("tokens"))


def csv_escape(spark: SparkSession, folder: str) -> DataFrame:
    return blocks(spark, folder).select("doc_id", "ix", text.safe_csv(F.col("text")).alias("cell"))


def regex_candidates_amount(spark: SparkSession, folder: str) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit(r"(?<![\d.,])\d{1,3}(?:[.,]\d{3})+(?![\d.,]?\d)"), 0)
    rows = blocks(spark, folder).select("doc_id", "ix", F.posexplode(found).alias("n", "raw"))
    return rows.select("doc_id", "ix", F.col("n").cast("long").alias("n"), "raw", F.regexp_replace("raw", "[.,]", "").cast("long").alias("amount"))


def regex_candidates_date(spark: SparkSession, folder: str) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit(r"\b\d{1,2}/\d{1,2}/\d{4}\b"), 0)
    rows = blocks(spark, folder).select("doc_id", "ix", F.posexplode(found).alias("n", "raw"))
    return rows.select("doc_id", "ix", F.col("n").cast("long").alias("n"), "raw", normalize.date(F.col("raw"))["value"].alias("iso"))


def _amount_text() -> Column:
    price, way = F.floor("l_extendedprice").cast("long"), F.col("l_orderkey") % 6
    grouped = F.format_number(price, 0)
    return F.when(way == 0, price.cast("string")).when(way == 1, grouped).when(way == 2, F.regexp_replace(grouped, ",", ".")).when(way == 3, F.concat(grouped, F.lit(" VND"))).when(way == 4, F.concat(price.cast("string"), F.lit(".5"))).otherwise(F.concat(F.lit("x"), grouped))


def amount_normalize(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "lineitem").select(_amount_text().alias("raw")).distinct()
    done = normalize.amount_vnd(F.col("raw"))
    return raw.select("raw", done["value"].alias("value"), done["rule"].alias("rule"), done["failure"].alias("failure"))


def _date_text() -> Column:
    day, way = F.col("o_orderdate"), F.col("o_orderkey") % 6
    fmt = lambda p: F.date_format(day.cast("timestamp"), p)
    return F.when(way == 0, fmt("yyyy-MM-dd")).when(way == 1, fmt("dd/MM/yyyy")).when(way == 2, fmt("MM/dd/yyyy")).when(way == 3, F.concat(F.lit("ngày "), fmt("d"), F.lit(" tháng "), fmt("M"), F.lit(" năm "), fmt("yyyy"))).when(way == 4, fmt("d MMM yyyy")).otherwise(fmt("dd/MM/yy"))


def date_normalize(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "orders").select(_date_text().alias("raw")).distinct()
    done = normalize.date(F.col("raw"))
    return raw.select("raw", done["value"].alias("value"), done["failure"].alias("failure"))


def tax_id_normalize(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "kie_split").where("seller_tax_id is not null").select(F.col("seller_tax_id").alias("raw")).distinct()
    done = normalize.tax_id(F.col("raw"))
    return raw.select("raw", done["value"].alias("value"), done["failure"].alias("failure"))


def identifier_normalize(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "invoice_headers").where("invoice_number is not null").select(F.col("invoice_number").alias("raw")).distinct()
    done = normalize.identifier(F.col("raw"))
    return raw.select("raw", done["value"].alias("value"), done["failure"].alias("failure"))


def quantity_normalize(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "line_cells").where("field = 'quantity' and raw_text is not null").select(F.col("raw_text").alias("raw")).distinct()
    done = normalize.quantity(F.col("raw"))
    return raw.select("raw", done["value"].alias("value"), done["failure"].alias("failure"))


def uuid5_ids(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select("o_orderkey", ids.uuid5(NAMESPACE, F.concat(F.lit("order|"), F.col("o_orderkey").cast("string"))).alias("id"))


def _readings(spark: SparkSession, folder: str) -> DataFrame:
    """English notes of any length and a reading of them with arithmetic edits; other languages would lose most letters to the ASCII form."""
    rows = spread(table(spark, folder, "documents").where("lang = 'en'")).select("doc_id", F.coalesce("source", F.lit("none")).alias("condition"), F.regexp_replace("text", r"[^\x20-\x7E]", "").alias("ref"))
    return rows.withColumn("hyp", F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("ref", "e", "c")).when(F.col("doc_id") % 3 == 1, F.expr("substring(ref, 4)")).otherwise(F.col("ref")))


def cer_micro_macro(spark: SparkSession, folder: str) -> DataFrame:
    rows = _readings(spark, folder)
    errors, length = text_metrics.character_errors(F.col("ref"), F.col("hyp"))
    return text_metrics.error_rates(rows.select("condition", errors.alias("e"), length.alias("n")), "condition", "e", "n")


def wer_tokens(spark: SparkSession, folder: str) -> DataFrame:
    rows = _readings(spark, folder).withColumn("e", text_metrics.word_edits()("ref", "hyp")).withColumn("n", F.size(F.split(text.collapse(F.col("ref")), " ")).cast("long"))
    return text_metrics.error_rates(rows.select("condition", "e", "n"), "condition", "e", "n")


QUERIES = {f.__name__: f for f in (
    text_ws_normalize, text_fold, text_nfc, keyword_match, label_match, token_counts, csv_escape, regex_candidates_amount, regex_candidates_date, amount_normalize, date_normalize, tax_id_normalize,
    identifier_normalize, quantity_normalize, uuid5_ids, cer_micro_macro, wer_tokens,
)}

_FOLD = r"""replace(regexp_replace(strip_accents(lower(trim(regexp_replace({0}, '[\s\x1c-\x1f\x{{85}}\p{{Z}}]+', ' ', 'g')))), '\p{{M}}+', '', 'g'), 'đ', 'd')"""
_CAMEL = r'''regexp_replace("text", '([a-z])([A-Z])', '\1 \2', 'g')'''
_HITS = ", ".join(f"{{'size': length(regexp_extract(p, '^(?:{p})(?:[^\\pL\\pN]|$)', 0)) - case when regexp_matches(p, '^(?:{p})[^\\pL\\pN]') then 1 else 0 end, 'field': '{f}'}}" for f, p in sorted(LABELS.items()))
_GROUPED = "regexp_replace(reverse(regexp_replace(reverse(p::varchar), '(\\d{3})', '\\1,', 'g')), '^,', '')"
_GROUP_RE = r"\d{1,3}(?:\.\d{3})+|\d{1,3}(?:,\d{3})+|\d{1,3}(?: \d{3})+"
SQL = {
    "text_ws_normalize": r"select doc_id, md5(trim(regexp_replace(text, '[\s\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g'))) text_md5 from documents",
    "text_fold": f"select doc_id, md5({_FOLD.format('text')}) text_md5 from documents",
    "text_nfc": 'select distinct transcript_id, nfc_normalize("text") "text" from transcriptions',
    "keyword_match": f"select doc_id, array_to_string(list_filter({KEYWORDS!r}, lambda k: contains(lower(text), lower(k))), '|') keywords from documents",
    "label_match": f"""with {BLOCKS_SQL}, f as (select doc_id, ix, {_FOLD.format(_CAMEL)} p from blocks),
 h as (select doc_id, ix, p, list_max([{_HITS}]) b from f) select doc_id, ix, b.field field, substring(p, b.size+1) suffix from h where b.size>0""",
    "csv_escape": f"""with {BLOCKS_SQL} select doc_id, ix, case when regexp_matches(regexp_replace("text", '^[\\s\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+', ''), '^[=+@\\-]') then '''' || "text" else "text" end cell from blocks""",
    "token_counts": r"select doc_id, coalesce(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x1c-\x1f\x{85}\p{Z}]+')),0) tokens from documents",
    "amount_normalize": f"""with r as (select l_orderkey%6 w, cast(floor(l_extendedprice) as bigint) p from lineitem),
 t as (select distinct case w when 0 then p::varchar when 1 then {_GROUPED} when 2 then replace({_GROUPED},',','.') when 3 then {_GROUPED}||' VND' when 4 then p::varchar||'.5' else 'x'||{_GROUPED} end raw from r),
 b as (select raw, regexp_replace(raw, '\\s*VND$', '') b from t), v as (select raw, b, regexp_full_match(b, '\\d+') pl, regexp_full_match(b, '{_GROUP_RE}') gr from b)
 select raw, case when pl or gr then regexp_replace(b, '[., ]', '', 'g') end "value", case when pl then 'vnd_plain_integer' when gr then 'vnd_grouped_integer' end rule, case when not (pl or gr) then 'NORMALIZATION_FAILED' end failure from v""",
    "date_normalize": """with r as (select o_orderdate::date d, o_orderkey%6 w from orders), t as (select distinct w, d, case w when 0 then strftime(d,'%Y-%m-%d') when 1 then strftime(d,'%d/%m/%Y') when 2 then strftime(d,'%m/%d/%Y')
 when 3 then 'ngày '||day(d)||' tháng '||month(d)||' năm '||year(d) when 4 then day(d)||' '||strftime(d,'%b %Y') else strftime(d,'%d/%m/%y') end raw from r),
 v as (select raw, case when w in (0,3,4) or (w in (1,2) and (day(d)>12 or day(d)=month(d))) then strftime(d,'%Y-%m-%d') end "value" from t) select distinct raw, "value", case when "value" is null then 'AMBIGUOUS_FORMAT' end failure from v""",
    "tax_id_normalize": r"""with t as (select distinct seller_tax_id raw from kie_split where seller_tax_id is not null), c as (select raw, trim(regexp_replace(raw,'\s+',' ','g')) x from t), d as (select raw, x, regexp_replace(x,'[ .\-]','','g') y from c),
 v as (select raw, case when regexp_full_match(x,'[0-9 .\-]+') and length(y) in (10,13) then y end "value" from d) select raw, "value", case when "value" is null then 'NORMALIZATION_FAILED' end failure from v""",
    "identifier_normalize": r"""with t as (select distinct invoice_number raw from invoice_headers where invoice_number is not null), c as (select raw, trim(regexp_replace(raw,'[\s\p{Z}]+',' ','g')) x from t),
 v as (select raw, case when regexp_full_match(x,'[\p{L}\p{N}][\p{L}\p{N}._/ \-]*') then x end "value" from c) select raw, "value", case when "value" is null then 'NORMALIZATION_FAILED' end failure from v""",
    "quantity_normalize": r"""with t as (select distinct raw_text raw from line_cells where field='quantity' and raw_text is not null), c as (select raw, trim(regexp_replace(raw,'[\s\p{Z}]+',' ','g')) x from t),
 v as (select raw, case when regexp_full_match(x,'[0-9]+(?:[.,][0-9]+)?') then replace(x,',','.') end "value" from c) select raw, "value", case when "value" is null then 'NORMALIZATION_FAILED' end failure from v""",
    "regex_candidates_date": rf"""with {BLOCKS_SQL}, m as (select doc_id, ix, regexp_extract_all("text", '\b\d{{1,2}}/\d{{1,2}}/\d{{4}}\b') l from blocks), e as (select doc_id, ix, unnest(range(len(l))) n, unnest(l) raw from m),
 p as (select *, split_part(raw,'/',1)::int a, split_part(raw,'/',2)::int b, split_part(raw,'/',3) y from e)
 select doc_id, ix, n, raw, case when a>12 or a=b then strftime(try_cast(y||'-'||b||'-'||a as date),'%Y-%m-%d') when b>12 then strftime(try_cast(y||'-'||a||'-'||b as date),'%Y-%m-%d') end iso from p""",
    "uuid5_ids": f"""with h as (select o_orderkey, sha1(unhex('{NAMESPACE.hex}') || encode('order|'||o_orderkey)) s from orders)
 select o_orderkey, substr(s,1,8)||'-'||substr(s,9,4)||'-5'||substr(s,14,3)||'-'||substr('89ab', (('0x'||substr(s,17,1))::int%4)+1, 1)||substr(s,18,3)||'-'||substr(s,21,12) id from h""",
    "cer_micro_macro": r"""with d as (select doc_id, coalesce(source,'none') condition, regexp_replace(text,'[^\x20-\x7E]','','g') r from documents where lang='en'),
 h as (select condition, trim(regexp_replace(r,' +',' ','g')) a, trim(regexp_replace(case doc_id%3 when 0 then replace(r,'e','c') when 1 then substring(r,4) else r end,' +',' ','g')) b from d),
 e as (select condition, levenshtein(a,b) e, length(a) n from h)
 select coalesce(condition,'all') condition, count(*) samples, cast(sum(e) as bigint) errors, cast(sum(n) as bigint) length, round(100.0*sum(e)/nullif(sum(n),0),6)::double micro, round(avg(round((100e0*e)/nullif(n,0),2)),2) macro from e group by grouping sets ((condition),())""",
}
