"""Problem 9: template residue, filler text, error pages and script notices.

Method: delimiter-specific grammars for unfilled variables and patterns for filler and
notices, judged sentence by sentence with their context.  What stands in a code block or in
quoted code is left out.  A variable is discounted in a sentence that explains, logs or
shows it as code; a program's empty value also where the sentence speaks of values; and a
text with at least as many explaining sentences as unfilled ones is a tutorial.  Filler
Latin counts as a whole sentence; filler phrases count by their density in the text.  A
notice counts only where it stands in place of content, by its share of what is not page
furniture, and not in a sentence that says what the notice means.  All of it is JVM
expressions on whole texts; nothing is shuffled.

Defined results: null and empty texts are no residue; letter case and missing accents do
not hide filler and notices; masked card numbers, leader dots and blank signature lines
match no grammar; a code fence that is never closed is no code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import strip_accents

_NAME = r"[A-Za-z_][A-Za-z0-9_.]*"
# One grammar for each pair of delimiters.
VARIABLES = [
    rf"\{{\{{\s*[#/^>&]?\s*(?:if |each |unless |with )?{_NAME}\s*(?:\|[^{{}}\n]{{1,40}})?\}}\}}",  # {{x}} {{#if x}} {{x | filter}}
    rf"\{{%-?\s*(?:if |for )?{_NAME}\s*-?%\}}",  # {%x%}
    rf"[$#]\{{\s*{_NAME}\s*\}}|\{{\${_NAME}\}}",  # ${x} #{x} {$x}
    rf"<%=?\s*{_NAME}\s*%>",  # <%= x %>
    rf"(?<![{{$\w])\{{{_NAME}\}}(?!\}})",  # {x}
    rf"<[A-Z][A-Z0-9_.]+>|<[a-z]\w*[_.]{_NAME}>|<(?iu:nhập|điền|enter|insert|fill in) [^<>\n]{{1,40}}>|<(?:first|last|full|your|customer|company|user) ?name>",  # <X> <x_y> <enter x>
    rf"\[\[\s*{_NAME}\s*\]\]",  # [[x]]
    r"(?<!\[)\[(?:[A-Z][a-z]+(?:[ .][a-z]+){0,4}|[A-Z][A-Z0-9]*(?:[_ ][A-Z0-9]+)+)\](?!\])",  # [Field name] [FIELD_NAME]
    r"(?<![\w:/]):[a-z]+(?:_[a-z]+)+\b(?!:)",  # :field_name
    rf"[«]\s*{_NAME}\s*[»]",  # «x»
    rf"@@{_NAME}@@",  # @@x@@
    r"(?<!_)__[A-Za-z][A-Za-z0-9.]*(?:_[A-Za-z0-9.]+)*__(?!_)",  # __X__
    rf"(?<![\w%])%{_NAME}%(?![\w%])|%\({_NAME}\)[sd]",  # %x% %(x)s
    rf"(?<![\w$])\${_NAME}\$(?![\w$])",  # $X$
    rf"(?<![\w#])#{_NAME}#(?![\w#])",  # #X#
    rf"(?<![\w~])~{_NAME}~(?![\w~])",  # ~x~
    r"\((?iu:điền|dien|nhập|nhap|fill in|enter|insert) [^()\n]{1,40}\)",  # (fill in x)
]
# Every grammar starts with one of these signs, so other positions are passed over at once.
VARIABLE = rf"(?=[{{<\[«@_%$#~(:])(?:{'|'.join(VARIABLES)})"
# What a program prints for a value it does not have.
EMPTY = r"(?=[uUnN\[])(?<![\w\"'.])(?:(?:undefined|UNDEFINED)(?! (?:terms?|behaviou?r|references?|variables?|symbols?|function|property|results?)\b)|(?i:\[object object\])|NaN|(?:null|NULL)(?! (?:hypothes[ie]s|values?|pointers?|sets?|vectors?|models?|results?)\b)|nil|None(?! of))(?![\w\"'(])"
# Code blocks and quoted code.
CODE = r"(?s)```.*?```|~~~.*?~~~|(?i:<(pre|code)\b[^<>]*>.*?</\1>)"
QUOTED = r"(?<!`)`[^`\n]{1,200}`(?!`)"
# Fixed values, folded: marks of a sentence that explains, logs or shows variables.
EXPLAINS = (
    r"\bbien\b.{0,40}(?:thay|ngoac)|\bky hieu \S+ cho moi|\bo cho can\b|\bcu phap\b|\b(?:is|are|will be) (?:replaced|substituted|filled in) (?:by|with|before|when|automatically)|\bnever type\b"
    r"|\b(?:place ?holders?|(?:merge|template|mail) (?:fields?|variables?|tags?)|variables?|bien mau|tham so mau)\b.{0,60}[\[{<«@_%$#~(]|[\]}>»@_%$#~)][\"'\u201d\u2019]? (?:place ?holders?|(?:merge |template )?(?:fields?|variables?|tags?))\b"
    r"|\b(?:syntax|written as|stands for|rendered with)\b|^log\b|\blog mau\b|\bevent=|payload=|\"\w+\"\s*:"
)
# Fixed values, folded: marks of a sentence that speaks of a program's empty values.
SPEAKS_OF_EMPTY = (
    r"\b(?:python|java(?:script)?|typescript|sql|json|golang|ruby|database|column|keyword|literal|data ?type|cot du lieu|kieu du lieu|ngon ngu)\b"
    r"|\b(?:values?|type|word|gia tri|tu khoa) (?:of )?[\"']?(?:null|none|nan|nil|undefined)\b|\b(?:returns?|means?|equals?|nghia la) [\"']?(?:null|none|nan|nil|undefined)\b"
)
# Fixed values, folded: marks of a sentence that says what a notice means or when it comes.
SPEAKS_OF_NOTICE = (
    r"\b(?:means?|indicates?|stands for|refers to|tells you|says that|(?:is|are) (?:shown|returned|displayed|sent|raised) (?:when|if|by)|(?:appears?|occurs?|happens?|comes? up) (?:when|if|because|after)"
    r"|nghia la|co nghia|cho biet|xuat hien khi|xay ra khi|hien ra khi|la ma loi|bedeutet|signifie|significa)\b"
)
# Words of the usual filler Latin.
LATIN = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud exercitation "
    "ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur vestibulum porta vel ultrices "
    "cras mollis sapien pharetra rutrum"
)
# Fixed values, folded: filler phrases at the start of a sentence, and anywhere in one.
FILLER_START = r"^\W*(?:to be completed\b|todo\b|tbd\b|(?:nhap|chen|dien) .{1,40} (?:tai|vao|o) day\b|(?:coming soon|content to follow)\W*$)"
FILLER = (
    r"\b(?:(?:text|heading|title|headline|content|message|paragraph|description|copy) (?:will )?goe?s? here\b|placeholder (?:copy|text|content)\b|(?:dummy|filler|mock) (?:content|text|copy)\b|insert .{1,40} here\b"
    r"|sample (?:paragraph|text)\b|replace before publishing\b|asdf\b|qwerty\b|abc abc\b|test test\b|noi dung mau\b|giu cho\b|doan chu nay\b|dat o day\b|viet o cho nay\b|van ban thu\b|khong co y nghia\b"
    r"|blindtext\b|platzhaltertext\b|texte? de remplissage\b|texto de relleno\b|noi dung (?:dang|se) (?:duoc )?(?:cap nhat|bo sung)\b)"
)
# Fixed values, folded: every phrase of FILLER holds one of these, so other texts are passed over at once.
FILLER_SEEDS = (
    "go here", "goes here", "placeholder ", "dummy ", "filler ", "mock ", "insert ", "sample ", "replace before", "asdf", "qwerty", "abc abc", "test test", "noi dung mau", "giu cho", "doan chu nay", "dat o day",
    "viet o cho nay", "van ban thu", "khong co y nghia", "blindtext", "platzhaltertext", "de remplissage", "de relleno", "noi dung dang", "noi dung se",
)
# Fixed values, folded: how a sentence of an error page, access or waiting notice, or script notice starts.
NOTICE = (
    r"^\W*(?:(?:error|loi)\s*\d{3}\b|\d{3}\s+(?:bad gateway|not found|internal server error|forbidden|service unavailable|gateway time-?out|gone|unauthorized|too many requests|bad request)\b"
    r"|(?:the )?requested (?:page|url|resource) |service (?:is )?temporarily unavailable|please try again (?:in|later)|this (?:page|site) (?:isn.?t|is not) working|the \w+ service took too long|something went wrong"
    r"|access denied|you do not have permission|(?:your )?session has expired|sign in again|too many requests|slow down and retry|(?:incident|reference|request id)\W{0,2} ?[0-9a-f]{6,}\b|traceback \(most recent|gateway/"
    r"|may chu dang bao tri|trang khong ton tai|quay lai trang chu|he thong qua tai|ban khong co quyen|phien dang nhap da het han|vui long (?:dang nhap lai|thu lai|bat (?:javascript|script))|khong the hien thi"
    r"|tai lai trang|het thoi gian cho|da xay ra loi|ma (?:loi|tham chieu)\b|khong tim thay trang"
    r"|(?:please )?(?:enable|turn on|allow) (?:java)?scripts?\b|(?:java)?scripts? (?:is|are|and cookies) (?:disabled|required|off|must)|scripts and cookies|this (?:site|page|app) (?:requires|needs) (?:java)?scripts?"
    r"|(?:the |this |your )?(?:page|document|file|resource|content|web ?site|site|link|url)\b.{0,40}\b(?:could not|couldn.?t|cannot|can.?t|can not|was not|is not|isn.?t|does not|doesn.?t|has been|no longer) (?:be )?"
    r"(?:loaded|found|displayed|opened|shown|available|exist|reached|retrieved|moved|removed|deleted|rendered)|(?:we.?re|we are|we.?ll be) (?:sorry|down|back|currently)\b.{0,60}(?:maintenance|soon|shortly|unavailable|wrong)"
    r"|(?:the )?(?:site|service|system|portal|server) (?:is )?(?:currently |temporarily )?(?:down|offline|unavailable|under maintenance|undergoing)|(?:connection|request|gateway|session) (?:has )?timed? ?out|rate limit|unsupported browser"
    r"|(?:please |you must |you need to )?(?:log|sign) in (?:again )?to (?:continue|view|access|see)|(?:you are )?(?:not authori[sz]ed|unauthori[sz]ed|forbidden)\b|(?:please )?(?:verify|confirm|prove) (?:that )?you are (?:a )?human|just a moment|one moment"
    r"|(?:oops|sorry|whoops|uh.oh|ooops)\W+(?:we|the|this|that|your|something|an?|page|but)\b|internal server error|you have been (?:logged|signed) out|(?:this |your )?account (?:has been|is) (?:suspended|locked|disabled)|(?:please )?(?:enable|allow|accept) cookies|we (?:can.?t|cannot|could not|couldn.?t|are unable to) (?:find|load|open|display|show|reach|process|connect)"
    r"|(?:[45]\d\d )(?:[a-z-]+ ){0,3}(?:error|timeout|gateway|required|exceeded|unavailable|refused)\b|an? (?:[a-z]+ ){0,2}error (?:has )?(?:occurred|happened)|error (?:establishing|connecting|loading|processing|retrieving|fetching|opening)\b|fatal error\b"
    r"|(?:subscribe|register|log in|login|sign up|sign in) to (?:read|continue|view|access|unlock|see)|your (?:browser|device) (?:has|does|is|may)\b.{0,40}(?:javascript|scripts?|cookies|outdated|support)|this (?:feature|content|video) is (?:not available|unavailable|only available|restricted)"
    r"|(?:ban |quy khach )?(?:can|phai|hay|vui long) (?:dang nhap|bat cookie|cap nhat trinh duyet)|(?:trang(?: web)?(?: nay)?|website|he thong|dich vu|cong tra cuu) (?:hien |tam thoi |hien tai )?(?:dang|tam|khong) (?:duoc )?(?:bao tri|nang cap|ngung|ngung hoat dong|dung|truy cap duoc|kha dung|tim thay|phan hoi)"
    r"|(?:le )?(?:site|service)(?: web)? (?:est )?(?:en maintenance|indisponible)|(?:el )?(?:sitio|servicio) (?:esta )?(?:en mantenimiento|no disponible)|(?:please )?wait while (?:we|your|the (?:page|site|system|request|connection|browser))|cookies (?:are|must be) (?:disabled|enabled|required)|(?:your )?browser (?:is not|isn.?t|does not|doesn.?t) support|complete the (?:captcha|security check)"
    r"|(?:die |diese )?(?:seite|datei) (?:wurde |konnte |ist )?(?:leider )?nicht (?:gefunden|verfugbar|geladen)|zugriff (?:verweigert|nicht)|bitte (?:aktivieren|schalten|warten|melden|versuchen) sie|javascript (?:ist|muss|wird)|fehler \d{3}\b|(?:ihre )?sitzung ist"
    r"|(?:der |dieser )?(?:dienst|server) ist (?:derzeit|momentan|vorubergehend)|wartungsarbeiten|ihr browser|page non trouvee|(?:la )?page (?:demandee |que vous )|acces refuse|erreur \d{3}\b|veuillez (?:activer|patienter|vous connecter|reessayer)"
    r"|pagina no encontrada|acceso denegado|(?:por favor,? )?(?:active|habilite) javascript|checking your browser|trinh duyet (?:cua ban )?(?:khong ho tro|da tat|dang tat)|ung dung can cho phep|dang tai\b|neu trang khong hien|can bat javascript|you need to enable|loading\b)"
)
# Fixed values, folded: page furniture that is neither content nor notice.
FURNITURE = r"\s\|\s|^(?:tai lieu|document|tep|file) \W?\d+$|^(?:gioi thieu|dieu khoan|trang chu|lien he|huong dan|about us|terms|user guide|home|help|contact|privacy)$"
SENTENCE = r"\n+|(?<=[.!?])\s+"
#: Share of filler in the text from which it counts as filler.
FILLER_SHARE = 0.1
#: Share of notices in what is not page furniture from which they stand in place of content.
NOTICE_SHARE = 0.5


def _sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, SENTENCE), lambda s: F.trim(s)), lambda s: s != "")


def _latin(sentence: Column) -> Column:
    """Whether a sentence starts like filler Latin and seven tenths of its words are."""
    names = LATIN.replace(" ", "|")
    known, words = F.regexp_count(sentence, F.lit(rf"\b(?:{names})\b")), F.regexp_count(sentence, F.lit(r"[a-z]+"))
    return (F.rlike(sentence, F.lit(rf"^\W*(?:{names})\b")) | F.contains(sentence, F.lit("lorem ipsum"))) & (known >= 4) & (known >= 0.7 * words)


def _share(kinds: list[str], of: Column) -> Column:
    """Characters of the sentences of some kinds over ``of``."""
    part = F.aggregate("classes__", F.lit(0), lambda n, c: n + F.when(c["kind"].isin(kinds), c["size"]).otherwise(0))
    return F.coalesce(F.try_divide(part.cast("double"), of), F.lit(0.0))


def _prose(text: Column) -> Column:
    """The text without code blocks and quoted code."""
    blocks = F.rlike(text, F.lit(r"```|~~~|(?i:</(?:pre|code)>)"))
    plain = F.when(blocks, F.regexp_replace(text, CODE, " ")).otherwise(text)
    return F.when(F.contains(text, F.lit("`")), F.regexp_replace(plain, QUOTED, " ")).otherwise(plain)


def _latin_at_length(sentence: Column) -> Column:
    """Whether a sentence is filler Latin of eight words or more."""
    return _latin(sentence) & (F.regexp_count(sentence, F.lit(r"[a-z]+")) >= 8)


def judge(documents: DataFrame) -> DataFrame:
    """``documents`` with ``variables``, ``filler_share``, ``notice_share`` and ``residue``.

    ``variables`` counts sentences with unfilled variables beyond those that explain some;
    ``residue`` is ``template``, ``filler``, ``notice`` or null.
    """
    # Worked out once a row: behind an explode, what follows reads them as columns.
    documents = documents.withColumn("prose__", F.explode_outer(F.array(_prose(F.col("text")))))
    prose = F.col("prose__")
    # Plain ASCII has no accents to strip.
    marked = F.rlike(prose, F.lit(r"[^\x00-\x7F]"))
    made = F.when(marked, strip_accents(F.lower(prose))).otherwise(F.lower(prose))
    documents = documents.withColumn("folded__", F.explode_outer(F.array(made)))
    folded = F.col("folded__")
    seeded = F.lit(False)
    for seed in FILLER_SEEDS:
        seeded = seeded | F.contains(folded, F.lit(seed))
    documents = documents.withColumn("seeded__", F.coalesce(seeded, F.lit(False)))
    may_hold = F.rlike(prose, F.lit(VARIABLE)) | F.rlike(prose, F.lit(EMPTY))
    plain = lambda s: strip_accents(F.lower(s))
    explains = lambda s: F.rlike(plain(s), F.lit(EXPLAINS))
    speaks = lambda s: F.rlike(plain(s), F.lit(SPEAKS_OF_EMPTY))
    holds = lambda s: F.rlike(s, F.lit(VARIABLE)) | (F.rlike(s, F.lit(EMPTY)) & ~speaks(s))
    marked = F.transform(F.filter(_sentences(prose), holds), explains)
    unfilled = F.size(F.filter(marked, lambda e: ~e))
    variables = F.when(may_hold, F.greatest(F.lit(0), F.when(unfilled > F.size(marked) - unfilled, unfilled))).otherwise(0)
    # Each sentence is classed once; everything after works on sizes and classes.
    notice = lambda s: F.rlike(s, F.lit(NOTICE)) & ~F.rlike(s, F.lit(SPEAKS_OF_NOTICE))
    filler = lambda s: ((F.col("seeded__") & F.rlike(s, F.lit(FILLER))) | F.rlike(s, F.lit(FILLER_START)) | _latin(s)) & ~F.rlike(s, F.lit(EXPLAINS))
    kind = lambda s: F.when(notice(s), "notice").when(filler(s), F.when(_latin_at_length(s), "latin").otherwise("filler")).when(F.rlike(s, F.lit(FURNITURE)), "furniture").otherwise("")
    classes = F.transform(_sentences(folded), lambda s: F.struct(F.length(s).alias("size"), kind(s).alias("kind")))
    rows = documents.withColumn("classes__", F.explode_outer(F.array(classes))).withColumn("variables", F.coalesce(variables, F.lit(0)))
    whole = F.aggregate("classes__", F.lit(0), lambda n, c: n + c["size"])
    furniture = F.aggregate("classes__", F.lit(0), lambda n, c: n + F.when(c["kind"] == "furniture", c["size"]).otherwise(0))
    rows = rows.withColumn("latin__", F.exists("classes__", lambda c: c["kind"] == "latin"))
    rows = rows.withColumn("filler_share", _share(["filler", "latin"], whole)).withColumn("notice_share", _share(["notice"], whole - furniture)).drop("classes__")
    is_filler = F.coalesce("latin__", F.lit(False)) | (F.col("filler_share") >= FILLER_SHARE)
    residue = F.when(F.col("variables") > 0, "template").when(is_filler, "filler").when(F.col("notice_share") >= NOTICE_SHARE, "notice")
    return rows.withColumn("residue", residue).drop("latin__", "prose__", "folded__", "seeded__")


def found(documents: DataFrame) -> DataFrame:
    """``doc_id`` of the texts that are residue instead of finished content."""
    return judge(documents.select("doc_id", "text")).where("residue is not null").select("doc_id")


def kept(documents: DataFrame) -> DataFrame:
    """The documents that are finished content, with all their columns."""
    judged = judge(documents.select("doc_id", "text")).where("residue is null").select("doc_id")
    return documents.join(judged, "doc_id", "left_semi")
