"""Problem 2: text that looks the same in one consistent form.

Texts that are already consistent are recognised by one pattern and never leave their row.
The others are cut into runs that need no change and clusters (a character with the marks
and invisible characters after it); clusters are exploded to positioned code points, a
broadcast join brings each code point's decomposition or look-alike, combining marks are
put in order of their class, a second broadcast join brings what the starters compose to,
and each cluster is recomposed; then the text is rebuilt.  Equal clusters are worked out
once.

Two forms come out.  The comparison form (``plain``) replaces every letter of another script
that is drawn like a Latin one: texts that look the same have the same one.  The consistent
text (``written``) replaces such letters only where they stand for Latin ones: in words that
hold Latin letters and no letter that is only of the other script, and in words made of
look-alikes alone if the text's letters are mostly Latin.  So Russian or Greek words stay
what they are.

What looks the same: canonical equivalents; full-width, half-width and other width or font
variants; letters and numerals written in one sign (ligatures such as fi, Roman numerals)
and the ellipsis sign, which look like the letters or dots they stand for; every kind of
blank (not line ends); invisible format characters, which are left out; letters of other
scripts that are drawn like a Latin one.  What does not: another accent, letter case,
raised or lowered signs, fractions, any further visible sign.

Defined results: null stays null, empty stays empty; blanks are not collapsed; the mapping
table is built from the Unicode database, about 5,000 entries, and the compositions are
about 400 families, whatever the data.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache
from string import ascii_letters

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.session import cut

# Letters of other scripts by the Latin letter they are drawn like: Cyrillic,
# Greek, Armenian, Cherokee, Lisu and Coptic ones, and Latin doubles.
LOOKALIKES = {
    "A": "АΑᎪꓮ", "B": "ВΒᏴꓐ", "C": "СϹᏟꓚⲤ", "D": "Ꭰꓓ", "E": "ЕΕᎬꓰ", "F": "ꓝ", "G": "Ꮐꓖ", "H": "НΗᎻꓧⲎ", "I": "ІΙӀꓲ", "J": "ЈͿᎫꓙ",
    "K": "КΚᏦꓗⲔ", "L": "Ꮮꓡ", "M": "МΜᎷꓟⲘ", "N": "ΝꓠⲚ", "O": "ОΟՕꓳⲞ", "P": "РΡᏢꓑⲢ", "Q": "Ԛ", "R": "Ꭱꓣ", "S": "ЅՏᏚꓢ",
    "T": "ТΤᎢꓔⲦ", "U": "Սꓴ", "V": "Ꮩꓦ", "W": "ԜᎳꓪ", "X": "ХΧꓫⲬ", "Y": "ҮΥꓬⲨ", "Z": "ΖᏃꓜ",
    "a": "аɑ", "c": "сϲⲥ", "d": "ԁ", "e": "е", "g": "ɡց", "h": "һհ", "i": "і", "j": "јϳ", "l": "ӏ", "n": "ո", "o": "оοօⲟ", "p": "рⲣ", "q": "ԛզ",
    "s": "ѕ", "u": "ս", "v": "ѵν", "w": "ԝ", "x": "х", "y": "у", "Đ": "ÐƉ",
}
# Signs drawn alike.
SIGNS = {"-": "‐‑", ";": ";", "...": "…"}
#: Letters of scripts that hold look-alikes, as a Java pattern.
OTHER_SCRIPT = r"[\p{IsCyrillic}\p{IsGreek}\p{IsArmenian}\p{IsCherokee}\p{IsLisu}\p{IsCoptic}]"
LATIN = r"\p{IsLatin}"
#: Words and what stands between them.
WORDS = r"[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}]+"
#: Compatibility forms that look like their plain form.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<font>")
#: Blanks that are drawn as a blank; line ends are no blanks here.
BLANKS = [c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Zs" or c == "\t"]


def _hidden(char: str) -> bool:
    """Whether a character is drawn as nothing."""
    point = ord(char)
    filler = point in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0)
    selector = 0xFE00 <= point <= 0xFE0F or 0xE0100 <= point <= 0xE01EF or 0x180B <= point <= 0x180F
    return filler or selector or unicodedata.category(char) == "Cf" and not 0x0600 <= point <= 0x08FF


def _plain(char: str, letters: bool = True) -> str:
    """A code point's full decomposition with look-alikes replaced, or without look-alike ``letters``."""
    if char in _REPLACED and (letters or char not in _LETTERS):
        return _REPLACED[char]
    if _hidden(char):
        return ""
    if char in BLANKS:
        return " "
    kind, _, rest = unicodedata.decomposition(char).rpartition("> ")
    if not rest:
        return char
    spelled = kind == "<compat" and char != "ſ" and all(chr(int(x, 16)) in ascii_letters for x in rest.split())
    if kind and f"{kind}>" not in SAME_LOOK and not spelled:
        return char
    return "".join(_plain(chr(int(x, 16)), letters) for x in rest.split())


_LETTERS = {variant for variants in LOOKALIKES.values() for variant in variants}
_REPLACED = {variant: plain for plain, variants in [*LOOKALIKES.items(), *SIGNS.items()] for variant in variants}
# A replaced letter is decomposed like its plain form (none of them has a decomposition).


def mapping_rows() -> list[tuple[str, list[str], list[int]]]:
    """``cp``, what it is written as, and the combining class of each part, for code points that change."""
    rows = []
    for point in range(sys.maxunicode + 1):
        char = chr(point)
        if 0xD800 <= point <= 0xDFFF or 0xAC00 <= point <= 0xD7A3 or unicodedata.category(char) in ("Cn", "Co"):
            continue  # Hangul syllables are consistent as they are
        parts = _plain(char)
        if parts != char or unicodedata.combining(char):
            rows.append((char, list(parts), [unicodedata.combining(c) for c in parts]))
    return rows


def composition_families() -> dict[str, list[tuple[str, str]]]:
    """By starter: all ``(base and mark, composed)`` that marks after it can lead to, of the primary composites."""
    families: dict[str, list[tuple[str, str]]] = {}
    for point in range(sys.maxunicode + 1):
        char = chr(point)
        parts = unicodedata.decomposition(char)
        if parts and "<" not in parts and " " in parts and unicodedata.normalize("NFC", char) == char:
            pair = "".join(chr(int(x, 16)) for x in parts.split())
            families.setdefault(unicodedata.normalize("NFD", char)[0], []).append((pair, char))
    return families


def _char_class(chars: list[str]) -> str:
    """A Java character class of the given characters, as ranges."""
    points, ranges = sorted(map(ord, chars)), []
    for p in points:
        if ranges and p == ranges[-1][1] + 1:
            ranges[-1][1] = p
        else:
            ranges.append([p, p])
    return "".join(rf"\x{{{a:X}}}" if a == b else rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges)


@cache
def patterns() -> tuple[str, str, str]:
    """Patterns of a character outside the common consistent ones, of one that may change, and of a text's pieces.

    A piece is a run of common characters or one character with the marks and invisible
    characters after it.  Precomposed letters are consistent as they are.
    """
    rows = mapping_rows()
    dirty = {r[0] for r in rows if unicodedata.combining(r[0]) or unicodedata.normalize("NFC", "".join(r[1])) != r[0]} - {" "}
    common = _char_class([c for c in map(chr, [0x0A, 0x0D, *range(0x20, 0x250), *range(0x1E00, 0x1F00)]) if c not in dirty])
    joining = _char_class([r[0] for r in rows if (r[2] and r[2][0] or not r[1]) and unicodedata.category(r[0]) not in ("Mn", "Mc", "Me", "Cf")])
    follow = rf"[\p{{M}}\p{{Cf}}{joining}]"
    return f"[^{common}]", f"[{_char_class(sorted(dirty))}]", rf"[{common}]+(?!{follow})|(?s:.){follow}*"


def _recompose(parts: Column, table: Column) -> Column:
    """Text from ``(char, class)`` parts in canonical order, composing what ``table`` composes."""
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("base"), F.lit("").alias("marks"), F.lit(0).alias("last"))

    def step(acc: Column, part: Column) -> Column:
        char, cls = part["char"], part["class"]
        joined = F.try_element_at(table, F.concat(acc["base"], char))
        free = (acc["last"] < cls) | ((acc["last"] == 0) & (acc["marks"] == ""))
        composed = F.when((acc["base"] != "") & free, joined)
        return F.when(composed.isNotNull(), F.struct(acc["done"].alias("done"), composed.alias("base"), acc["marks"].alias("marks"), acc["last"].alias("last"))).when(
            cls == 0, F.struct(F.concat(acc["done"], acc["base"], acc["marks"]).alias("done"), char.alias("base"), F.lit("").alias("marks"), F.lit(0).alias("last"))
        ).otherwise(F.struct(acc["done"].alias("done"), acc["base"].alias("base"), F.concat(acc["marks"], char).alias("marks"), cls.alias("last")))

    end = lambda acc: F.concat(acc["done"], acc["base"], acc["marks"])
    return F.aggregate(parts, start, step, end)


def clusters(spark: SparkSession, distinct: DataFrame) -> DataFrame:
    """``piece``, ``look``, ``kept``: each distinct cluster with look-alike letters replaced and kept."""
    kept = lambda c: [(x, unicodedata.combining(x)) for x in _plain(c, letters=False)]
    mapping = spark.createDataFrame([(c, list(zip(parts, classes, strict=True)), kept(c)) for c, parts, classes in mapping_rows()], "cp string, parts array<struct<c:string,k:int>>, same array<struct<c:string,k:int>>")
    families = spark.createDataFrame([(c, f) for c, f in composition_families().items()], "char string, family array<struct<pair:string,composed:string>>")
    points = distinct.select("piece", F.posexplode(F.split("piece", "")).alias("pos", "cp"))
    met = points.join(F.broadcast(mapping), "cp", "left")
    own = F.array(F.struct(F.col("cp").alias("c"), F.lit(0).alias("k")))
    forms = F.array(F.struct(F.lit(True).alias("kept"), F.coalesce("same", own).alias("p")), F.struct(F.lit(False).alias("kept"), F.coalesce("parts", own).alias("p")))
    spelled = met.select("piece", "pos", F.inline(forms)).select("piece", "kept", "pos", F.posexplode_outer("p").alias("i", "x"))
    parts = spelled.select("piece", "kept", "pos", "i", F.col("x.c").alias("char"), F.col("x.k").alias("class"))
    joined = parts.join(F.broadcast(families), "char", "left")
    in_order = F.array_sort(F.collect_list(F.when(F.col("char").isNotNull(), F.struct("pos", "i", "char", "class"))))
    whole = joined.groupBy("piece", "kept").agg(in_order.alias("parts"), F.flatten(F.collect_set("family")).alias("pairs"))
    # Canonical order: within the marks after a starter, by class and then by position.
    starters = lambda i: F.size(F.filter(F.slice("parts", F.lit(1), i + 1), lambda q: q["class"] == 0))
    ranked = F.transform("parts", lambda p, i: F.struct(starters(i).alias("starter"), p["class"].alias("class"), i.alias("i"), p["char"].alias("char")))
    ordered = whole.withColumn("parts", F.array_sort(ranked)).withColumn("pairs", F.map_from_entries(F.array_distinct("pairs")))
    made = ordered.select("piece", "kept", _recompose(F.col("parts"), F.col("pairs")).alias("text"))
    return made.groupBy("piece").agg(F.max(F.when(~F.col("kept"), F.col("text"))).alias("look"), F.max(F.when(F.col("kept"), F.col("text"))).alias("kept"))


def _by_script(kept: Column, look: Column) -> Column:
    """``kept`` with the look-alike letters replaced that stand for Latin ones; ``look`` has all replaced.

    Replacing changes neither what is a word nor what stands between, so the words of both
    are in step.
    """
    latin = F.regexp_count(kept, F.lit(LATIN)) > F.regexp_count(kept, F.lit(OTHER_SCRIPT))

    def choose(a: Column, b: Column) -> Column:
        return F.when(F.rlike(b, F.lit(OTHER_SCRIPT)), a).when(latin | F.rlike(a, F.lit(LATIN)), b).otherwise(a)

    words = lambda t: F.regexp_extract_all(t, F.lit(WORDS), F.lit(0))
    return F.when(kept == look, kept).otherwise(F.array_join(F.zip_with(words(kept), words(look), choose), ""))


def both_forms(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``written``, the consistent text, and ``plain``, its comparison form.

    Only rows whose text may change are exploded, each different text once; the others
    keep their place and are not shuffled.
    """
    spark = rows.sparkSession
    rare, odd, cutter = patterns()
    may_change = F.coalesce(F.rlike(text, F.lit(rare)) & F.rlike(text, F.lit(odd)), F.lit(False))
    dirty = cut(rows.where(may_change).select(F.md5(text).alias("h"), F.col(text).alias("t")).distinct())
    pieces = dirty.select("h", F.posexplode(F.regexp_extract_all("t", F.lit(cutter), 0)).alias("at", "piece")).withColumn("odd", F.rlike("piece", F.lit(rare)) & F.rlike("piece", F.lit(odd)))
    forms = clusters(spark, pieces.where("odd").select("piece").distinct())
    changed = pieces.where("odd").join(forms, "piece").select("h", "at", "look", "kept")
    same_piece = pieces.where("not odd").select("h", "at", F.col("piece").alias("look"), F.col("piece").alias("kept"))
    joined = lambda c: F.array_join(F.transform("all", lambda x: x[c]), "")
    rebuilt = same_piece.union(changed).groupBy("h").agg(F.array_sort(F.collect_list(F.struct("at", "look", "kept"))).alias("all")).select("h", joined("look").alias("look"), joined("kept").alias("kept"))
    scripted = rebuilt.select(F.col("h").alias("hash__"), _by_script(F.col("kept"), F.col("look")).alias("written__"), F.col("look").alias("plain__"))
    rest = [c for c in rows.columns if c not in ("written", "plain")]
    made = rows.where(may_change).withColumn("hash__", F.md5(text)).join(scripted, "hash__")
    same = rows.where(~may_change).withColumn("written__", F.col(text)).withColumn("plain__", F.col(text))
    out = [*rest, F.col("written__").alias("written"), F.col("plain__").alias("plain")]
    return made.select(*out).unionByName(same.select(*out))


def consistent(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``plain``, the comparison form of ``text``."""
    return both_forms(rows, text).drop("written")


def alike(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``id_a`` < ``id_b`` of rows whose texts look the same and differ in code points.

    Spellings are paired first, then their rows: rows with the same code points are never
    compared with each other.  Null texts and keys make no pair; repeated rows count once.
    """
    named = rows.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"))
    plain = cut(both_forms(named, "text").select("id", F.md5("text").alias("s"), F.md5("plain").alias("g")).distinct())
    spellings = plain.select("g", "s").distinct()
    mixed = spellings.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g")
    known = spellings.join(mixed, "g")
    pairs = known.withColumnRenamed("s", "s_a").join(known.withColumnRenamed("s", "s_b"), "g").where("s_a < s_b")
    a = plain.select(F.col("s").alias("s_a"), F.col("id").alias("x"))
    b = plain.select(F.col("s").alias("s_b"), F.col("id").alias("y"))
    met = pairs.join(a, "s_a").join(b, "s_b").where("x != y")
    return met.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
