"""Problem 4: which postal addresses, written differently, denote the same location.

Method: a self-built gazetteer.  Every address is read into parts; addresses that name
street, district and city become gazetteer entries; spellings of districts within a city
and of streets within a district are clustered (a spelling joins its most frequent
neighbour one edit away, however many steps that leads; a spelling seen at one house only
also joins one two edits away that is seen at the same house); every address is then
resolved by a beam search over the entries - street, locality and ward evidence first,
then known house numbers for the hypotheses that these can still bring to the top, however
many - and receipts are joined on street identifier, house number and lane.

An address that names street, district and city is part of the gazetteer: its own entry
agrees in all three, which no other entry can, so the search ends there at once.  The
others are resolved once for each different combination of street, ward, district, city and
loose parts; house numbers are only looked at where these leave several hypotheses.  What
is exploded by spelling keys are combinations and entries, never whole addresses, so an
address or a street held by a third of all receipts costs one resolution.  Spelling
candidates meet through shared deletion keys, never through all pairs.

An address that fits no entry, or several equally well, stands for itself: it equals
addresses of the same street and house whose city, district and ward are the same.  A part
it does not name is taken from others of the same street and house if they agree in all
that both name and there is one such value only; else it stays unnamed and equals no named
one.

Defined results: null, blank or dash-only texts and texts without a house number and a
street are no address and are in no pair; rows repeated for a receipt count once, the
latest ``updated_at`` holds.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.session import cut

# How the parts of an address are introduced, folded to plain lower case.
LABEL = r"^(?:dia chi(?: nguoi ban)?|d/c|dc)\s*:\s*"
COUNTRY = r"^(?:vn|viet ?nam)\.?$"
UNIT = r"^(?:phong|lau|tang|ki-?ot|toa nha|can ho|kiosk|floor|room|stall)\b"
CITY = r"^(?:thanh pho|tp|t\.p)\b\.?\s*|^tp\.?(?=[a-z]{3}$)"
CITY_TAIL = r"\s+city$"
DISTRICT = r"^(?:quan\b|huyen\b|thi xa\b|[qh]\.|[qh](?=\s|\d))\s*"
WARD = r"^(?:phuong\b|xa\b|thi tran\b|tt\b\.?|[pfx]\.|[pfx](?=\s|\d))\s*"
STREET = r"^(?:duong\b|pho\b|dg\b\.?|d\.|str\b\.?|street\b|d(?=\s))\s*"
HOUSE = r"^(?:so nha|so|no\b\.?|sn|#)?\s*(\d+)(?:\s*-?\s*([a-z])(?![a-z.]))?(?:\s*/\s*(\d+)(?:\s*-?\s*([a-z])(?![a-z.]))?)?"
LANE = r"^(?:ngo|hem|ngach|kiet)\s+(\d+[a-z]?)\b"

#: What a house number known at the street adds: the last evidence weighed.  The beam is as wide, so it drops no hypothesis that could still win or tie.
KNOWN = 0.25
PARTS = "address string, house string, street string, ward string, district string, city string, loose array<string>"


def folded(text: str) -> str:
    """Lower case without accents, đ as d."""
    plain = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text).lower()).replace("đ", "d")
    return "".join(c for c in plain if not unicodedata.combining(c))


def _name(text: str) -> str:
    """A place name as compared: words joined without blanks, numbers without leading zeros."""
    words = re.sub(r"[^a-z0-9]+", "", text)
    return words.lstrip("0") or words if words.isdigit() else words


def read_parts(text: str | None) -> tuple | None:
    """House, street, ward, district, city and parts of unknown kind; None if it is no address."""
    if text is None:
        return None
    plain = re.sub(LABEL, "", folded(text).strip())
    pieces = [p.strip(" .") for p in re.split(r"[,;\n\t]+|\s+-\s+|\s{2,}", plain)]
    house = street = ward = district = city = lane = None
    loose: list[str] = []
    bare_house = False
    for piece in pieces:
        if not piece or re.match(COUNTRY, piece) or re.match(UNIT, piece):
            continue
        if re.search(CITY_TAIL, piece) or re.match(CITY, piece):
            city = city or _name(re.sub(CITY, "", re.sub(CITY_TAIL, "", piece)))
            continue
        number = re.match(HOUSE, piece)
        if number and house is None:
            first, letter, second, tail = number.groups()
            house = first + (letter or "") + (f"/{second}{tail or ''}" if second else "")
            rest = piece[number.end() :].strip(" .")
            if alley := re.match(LANE, rest):
                lane, rest = alley[1], rest[alley.end() :].strip(" .")
            bare_house = not rest
            if rest and street is None:
                street = _name(re.sub(STREET, "", rest))
            continue
        if alley := re.match(LANE, piece):
            lane = lane or alley[1]
            rest = piece[alley.end() :].strip(" .")
            if rest and street is None:
                street, bare_house = _name(re.sub(STREET, "", rest)), False
            continue
        if re.match(DISTRICT, piece):
            district = district or _name(re.sub(DISTRICT, "", piece))
        elif re.match(STREET, piece) and street is None:
            street, bare_house = _name(re.sub(STREET, "", piece)), False
        elif re.match(WARD, piece):
            ward = ward or _name(re.sub(WARD, "", piece))
        elif bare_house and street is None:
            street, bare_house = _name(piece), False
        else:
            loose.append(_name(piece))
    if not house or not street:
        return None
    return (f"{lane}/{house}" if lane else house), street, ward, district, city, [x for x in loose if x]


def _read_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(text, *parts, n) for text, n in zip(batch["address"], batch["n"], strict=True) if (parts := read_parts(text)) is not None]
        yield pd.DataFrame(rows, columns=["address", "house", "street", "ward", "district", "city", "loose", "n"])


def near(a: Column, b: Column) -> Column:
    """Whether two names are equal or one edit apart (also two letters swapped); numbers and short names must be equal."""
    swapped = (F.length(a) == F.length(b)) & (F.levenshtein(a, b, 2) == 2) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))
    fuzzy = (F.least(F.length(a), F.length(b)) >= 5) & ~F.rlike(a, F.lit(r"^\d+$")) & ((F.levenshtein(a, b, 1) >= 0) | swapped)
    return (a == b) | fuzzy


def _keys(name: Column) -> Column:
    """Hashes of the name and of every form of it with one letter left out: names one edit apart share one."""
    cuts = F.transform(F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1))), lambda i: F.concat(F.substring(name, F.lit(1), i - 1), F.substring(name, i + 1, F.length(name))))
    forms = F.concat(F.array(name), F.when(F.length(name) >= 5, cuts).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.transform(forms, lambda x: F.xxhash64(x)))


def _halves(name: Column) -> Column:
    """Hashes of a name's first and last halves: names one edit or one swap apart share one.

    Fewer than :func:`_keys` and less telling, for names of one district.
    """
    half = F.array_distinct(F.array(F.floor((F.length(name) - 1) / 2), F.floor(F.length(name) / 2)).cast("array<int>"))
    forms = F.transform(half, lambda h: F.array(F.xxhash64(F.lit("first"), F.substring(name, F.lit(1), h)), F.xxhash64(F.lit("last"), F.right(name, h))))
    return F.array_distinct(F.concat(F.array(F.xxhash64(name)), F.when(F.length(name) >= 5, F.flatten(forms)).otherwise(F.array().cast("array<bigint>"))))


def _follow(links: DataFrame, within: list[str], name: str) -> DataFrame:
    """``within``, ``name``, ``canonical``: the end of each chain of ``name`` to ``next`` links, of any length.

    Links lead to more frequent spellings, so there are no circles; chains halve with every step.
    """
    links = cut(links)
    while True:
        further = links.select(*within, F.col(name).alias("next"), F.col("next").alias("after"))
        moved = cut(links.join(further, [*within, "next"], "left").select(*within, name, F.coalesce("after", "next").alias("next"), F.col("after").isNotNull().alias("moved")))
        links = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return links.withColumnRenamed("next", "canonical")


def _cluster(spellings: DataFrame, within: list[str], name: str, seen: DataFrame | None = None) -> DataFrame:
    """``within``, ``name``, ``canonical``: the spelling each spelling stands for.

    ``spellings`` has a count ``n`` for each spelling.  A neighbour must be more frequent,
    or as frequent and later in the alphabet.  ``seen`` has the house numbers of spellings:
    two spellings of which one is seen at a single house, which is one of the other's, may
    be two edits apart.
    """
    keyed = spellings.select(*within, name, "n", F.explode(_halves(F.col(name))).alias("k"))
    other = keyed.select(*within, F.col(name).alias("other"), F.col("n").alias("m"), "k")
    more = F.struct("m", "other") > F.struct("n", F.col(name).alias("other"))
    pairs = keyed.join(other, [*within, "k"]).where(more & near(F.col(name), F.col("other"))).select(*within, name, "m", "other")
    if seen is not None:
        single = seen.groupBy(*within, name).agg(F.count("*").alias("houses"))
        at = spellings.join(single, [*within, name]).join(seen, [*within, name]).select(*within, name, "n", "houses", "house")
        # Those seen at one house meet the spellings of their district at that house.
        lone = at.where("houses = 1").drop("houses")
        close = at.select(*within, "house", F.col(name).alias("other"), F.col("n").alias("m"))
        two = (F.least(F.length(name), F.length("other")) >= 8) & (F.levenshtein(F.col(name), F.col("other"), 2) >= 0)
        pairs = pairs.union(lone.join(close, [*within, "house"]).where(more & two).select(*within, name, "m", "other"))
    best = pairs.groupBy(*within, name).agg(F.max(F.struct("m", "other"))["other"].alias("next"))
    return spellings.select(*within, name).join(_follow(best, within, name), [*within, name], "left").withColumn("canonical", F.coalesce("canonical", name))


def localities(parts: DataFrame) -> DataFrame:
    """``parts`` (keyed by ``aid``) with each district in its city's most frequent spelling.

    A part of unknown kind that is a district of the named city, or one edit away from
    one, becomes the district where none is named.
    """
    places = parts.where("city is not null and district is not null").groupBy("city", "district").agg(F.sum("n").alias("n"))
    spelling = _cluster(places, ["city"], "district")
    known = places.join(spelling, ["city", "district"]).groupBy("city", F.col("canonical").alias("known")).agg(F.sum("n").alias("m"))
    named = parts.join(spelling.withColumnRenamed("canonical", "named"), ["city", "district"], "left").withColumn("district", F.coalesce("named", "district")).drop("named")
    bare = named.where("city is not null and district is null").select("aid", "city", F.explode("loose").alias("part"))
    asked = bare.withColumn("k", F.explode(_keys(F.col("part"))))
    offered = known.select("city", "known", "m", F.explode(_keys(F.col("known"))).alias("k"))
    named_part = F.struct((F.col("part") == F.col("known")).alias("exact"), "m", "known", "part")
    hit = asked.join(offered, ["city", "k"]).where(near(F.col("part"), F.col("known"))).groupBy("aid").agg(F.max(named_part).alias("hit"))
    filled = named.join(hit, "aid", "left").withColumn("district", F.coalesce("district", "hit.known"))
    return filled.withColumn("loose", _without(F.col("loose"), F.col("hit.part"))).drop("hit")


def _without(parts: Column, part: Column) -> Column:
    return F.when(part.isNull(), parts).otherwise(F.array_remove(parts, F.coalesce(part, F.lit(""))))


def gazetteer(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``entry``, ``city``, ``district``, ``street``, ``n``, ``wards`` from addresses that name all three, and their ``aid``, ``entry``, ``house``.

    ``parts`` has one row for each distinct address, with ``n`` receipts, the city in its
    listed form and the district in its most frequent spelling.
    """
    placed = parts.where("city is not null and district is not null")
    within = ["city", "district"]
    streets = cut(placed.groupBy(*within, "street").agg(F.sum("n").alias("n")))
    street = _cluster(streets, within, "street", placed.select(*within, "street", "house").distinct())
    named = placed.join(street, [*within, "street"]).withColumn("street", F.col("canonical"))
    named = cut(named.select(F.concat_ws("|", "city", "district", "street").alias("entry"), "aid", "house", *within, "street", "n", "ward"))
    entries = named.groupBy("entry", *within, "street").agg(F.sum("n").alias("n"), F.collect_set("ward").alias("wards"))
    return entries, named.select("aid", "entry", "house")


def _any_near(names: Column, name: Column) -> Column:
    return F.exists(names, lambda x: near(x, name))


QUESTION = ["street", "ward", "district", "city", "loose"]


def _hypotheses(questions: DataFrame, entries: DataFrame) -> DataFrame:
    """``q``, ``entry``, ``s``: the entries each question may mean, weighed by street, locality and ward, within ``KNOWN`` of the best."""
    asked = questions.select("q", "street", "city", "district", F.explode(_keys(F.col("street"))).alias("k"))
    known = entries.select("entry", F.col("street").alias("e_street"), F.col("district").alias("e_district"), F.col("city").alias("e_city"), F.explode(_keys(F.col("street"))).alias("k"))
    # Those that name their city meet that city's streets only, the others those of the district they name.
    in_city = asked.where("city is not null").join(known, (asked["k"] == known["k"]) & (asked["city"] == known["e_city"]))
    in_district = asked.where("city is null and district is not null").join(known, (asked["k"] == known["k"]) & (asked["district"] == known["e_district"]))
    anywhere = asked.where("city is null and district is null").join(known, asked["k"] == known["k"])
    either = [m.where(near(F.col("street"), F.col("e_street"))).select("q", "entry") for m in (in_city, in_district, anywhere)]
    pairs = either[0].union(either[1]).union(either[2]).distinct()
    places = entries.select("entry", F.col("street").alias("e_street"), F.col("district").alias("e_district"), F.col("city").alias("e_city"), "wards")
    met = pairs.join(questions, "q").join(places, "entry")
    exact = F.when(F.col("street") == F.col("e_street"), 3.0).otherwise(2.0)

    def locality(name: str) -> Column:
        mine, theirs = F.col(name), F.col(f"e_{name}")
        loosely = F.when(_any_near(F.col("loose"), theirs), 2.0).otherwise(0.0)
        # A clear conflict of a named district or city rules a hypothesis out at once.
        return F.when(mine.isNull(), loosely).when(mine == theirs, 2.0).when(near(mine, theirs), 1.5).otherwise(-5.0)

    placed = met.withColumn("s", exact + locality("city") + locality("district")).where(F.col("s") >= 2)
    written = F.array_compact(F.concat(F.array("ward"), F.col("loose")))
    agrees = F.exists("wards", lambda w: F.exists(written, lambda x: near(x, w)))
    same_ward = F.when(agrees, 1.0).when(F.col("ward").isNotNull() & (F.size("wards") > 0), -0.5).otherwise(0.0)
    two = placed.select("q", "entry", (F.col("s") + same_ward).alias("s"))
    whole = Window.partitionBy("q")
    beam = two.withColumn("top", F.max("s").over(whole)).where(F.col("s") >= F.col("top") - KNOWN)
    return beam.withColumn("rivals", F.count("*").over(whole)).drop("top")


def resolve(parts: DataFrame, entries: DataFrame, houses: DataFrame, key: str = "address") -> DataFrame:
    """``key``, ``entry``: the gazetteer entry of each address, by beam search.

    Step 1 proposes entries whose street is the address's street or one edit away.
    Step 2 weighs district and city: named and agreeing, named and another, or found among
    parts of unknown kind; and the ward.  Step 3 adds whether the house number is known at
    the street, where several hypotheses are within ``KNOWN`` of the best; an address whose
    two best hypotheses weigh the same has no entry.
    """
    question = F.unhex(F.md5(F.to_json(F.struct(*QUESTION))))
    asked = parts.select(key, "house", question.alias("q"), *QUESTION)
    questions = cut(asked.groupBy("q").agg(*[F.first(c).alias(c) for c in QUESTION]))
    beam = cut(_hypotheses(questions, entries))
    asked = asked.select(key, "house", "q")
    clear = asked.join(beam.where("rivals = 1"), "q").select(key, "entry")
    open_ = asked.join(beam.where("rivals > 1"), "q")
    three = open_.join(houses.withColumn("known", F.lit(KNOWN)), ["entry", "house"], "left").withColumn("s", F.col("s") + F.coalesce("known", F.lit(0.0)))
    # Hypotheses of one weight are counted, not collected: a street name may stand in any number of localities.
    weighed = three.groupBy(key, "s").agg(F.count("*").alias("tied"), F.min("entry").alias("entry"))
    best = weighed.groupBy(key).agg(F.max(F.struct("s", "tied", "entry")).alias("best"))
    return clear.union(best.where("best.tied = 1").select(key, F.col("best.entry").alias("entry")))


def _filled(rows: DataFrame, part: str, others: list[str]) -> DataFrame:
    """``rows`` with ``part``, where it is null, from the rows of the same street and house.

    They must name it and agree in all of ``others`` that both name; it is taken if there is
    one such value only.
    """
    lacking = rows.where(F.col(part).isNull()).select("i", "street", "house", *others)
    naming = rows.where(F.col(part).isNotNull()).select("street", "house", F.col(part).alias("value"), *[F.col(o).alias(f"o_{o}") for o in others]).distinct()
    agree = F.lit(True)
    for o in others:
        agree = agree & F.coalesce(F.col(o) == F.col(f"o_{o}"), F.lit(True))
    values = lacking.join(naming, ["street", "house"]).where(agree).groupBy("i").agg(F.min("value").alias("value"), F.max("value").alias("last"))
    only = values.where("value = last").select("i", "value")
    return rows.join(only, "i", "left").withColumn(part, F.coalesce(part, "value")).drop("value")


def unresolved(parts: DataFrame) -> DataFrame:
    """``aid``, ``place`` of addresses without an entry, by their own parts and those of their like."""
    named = ["city", "district", "ward"]
    keyed = parts.withColumn("i", F.unhex(F.md5(F.to_json(F.struct("street", "house", *named)))))
    rows = keyed.groupBy("i").agg(*[F.first(c).alias(c) for c in ("street", "house", *named)])
    for part in named:
        rows = cut(_filled(rows, part, [x for x in named if x != part]))
    # With a district the ward is no part of the place.
    ward = F.when(F.col("district").isNull(), F.concat(F.lit("ward "), "ward"))
    place = F.concat_ws("|", F.coalesce("city", F.lit("?")), F.coalesce("district", ward, F.lit("?")), "street")
    return keyed.select("aid", "i").join(rows.select("i", place.alias("place")), "i").select("aid", "place")


def _plain_names(names: pd.Series) -> pd.Series:
    return names.map(lambda t: None if t is None else _name(folded(re.sub(r"\s+city$", "", t.strip(), flags=re.I))))


def listed_cities(aliases: DataFrame) -> DataFrame:
    """``name``, ``known``: folded spellings of the listed cities and the city each means."""
    plain = F.pandas_udf(_plain_names, "string")
    names = aliases.select(F.col("city_name").alias("known"), F.col("alias").alias("name")).union(aliases.select("city_name", "city_name")).distinct()
    return names.select(plain("known").alias("known"), plain("name").alias("name")).where("name is not null").groupBy("name").agg(F.min("known").alias("known"))


def placed_cities(read: DataFrame, aliases: DataFrame) -> DataFrame:
    """``read`` with the city in its listed form; a part of unknown kind that is a listed city is the city where none is named."""
    names = cut(listed_cities(aliases))  # a fixed small table, so it is broadcast
    exact = read.join(F.broadcast(names.withColumnRenamed("name", "city")), "city", "left")
    by_key = names.select(F.explode(_keys(F.col("name"))).alias("k"), "name", F.col("known").alias("close"))
    odd = exact.where("city is not null and known is null").select("city").distinct()
    fixed = odd.select("city", F.explode(_keys(F.col("city"))).alias("k")).join(F.broadcast(by_key), "k").where(near(F.col("city"), F.col("name"))).groupBy("city").agg(F.min("close").alias("close"))
    full = exact.join(fixed, "city", "left").withColumn("city", F.coalesce("known", "close", "city")).drop("known", "close")
    listed = F.array(*[F.lit(r["name"]) for r in names.select("name").distinct().orderBy("name").collect()]).cast("array<string>")
    part = F.filter("loose", lambda x: F.array_contains(listed, x))
    marked = full.withColumn("hit", F.when(F.col("city").isNull(), F.array_min(part))).join(F.broadcast(names.withColumnRenamed("name", "hit")), "hit", "left")
    return marked.withColumn("city", F.coalesce("city", "known")).withColumn("loose", _without(F.col("loose"), F.col("hit"))).drop("hit", "known")


def locations(headers: DataFrame, aliases: DataFrame) -> DataFrame:
    """``receipt_id``, ``location_id``, ``house``, ``street``, ``district``, ``city`` for receipts with an address."""
    latest = headers.where(F.col("receipt_id").isNotNull()).groupBy("receipt_id").agg(F.max(F.struct("updated_at", F.col("seller_address").alias("address")))["address"].alias("address"))
    receipts = cut(latest.where("address is not null"))
    distinct = receipts.groupBy("address").agg(F.count("*").alias("n"))
    read = cut(distinct.mapInPandas(_read_batches, f"{PARTS}, n long").withColumn("aid", F.monotonically_increasing_id()))
    parts = cut(localities(cut(placed_cities(read.drop("address"), aliases))))
    entries, own = gazetteer(parts)
    entries = cut(entries)
    # Addresses that name all three are part of the gazetteer.
    incomplete = parts.where("city is null or district is null")
    chosen = resolve(incomplete, entries, own.select("entry", "house").distinct(), "aid")
    settled = cut(own.select("aid", "entry").union(chosen))
    alone = unresolved(parts.join(settled, "aid", "left_anti"))
    places = settled.withColumnRenamed("entry", "place").union(alone)
    placed = parts.join(places, "aid").select("aid", F.concat_ws("#", "place", "house").alias("location_id"), "house", "street", "district", "city")
    return receipts.join(read.select("address", "aid"), "address").join(placed, "aid").select("receipt_id", "location_id", "house", "street", "district", "city")


def same_location(located: DataFrame) -> DataFrame:
    """``receipt_id_a`` < ``receipt_id_b`` for receipts of one location."""
    a = located.select("location_id", F.col("receipt_id").alias("receipt_id_a"))
    b = located.select("location_id", F.col("receipt_id").alias("receipt_id_b"))
    return a.join(b, "location_id").where("receipt_id_a < receipt_id_b").select("receipt_id_a", "receipt_id_b")
