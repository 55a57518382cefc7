"""Problems 4 and 5 on hand-made records, and their edge cases."""

import datetime
import math
import random

from docweave.llm import addresses, overlap
from tests.conftest import rows

HEADER = "receipt_id string, seller_address string, updated_at timestamp, house string, street string, city string, entry string, n int"
AT = datetime.datetime(2026, 1, 1)
CITIES = [("Mít Thạch", "MTH"), ("Mít Thạch", "Mit Thach"), ("Mít Thạch", "Mít Thạch City"), ("Sậy Gốm", "SGO")]
SAME = [
    "Số 171, Đường Kiều Tâm Sậy, Phường 1, Quận Khánh Bình, Thành phố Mít Thạch", "No. 171 Str. Kiều Tâm Sậy, Q. Khánh Bình, TP. MTH", "SN 171 DUONG KIEU TAM SAY; P. 1; QUAN KHANH BINH; TPMTH; VIETNAM", "Thành phố Mít Thạch - Q. Khánh Bình - # 171 Đ. Kiều Tâm Sậy",
    "Phòng 475, Số 171 Kiều Tâm Sâỵ, Khánh Bình, Mít Thạch City", "Địa chỉ: số nhà 171 đg. Kiều Tâm Sy\nQuận Khánh Bình\nMit Thach",
]
LANES = ["Số 40, ngõ 578, Đường Lạc Trà Hải, Quận 9, Thành phố Sậy Gốm", "578/40 Str. Lạc Trà Hải, Q.09, TP. SGO"]
OTHER = [
    "Số 171A, Đường Kiều Tâm Sậy, Phường 1, Quận Khánh Bình, Thành phố Mít Thạch", "Số 171/2 Đường Kiều Tâm Sậy, Quận Khánh Bình, Thành phố Mít Thạch", "Số 171, Đường Kiều Tâm Sậy, Phường 1, Quận 5, Thành phố Sậy Gốm", "Số 171, Đường Lụa Vân Quế, Quận Khánh Bình, Thành phố Mít Thạch",
    None, "", "-", "Như trên", "Địa chỉ:", "Quận 9, Thành phố Sậy Gốm",
]


def located(spark, texts):
    data = [(f"r{i:02d}", t, AT, "h", "s", "c", "e", 1) for i, t in enumerate(texts)]
    data += [("r00", "(xem con dấu)", AT - datetime.timedelta(days=1), "h", "s", "c", "e", 1), data[1], (None, texts[0], AT, "h", "s", "c", "e", 1)] if texts else []
    aliases = spark.createDataFrame(CITIES, "city_name string, alias string")
    return addresses.locations(spark.createDataFrame(data, HEADER), aliases)


def test_locations(spark):
    found = rows(addresses.same_location(located(spark, SAME + LANES + OTHER)))
    n, m = len(SAME), len(SAME) + len(LANES)
    assert found == {(f"r{a:02d}", f"r{b:02d}") for a in range(n) for b in range(a + 1, n)} | {(f"r{a:02d}", f"r{b:02d}") for a in range(n, m) for b in range(a + 1, m)}


def test_locality_beyond_eight_of_a_street(spark):
    """The street stands in twelve localities; the ward, or the district without a label, names the least frequent one."""
    entries = [(f"c{i:02d}|d{i:02d}|lactra", f"c{i:02d}", f"district{chr(97 + i) * 3}", "lactra", 50 - i, [f"ward{chr(97 + i) * 3}"]) for i in range(12)]
    entries += [("c12|d12|lactrb", "c12", "districtzzz", "lactrb", 1, ["wardzzz"])]
    asked = [
        ("by ward", "1", "lactra", "wardlll", None, None, []), ("by loose ward", "1", "lactra", None, None, None, ["wardlll"]), ("by district", "1", "lactra", None, None, None, ["districtlll"]), ("by both, street one edit away", "1", "lactra", "wardzzz", None, None, ["districtzzz"]),
        ("by house", "7", "lactra", None, None, None, []), ("none", "1", "lactra", None, None, None, []),
    ]
    parts = spark.createDataFrame(asked, addresses.PARTS)
    found = addresses.resolve(parts, spark.createDataFrame(entries, "entry string, city string, district string, street string, n long, wards array<string>"), spark.createDataFrame([("c11|d11|lactra", "7")], "entry string, house string"))
    last = "c11|d11|lactra"
    assert rows(found) == {("by ward", last), ("by loose ward", last), ("by district", last), ("by both, street one edit away", "c12|d12|lactrb"), ("by house", last)}


def test_unresolved_addresses_keep_their_city(spark):
    """Wards of the same name stand in many cities; a missing part is taken from one partner only."""
    two = ["12 Lê Lợi, Phường 1, TP Đà Lạt", "12 Lê Lợi, Phường 1, TP Vũng Tàu", "12 Lê Lợi, Phường 1"]
    assert addresses.same_location(located(spark, two)).count() == 0
    one = ["12 Lê Lợi, Phường 1, TP Đà Lạt", "12 Lê Lợi, P. 1", "14 Lê Lợi, P. 1", "12 Lê Lợi, P. 2, TP Đà Lạt"]
    assert rows(addresses.same_location(located(spark, one))) == {("r00", "r01")}


def test_spellings_of_one_street(spark):
    """A chain of spellings, and two different typos at one house without the right spelling."""
    at = lambda n, street: f"Số {n}, Đường {street}, Phường 1, Quận 5, Thành phố Sậy Gốm"
    chain = [at(7, "Kiều Tâm Sậy"), at(7, "Kiều Tâm Sậyx"), at(7, "Kiều Tâm Sậyxx"), at(9, "Lạc Tra Hi"), at(9, "Lc Trà Hải"), at(9, "Quế Lụa Vân")]
    found = rows(addresses.same_location(located(spark, chain)))
    assert found == {("r00", "r01"), ("r00", "r02"), ("r01", "r02"), ("r03", "r04")}


def test_no_addresses(spark):
    assert addresses.same_location(located(spark, [])).count() == 0


def test_read_parts():
    assert addresses.read_parts("Tang 8,SN 917 C D.Moc Hai Phu,Phuong 12,Khanh Tam,Toi Phu") == ("917c", "mochaiphu", "12", None, None, ["khanhtam", "toiphu"])
    assert addresses.read_parts("12 hẻm 294 Phố Thủy Vân Trà,X. Khánh Khê,Huyện Oanh Bảo,TPRMI") == ("294/12", "thuyvantra", "khanhkhe", "oanhbao", "rmi", [])
    assert addresses.read_parts("x" * 200_000) is None and addresses.read_parts(None) is None


MANIFEST = "test_id string, sha256 string, width int, height int, brightness double, contrast double, sharpness double, illumination_range double, id string, v string"
POOL = MANIFEST.replace("test_id", "candidate_id") + ", pool_split string"


def agree(a, b):
    near = lambda x, y: abs(math.log(x / y)) <= -math.log(0.99)
    return all(near(x, y) for x, y in zip(a[4:8], b[4:8], strict=True)) and abs(abs(math.log(a[3] / a[2])) - abs(math.log(b[3] / b[2]))) <= -math.log(0.99)


def test_overlaps_against_all_pairs(spark):
    draw = random.Random(4)
    manifest = [(f"T{i}", f"{i:064x}", draw.choice([600, 1200]), draw.choice([800, 1600]), *(draw.uniform(50, 60) for _ in range(4)), "i", "v") for i in range(120)]
    pool = []
    for i in range(400):
        base = draw.choice(manifest)
        turned = draw.random() < 0.5
        change = draw.choice([0.001, 0.004, 0.0099, 0.0101, 0.02])
        measures = [m * math.exp(draw.uniform(-change, change)) for m in base[4:8]]
        digest = f" SHA256={base[1].upper()}\n" if draw.random() < 0.2 else f"{i + 10_000:064x}"
        pool.append((f"C{i}", digest, base[3] if turned else base[2], base[2] if turned else base[3], *measures, "i", "v", draw.choice(["train", " Train", "unused", None])))
    pool += [pool[0], ("N1", None, None, 5, 1.0, None, 2.0, 3.0, "i", "v", "train"), ("N2", None, 5, 5, 0.0, 1.0, 2.0, 3.0, "i", "v", "train"), (None, manifest[0][1], 1, 1, 1.0, 1.0, 1.0, 1.0, "i", "v", "train")]
    asked = [*manifest, manifest[0], ("N3", None, None, None, None, None, None, None, "i", "v")]
    clean = lambda s: s and s.strip().lower().replace("sha256=", "")
    expected = {(a[0], b[0]) for a in manifest for b in pool if b[0] and (b[10] or "").strip().lower() == "train" and (clean(b[1]) == a[1] or (b[7] and b[5] and b[4] and agree(a, b)))}
    tables = spark.createDataFrame(asked, MANIFEST), spark.createDataFrame(pool, POOL)
    assert rows(overlap.found(*tables)) == expected and len(expected) > 100
    counted = {r["test_id"]: r["links"] for r in overlap.links(*tables).collect()}
    assert counted == {t: sum(a == t for a, _ in expected) for t in {a[0] for a in asked}}


def test_agreeing_vectors_reach_the_threshold(spark):
    """At the edge of the tolerance in every coordinate, wherever the points lie, and in both directions."""
    draw, data = random.Random(8), []
    for i in range(300):
        x = [draw.uniform(0, 6) for _ in range(5)]
        data.append((i, None, x, 0))
        data.append((i, None, [v + draw.choice([-1, 1]) * (overlap._REACH - 1e-12) for v in x], 1))
    vectors = spark.createDataFrame(data, "v long, hash string, x array<double>, side int")
    found = {(r["v_a"], r["v_b"]): r["cosine"] for r in overlap.vector_pairs(overlap.weighed(vectors)).collect()}
    assert all(found.get((i, i), 0) >= overlap.THRESHOLD for i in range(300))
    assert len(found) < 3000


def test_copies_and_empty(spark):
    one = ("{}", "a" * 64, 600, 800, 50.0, 50.0, 50.0, 50.0, "i", "v")
    manifest = spark.createDataFrame([("T1", *one[1:])], MANIFEST)
    pool = spark.createDataFrame([(f"C{i}", *one[1:], "train") for i in range(200)], POOL)
    assert overlap.found(manifest, pool).count() == 200
    assert overlap.found(manifest, pool.limit(0)).count() == overlap.found(manifest.limit(0), pool).count() == 0
