"""Queries on small tables that are larger than any cut: every row takes part."""

import datetime

from docweave import queries as core


def made(spark, folder, name, data, schema):
    """The folder, with one more table."""
    spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


AT = datetime.datetime(2026, 1, 1)


def test_every_receipt_is_sorted(spark, tmp_path):
    data = [(f"r{i:03d}", None if i % 50 == 7 else i * 13 % 101, AT) for i in range(300)]
    folder = made(spark, tmp_path, "invoice_headers", data, "receipt_id string, total_amount long, updated_at timestamp")
    expected = sorted(((r, -1 if t is None else t) for r, t, _ in data), key=lambda x: (-x[1], x[0]))
    assert [tuple(r) for r in core.queries()["sort_null_total"](spark, folder).collect()] == expected


def test_whole_history_oldest_first(spark, tmp_path):
    data = [(i, AT + datetime.timedelta(seconds=i * 7 % 10), i % 2, "view", 1.0) for i in range(40)]
    folder = made(spark, tmp_path, "events", data, "event_id long, ts timestamp, user_id long, event_type string, value double")
    expected = [(u, i) for u, _, i in sorted((u, t, i) for i, t, u, *_ in data)]
    assert [(r["user_id"], r["event_id"]) for r in core.queries()["audit_history"](spark, folder).collect()] == expected


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_error_rates_over_whole_texts(spark, tmp_path):
    texts = ["even the deepest well " * 30, "one two three " * 50, "short note here", "eee " * 120, "a b c " * 90, "same text " * 60]
    data = [(i, t, "en", len(t), "s") for i, t in enumerate(texts)] + [(9, "hóa đơn", "vi", 7, "s")]
    folder = made(spark, tmp_path, "documents", data, "doc_id long, text string, lang string, n_chars long, source string")
    read = [(t, t.replace("e", "c") if i % 3 == 0 else t[3:] if i % 3 == 1 else t) for i, t in enumerate(texts)]
    chars = [(edits(" ".join(a.split()), " ".join(b.split())), len(" ".join(a.split()))) for a, b in read]
    words = [(edits(a.split(), b.split()), len(a.split())) for a, b in read]
    for name, pairs in (("cer_micro_macro", chars), ("wer_tokens", words)):
        found = {r["condition"]: (r["samples"], r["errors"], r["length"]) for r in core.queries()[name](spark, folder).collect()}
        total = (len(texts), sum(e for e, _ in pairs), sum(n for _, n in pairs))
        assert found == {"s": total, "all": total}


LINES = 130


def long_documents(spark, folder):
    data = [(i, "\n".join(f"line {j}" for j in range(n)), "en", 0, "s") for i, n in enumerate((3, LINES), 1)]
    return made(spark, folder, "documents", data, "doc_id long, text string, lang string, n_chars long, source string")


def test_every_block_is_cited_assembled_and_matched(spark, tmp_path):
    folder = long_documents(spark, tmp_path)
    run = lambda name: core.queries()[name](spark, folder).collect()
    cited = {(d, j % 5): 0 for d, n in ((1, 3), (2, LINES)) for j in range(n) if j % 4 != 3}
    for d, n in ((1, 3), (2, LINES)):
        for j in range(n):
            if j % 4 != 3:
                cited[d, j % 5] += 1
    assert {(r["doc_id"], r["cell"]): r["blocks"] for r in run("evidence_text_join")} == cited
    records = {r["doc_id"]: (r["rows"], r["record"].count('"c')) for r in run("record_assembly")}
    assert records == {1: (1, 3), 2: (-(-LINES // 4), LINES)}
    (found,) = run("line_metrics_v2")
    gold = sum(j % 5 != 4 for n in (3, LINES) for j in range(n))
    predicted = sum(j % 3 != 2 for n in (3, LINES) for j in range(n))
    both = sum(j % 5 != 4 and j % 3 != 2 for n in (3, LINES) for j in range(n))
    assert (found["gold_rows"], found["predicted_rows"], found["matched_rows"]) == (gold, predicted, both)


def test_every_block_has_its_anchor_and_column(spark, tmp_path):
    folder = long_documents(spark, tmp_path)
    box = lambda d, j: (j % 4 * 250 + 10 * ((d + j) % 3), j // 4 * 20 + j % 3)
    anchors, near, inside = set(), set(), set()
    for d, n in ((1, 3), (2, LINES)):
        for j in range(n):
            x, y = box(d, j)
            if j % 3 == 1:
                distance, anchor = min((abs(x - box(d, o)[0]) + y - box(d, o)[1], o) for o in range(0, n, 3) if box(d, o)[1] <= y)
                anchors.add((d, j, anchor, distance))
            if j >= 4:
                heads = [(abs(x - box(d, o)[0]), box(d, o)[0], o) for o in range(4)]
                near.add((d, j, min(heads)[2], min(heads)[0]))
                inside |= {(d, j, o) for gap, _, o in heads if gap <= 15}
    run = lambda name, *columns: {tuple(r[c] for c in ("doc_id", "ix", *columns)) for r in core.queries()[name](spark, folder).collect()}
    assert run("nearest_anchor", "anchor_ix", "distance") == anchors
    assert run("column_assign_nearest", "column_ix", "distance") == near
    assert run("column_assign_interval", "column_ix") == inside
