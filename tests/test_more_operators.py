"""Boxes, sessions, registry life cycle and post-checks: plain expectations and brute force on small tables, odd rows included."""

import random
import re

from pyspark.sql import functions as F

from maskwright.operators import geometry, lifecycle, postcheck, resolve, sessions

BOX = "doc long, id long, x0 double, y0 double, x1 double, y1 double, score double, text string"


def boxes(spark, rows):
    return spark.createDataFrame(rows, BOX)


def random_boxes(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        x, y = r.randrange(40), r.randrange(40)
        out.append((i % 3, i, float(x), float(y), float(x + r.randrange(1, 15)), float(y + r.randrange(1, 15)), r.randrange(100) / 100, "w"))
    return out


def overlap(a, b):
    return max(0, min(a[4], b[4]) - max(a[2], b[2])) * max(0, min(a[5], b[5]) - max(a[3], b[3]))


def size(a):
    return (a[4] - a[2]) * (a[5] - a[3])


def test_suppression_against_loops(spark):
    rows = random_boxes(60, 1)
    want = set()
    for doc in range(3):
        kept = []
        for b in sorted((b for b in rows if b[0] == doc and b[6] >= 0.25), key=lambda b: (-b[6], b[1])):
            if not any(overlap(b, k) > 0.45 * (size(b) + size(k) - overlap(b, k)) for k in kept):
                kept.append(b)
        want |= {(doc, b[1]) for b in kept}
    assert {(r.doc, r.id) for r in geometry.suppressed(boxes(spark, rows), ["doc"]).collect()} == want
    assert geometry.suppressed(boxes(spark, rows).where("false"), ["doc"]).count() == 0


def test_tiles_and_unions(spark):
    grid = [(1, i, 10.0 * (i % 4), 10.0 * (i // 4), 10.0 * (i % 4) + 10, 10.0 * (i // 4) + 10, 1.0, "t") for i in range(12)] + [(1, 50, 90.0, 90.0, 99.0, 99.0, 1.0, "t"), (2, 0, 0.0, 0.0, 10.0, 10.0, 1.0, "t"), (2, 1, 10.0, 5.0, 20.0, 15.0, 1.0, "t")]
    got = [tuple(r) for r in geometry.tile_groups(boxes(spark, grid), ["doc"]).collect()]
    assert got == [(1, 0, 12, 0.0, 0.0, 40.0, 30.0)]
    chain = [(1, i, 3.0 * i, 0.0, 3.0 * i + 4, 1.0, 1.0, "c") for i in range(30)]
    assert [tuple(r)[:3] for r in geometry.united(boxes(spark, chain), ["doc"]).collect()] == [(1, 0, 30)]


def test_columns_and_parts_of_lines(spark):
    heads = spark.createDataFrame([(1, "A", 0.0, 10.0), (1, "B", 20.0, 30.0), (1, "C", 40.0, 50.0)], "doc long, letter string, x0 double, x1 double")
    words = spark.createDataFrame([(1, 1, -5.0, 0.0), (1, 2, 14.0, 15.5), (1, 3, 15.0, 16.0), (1, 4, 99.0, 100.0), (2, 5, 0.0, 1.0)], "doc long, id long, x0 double, x1 double")
    assert {(r.letter, r.id) for r in geometry.column_bands(heads, words, ["doc"]).collect()} == {("A", 1), ("A", 2), ("B", 3), ("C", 4)}
    line = spark.createDataFrame([(0.0, 0.0, 100.0, 10.0), (0.0, 0.0, 10.0, 100.0)], "x0 double, y0 double, x1 double, y1 double")
    got = [tuple(r) for r in line.select(*geometry.sub_box(F.lit(2), F.lit(5), F.lit(10))).collect()]
    assert got == [(20.0, 0.0, 50.0, 10.0), (0.0, 20.0, 10.0, 50.0)]
    pages = spark.createDataFrame([(None, 80, 0.1), (0, 80, 0.9), (5, 80, 0.0), (0, 3, 0.0)], "t int, d int, i double")
    assert [r[0] for r in pages.select(geometry.vector_page(F.col("t"), F.col("d"), F.col("i"))).collect()] == [True, False, False, False]


def test_residual_looks_at_every_occurrence(spark):
    cases = [("Annabel met Anna", "Anna", True), ("Annabel", "Anna", False), ("anna", "ANNA", True), ("price 3.500 or 1.500,20", "500", False), ("code 500.", "500", True), ("x", "", False), (None, "a", False), ("a", None, False), ("b\\Ec d", "b\\ec", True), ("AnnaAnna", "anna", False), ("xanna anna", "anna", True)]
    df = spark.createDataFrame([(t, v) for t, v, _ in cases], "t string, v string")
    assert [r[0] for r in df.select(resolve.residual(F.col("t"), F.col("v"))).collect()] == [w for _, _, w in cases]


def test_round_trip_with_literal_placeholders(spark):
    from maskwright.operators import detect

    texts = ["write to [EMAIL_1] or ann@example.org and bob@example.org, ann@example.org", "[EMAIL_7] x@example.com [IP_ADDRESS_2]", "", None, "no marks [EMAIL_x] a@example.net"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = resolve.anonymise(detect.detect(df, labels=("EMAIL",)))
    rows = out.select("doc_id", "text", "anonymized_text", resolve.decode(F.col("anonymized_text"), F.col("mapping")).alias("back")).orderBy("doc_id").collect()
    assert [r.back for r in rows] == [t or "" for t in texts]
    assert "[EMAIL_2] and [EMAIL_3], [EMAIL_2]" in rows[0].anonymized_text and rows[1].anonymized_text == "[EMAIL_7] [EMAIL_8] [IP_ADDRESS_2]"


def test_patterns(spark):
    hit = lambda p, t: spark.sql("SELECT 1").select(F.lit(t).rlike(p)).first()[0]
    v = lifecycle.value_pattern("Mario Rossi")
    assert hit(v, "sig. MARIO\n  Rossi,") and hit(v, "Ma-\nrio Rossi") and not hit(v, "Mario Rossini")
    n = lifecycle.value_pattern("1500")
    assert hit(n, "is 1500.") and not hit(n, "21.500 1500,20") and not hit(n, "3.1500")
    e = lifecycle.exact_pattern("s3cret!")
    assert hit(e, "-ps3cret!") and hit(e, "(s3cret!x") and not hit(e, "xs3cret!") and not hit(e, "S3CRET!")


def test_registry_by_hand(spark):
    e = spark.createDataFrame([(1, "s", "[ORG_1]", "ORG", False, None), (2, "s", "[ORG_2]", "ORG", None, None)], "id long, scope string, placeholder string, label string, excluded boolean, merged_into long")
    a = spark.createDataFrame([(1, "Acme", 1), (2, "Acme Ltd", 2)], "entity_id long, surface string, version int")
    sent, more = lifecycle.merged(e, a, F.lit(2), F.lit(1), 7)
    assert {(r.id, r.merged_into) for r in sent.collect()} == {(1, None), (2, 1)}
    assert {tuple(r) for r in more.collect()} == {(1, "Acme", 1), (2, "Acme Ltd", 2), (1, "Acme Ltd", 8)}
    assert {(r.root, r.n) for r in lifecycle.current_roots(sent).collect()} == {(1, 2)}
    assert {(r.id, r.excluded) for r in lifecycle.excluded(e, e.where("id = 2")).collect()} == {(1, False), (2, True)}
    s = spark.createDataFrame([("a", "ab"), ("c", "cd")], "short_id string, long_id string")
    assert [tuple(r) for r in lifecycle.keep_separate(s, spark.createDataFrame([("ab", "a")], "short_id string, long_id string")).collect()] == [("c", "cd")]
    t = spark.createDataFrame([(1, "s", "Acme Foods and acme foods"), (2, "s", "AcmeFoods"), (3, "s", "acme foodstore, Acme Foods"), (4, "s", None)], "doc_id long, scope string, text string")
    v = spark.createDataFrame([("s", "[ORG_1]", "Acme Foods")], "scope string, placeholder string, surface string")
    assert [r.doc_id for r in lifecycle.safe_variants(t, v, "doc_id").collect()] == [1]
    cells = spark.createDataFrame([("s", "t", i, 1, x) for i, x in enumerate(["Bob", "Ann", "bob", "x", None])], "scope string, sheet string, row int, col int, text string")
    columns = spark.createDataFrame([("t", 1, "CODE")], "sheet string, col int, label string")
    known = spark.createDataFrame([("s", "CODE", "CODE|ann", "[CODE_4]")], "scope string, label string, key string, placeholder string")
    assert {(r.value, r.placeholder) for r in lifecycle.column_placeholders(cells, columns, known).collect()} == {("Bob", "[CODE_5]"), ("Ann", "[CODE_4]")}
    names = spark.createDataFrame([("[FULL NAME_1]",), ("EMAIL_2",)], "p string")
    assert [r[0] for r in names.select(lifecycle.display_name(F.col("p"))).collect()] == ["FULL_NAME_1", "EMAIL_2"]


def test_post_checks(spark):
    text = "card 4111 1111 1111 1111 and 4111 1111 1111 1112; P.IVA 12345678903, tel. +39 06 1234567 or 12 3456; nato il 12/03/1980, paid 1234567 EUR"
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")

    def span(value, label, cut=0):
        at = text.index(value)
        return (1, label, at, at + len(value) - cut)

    proposed = [span("4111 1111 1111 1111", "CREDITCARDNUMBER", 6), span("4111 1111 1111 1112", "CREDITCARDNUMBER"), span("12345678903", "PIVA", 3), span("06 1234567", "TELEPHONENUM"), span("12 3456;", "TELEPHONENUM", 1), span("12/03/1980", "TELEPHONENUM"), span("1234567 EUR", "TELEPHONENUM", 4), span("paid", "NAME"), (2, "IBAN", 0, 4)]
    e = spark.createDataFrame(proposed + proposed[:1], "doc_id long, label string, start int, end int")
    got = {(r.label, text[r.start : r.end]) for r in postcheck.checked(docs, e).collect()}
    assert got == {("CREDITCARDNUMBER", "4111 1111 1111 1111"), ("PIVA", "12345678903"), ("TELEPHONENUM", "+39 06 1234567"), ("NAME", "paid")}
    assert postcheck.checked(docs, e.where("false")).count() == 0


def test_odd_rows_of_sessions(spark):
    assert [r[0] for r in spark.createDataFrame([("x",), (None,), ("7",), ("-1",)], "v string").select(sessions.clamped(F.col("v"), 0, 5)).collect()] == [None, None, 5.0, 0.0]
    n = spark.createDataFrame([(0,), (1023,), (1024,), (5 << 20,), (3 << 30,)], "n long")
    assert [r[0] for r in n.select(sessions.size_text(F.col("n"))).collect()] == ["0 B", "1023 B", "1.0 KB", "5.0 MB", "3.0 GB"]
    empty = spark.createDataFrame([], "k long, o int, p string")
    assert sessions.accumulated(empty, ["k"], "o", "p").count() == 0
    marks = spark.createDataFrame([("a [X_1] ```[X_2] [X_2]``` `[Y_1]` [t](u[Z_1]) <i [W_1]>",), (None,), ("```[X_3]",)], "t string")
    assert [r[0] for r in marks.select(lifecycle.protected_placeholders(F.col("t"))).collect()] == [["[X_2]", "[Y_1]", "[Z_1]", "[W_1]"], [], ["[X_3]"]]
    assert re.search("␞", lifecycle.FIELD_BREAK)
