import pytest
from pyspark.sql import functions as F

from maskwright.functions import text as tx
from maskwright.operators import detect, resolve

CASES = [
    ("write to anna.rossi@example.org now", "EMAIL", "anna.rossi@example.org"),
    ("bad..dots@example.org", "EMAIL", None),
    ("pay DE89370400440532013000 today", "IBAN", "DE89370400440532013000"),
    ("pay DE89370400440532013001 today", "IBAN", None),
    ("card 4111 1111 1111 1111.", "CREDITCARDNUMBER", "4111 1111 1111 1111"),
    ("card 4111 1111 1111 1112.", "CREDITCARDNUMBER", None),
    ("codice fiscale RSSMRA85T10A562S", "CF", "RSSMRA85T10A562S"),
    ("host 10.20.30.40 up", "IP_ADDRESS", "10.20.30.40"),
    ("version 10.20.30.40", "IP_ADDRESS", None),
    ("mac 00:1a:2b:3c:4d:5e", "MAC_ADDRESS", "00:1a:2b:3c:4d:5e"),
    ("call +39 06 1234567", "TELEPHONENUM", "+39 06 1234567"),
    ("due 31/12/2023", "DATE", "31/12/2023"),
    ("due 32/13/2023", "DATE", None),
    ("on 5 marzo 2021 ok", "DATE", "5 marzo 2021"),
    ("costs € 1.234,50 net", "AMOUNT", "€ 1.234,50"),
    ("see https://example.org/a?b=1.", "URL", "https://example.org/a?b=1"),
    ("password: hunter2!x", "PASSWORD", "hunter2!x"),
    ("the password is required", "PASSWORD", None),
    ("ssn 123-45-6789", "US_SSN", "123-45-6789"),
    ("dni 12345678Z", "ES_NIF", "12345678Z"),
    ("dni 12345678A", "ES_NIF", None),
    ("IMEI: 490154203237518", "DEVICE_ID", "490154203237518"),
    ("sid S-1-5-21-3623811015-3361044348-30300820-1013", "WINDOWS_SID", "S-1-5-21-3623811015-3361044348-30300820-1013"),
    ("key VK7JG-NPHTM-C97JM-9MPGT-3V66T", "PRODUCT_KEY", "VK7JG-NPHTM-C97JM-9MPGT-3V66T"),
]


def test_rules(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CASES)], "doc_id long, text string")
    got = {r.doc_id: [(e.label, e.value) for e in r.entities] for r in detect.detect(df).collect()}
    for i, (text, label, value) in enumerate(CASES):
        mine = [v for la, v in got[i] if la == label]
        assert mine == ([value] if value else []) or (value in mine), (text, label, got[i])


def test_offsets_are_code_points(spark):
    text = "ça 🙂 été x@example.org fin y@example.org"
    row = detect.detect(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"), labels=("EMAIL",)).orderBy("doc_id").collect()
    assert [text[e.start : e.end] for e in row[0].entities] == ["x@example.org", "y@example.org"]
    assert row[1].entities == row[2].entities == []


def test_anonymise_and_decode(spark):
    text = "a@example.org, 4111111111111111, A@example.org, a@example.org [EMAIL_1]"
    out = resolve.anonymise(detect.detect(spark.createDataFrame([(1, text)], "doc_id long, text string"), labels=("EMAIL", "CREDITCARDNUMBER")))
    r = out.select("*", resolve.decode(F.col("anonymized_text"), F.col("mapping")).alias("back")).first()
    assert r.anonymized_text == "[EMAIL_2], [CREDITCARDNUMBER_1], [EMAIL_3], [EMAIL_2] [EMAIL_1]"
    assert r.n_entities == 4 and r.n_unique == 3 and r.back == text


def test_custom_terms_survive_exclusion(spark):
    df = detect.custom_terms(detect.detect(spark.createDataFrame([(1, "Big  Corp wrote a@example.org")], "doc_id long, text string"), labels=("EMAIL",)), [("big corp", "ORG")])
    r = resolve.anonymise(df, excluded=("EMAIL", "ORG")).first()
    assert r.anonymized_text == "[ORG_1] wrote a@example.org"


@pytest.mark.parametrize(("value", "noisy"), [("a", True), ("12", True), ("123", False), ("ab", False), ("--", True)])
def test_noisy(spark, value, noisy):
    assert spark.range(1).select(tx.too_noisy(F.lit(value))).first()[0] is noisy


def test_html(spark):
    html = "<html><script>x</p></script><h1>T &amp; U</h1><table><tr><td>a</td><td>b</td></tr></table></html>"
    assert spark.range(1).select(tx.html_to_text(F.lit(html))).first()[0] == "T & U\na\tb"
