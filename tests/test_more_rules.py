"""Rules of national numbers, VAT numbers and wallets, and values that recur; check digits made here, apart from the expressions."""

import hashlib

import pytest

from maskwright.operators import detect

B58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def wallet(version: int, fill: int) -> str:
    raw = bytes([version]) + bytes([fill]) * 20
    raw += hashlib.sha256(hashlib.sha256(raw).digest()).digest()[:4]
    n, out = int.from_bytes(raw, "big"), ""
    while n:
        n, k = divmod(n, 58)
        out = B58[k] + out
    return "1" * (len(raw) - len(raw.lstrip(b"\0"))) + out


GENESIS = "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa"
CASES = [
    ("numéro fiscal : 12 34 567 890 123", "FR_SPI", "12 34 567 890 123"),
    ("Steuernummer: 12/345/67890", "DE_STEUERNUMMER", "12/345/67890"),
    ("CIF A58818501", "ES_CIF", "A58818501"),
    ("CIF A58818502", "ES_CIF", None),
    ("NSS 28/12345678/40", "ES_NSS", "28/12345678/40"),
    ("RSIN 111222333", "NL_RSIN", "111222333"),
    ("KvK-nummer: 12345678", "NL_KVK", "12345678"),
    ("12345678 alone", "NL_KVK", None),
    ("UTR 1123456789", "UK_UTR", "1123456789"),
    ("company number SC123456", "UK_COMPANY", "SC123456"),
    ("KBO 0403.170.701", "BE_ENTERPRISE", "0403.170.701"),
    ("SVNR 1237 010180", "AT_SVNR", "1237 010180"),
    ("VAT ATU13585627", "PIVA", "ATU13585627"),
    ("VAT ATU13585626", "PIVA", None),
    ("FR83404833048", "PIVA", "FR83404833048"),
    ("FR84404833048", "PIVA", None),
    ("EL094259216", "PIVA", "EL094259216"),
    ("LU15027442", "PIVA", "LU15027442"),
    ("PL8567346215", "PIVA", "PL8567346215"),
    ("GB980780684", "PIVA", "GB980780684"),
    ("ESA58818501", "PIVA", "ESA58818501"),
    ("SE556123456701", "PIVA", "SE556123456701"),
    ("VAT SK 1234567890", "PIVA", "SK 1234567890"),
    ("code SK 1234567890", "PIVA", None),
    (f"to {GENESIS} today", "CRYPTO_WALLET", GENESIS),
    (f"to {GENESIS[:-1]}b today", "CRYPTO_WALLET", None),
    (f"to {wallet(5, 7)} today", "CRYPTO_WALLET", wallet(5, 7)),
    (f"to {wallet(0, 0)} today", "CRYPTO_WALLET", wallet(0, 0)),
]


def test_more_rules(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CASES)], "doc_id long, text string")
    got = {r.doc_id: [(e.label, e.value) for e in r.entities] for r in detect.detect(df).collect()}
    wrong = [(c, got[i]) for i, c in enumerate(CASES) if [v for la, v in got[i] if la == c[1]] != ([c[2]] if c[2] else [])]
    assert not wrong


@pytest.mark.parametrize(
    ("text", "label", "values"),
    [
        (r"password: hun\Eter2! then hun\Eter2! and hun\Eter2!x", "PASSWORD", [r"hun\Eter2!", r"hun\Eter2!"]),
        ("hostname: web-server7, ping WEB-SERVER7 and web-server77", "HOSTNAME", ["web-server7", "WEB-SERVER7"]),
        ("srv01.corp answered, srv01 did not", "HOSTNAME", ["srv01.corp", "srv01"]),
        ("user: anna.rossi; anna.rossi left, 🙂 anna.rossi!", "USERNAME", ["anna.rossi"] * 3),
        ("serial number: C02XK1 is C02XK1", "DEVICE_ID", ["C02XK1", "C02XK1"]),
        ("password: open, open it", "PASSWORD", ["open"]),
    ],
)
def test_values_recur(spark, text, label, values):
    row = detect.detect(spark.createDataFrame([(1, text)], "doc_id long, text string"), labels=(label,)).first()
    mine = sorted((e.start, e.end, e.value) for e in row.entities)
    assert [v for _, _, v in mine] == values and all(text[a:b] == v for a, b, v in mine)
