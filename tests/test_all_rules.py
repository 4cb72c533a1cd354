"""The flagship queries over every rule, against a resolver in plain Python."""

import re

from maskwright.operators import detect
from maskwright.plans import registry

TOKEN = "0123456789abcdef" * 2 + "89abcdef"
TEXTS = [
    (1, f'token = "{TOKEN}" and again token = "{TOKEN}"'),
    (2, "password: DE89370400440532013000 then card 4111 1111 1111 1111 on 31/12/2023"),
    (3, "see https://a.example.org/x?m=anna@example.org, mail anna@example.org, host 10.20.30.40"),
    (4, "pay DE89 3704 0044 0532 0130 00 or € 1.234,50; ssn 123-45-6789; call +39 06 1234567"),
    (5, None),
    (6, "nothing here"),
]


def brute(text, entities):
    taken = []
    for e in sorted(entities, key=lambda e: (not e.validated, -e.priority, -e.score, e.start - e.end, e.start)):
        if all(e.end <= o.start or o.end <= e.start for o in taken):
            taken.append(e)
    out, at, numbers = "", 0, {}
    for e in sorted(taken, key=lambda e: e.start):
        key = e.value if e.label in detect.EXACT else re.sub(r"\s+", " ", e.value.strip().lower())
        own = numbers.setdefault(e.label, {})
        out += text[at : e.start] + f"[{e.label}_{own.setdefault(key, len(own) + 1)}]"
        at = e.end
    return out + text[at:], len(taken), sum(map(len, numbers.values()))


def test_flagship_masks_every_rule(spark, tmp_path):
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: (r.text or "", r.entities) for r in detect.detect(spark.createDataFrame(TEXTS, "doc_id long, text string")).collect()}
    got = {r.doc_id: (r.anonymized_text, r.n_entities, r.n_unique) for r in registry.QUERIES["anonymise_all_rules"](spark, str(tmp_path)).collect()}
    assert got == {i: brute(*x) for i, x in found.items()}
    assert got[1][0] == 'token = "[SECRET_1]" and again token = "[SECRET_1]"' and "[PASSWORD_1]" in got[2][0]
    back = {r.doc_id: r.restored for r in registry.QUERIES["decode_round_trip_all_rules"](spark, str(tmp_path)).collect()}
    assert back == {i: t or "" for i, t in TEXTS}
    counts = {r.label: r.n for r in registry.QUERIES["count_by_label_all_rules"](spark, str(tmp_path)).collect()}
    assert sum(counts.values()) == sum(n for _, n, _ in got.values()) and counts["SECRET"] == 2


def test_gate_and_triggers_hide_nothing(spark):
    """Rules behind the shared look for digits, or behind a trigger, find what they find alone."""
    import dataclasses
    import random

    from pyspark.sql import functions as F

    from maskwright.operators import detect

    r = random.Random(3)
    parts = ["12/03/2021", "1.2.2020", "3 March 2021", "€ 5", "5 EUR", "078-05-1120", "AB 12 34 56 C", "IT60X0542811101000000123456", "00:1a:2B:3c:4d:5e", "001a.2b3c.4d5e", "WIN-ABCDEF12", "srv.corp", "\\\\FILES\\x", "4111 1111 1111 1111", "DE136695976", "NL123456782B90", "KvK 12345678", "SSN", "x", "1", "-", " ", "756.9217.0769.85", "12345678Z", "company AB123456"]
    texts = ["".join(r.choice(parts) + r.choice(["", " ", ", "]) for _ in range(r.randrange(0, 9))) for _ in range(400)]
    text, df = F.col("text"), spark.createDataFrame([(t,) for t in [*texts, "", None]], "text string")
    key = lambda e: F.transform(F.array_sort(e), lambda x: F.concat_ws(":", x["label"], x["start"].cast("string"), x["value"], x["priority"].cast("string")))
    alone = F.flatten(F.array(*(detect.rule_entities(F.coalesce(text, F.lit("")), dataclasses.replace(r, trigger=None)) for r in detect.RULES if r.digits or r.label in ("IBAN", "AMOUNT", "DATE", "MAC_ADDRESS", "UK_NINO") or r.label == "HOSTNAME" and not r.needs_cue)))
    labels = tuple({r.label for r in detect.RULES if r.digits} | {"IBAN", "AMOUNT", "DATE", "MAC_ADDRESS", "UK_NINO", "HOSTNAME"})
    both = detect.detect(df, text_col="text", labels=labels).select(key(alone).alias("want"), key(F.col("entities")).alias("got"))
    rows = both.collect()
    assert all(not set(x.want) - set(x.got) for x in rows) and sum(len(x.want) for x in rows) > 300
