import duckdb
import pytest

from maskwright.operators import detect
from maskwright.plans import registry

TEXTS = [
    "un. +1 (843) 555-7672 170.106.47.218 et",
    "+1 (269) 555-3296 4111111111111111 and",
    "zu ver 42.244.84.203, version 10.20.30.40; 127.0.0.1 256.1.1.1",
    "x.42 4366089147969128 y, 5 4111111111111111, é4111111111111111 4111-1111-1111-1111",
    "4451718024887799 27.65.93.188 der",
    "a@example.org, 4111111111111111, a@example.org; +1 (826) 555-4081 190.137.223.204",
    "890000000000000000000 0000000000000 _4111111111111111",
    "nothing here",
    "",
    None,
]


@pytest.mark.parametrize("name", ["anonymise_documents", "count_by_label", "detect_phones", "detect_cards", "detect_ip"])
def test_queries_take_the_forms_of_their_sql(spark, tmp_path, name):
    """Numbers that stand side by side, words before a number and letters beyond ASCII."""
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = registry.QUERIES[name](spark, str(tmp_path)).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


@pytest.mark.parametrize(("text", "phone"), [(TEXTS[0], "+1 (843) 555-7672"), (TEXTS[1], "+1 (269) 555-3296"), ("+39 06 1234567 190.137.223.204", "+39 06 1234567"), ("+44 20 7946 0958 4111111111111111", "+44 20 7946 0958"), ("+49 30 1234 56", "+49 30 1234 56")])
def test_phones_end_before_another_number(spark, text, phone):
    row = detect.detect(spark.createDataFrame([(1, text)], "doc_id long, text string"), labels=("TELEPHONENUM",)).first()
    assert [e.value for e in row.entities] == [phone]
