import io
import zipfile

import pytest
from pyspark.sql import functions as F

from maskwright.operators import analytics, registry, tables
from maskwright.sources import files
from maskwright.streaming.decoder import StreamDecoder, decode_stream, decode_text


def test_merges_and_allocation(spark):
    e = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 5), (5, 4), (6, 99)], "id long, merged_into long")
    assert dict(registry.resolve_merges(e).collect()) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}
    values = spark.createDataFrame([("s", "ORG", "Acme Srl", 2), ("s", "ORG", "ACME", 1), ("s", "ORG", "Beta", 3)], "scope string, label string, value string, first_seen int")
    old = spark.createDataFrame([("s", "ORG", "ORG|beta", "[ORG_4]")], "scope string, label string, key string, placeholder string")
    assert {(r.value, r.placeholder) for r in registry.allocate(values, old).collect()} == {("ACME", "[ORG_5]"), ("Beta", "[ORG_4]")}


def test_redact_longest_first(spark):
    df = spark.createDataFrame([(1, "Anna Rossi and Anna met ANNA; Annabel not"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in registry.redact(df, [("Anna", "[P_1]"), ("Anna Rossi", "[P_2]")]).collect()}
    assert rows[1].redacted == "[P_2] and [P_1] met [P_1]; Annabel not" and rows[1].by_placeholder == {"[P_1]": 2, "[P_2]": 1}
    assert rows[2].redacted is None and rows[2].occurrences == 0


def test_leaks(spark):
    docs = spark.createDataFrame([(1, "then Anna  rossi, left"), (2, "Anna Rossini")], "doc_id long, text string")
    s = spark.createDataFrame([("[P_2]", "Anna Rossi")], "placeholder string, surface string")
    assert [tuple(r) for r in registry.leaks(docs, s).collect()] == [(1, "[P_2]", "Anna Rossi")]


def test_sample_and_votes(spark):
    df = spark.createDataFrame([("g", i) for i in range(200)], "g string, i int")
    got = sorted(r.i for r in tables.stratified_sample(df, ["g"], "i", 20).collect())
    assert got[:10] == list(range(10)) and got[-1] == 199 and len(got) == 20
    assert spark.range(1).select(tables.delimiter_vote(F.lit("a;b;c\n1;2,5;3\n4;5;6"))).first()[0] == ";"
    cards = [spark.range(1).select(tables.json_card(F.lit(x))).first()[0] for x in ('{"b":1,"a":2}', "[1,2]", "{", "3")]
    assert cards == ["object: a,b", "array of 2", "invalid", "scalar"]


def test_search_tolerates_a_typo(spark):
    rows = [(1, 0, "user", "the invoice of march", 5), (2, 0, "user", "invoise pending", 9), (3, 0, "system", "invoice", 10)]
    df = spark.createDataFrame(rows, "conv_id long, seq int, role string, text string, updated_at int")
    assert [r.conv_id for r in analytics.search(df, "invoice march").collect()] == [1, 2]


def test_interval_overlaps_once(spark):
    a = spark.createDataFrame([(1, 1, 0, 300), (1, 2, 310, 320)], "k int, id int, start int, end int")
    b = spark.createDataFrame([(1, 7, 100, 315)], "k int, id int, start int, end int")
    assert sorted(map(tuple, analytics.interval_overlaps(a, b, "k").collect())) == [(1, 1, 7, 100, 300), (1, 2, 7, 310, 315)]


TEXT = "see [NAME_1] and `[NAME_1]` in [x [NAME_1]](http://a/[NAME_1]) ```\n[NAME_1]\n``` <b [NAME_1]> [NAME_9] end"


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_stream_decoder_agrees_with_whole(size):
    mapping, out = {"[NAME_1]": "Anna [NAME_2]", "[NAME_2]": "no"}, ""
    d = StreamDecoder(mapping)
    for i in range(0, len(TEXT), size):
        out += d.feed(TEXT[i : i + size])
    assert out + d.feed("", True) == decode_text(TEXT, mapping)


def test_stream_query(spark, tmp_path):
    spark.createDataFrame([(1, 0, "hi [NA", False), (1, 1, "ME_1] ok", True)], "conv_id long, seq long, delta string, done boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("conv_id long, seq long, delta string, done boolean").parquet(str(tmp_path / "in"))
    q = decode_stream(src, {"[NAME_1]": "Anna"}).writeStream.format("memory").queryName("decoded").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert "".join(r.text for r in spark.table("decoded").orderBy("seq").collect()) == "hi Anna ok"


def test_xlsx(spark):
    buf = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Name</t></si></sst>")
        z.writestr("xl/worksheets/s.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1"><v>7</v></c></row></sheetData></worksheet>')
    df = spark.createDataFrame([("a.xlsx", bytearray(buf.getvalue())), ("b.xlsx", bytearray(b"junk"))], "path string, content binary")
    rows = sorted(map(tuple, files.office_rows(df, "xlsx").collect()), key=str)
    assert ("a.xlsx", "S", 1, 0, "Name", True) in rows and ("a.xlsx", "S", 1, 27, "7", False) in rows and ("b.xlsx", None, None, None, None, None) in rows


def test_decode_bytes(spark):
    data = [b"\xef\xbb\xbfna\xc3\xafve", b"na\xefve", b"a\x00b"]
    got = [r.d for r in spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(data)], "i int, c binary").orderBy("i").select(files.decode_bytes(F.col("c")).alias("d")).collect()]
    assert [tuple(g) for g in got] == [("naïve", "utf-8", True), ("naïve", "cp1252", False), (None, "binary", False)]
