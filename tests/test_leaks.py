import pytest

from maskwright.operators import registry

DOCS = [(1, "seen: anna  ROSSI, left"), (1, "another Anna Rossi"), (2, "Annarossi"), (3, None), (4, "to the " + " ".join(f"w{i}" for i in range(12)) + " end"), (5, " ".join(f"w{i}" for i in range(11))), (6, "anna")]
SURFACES = [("[P_1]", "Anna Rossi"), ("[P_2]", "Anna"), ("[T_1]", " ".join(f"W{i}" for i in range(12))), ("[T_2]", "--"), ("[T_3]", None)]
FOUND = {(1, "[P_1]"), (1, "[P_2]"), (6, "[P_2]"), (4, "[T_1]")}


@pytest.mark.parametrize("block", [20_000, 1])
def test_surfaces_meet_runs_of_words(spark, monkeypatch, block):
    """Rows that repeat an id and surfaces of any length; the texts' words are never what is sent to the driver."""
    monkeypatch.setattr(registry, "BLOCK", block)
    out = registry.leaks(spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(SURFACES, "placeholder string, surface string"))
    rows = [(r.doc_id, r.placeholder) for r in out.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == FOUND


def test_texts_are_not_broadcast(spark, tmp_path):
    """Repeated texts take little room in a file, but not on the driver: only the counted surfaces are broadcast."""
    spark.createDataFrame(DOCS[:1] * 1000, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/d")
    out = registry.leaks(spark.read.parquet(f"{tmp_path}/d"), spark.createDataFrame(SURFACES[:2], "placeholder string, surface string"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "strategy=broadcast" in plan
    assert out.count() == 2


def test_no_surfaces(spark):
    out = registry.leaks(spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame([], "placeholder string, surface string"))
    assert out.count() == 0
