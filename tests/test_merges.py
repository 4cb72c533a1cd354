from maskwright.operators import registry


def test_long_chains_and_circles(spark):
    rows = [(0, None)] + [(i, i - 1) for i in range(1, 101)] + [(200, 202), (201, 200), (202, 201), (203, 200), (300, 999)]
    got = dict(registry.resolve_merges(spark.createDataFrame(rows, "id long, merged_into long")).collect())
    assert got == {i: 0 for i in range(101)} | {i: i for i in (200, 201, 202, 203, 300)}


def test_known_surfaces_behind_a_long_chain(spark):
    rows = [(i, "s", f"[ORG_{i}]", "ORG", False, i - 1 if i else None) for i in range(60)]
    e = spark.createDataFrame(rows, "id long, scope string, placeholder string, label string, excluded boolean, merged_into long")
    a = spark.createDataFrame([(59, "Acme", 1)], "entity_id long, surface string, version int")
    assert [r.placeholder for r in registry.known_surfaces(e, a).collect()] == ["[ORG_0]"]
