from maskwright.llm import jaccard_join, toxicity


def test_fit_makes_trigrams_slice_by_slice(spark, monkeypatch):
    """Words of a large sample are never all held as lists of numbers on the driver."""
    most, inputs = [], toxicity.Network.inputs
    monkeypatch.setattr(toxicity.Network, "inputs", lambda self, words: most.append(len(words)) or inputs(self, words))
    texts = [" ".join(f"w{i}x{j}" for j in range(2000)) + (" vile" * 9 if i % 2 else " kind") for i in range(20)]
    net = toxicity.train(texts, [i % 2 for i in range(20)], epochs=1)
    assert max(most) <= 1 << 14 < sum(most)
    assert net.scale > 0


def test_kept_rows_need_no_plan_of_the_join(spark):
    """What keep_one returns joins the rows with written components."""
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "x y z"), (None, "x y z"), (4, None)], "doc_id long, text string")
    out = jaccard_join.keep_one(docs)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 1, 3, 4]
