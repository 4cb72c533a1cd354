import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from maskwright.llm import chat_pairs, queries


def test_answers_far_apart_are_paired(spark):
    ids = [10, 11, 12, 1000, 70_000, -5, 9_000_000_000, 65]  # one opening; 7 is another
    rows = [(i, k, r, t) for i in ids for k, r, t in ((0, "user", "q"), (1, "assistant", f"a{i}"))] + [(7, 0, "user", "z"), (7, 1, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat_pairs.format_pairs(chat_pairs.pair_by_opening(df)).collect()
    used = Counter(i for r in got for i in {r.chosen_id, r.rejected_id})
    assert used == Counter([*ids, 7]) and all(r.chosen_id <= r.rejected_id for r in got)
    assert [(r.chosen_id, r.rejected) for r in got if r.chosen_id == r.rejected_id] == [(7, "")]
    assert (10, 11) in {(r.chosen_id, r.rejected_id) for r in got} and all(r.prompt_turns == 1 and r.rejected for r in got if r.chosen_id != 7)


def test_a_common_opening_leaves_one(spark):
    df = spark.range(0, 100_000, 37).selectExpr("id AS conv_id", "0L AS turn", "'user' AS role", "'q' AS text")
    got = chat_pairs.pair_by_opening(df).collect()
    n = df.count()
    assert len(got) == (n + 1) // 2 and sum(r.chosen_id == r.rejected_id for r in got) == n % 2


def test_written_shards_hold_every_record(spark, tmp_path, monkeypatch):
    from maskwright.llm import sharding

    rows = [(i, None if i == 3 else "é" * i + "x", "n") for i in range(200)] + [(None, "y", "n"), (5, "x", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    paths, write = [], sharding.write_shards
    monkeypatch.setattr(sharding, "write_shards", lambda d, p: (paths.append(p), write(d, p)))
    got = queries.op3_sharding(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r.doc_id, r.text, r.lang) for r in spark.read.parquet(paths[0]).collect()) == Counter(rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert sorted(by) == list(range(16)) and all(sorted(s) == list(range(len(s))) for s in by.values())


@pytest.mark.parametrize("low", [-70_000, 0, 4_000, 2**62 - 1])
def test_sql_pairs_across_runs(spark, tmp_path, low):
    r = random.Random(low)
    ids = sorted({low + r.randrange(10 ** r.randrange(1, 6)) for _ in range(300)})
    turns = [(i, k, role, t) for i in ids for k, role, t in ((0, "user", f"q{r.randrange(4)}"), (1, "assistant", r.choice("ab")), (2, None, None), (2, None, None), (3, "assistant", "<|im_end|>"))]
    spark.createDataFrame([*turns, (None, 0, "user", "q0")], "conv_id long, turn long, role string, text string").write.parquet(path := str(tmp_path / "conversations.parquet"))
    got = [tuple(x) for x in queries.op8_chat_pairs(spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    want = con.execute(queries.oracle()["op8_chat_pairs"]).fetchall()
    assert Counter(got) == Counter(want) and len(got) < len(ids) and any(a // 64 != b // 64 for a, b, *_ in got)
