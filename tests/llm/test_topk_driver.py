"""Top-k: neither the vectors of each task's sample nor the query blocks go to the driver."""

import random

from pyspark.sql import functions as F

from pagelane.llm import op2_exact_topk as op2


def vectors(spark, n, width=4):
    rng = random.Random(9)
    rows = [(i, [rng.random() - 0.5 for _ in range(width)]) for i in range(n)]
    return spark.createDataFrame(rows + rows[:20] * 3, "vec_id long, embedding array<float>")


def test_query_blocks_meet_the_trees_by_shuffle_whatever_their_files_size(spark, monkeypatch):
    monkeypatch.setattr(op2, "TREE_ROWS", 60)
    found = op2.top_k(vectors(spark, 300), k=5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert found.count() == 5 * (15 + 3)  # id 0 comes four times


def test_sample_is_of_the_smallest_hashes_with_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(op2, "SAMPLE_ROWS", 40)
    rows = op2.quantised(vectors(spark, 300), "vec_id", "embedding")
    every = rows.select(F.xxhash64("vec_id", "v").alias("hash"), "vec_id", "v").collect()
    expected = [(r.vec_id, r.v) for r in sorted(every, key=lambda r: (r.hash, r.vec_id))[:40]]
    assert [(r.vec_id, r.v) for r in op2._sample(rows).collect()] == expected
