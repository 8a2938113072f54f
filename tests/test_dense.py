"""Dense search stays exact while it passes over blocks, and hands on few rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from litmine.operators import retrieval as R


def frame(spark, ids, vectors, name):
    return spark.createDataFrame([(int(i), [float(v) for v in x]) for i, x in zip(ids, vectors)], f"{name} long, embedding array<double>")


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_equal_to_all_products(spark, monkeypatch, spread):
    monkeypatch.setattr(R, "CHUNK_BLOCK", 50)
    monkeypatch.setattr(R, "QUESTION_BLOCK", 7)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(9, 12))
    v = centres[rng.integers(0, 9, 2000)] + rng.normal(size=(2000, 12)) * spread
    v[100:400] = v[100]  # one vector many times: ties go by id
    q = np.vstack([v[::97], rng.normal(size=(5, 12)), np.zeros((1, 12))])
    got = R.dense_topk(frame(spark, range(len(q)), q, "question_id"), frame(spark, range(2000), v, "chunk_id"), 10).toPandas().sort_values(["question_id", "rank"])
    score = (R._unit(q) @ R._unit(v).T).round(12)
    want = np.lexsort((np.broadcast_to(np.arange(2000), score.shape), -score), axis=1)[:, :10]
    assert got["chunk_id"].tolist() == want.ravel().tolist()


def test_far_blocks_are_passed_over():
    rng = np.random.default_rng(4)
    near, far = R._unit(np.array([1.0, 0, 0]) + rng.normal(size=(40, 3)) * 0.01), R._unit(np.array([-1.0, 0, 0]) + rng.normal(size=(40, 3)) * 0.01)
    best = R._Best([5], np.array([1.0, 0, 0]).tobytes(), 3)
    for ids, block in ((np.arange(40), near), (np.arange(40, 80), far)):
        centre = R._unit(block.sum(axis=0))
        before = best.found[0]
        best.meet(ids, block.tobytes(), centre.tobytes(), float(np.arccos(np.clip(block @ centre, -1, 1)).max()))
    assert best.found[0] is before and len(best.rows()) == 3  # the second block has not been looked at


def test_few_rows_leave_a_task(spark):
    rng = np.random.default_rng(5)
    q, v = rng.normal(size=(30, 4)), rng.normal(size=(5000, 4))
    chunks = frame(spark, range(5000), v, "chunk_id").repartition(6)
    got = R.dense_topk(frame(spark, range(30), q, "question_id"), chunks, 5)
    assert got.count() == 150 and got.agg(F.max("rank")).first()[0] == 5


def test_odd_rows(spark):
    none = spark.createDataFrame([], "chunk_id long, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "question_id long, embedding array<double>")
    assert R.dense_topk(q, none, 3).count() == 0
    one = spark.createDataFrame([(7, [2.0, 0.0]), (8, None)], "chunk_id long, embedding array<double>")
    assert [tuple(r) for r in R.dense_topk(q, one, 3).collect()] == [(1, 7, 1.0, 1)]
