"""Hard negatives against brute force: many rounds, ties, copies, odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from litmine.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, embedding array<float>, q string, cluster string, anchor_id long"


def plain(rows, positives=5, negatives=10, low=30, high=90):
    """Brute force over (vec_id, label, q) lists of equal length, one row per vec_id."""
    out = []
    for a, label, q in rows:
        if a % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(q, p)), i, other) for i, other, p in rows if i != a]
        for s, i, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            fit = sorted(x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s)[:negatives]
            out += [(a, i, r, j, -s, -t) for r, (t, j, _) in enumerate(fit, 1)]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, label, v, "q", "c", 1) for i, label, v in rows], SCHEMA)
    df = df.withColumn("q", hn.quantised(F.col("embedding")))
    return sorted(map(tuple, hn.hard_negatives(df, F.col("vec_id") % 100 == 0, **options).collect()))


def floors(v):
    import numpy as np

    return [int(np.floor(256 * float(np.float32(x)))) for x in v]


@pytest.mark.parametrize("spread", [0.05, 2.0])
def test_many_rounds(spark, monkeypatch, spread):
    """Small cells and short rounds; narrow clusters end early, wide ones late."""
    for name, value in {"CELL": 40, "CLUSTER": 3, "PIVOTS": 7, "FIRST": 1}.items():
        monkeypatch.setattr(hn, name, value)
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(8)]
    rows = []
    for i in range(900):
        c = rng.randrange(8)
        rows.append((i, c % 5, [x + rng.gauss(0, spread) for x in centres[c]]))
    assert run(spark, rows) == plain([(i, label, floors(v)) for i, label, v in rows])
    assert run(spark, rows, positives=2, negatives=3, low=-10, high=120) == plain([(i, label, floors(v)) for i, label, v in rows], 2, 3, -10, 120)


def test_copies_of_one_vector(spark, monkeypatch):
    """A third of the rows are one vector, in all labels: ties go by vec_id."""
    monkeypatch.setattr(hn, "CELL", 64)
    rng = random.Random(6)
    same = [0.5, -0.25, 0.125]
    rows = [(i, rng.randrange(3), same if i % 3 == 0 else [rng.uniform(-1, 1) for _ in same]) for i in range(700)]
    assert run(spark, rows) == plain([(i, label, floors(v)) for i, label, v in rows])


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [0.5, 0.5]), (1, 1, [0.5, 0.25]), (2, 1, [0.0, 0.0]), (3, 2, [0.25, 0.25]), (4, 2, [0.25, 0.2]), (5, None, [0.5, 0.5]), (6, 1, None), (7, 1, [None, 1.0]), (8, 1, [nan, 1.0]),
        (9, 2, [inf, 0.5]), (10, 2, [-inf, 0.5]), (None, 2, [0.25, 0.25]), (100, 7, [1.0, 1.0]), (200, 2, [-0.25, -0.25]), (11, 2, [0.25]), (12, 1, []), (1, 1, [0.5, 0.25]),
    ]
    sound = [(0, 1, [128, 128]), (1, 1, [128, 64]), (2, 1, [0, 0]), (3, 2, [64, 64]), (4, 2, [64, 51]), (100, 7, [256, 256]), (200, 2, [-64, -64]), (11, 2, [64, 0]), (12, 1, [0, 0])]
    assert run(spark, rows) == plain(sound)
    assert run(spark, []) == []


def test_large_components_stay_exact(spark):
    rng = random.Random(7)
    rows = [(i * 50, i % 2, [float(rng.randrange(1 << 18)) for _ in range(3)]) for i in range(40)]
    assert run(spark, rows) == plain([(i, label, floors(v)) for i, label, v in rows])
