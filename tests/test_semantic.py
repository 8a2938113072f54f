"""Semantic parts of documents that take several tasks."""

import random
import time
import uuid

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from litmine.functions import scalars
from litmine.operators import chunking, retrieval


def plain(rows):
    """(doc, ord) -> part."""
    out, docs = {}, {}
    for doc, n, e in rows:
        docs.setdefault(doc, []).append((n, e))
    for doc, mine in docs.items():
        mine.sort(key=lambda x: x[0])
        unit = [None if e is None else np.array(e) / np.linalg.norm(e) for _, e in mine]
        far = [None] + [None if a is None or b is None else 1 - float(a @ b) for a, b in zip(unit, unit[1:])]
        known = [x for x in far if x is not None]
        limit, part = (np.mean(known) + 1.5 * np.std(known)) if known else 0, 0
        for (n, _), x in zip(mine, far):
            part += x is not None and x > limit
            out[doc, n] = part
    return out


@pytest.mark.parametrize("tasks", [1, 16])
def test_one_document_over_many_tasks(spark, tmp_path, tasks):
    rng = random.Random(9)
    rows = [(doc, 7 * k, None if rng.random() < 0.02 else [rng.gauss(0, 1) for _ in range(4)]) for doc, n in ((1, 3000), (None, 40), (2, 25), (3, 1), (4, 2)) for k in range(n)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "doc_id int, ord int, embedding array<double>").withColumn("sentence", F.lit("x"))
        got = {(r.doc_id, r.ord): r.part for r in chunking.semantic_groups(df, str(tmp_path)).collect()}
        ranges = spark.read.parquet(f"{tmp_path}/ranges").filter("doc_id = 1").select("_range").distinct().count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == plain(rows) and max(got.values()) > 100
    assert ranges >= (8 if tasks == 16 else 1)


def test_no_sentences(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id int, ord int, sentence string, embedding array<double>")
    assert chunking.semantic_groups(df, str(tmp_path)).collect() == []


def test_each_sentence_is_embedded_once(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()

    def embedder(texts):
        for t in texts:
            (seen / f"{t}-{uuid.uuid4().hex}").touch()
        return retrieval.hashing_embedder(texts)

    rows = spark.createDataFrame([(k % 3, k, f"w{k}") for k in range(30)], "doc_id long, ord int, sentence string")
    chunking.semantic_split(retrieval.embed(rows, embedder, "sentence"), str(tmp_path / "shared")).collect()
    assert len(list(seen.iterdir())) == 30

def test_long_vectors(spark, tmp_path):
    """The norm of a vector is taken once, not for each of its elements (that took minutes here)."""
    rng = np.random.default_rng(4)
    rows = [(k % 3, k, rng.normal(size=2000).tolist()) for k in range(500)]
    df = spark.createDataFrame(rows, "doc_id int, ord int, embedding array<float>").withColumn("sentence", F.lit("x"))
    start = time.monotonic()
    got = {(r.doc_id, r.ord): r.part for r in chunking.semantic_groups(df, str(tmp_path)).select("doc_id", "ord", "part").collect()}
    norms = df.select(scalars.l2_normalize(F.col("embedding")).alias("u")).select(F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x).alias("n")).collect()
    assert time.monotonic() - start < 45
    assert got == plain([(doc, n, np.array(e, np.float32).astype(float)) for doc, n, e in rows])
    assert all(abs(r.n - 1) < 1e-9 for r in norms)


def test_vectors_without_a_distance(spark, tmp_path):
    """Nulls, nulls inside, other lengths, zeros and empty ones, as steps in native expressions have them."""
    odd = [[3.0, 4.0], [4.0, 3.0], None, [1.0, 0.0], [1.0, None], [1.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0], [0.0, 1.0], [], [], [float("nan"), 1.0], [1.0, 2.0]]
    df = spark.createDataFrame([(1, k, "x", v) for k, v in enumerate(odd)], "doc_id int, ord int, sentence string, embedding array<float>")
    got = chunking.semantic_groups(df, str(tmp_path)).orderBy("ord").collect()
    u = scalars.l2_normalize(F.col("embedding"))
    want = df.withColumn("d", 1 - scalars.dot(F.lag(u).over(Window.partitionBy("doc_id").orderBy("ord")), u)).orderBy("ord").collect()
    assert list(map(str, (r.distance for r in got))) == list(map(str, (r.d for r in want))) and got[1].embedding == [4.0, 3.0]


def test_split_writes_vectors_once(spark, tmp_path):
    rows = spark.createDataFrame([(k % 3, k, f"w{k}") for k in range(30)], "doc_id long, ord int, sentence string")
    chunking.semantic_split(retrieval.embed(rows, retrieval.hashing_embedder, "sentence"), str(tmp_path)).collect()
    with_vectors = [d.name for d in tmp_path.iterdir() if d.is_dir() and "embedding" in spark.read.parquet(str(d)).columns]
    assert with_vectors == ["sentences"]


def test_embedders_of_any_kind(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(["a", None, " ", "bb", "ccc"])], "i int, text string")
    want = {0: [1.0, 0.5], 1: None, 2: None, 3: [2.0, 0.5], 4: [3.0, 0.5]}
    for embedder in (lambda texts: [[len(t), 0.5] for t in texts], lambda texts: np.array([[len(t), 0.5] for t in texts])):
        assert {r.i: r.embedding for r in retrieval.embed(rows, embedder, batch=2).collect()} == want
