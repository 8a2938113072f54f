"""Streams: replaced, repeated and failing files; batches that are counted once."""

import os

from litmine.streaming import ingest


def put(folder, name, text, at):
    (folder / name).write_text(text)
    os.utime(folder / name, (at, at))


def state(store):
    return {r.filename: (r.status, r.n_chunks > 0) for r in store.catalog().collect()}


def bodies(store):
    return sorted((r.filename, r.body) for r in store.chunks().collect())


def test_changed_repeated_and_failing_files(spark, tmp_path):
    folder, root = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    put(folder, "a.txt", "The first text of a.", 1000)
    put(folder, "b.txt", "The text of b.", 1000)
    put(folder, "bad.txt", " \n ", 1000)
    store = ingest.ingest_folder(spark, str(folder), root)
    assert state(store) == {"a.txt": ("indexed", True), "b.txt": ("indexed", True), "bad.txt": ("error", False)}

    # a changed file takes the place of its old version, a new one joins, a mended one is tried again
    put(folder, "a.txt", "Another text, which is later.", 2000)
    put(folder, "c.txt", "The text of c.", 2000)
    store = ingest.ingest_folder(spark, str(folder), root)
    assert bodies(store) == [("a.txt", "Another text, which is later."), ("b.txt", "The text of b."), ("c.txt", "The text of c.")]
    assert state(store)["bad.txt"] == ("error", False)
    put(folder, "bad.txt", "Mended.", 1000)  # the time is as it was: failed files are tried again anyway
    store = ingest.ingest_folder(spark, str(folder), root)
    assert state(store)["bad.txt"] == ("indexed", True)

    # a change right after another refresh leaves what that one did; older times don't count
    put(folder, "b.txt", "B again.", 3000)
    put(folder, "c.txt", "Older.", 500)
    store = ingest.ingest_folder(spark, str(folder), root)
    assert bodies(store) == [("a.txt", "Another text, which is later."), ("b.txt", "B again."), ("bad.txt", "Mended."), ("c.txt", "The text of c.")]

    # nothing new: nothing changes; a log of one step has the same rows
    before = bodies(store)
    store = ingest.ingest_folder(spark, str(folder), root)
    assert bodies(store) == before
    store.compact()
    assert bodies(store) == before and len(store.log.steps()) == 1


def rows(spark, *files):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(files, "filename string, at long, text string")
    return df.select("filename", ingest.corpus.content_id(F.col("text")).alias("paper_id"), F.timestamp_seconds("at").alias("modified"), "text")


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    store = ingest.CorpusStore(spark, str(tmp_path))
    store.merge(rows(spark, ("a", 1, "one"), ("b", 1, "two")), 0)
    second = rows(spark, ("a", 5, "newest"), ("a", 3, "newer, but with a larger hash perhaps"), ("b", 0, "older than known"), ("c", 1, "three"))
    store.merge(second, 2)
    once = sorted(map(tuple, store.catalog().collect()))
    store.merge(second, 2)
    assert sorted(map(tuple, store.catalog().collect())) == once
    assert bodies(store) == [("a", "newest"), ("b", "two"), ("c", "three")]
    # the step before may be repeated too: later ones still count
    store.merge(rows(spark, ("a", 1, "one"), ("b", 1, "two")), 0)
    assert bodies(store) == [("a", "newest"), ("b", "two"), ("c", "three")]


def test_a_failing_splitter_fails_one_document(spark, tmp_path):
    def splitter(text, size, overlap):
        if "boom" in text:
            raise RuntimeError("boom")
        return [text]

    store = ingest.CorpusStore(spark, str(tmp_path), splitter=splitter)
    store.merge(rows(spark, ("a", 1, "fine"), ("b", 1, "boom")), 0)
    assert {(r.filename, r.status, r.error) for r in store.catalog().collect()} == {("a", "indexed", None), ("b", "error", "boom")}
    # an unchanged failed file is planned again, an indexed one is not
    store.merge(rows(spark, ("a", 1, "fine"), ("b", 1, "boom")), 2)
    assert [r.filename for r in store.log.read().filter("step = 2").collect()] == ["b"]


def test_counts_are_merged_once(spark, tmp_path):
    facts = lambda *x: spark.createDataFrame(x, "doi string, label string, canonical_text string, metadata string")
    store = ingest.CountStore(spark, str(tmp_path))
    first, second = facts(("d", "L", "x", None), ("d", "L", "x", "m1"), ("d", "L", None, None)), facts(("d", "L", "x", "m0"), ("e", "L", "x", None))
    want = {("d", "L", "x", 3, "m1"), ("d", "L", None, 1, None), ("e", "L", "x", 1, None)}
    for batch, step in ((first, 0), (first, 0), (second, 1), (second, 1), (first, 0)):
        store.merge(batch, step)
    assert set(map(tuple, store.table().collect())) == want
    store.compact()
    store.merge(second, 1)  # repeated after it became part of the sum
    assert set(map(tuple, store.table().collect())) == want
    store.merge(facts(("e", "L", "x", "m2")), 2)
    store.compact()
    assert {tuple(r) for r in store.table().collect() if r.doi == "e"} == {("e", "L", "x", 2, "m2")}
    assert store.ledger.steps() == [2] and store.log.steps() == []


def test_stream_of_facts(spark, tmp_path):
    source = tmp_path / "facts"
    row = ("d", "L", "x")
    spark.createDataFrame([row] * 3, "doi string, label string, canonical_text string").write.parquet(str(source))
    store = ingest.CountStore(spark, str(tmp_path / "store"))
    for _ in range(2):
        ingest.upsert_counts(spark.readStream.schema("doi string, label string, canonical_text string").parquet(str(source)), store).awaitTermination()
    assert [tuple(r)[:4] for r in store.table().collect()] == [(*row, 3)]
