"""Continuous runs of the batch operators: ingest, extraction, counts.

Stores are logs: a batch writes what it adds under its own number, and readers resolve
the latest entry of each key.  A batch costs what it holds, and one that is repeated
after a failure overwrites its own entry and changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from litmine.operators import chunking, corpus, kb, ner
from litmine.sources.log import Log

_CORPUS = (
    "filename string, paper_id string, modified timestamp, title string, doc_id string, source string, "
    f"parents array<{chunking._PARENT}>, chunks array<{chunking._CHUNK}>, error string, status string, step long"
)
_COUNTS = "doi string, label string, canonical_text string, frequency long, metadata string, step long"
#: Steps from one batch to the next.
_ROOM = 1 << 20


def read_files(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """A stream of (filename, paper_id, modified, text) of a folder's files, each path once: see ``refresh`` for changed ones."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return _of_files(spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_batch).load(folder))


def _of_files(files: DataFrame) -> DataFrame:
    name, text = F.regexp_extract("path", "([^/]+)$", 1), F.col("content").cast("string")
    return files.select(name.alias("filename"), corpus.content_id(F.col("content")).alias("paper_id"), F.col("modificationTime").alias("modified"), text.alias("text"))


class CorpusStore:
    """The chunked corpus that a stream of files builds: one log row per file version, with its parents and chunks."""

    def __init__(self, spark: SparkSession, root: str, **options):
        """``options`` go to ``chunking.chunk_corpus``."""
        self.log, self.options = Log(spark, f"{root.rstrip('/')}/corpus", _CORPUS), options
        self.checkpoint = f"{root.rstrip('/')}/checkpoint"

    def current(self, before: int | None = None) -> DataFrame:
        """The latest entry of each file name, failed ones too."""
        last = F.row_number().over(Window.partitionBy("filename").orderBy(F.desc("step")))
        return self.log.read(before).withColumn("_n", last).filter("_n = 1").drop("_n")

    def catalog(self, before: int | None = None) -> DataFrame:
        """(filename, paper_id, status, error, modified, n_chunks) of each file as it is now."""
        return self.current(before).select("filename", "paper_id", "status", "error", "modified", F.greatest(F.size("chunks"), F.lit(0)).alias("n_chunks"))

    def parents(self) -> DataFrame:
        return chunking.parents_of(self.current().drop("step", "status"))

    def chunks(self) -> DataFrame:
        return chunking.chunks_of(self.current().drop("step", "status"))

    def merge(self, files: DataFrame, step: int) -> None:
        """Index what ``files`` (filename, paper_id, modified, text, perhaps title) has that the store lacks.

        Of a name's versions the one modified last counts, the larger id of equals.  A
        version older than the stored one is passed over; one with the stored id is, too,
        if that has been indexed; any other takes the stored one's place, whether its
        chunking fails or not.  The step sees what earlier steps left, so repeating it
        writes the same again.
        """
        titled = files if "title" in files.columns else files.withColumn("title", F.regexp_replace("filename", r"\.[^.]*$", ""))
        latest = titled.groupBy("filename").agg(F.max_by(F.struct("paper_id", "modified", "title", "text"), F.struct("modified", "paper_id")).alias("f")).select("filename", "f.*")
        known = self.catalog(step)
        newer = latest.join(known.select("filename", F.col("modified").alias("had")), "filename", "left").filter("had IS NULL OR modified IS NULL OR modified >= had").drop("had")
        plan = corpus.plan_increment(newer.select("filename", "paper_id"), known).filter("action IN ('index', 'replace')")
        todo = newer.join(plan.select("filename"), "filename").withColumn("doc_id", F.col("paper_id")).withColumn("source", F.col("filename"))
        cut = chunking.chunk_corpus(todo, **self.options)
        status = F.when(F.col("error").isNull(), "indexed").otherwise("error")
        self.log.write(cut.withColumn("status", status).select("filename", "paper_id", "modified", "title", "doc_id", "source", "parents", "chunks", "error", "status"), step)

    def refresh(self, folder: str) -> None:
        """Index again what has failed, and files that have changed since, which a stream of files doesn't see.

        Names and times are compared first; contents are read of files from the earliest
        to the latest time among those found.
        """
        files = self.log.spark.read.format("binaryFile").load(folder)
        named = files.withColumn("filename", F.regexp_extract("path", "([^/]+)$", 1))
        known = self.catalog().select("filename", "status", F.col("modified").alias("had"))
        found = named.select("filename", "modificationTime").join(known, "filename").filter("status = 'error' OR modificationTime > had")
        first, last = found.agg(F.min("modificationTime"), F.max("modificationTime")).first()
        if first is not None:
            between = files.filter(F.col("modificationTime").between(first, last))
            self.merge(_of_files(between).join(found.select("filename").distinct(), "filename", "left_semi"), max(self.log.steps()) + 1)

    def compact(self) -> None:
        """Rewrite the log as its last step alone, read back to the same rows."""
        steps = self.log.steps()
        if len(steps) > 1:
            spare = Log(self.log.spark, f"{self.log.root}-compact", _CORPUS)
            spare.write(self.current().drop("step"), steps[-1])
            self.log.write(spare.read().drop("step"), steps[-1])
            self.log.drop(steps[:-1])
            spare.drop(steps[-1:])


def stream_ingest(files: DataFrame, store: CorpusStore) -> StreamingQuery:
    """Merge a stream of files into a store, batch by batch; between the steps of two batches there is room for refreshes."""

    def batch(rows: DataFrame, number: int) -> None:
        store.merge(rows, (number + 1) * _ROOM)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", store.checkpoint).trigger(availableNow=True).start()


def ingest_folder(spark: SparkSession, folder: str, root: str, per_batch: int = 1000, **options) -> CorpusStore:
    """Bring a store up to a folder's files: changed ones and failed ones of earlier runs again, then what is new."""
    store = CorpusStore(spark, root, **options)
    store.refresh(folder)
    stream_ingest(read_files(spark, folder, per_batch), store).awaitTermination()
    return store


def stream_extract(spark: SparkSession, docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Entities of each arriving document; no state, so it runs in append mode."""
    return ner.match_trie(spark, docs, dictionary)


def stream_counts(facts: DataFrame) -> DataFrame:
    """Running frequency of each (doi, label, canonical_text), for update mode."""
    return facts.groupBy(*kb.FACT).agg(F.count("*").alias("frequency"))


class CountStore:
    """Frequencies of facts, each batch counted exactly once.

    A batch's own counts are a step of the log; ``compact`` adds steps up and leaves the
    sum as the last one's entry, with that number in a ledger: batches up to it are part
    of the sum, and are not taken again.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.log, self.ledger = Log(spark, f"{root.rstrip('/')}/counts", _COUNTS), Log(spark, f"{root.rstrip('/')}/ledger", _COUNTS)
        self.checkpoint = f"{root.rstrip('/')}/checkpoint"

    def merge(self, facts: DataFrame, step: int) -> None:
        """Count a batch of facts (doi, label, canonical_text, perhaps metadata); again, if it is repeated, in the same place."""
        if step <= max(self.ledger.steps(), default=-1):
            return
        rows = facts if "metadata" in facts.columns else facts.withColumn("metadata", F.lit(None).cast("string"))
        self.log.write(rows.groupBy(*kb.FACT).agg(F.count("*").alias("frequency"), F.min("metadata").alias("metadata")), step)

    def table(self) -> DataFrame:
        """(doi, label, canonical_text, frequency, metadata): sums over all batches, the first known metadata."""
        summed = max(self.ledger.steps(), default=-1)
        rows = self.log.read().filter(F.col("step") > summed)
        if summed >= 0:
            rows = rows.unionByName(self.ledger.read().filter(F.col("step") == summed))
        first = F.min_by("metadata", F.when(F.col("metadata").isNotNull(), F.col("step")))
        return rows.groupBy(*kb.FACT).agg(F.sum("frequency").alias("frequency"), first.alias("metadata"))

    def compact(self) -> None:
        """Add all steps up; only then are they and the sum before dropped."""
        steps, sums = self.log.steps(), self.ledger.steps()
        if steps and steps[-1] > max(sums, default=-1):
            self.ledger.write(self.table(), steps[-1])
            self.log.drop(steps)
            self.ledger.drop(sums)


def upsert_counts(facts: DataFrame, store: CountStore) -> StreamingQuery:
    """Adds each batch of facts to a stored table of frequencies, once however often the batch is run."""
    return facts.writeStream.foreachBatch(store.merge).option("checkpointLocation", store.checkpoint).trigger(availableNow=True).start()
