"""A BM25 index that outlives a call, kept up source by source."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litmine.functions.stemming import stem
from litmine.operators.retrieval import B, K1, RETRIEVE, Stemmer, asked_terms, bm25_scores, few_or_not, parts_for, terms_of, words
from litmine.sources.log import Log

#: Folders that postings are dealt to by term: a search reads those of its terms.
BUCKETS = 64
#: Words of the texts that a task writes the postings of, about.
WORDS = 2 << 20


class Bm25Index:
    """Postings by term, document frequencies and lengths of the chunks of sources.

    Each step writes the postings of the sources that it brings, and what document
    frequencies and total lengths change by when they take their older selves' place; the
    sums over all steps are those of the live chunks.  Postings of a source count while
    its latest step is theirs.  Steps are numbered by the caller; one that is repeated writes
    the same again.  Sources and chunks may not be null; texts may.
    """

    def __init__(self, spark: SparkSession, root: str, stemmer: Stemmer = stem, buckets: int = BUCKETS, id_type: str = "string"):
        """``id_type``: of chunk ids, by which equal scores are put in order."""
        log = lambda name, schema: Log(spark, f"{root.rstrip('/')}/{name}", schema)
        self.stemmer, self.buckets, self.id_type = stemmer, buckets, id_type
        self._postings = log("postings", f"term string, source string, chunk_id {id_type}, dl int, tf long, step long, bucket int")
        self._lengths = log("chunks", f"source string, chunk_id {id_type}, dl int, step long")
        self._terms = log("terms", "term string, change long, step long")
        self._sources = log("sources", "source string, there boolean, n long, words long, step long")

    def bucket(self, term):
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _live(self, before: int | None = None) -> DataFrame:
        """(source, step) of the sources that are there."""
        last = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("step")))
        return self._sources.read(before).withColumn("_n", last).filter("_n = 1 AND there").select("source", "step")

    def _replace(self, sources: DataFrame, postings: DataFrame | None, lengths: DataFrame | None, step: int) -> None:
        """Put ``postings`` and ``lengths`` in the place of what the sources (source, …) had."""
        gone = self._live(step).join(sources.select("source"), "source", "left_semi")
        steps = [r.step for r in gone.select("step").distinct().collect()]  # only their folders are read
        old = self._postings.read(step).filter(F.col("step").isin(steps)).join(gone, ["source", "step"], "left_semi")
        less = old.groupBy("term").agg((-F.count("*")).alias("change"))
        old_lengths = self._lengths.read(step).filter(F.col("step").isin(steps)).join(gone, ["source", "step"], "left_semi")
        less_words = old_lengths.groupBy("source").agg((-F.count("*")).alias("n"), (-F.sum("dl")).alias("words"))
        there = postings is not None
        if there:
            self._lengths.write(lengths, step)
            # a bucket takes several tasks, by chunk: each step has as many as its words need
            n_words = self._lengths.one(step).agg(F.sum("dl")).first()[0] or 0
            parts = parts_for(postings, n_words, WORDS)
            slice_ = F.pmod(F.xxhash64("chunk_id"), F.lit(math.ceil(4 * parts / self.buckets)))  # several to a task, so that tasks are alike
            self._postings.write(postings.withColumn("bucket", self.bucket("term")).repartition(parts, "bucket", slice_).sortWithinPartitions("bucket", "term"), step, "bucket")
            mine = self._postings.one(step)
            less = less.unionByName(mine.groupBy("term").agg(F.count("*").alias("change")))
            less_words = less_words.unionByName(self._lengths.one(step).groupBy("source").agg(F.count("*").alias("n"), F.sum("dl").alias("words")))
        self._terms.write(less.groupBy("term").agg(F.sum("change").alias("change")).filter("change <> 0"), step)
        changed = sources.select("source").distinct().join(less_words.groupBy("source").agg(F.sum("n").alias("n"), F.sum("words").alias("words")), "source", "left")
        # written last: without it the step's postings are of no source
        self._sources.write(changed.select("source", F.lit(there).alias("there"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("words", F.lit(0)).alias("words")), step)

    def add(self, chunks: DataFrame, step: int) -> None:
        """Index chunks (chunk_id, source, text); they replace all that their sources had."""
        rows = chunks.select("source", F.col("chunk_id").cast(self.id_type).alias("chunk_id"), "text")
        postings = terms_of(rows, "text", self.stemmer, "source", "chunk_id").select("term", "source", "chunk_id", "dl", "tf")
        self._replace(rows.select("source").distinct(), postings, rows.select("source", "chunk_id", F.size(words(F.col("text"))).alias("dl")), step)

    def remove(self, sources: DataFrame, step: int) -> None:
        """Take sources (source) out."""
        self._replace(sources, None, None, step)

    def terms(self) -> DataFrame:
        """(term, df)."""
        return self._terms.read().groupBy("term").agg(F.sum("change").alias("df")).filter("df > 0")

    def stats(self) -> DataFrame:
        """One row (n, avgdl)."""
        return self._sources.read().agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (F.sum("words") / F.sum("n")).alias("avgdl"))

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """(chunk_id, source, dl, term, tf) of the chunks that are there; of ``terms`` (term) alone if given.

        Only the folders of the terms' buckets are read.
        """
        rows = self._postings.read()
        if terms is not None:
            buckets = [r.b for r in terms.select(self.bucket("term").alias("b")).distinct().collect()]  # as many as there are at most
            rows = rows.filter(F.col("bucket").isin(buckets)).join(terms, "term", "left_semi")
        return rows.join(self._live(), ["source", "step"], "left_semi").drop("step", "bucket")

    def topk(self, questions: DataFrame, k: int = RETRIEVE, k1: float = K1, b: float = B) -> DataFrame:
        """(question_id, chunk_id, score, rank) as ``bm25_topk`` over the chunks that are there; no text is read."""
        asked = asked_terms(questions, self.stemmer)
        terms = few_or_not(asked.select("term").distinct(), asked)
        return bm25_scores(self.postings(terms), asked, self.terms(), self.stats(), k, k1, b)
