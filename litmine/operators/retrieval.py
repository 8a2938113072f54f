"""Hybrid retrieval for a table of questions: dense and BM25 search, fusion, reranking, context."""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litmine.functions.scalars import mask_markers
from litmine.functions.stemming import stem
from litmine.operators.chunking import strip_to_body

RETRIEVE, RERANK, PARENTS, OVERLAP = 60, 40, 10, 0.60
K1, B, RRF_K = 1.2, 0.75, 60
#: Questions and chunks that are multiplied at once in a dense search.
QUESTION_BLOCK, CHUNK_BLOCK = 512, 4_096
#: Bytes of question terms up to which they are broadcast.
BROADCAST_BYTES = 32 << 20
#: Bytes of text, and pairs of a question and a chunk, that a task of a word search takes, about.
TEXT_BYTES, PAIRS = 4 << 20, 1 << 20
NO_CONTEXT = "No relevant passages were found for this question."


Embedder = Callable[[list[str]], "np.ndarray"]


def embed(rows: DataFrame, embedder: Embedder, text: str = "text", out: str = "embedding", batch: int = 256) -> DataFrame:
    """``rows`` plus the embedder's vector of each text, ``batch`` texts at a time; null and blank texts have none.

    The embedder is any function of a list of texts; it is sent to the workers, which call it.
    """

    def vectors(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            texts = part.to_pylist()
            found: list = [None] * len(texts)
            at = [i for i, t in enumerate(texts) if t is not None and t.strip()]
            for lo in range(0, len(at), batch):
                some = at[lo : lo + batch]
                made = embedder([texts[i] for i in some])
                made = made.astype(np.float32) if isinstance(made, np.ndarray) else made  # all at once
                for i, v in zip(some, made):
                    found[i] = np.asarray(v, np.float32)
            none = np.array([v is None for v in found], bool)
            ends = np.cumsum([0 if v is None else len(v) for v in found], dtype=np.int32)
            flat = np.concatenate([np.empty(0, np.float32), *(v for v in found if v is not None)])
            yield pa.ListArray.from_arrays(np.append(np.int32(0), ends), pa.array(flat, from_pandas=True), mask=pa.array(none))

    return rows.withColumn(out, F.arrow_udf(vectors, "array<float>")(F.col(f"`{text}`")))


def hashing_embedder(texts: list[str], dimensions: int = 64) -> "np.ndarray":
    """Signed counts of words hashed into ``dimensions``, of unit length: an embedder without a model."""
    words = [re.findall(r"\w+", text.lower()) for text in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    h = np.fromiter(map(zlib.crc32, map(str.encode, itertools.chain.from_iterable(words))), np.int64, n.sum())
    at = np.repeat(np.arange(len(texts)), n) * dimensions + h % dimensions
    out = np.bincount(at, np.where(h >> 31, 1.0, -1.0), len(texts) * dimensions).reshape(len(texts), dimensions)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-30)


def truncate_dim(v: Column, d: int) -> Column:
    return F.slice(v, 1, d)


#: Chunks around which the others are gathered into blocks: those of lowest hash, so many at most.
PIVOTS = 64
_BLOCK = "ids array<long>, unit binary, centre binary, radius double"


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=-1, keepdims=True), 1e-30)


def _blocks(rows: DataFrame, key: str, size: int) -> DataFrame:
    """(ids, unit, centre, radius): rows (key, embedding) in blocks of at most ``size``, with their unit vectors as bytes,
    the direction of their mean and the largest angle to it."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, unit = [], []

        def block() -> pd.DataFrame:
            mine = np.array(unit[:size])
            centre = _unit(mine.sum(axis=0))
            radius = float(np.arccos(np.clip(mine @ centre, -1, 1)).max())
            out = pd.DataFrame({"ids": [ids[:size]], "unit": [mine.tobytes()], "centre": [centre.tobytes()], "radius": [radius]})
            del ids[:size], unit[:size]
            return out

        for part in batches:
            for i, x in zip(part[key], part["embedding"]):
                ids.append(int(i))
                unit.append(_unit(np.asarray(x, float)))
                if len(ids) == size:
                    yield block()
        if ids:
            yield block()

    return rows.filter("embedding IS NOT NULL").select(key, "embedding").mapInPandas(pack, _BLOCK)


def gathered(chunks: DataFrame, key: str) -> DataFrame:
    """``chunks`` (key, embedding) dealt out so that neighbours in space are neighbours in a partition.

    By the nearest of a few pivots, then by id: partitions are cut by range, so that a
    pivot with many chunks takes as many of them as it needs.
    """
    there = chunks.filter("embedding IS NOT NULL").select(key, "embedding")
    sample = there.orderBy(F.xxhash64(key), key).limit(PIVOTS).collect()
    if len(sample) < 2:
        return there
    pivots = _unit(np.array([r.embedding for r in sample], float))

    def nearest(vectors: pd.Series) -> pd.Series:
        return pd.Series(np.argmax(np.stack(vectors.to_numpy()).astype(float) @ pivots.T, axis=1))

    near = there.withColumn("pivot", F.pandas_udf(nearest, "int")("embedding"))
    return near.repartitionByRange("pivot", key).sortWithinPartitions("pivot", key).select(key, "embedding")


class _Best:
    """The k best chunks so far of each question of a block."""

    def __init__(self, ids: np.ndarray, unit: bytes, k: int):
        self.ids, self.k = np.asarray(ids), k
        self.unit = np.frombuffer(unit).reshape(len(self.ids), -1)
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0), np.empty(0, np.int64))] * len(self.ids)
        self.least = np.full(len(self.ids), -np.inf)

    def meet(self, chunk: np.ndarray, unit: bytes, centre: bytes, radius: float) -> None:
        """Questions whose k best no chunk of the block can enter are left out: an angle to the centre less the radius bounds the others."""
        angle = np.arccos(np.clip(self.unit @ np.frombuffer(centre), -1, 1))
        live = np.flatnonzero(np.cos(np.maximum(angle - radius, 0)) + 1e-9 >= self.least)
        if not len(live):
            return
        score = self.unit[live] @ np.frombuffer(unit).reshape(len(chunk), -1).T
        for q, row in zip(live, score):
            new = np.flatnonzero(row + 1e-11 >= self.least[q])
            if len(new):
                had, ids = self.found[q]
                had, ids = np.concatenate([had, row[new]]), np.concatenate([ids, chunk[new]])
                top = np.lexsort((ids, -had.round(12)))[: self.k]
                self.found[q] = had[top], ids[top]
                if len(top) == self.k:
                    self.least[q] = had[top[-1]]

    def rows(self) -> pd.DataFrame:
        n = [len(ids) for _, ids in self.found]
        return pd.DataFrame({"question_id": np.repeat(self.ids, n), "chunk_id": np.concatenate([i for _, i in self.found]), "score": np.concatenate([s for s, _ in self.found])})


def dense_topk(questions: DataFrame, chunks: DataFrame, k: int = RETRIEVE) -> DataFrame:
    """(question_id, chunk_id, score, rank): the k nearest chunks of each question by cosine, exactly.

    ``questions``: (question_id long, embedding), as many as there are; ``chunks``:
    (chunk_id long, embedding).  A task keeps the k best of each of its questions over all
    its blocks of chunks, passes over blocks that none of them needs, and hands those on at
    its end: at most k rows of a question leave a task, and nothing is read to the driver.
    """

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict[int, _Best] = {}  # the task's own questions
        for pairs in batches:
            for asked, q, chunk, v, centre, radius in zip(pairs["q_ids"], pairs["q_unit"], pairs["ids"], pairs["unit"], pairs["centre"], pairs["radius"]):
                if int(asked[0]) not in state:
                    state[int(asked[0])] = _Best(asked, q, k)
                state[int(asked[0])].meet(np.asarray(chunk), v, centre, radius)
        for mine in state.values():
            yield mine.rows()

    # dealt out, so that the blocks are made once and not for each pair of partitions
    asked = _blocks(questions, "question_id", QUESTION_BLOCK).select(F.col("ids").alias("q_ids"), F.col("unit").alias("q_unit")).repartition(F.col("q_ids")[0])
    pairs = _blocks(gathered(chunks, "chunk_id"), "chunk_id", CHUNK_BLOCK).repartition(F.col("ids")[0]).crossJoin(asked)
    found = pairs.mapInPandas(best, "question_id long, chunk_id long, score double")
    w = Window.partitionBy("question_id").orderBy(F.desc(F.round("score", 12)), "chunk_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def light_stem(word: Column) -> Column:
    """A word without a plural or verb ending."""
    cut = lambda n: F.substring(word, F.lit(1), F.length(word) - n)
    stem = F.when(word.endswith("ing"), cut(3)).when(word.endswith("ed") | word.endswith("es"), cut(2)).when(word.endswith("s"), cut(1)).otherwise(word)
    return F.when(F.length(word) > 4, stem).otherwise(word)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


Stemmer = Callable[[Column], Column]


def tokens(text: Column) -> Column:
    return F.transform(words(text), light_stem)


def _exploded(rows: DataFrame, text: str, *keep: str) -> DataFrame:
    """(keep…, dl, word): a row per word.  The words are counted before they become rows, so that
    none of these carries the whole list, which a stemmer in Python would have to queue with each."""
    each = rows.select(*keep, words(F.col(text)).alias("w")).select(*keep, F.size("w").alias("dl"), "w")
    return each.select(*keep, "dl", F.explode_outer("w").alias("word")).filter("word IS NOT NULL")


def parts_for(rows: DataFrame, size: float, most: int) -> int:
    """Partitions that take ``most`` each of ``size``, one for each core at least: tasks keep their size as tables grow."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(size / most))


def dealt(rows: DataFrame, text: str, *keys: str) -> DataFrame:
    """``rows`` dealt out by ``keys``, in partitions of about TEXT_BYTES of text."""
    size = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return rows.repartition(parts_for(rows, size, TEXT_BYTES), *keys)


def terms_of(rows: DataFrame, text: str, stemmer: Stemmer, *keep: str) -> DataFrame:
    """(keep…, dl, term, tf): the stemmed words of a text, how often each is there, and how many words there are.

    Texts are dealt out by ``keep`` once; their words are counted before they are stemmed,
    so that each is stemmed once a text, and counted where the text is.
    """
    each = _exploded(dealt(rows.select(*keep, text), text, *keep), text, *keep).groupBy(*keep, "dl", "word").agg(F.count("*").alias("n"))
    return each.select(*keep, "dl", stemmer(F.col("word")).alias("term"), "n").groupBy(*keep, "dl", "term").agg(F.sum("n").alias("tf"))


def _asked_words(chunks: DataFrame, asked: DataFrame, stemmer: Stemmer) -> DataFrame:
    """(word, term) of the chunks' words whose stem is asked (distinct term); each is stemmed once.

    An inner join: a semi join would be moved below the distinct words, and the stemmer with it.
    """
    each = chunks.select(F.explode_outer(words(F.col("text"))).alias("word")).filter("word IS NOT NULL").distinct()
    return each.select("word", stemmer(F.col("word")).alias("term")).join(asked, "term").select("word", "term")


def _stats(chunks: DataFrame) -> DataFrame:
    """One row (n, avgdl)."""
    return chunks.select(F.size(words(F.col("text"))).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def bm25_index(chunks: DataFrame, stemmer: Stemmer = stem) -> tuple[DataFrame, DataFrame, DataFrame]:
    """postings(chunk_id, term, tf, dl), terms(term, df) and stats(n, avgdl) of chunks (chunk_id, text)."""
    postings = terms_of(chunks, "text", stemmer, "chunk_id")
    return postings, postings.groupBy("term").agg(F.count("*").alias("df")), _stats(chunks)


def bm25_scores(tf: DataFrame, asked: DataFrame, df: DataFrame, stats: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """(question_id, chunk_id, score, rank) of asked (question_id, term) and the chunks' tf (chunk_id, dl, term, tf), df (term, df) and stats, one row (n, avgdl).

    Counts are dealt out by chunk, in partitions of PAIRS questions times chunks at most, about;
    scores are added up there, and a partition hands on its k best of each question.
    """
    n, avgdl = stats.first()
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = asked.join(df, "term").select("question_id", "term", idf.alias("idf"))
    gain = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(avgdl).cast("double")))
    pairs = asked.agg(F.count_distinct("question_id")).first()[0] * n
    there = tf.repartition(parts_for(tf, pairs, PAIRS), "chunk_id")
    scored = there.join(few_or_not(weights, asked), "term").groupBy("question_id", "chunk_id").agg(F.sum(F.col("idf") * gain).alias("score"))
    w = Window.partitionBy("question_id").orderBy(F.desc(F.round("score", 9)), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def few_or_not(rows: DataFrame, asked: DataFrame, column: str = "term") -> DataFrame:
    """``rows``, no more than ``asked`` has, with a broadcast hint if its terms' bytes add up to few."""
    few = (asked.agg(F.sum(F.octet_length(column) + 40)).first()[0] or 0) <= BROADCAST_BYTES
    return F.broadcast(rows) if few else rows


def asked_terms(questions: DataFrame, stemmer: Stemmer) -> DataFrame:
    """(question_id, term): the distinct stems of questions (question_id, question)."""
    each = questions.select("question_id", F.explode(F.array_distinct(words(F.col("question")))).alias("word"))
    return each.select("question_id", stemmer(F.col("word")).alias("term")).distinct()


def bm25_topk(questions: DataFrame, chunks: DataFrame, k: int = RETRIEVE, k1: float = K1, b: float = B, stemmer: Stemmer = stem, shared: str | None = None) -> DataFrame:
    """(question_id, chunk_id, score, rank): the k best chunks of each question (question_id, question).

    For chunks that no index holds; see ``search_index.Bm25Index`` for those that stay.
    The chunks' distinct words are stemmed first; texts are then dealt out by chunk once,
    and their words with an asked stem counted where they are, while these words are
    few enough to broadcast (their bytes are added up); beyond that, words are shuffled.
    ``shared``: a new folder that all executors share; the words and the counts are then
    written there, each made once.
    """

    def saved(rows: DataFrame, name: str) -> DataFrame:
        if shared is None:
            return rows
        rows.write.parquet(f"{shared}/{name}")
        return rows.sparkSession.read.schema(rows.schema).parquet(f"{shared}/{name}")

    there = chunks.select("chunk_id", "text")
    asked = asked_terms(questions, stemmer)
    known = saved(_asked_words(there, few_or_not(asked.select("term").distinct(), asked), stemmer), "asked-words")
    counted = _exploded(dealt(there, "text", "chunk_id"), "text", "chunk_id").join(few_or_not(known, known, "word"), "word")
    tf = saved(counted.groupBy("chunk_id", "dl", "term").agg(F.count("*").alias("tf")), "counts")
    return bm25_scores(tf, asked, tf.groupBy("term").agg(F.count("*").alias("df")), _stats(there), k, k1, b)


def rrf_fuse(dense: DataFrame, sparse: DataFrame | None, k: int = RRF_K, top: int = RETRIEVE) -> DataFrame:
    """Reciprocal-rank fusion of two rankings; dense alone without the other."""
    both = dense.select("question_id", "chunk_id", "rank")
    if sparse is not None:
        both = both.unionByName(sparse.select("question_id", "chunk_id", "rank"))
    fused = both.groupBy("question_id", "chunk_id").agg(F.sum(1 / (k + F.col("rank"))).alias("score"))
    w = Window.partitionBy("question_id").orderBy(F.desc(F.round("score", 12)), "chunk_id")
    return fused.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def source_filter(chunks: DataFrame, sources: list[str] | None, kb: bool = False) -> DataFrame:
    return chunks if kb or not sources else chunks.filter(F.col("source").isin(sources))


def display_score(score: Column, by: str = "question_id") -> Column:
    top = F.max(score).over(Window.partitionBy(by))
    return F.when(top > 0, F.bround(score / top * 100)).otherwise(F.lit(0.0)).cast("int")


def lexical_scorer(question: Column, passage: Column) -> Column:
    """Share of the question's distinct terms that the passage has."""
    q = F.array_distinct(tokens(question))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokens(passage))) / F.size(q)).otherwise(F.lit(0.0))


def rerank(candidates: DataFrame, scorer: Callable[[Column, Column], Column] = lexical_scorer, top: int = RERANK, instruction: str = "") -> DataFrame:
    """The first ``top`` candidates (question_id, question, chunk_id, text, rank) with ``raw``, the scorer's score.

    Blank questions and passages are not scored; a score that isn't finite is null.
    """
    asked = F.concat(F.lit(f"{instruction}\n" if instruction else ""), "question")
    raw = scorer(asked, F.col("text")).cast("double")
    fit = (F.trim("text") != "") & (F.trim("question") != "")
    return candidates.filter(F.col("rank") <= top).withColumn("raw", F.when(fit, raw)).withColumn("raw", F.when(~F.isnan("raw") & (F.abs("raw") < float("inf")), F.col("raw")))


def rerank_threshold(scored: DataFrame, least: float = 0.1) -> DataFrame:
    """Candidates whose score, scaled per question, is ``least`` or more, best first; if none is, the order found."""
    of = Window.partitionBy("question_id")
    low, high = F.min("raw").over(of), F.max("raw").over(of)
    scaled = F.when(high - low < 1e-9, 0.5).otherwise((F.col("raw") - low) / (high - low))
    kept = scored.withColumn("scaled", scaled).withColumn("_keep", F.coalesce(F.col("scaled") >= least, F.lit(False)))
    none = F.max(F.col("_keep").cast("int")).over(of) == 0
    kept = kept.withColumn("_none", none).filter(F.col("_keep") | F.col("_none"))
    order = [F.when(F.col("_none"), F.lit(0.0)).otherwise(-F.col("raw")), F.col("rank")]
    return kept.withColumn("rank", F.row_number().over(of.orderBy(*order))).drop("_keep", "_none")


def resolve_parents(hits: DataFrame, parents: DataFrame, final: int = PARENTS) -> DataFrame:
    """Children (question_id, chunk_id, parent_id, text, rank) as their parents, first hit first.

    Children without a parent (tables) pass; a parent without text keeps the child's.
    """
    pool = max(3 * final, 6)
    p = parents.select("parent_id", F.col("body").alias("parent_text"))
    key = F.coalesce("parent_id", F.concat(F.lit("child:"), F.col("chunk_id").cast("string")))
    rows = hits.join(p, "parent_id", "left").withColumn("_key", key)
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("question_id", "_key").orderBy("rank"))).filter("_n = 1")
    first = first.withColumn("text", F.coalesce(F.nullif("parent_text", F.lit("")), "text"))
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("rank"))
    return first.withColumn("rank", place).filter(F.col("rank") <= pool).drop("_key", "_n", "parent_text")


def bigrams(text: str) -> frozenset:
    """Pairs of neighbouring words; the word itself of a text of one."""
    words = re.findall(r"\w+", (text or "").lower())
    return frozenset(zip(words, words[1:])) if len(words) > 1 else frozenset(words)


def diversify(blocks: DataFrame, most: int = PARENTS, overlap: float = OVERLAP) -> DataFrame:
    """Per question, in rank order, the blocks whose bigrams overlap with no kept block by ``overlap`` or more.

    Overlap is the shared part of the smaller set; blocks without words stay.
    """

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank", ignore_index=True)
        sets = rows["text"].map(bigrams).tolist()
        alike = np.array([[bool(x and y) and len(x & y) >= overlap * min(len(x), len(y)) for y in sets] for x in sets])
        kept = reduce(lambda held, i: held if alike[i, held].any() else [*held, i], range(len(sets)), [])[:most]
        return rows.iloc[kept].assign(rank=range(1, len(kept) + 1))

    return blocks.groupBy("question_id").applyInPandas(pick, blocks.schema)


def context_budget(blocks: DataFrame, window: int = 8192, reserve: int = 2000, chars: int = 4, least: int = 1000) -> DataFrame:
    """``blocks`` plus context_status: full while the budget of characters lasts, the first always, else omitted_budget."""
    budget = max(least, (window - reserve) * chars)
    rest = [c for c in blocks.columns if c not in ("question_id", "rank")]
    lists = blocks.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", *rest))).alias("b"))  # a question's blocks are few
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("keep"))

    def step(s: Column, x: Column) -> Column:
        used = s["used"] + F.coalesce(x["n"], F.lit(0))
        fits = (F.size(s["keep"]) == 0) | (used <= budget)
        return F.when(fits, F.struct(used.alias("used"), F.array_append(s["keep"], x["rank"]).alias("keep"))).otherwise(s)

    sizes = F.transform("b", lambda x: F.struct(x["rank"].alias("rank"), F.length(x["text"]).alias("n")))
    kept = lists.withColumn("_keep", F.aggregate(sizes, start, step)["keep"])
    each = kept.select("question_id", "_keep", F.explode("b").alias("x")).select("question_id", "_keep", "x.*")
    status = F.when(F.array_contains("_keep", F.col("rank")), "full").otherwise("omitted_budget")
    return each.select(*blocks.columns, status.alias("context_status"))


def positional_ids(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("cid", F.concat(F.lit("c"), F.row_number().over(Window.partitionBy("question_id").orderBy("rank")).cast("string")))


def context_block(cid: Column, title: Column, authors: Column, file: Column, section: Column, body: Column, is_table: Column) -> Column:
    head = F.concat_ws(" | ", cid, F.nullif(title, F.lit("")), F.nullif(authors, F.lit("")), F.nullif(file, F.lit("")), F.nullif(section, F.lit("")))
    return F.concat(F.when(is_table, "TABLE ").otherwise(""), head, F.lit("\n"), body)


def contexts(blocks: DataFrame) -> DataFrame:
    """(question_id, context): the full blocks (…, block) of each question, by rank."""
    full = blocks.filter("context_status = 'full'")
    return full.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n\n").alias("context"))


def source_records(blocks: DataFrame, kb: bool = False) -> DataFrame:
    fields = [F.col("cid").alias("chunk_id"), "source", "section", "score", strip_to_body(F.col("text"), F.col("title")).alias("chunk_text"), "start", "end", "page", "context_status"]
    return blocks.select("question_id", F.struct(*fields, *(["title", "doi"] if kb else [])).alias("record"))


def build_messages(questions: DataFrame, context: DataFrame, history: DataFrame, system: str, last: int = 10) -> DataFrame:
    """(question_id, messages): system text, the last turns with masked markers, and the question with its context."""
    turn = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("turn")))
    said = history.withColumn("_n", turn).filter(F.col("_n") <= last)
    text = F.when(F.col("role") == "assistant", mask_markers(F.col("text"))).otherwise(F.col("text"))
    past = said.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", text.alias("content")))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("past"))
    j = questions.join(context, "question_id", "left").join(past, "question_id", "left")
    asked = F.struct(F.lit("user").alias("role"), F.concat(F.lit("Context:\n"), "context", F.lit("\n\nQuestion: "), "question").alias("content"))
    none = F.array().cast("array<struct<role:string,content:string>>")
    first = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")))
    return j.select("question_id", F.when(F.col("context").isNotNull(), F.concat(first, F.coalesce("past", none), F.array(asked))).alias("messages"), F.when(F.col("context").isNull(), NO_CONTEXT).alias("answer"))


def truncate_tokens(text: Column, n: int, per_token: int | None = None) -> Column:
    """The first n words of a text, or the first n * per_token characters."""
    if per_token:
        return F.substring(text, 1, n * per_token)
    return F.array_join(F.slice(F.split(text, " "), 1, n), " ")


def hybrid_search(questions: DataFrame, chunks: DataFrame, parents: DataFrame, scorer: Callable[[Column, Column], Column] = lexical_scorer, sources: list[str] | None = None, embedder: Embedder | None = None, shared: str | None = None) -> DataFrame:
    """Questions (question_id, question, embedding) to ranked context blocks with their status.

    ``chunks``: (chunk_id, parent_id, source, text, embedding).  With an ``embedder``,
    questions and chunks need no embedding.  ``shared``: a new folder that all executors
    share; vectors, the fused ranking and the passages found are then written there, each
    made once, and what follows reads them.
    """

    def saved(rows: DataFrame, name: str) -> DataFrame:
        if shared is None:
            return rows
        rows.write.parquet(f"{shared}/{name}")
        return rows.sparkSession.read.schema(rows.schema).parquet(f"{shared}/{name}")

    if embedder:
        questions = saved(embed(questions.drop("embedding"), embedder, "question"), "questions")
        chunks = saved(embed(chunks.drop("embedding"), embedder), "chunks")
    there = source_filter(chunks, sources)
    fused = rrf_fuse(saved(dense_topk(questions, there), "dense"), saved(bm25_topk(questions, there, shared=shared and f"{shared}/bm25"), "words"))
    hits = fused.join(there.select("chunk_id", "parent_id", "source", "text"), "chunk_id").join(questions.select("question_id", "question"), "question_id")
    best = resolve_parents(rerank_threshold(saved(rerank(hits, scorer), "reranked")), parents)
    return positional_ids(context_budget(diversify(best.select("question_id", "question", "chunk_id", "parent_id", "source", "text", "score", "rank"))))
