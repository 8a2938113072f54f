"""Token counts through a cache keyed by content and tokenizer digests.

The cache is a Parquet table (tokenizer, content, n_tokens) in a folder.  Documents
are reduced to digests; digests that the cache has for this tokenizer are answered
from it, and of the others one text each is encoded and its count appended.  Content
is normalised only as far as counts allow: null becomes empty.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmine.llm.common import Scratch, small, table, within

LIMIT = 4096
#: Pieces of text whose counts a worker remembers at most.
_REMEMBERED = 500_000
_RUN = re.compile(" +[^ ]*")


def tokenizer_version(path: str) -> str:
    """Digest of a tokenizer's file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


@lru_cache(maxsize=4)
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts tokens as the file's library does, without added special tokens.

    A sentencepiece model that leaves text as it is and has no piece with a space
    after another character never joins across the start of a run of spaces; its
    texts are counted run by run, and counts of runs are remembered.  Other models
    encode whole texts.
    """
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        return lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    whole = lambda texts: [len(x) for x in m.encode(texts, num_threads=1)]
    if not runs_are_separate(m, path):
        return whole
    known: dict[str, int] = {" ": 1}

    def count(texts: list[str]) -> list[int]:
        cut = []
        for text in texts:
            text = text.replace("▁", " ")
            if not text:
                cut.append([])
            elif "  " in text or text[0] == " " or text[-1] == " ":
                cut.append(_RUN.findall(f" {text}"))
            else:
                cut.append(text.split(" "))  # the usual case: single spaces, left off
        fresh = list({p for parts in cut for p in parts} - known.keys())
        if len(known) + len(fresh) > _REMEMBERED:
            known.clear()
            known[" "] = 1
            fresh = list({p for parts in cut for p in parts} - known.keys())
        # encoding puts one space before a text: a run hands its own first space over to that
        known.update(zip(fresh, whole([p[1:] if p[0] == " " else p for p in fresh])))
        return [sum(map(known.__getitem__, parts)) for parts in cut]

    return count


def runs_are_separate(m, path: str) -> bool:
    """Whether counts of a text are the sums over its runs of spaces and what follows each."""
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        spec.ParseFromString(f.read())
    n = spec.normalizer_spec
    plain = n.name == "identity" and not n.precompiled_charsmap and n.add_dummy_prefix and not n.remove_extra_whitespaces
    kinds = {p.type for p in spec.pieces} <= {1, 2, 3, 6}  # normal, unknown, control, byte: no user-defined pieces
    return plain and kinds and spec.trainer_spec.model_type == 2 and spec.trainer_spec.byte_fallback and not any("▁" in p.piece.lstrip("▁") for p in spec.pieces)


def _encode(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            n = count(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["content", "n_tokens"])

    return encode


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


_CACHE = "content binary, n_tokens long, tokenizer string"


def cached(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(content, n_tokens) that the cache has for a tokenizer, one row per digest."""
    if not _exists(spark, cache):
        return spark.createDataFrame([], "content binary, n_tokens long")
    rows = spark.read.schema(_CACHE).parquet(cache).filter(F.col("tokenizer") == version)
    return rows.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    ``tokenizer``: a .json or .model file that every executor has; ``cache``: a folder
    shared by all, by default one of this call.  Null and empty texts have no bytes and
    no tokens; repeated rows get equal counts; an empty table gives an empty one.
    A text is encoded if the cache has no count of it; a second call with the same
    cache encodes nothing.  A task that is run again appends equal counts, which the
    reader merges.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    cache = cache or f"{scratch.root}/cache"
    version = tokenizer_version(tokenizer)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("id"), F.unhex(F.sha2(body, 256)).alias("content"), body.alias("text"))
    keys = scratch.save(rows.select("doc_id", "id", "content", F.octet_length("text").cast("long").alias("n_bytes")), "keys")
    have = cached(spark, cache, version)
    first = keys.join(have, "content", "left_anti").groupBy("content").agg(F.min("id").alias("id"))
    first = scratch.save(first, "misses")
    # the texts to encode: found by leaving out the others if those are few, else by a shuffle
    others = scratch.save(keys.join(first, ["content", "id"], "left_anti").select("content", "id").distinct(), "others")
    if within(others):
        texts = rows.join(F.broadcast(others), ["content", "id"], "left_anti")
    else:
        texts = rows.join(small(first), ["content", "id"], "left_semi")
    counted = texts.select("content", "text").mapInArrow(_encode(tokenizer), "content binary, n_tokens long")
    counted.withColumn("tokenizer", F.lit(version)).write.mode("append").parquet(cache)
    scratch.drop("misses", "others")
    return keys.join(cached(spark, cache, version), "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts through the cache folder that the session names in ``spark.litmine.tokenCache``, or one of this call."""
    import public_tokenizers

    cache = spark.conf.get("spark.litmine.tokenCache", None)
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), cache)
