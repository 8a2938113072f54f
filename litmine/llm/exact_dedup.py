"""Exact deduplication by polynomial fingerprints that compose.

The fingerprint of a text's UTF-8 bytes b is the pair of sums b[j] * B^j modulo the
prime P, for two bases B.  A chunk at offset o hashed alone counts with B^o: chunks of
one text may be hashed anywhere, in any order, and are added up.  Texts with equal
fingerprints and lengths are then compared byte by byte, chunk by chunk, in a sorted
stream that holds one text of each kind; a large group is dealt out to about as many
streams as each of them has rows, and one text of each stream goes to a second one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litmine.llm.common import Scratch, small, table

PRIME = (1 << 31) - 1
BASES = (1_000_003, 754_974_721)
#: Bytes of a chunk: longer texts are cut, and their chunks dealt out.  Products of bytes and
#: powers add up below 2^63 for this many.
CHUNK = 1 << 16
#: Groups of more members are compared in several streams.
STREAM = 256
#: White space that isn't one blank already; what the pattern [\x20\x09-\x0D]+ would replace by itself is left out.
_SPACE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
#: A group of texts with one fingerprint, and its stream.
_STREAM = ["fp", "n_bytes", "stream"]


def normalised(text: Column) -> Column:
    """The text with runs of ASCII white space as one blank; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _SPACE, " ")


@lru_cache(maxsize=8)
def _powers(base: int, prime: int, n: int) -> np.ndarray:
    out = np.ones(n, np.int64)
    for k in range(1, n):
        out[k] = out[k - 1] * base % prime
    return out


def chunk_hash(data: bytes, base: int, prime: int = PRIME) -> int:
    """Fingerprint of a chunk of at most ``CHUNK`` bytes by itself."""
    return int(np.frombuffer(data, np.uint8) @ _powers(base, prime, CHUNK)[: len(data)]) % prime


def combine(left: int, n_left: int, right: int, base: int, prime: int = PRIME) -> int:
    """Fingerprint of two stretches put together: the right one's is shifted by the left one's length."""
    return (left + right * pow(base, n_left, prime)) % prime


def _hashed(prime: int):
    """Arrow batches (…, body, offset): offset and body become f0 and f1, shifted to the offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, offsets = batch.column("body"), batch.column("offset").to_pylist()
            views = [(v.as_py(), o) for v, o in zip(bodies, offsets)]
            sums = [pa.array([combine(0, o, chunk_hash(v, base, prime), base, prime) for v, o in views], pa.int64()) for base in BASES]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("id", "sha", "n_bytes")), *sums], ["id", "sha", "n_bytes", "f0", "f1"])

    return run


def fingerprints(rows: DataFrame, prime: int = PRIME) -> DataFrame:
    """(id, sha, n_bytes, fp) of rows (id, sha, body): a row each.

    ``body``: binary, of any length; ``sha``: its digest, which with the id names a row
    whose chunks have been dealt out.  Rows equal in both have equal texts: their chunks
    are added up together, and the sum is divided by their number.
    """
    kind = f"id {rows.schema['id'].dataType.simpleString()}, sha binary, n_bytes long, f0 long, f1 long"
    rows = rows.withColumn("n_bytes", F.octet_length("body").cast("long"))
    short = rows.filter(F.col("n_bytes") <= CHUNK).withColumn("offset", F.lit(0).cast("long")).mapInArrow(_hashed(prime), kind)
    cut = rows.filter(F.col("n_bytes") > CHUNK).withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_bytes") - 1) / CHUNK).cast("int"))))
    offset = F.col("k").cast("long") * CHUNK
    cut = cut.select("id", "sha", "n_bytes", F.substring("body", F.col("k") * CHUNK + 1, F.lit(CHUNK)).alias("body"), offset.alias("offset"))
    parts = cut.repartition("id", "sha", "offset").withColumn("first", F.col("offset") == 0)
    # the chunk at offset 0 is there once for each equal row
    hashed = parts.select("id", "sha", "n_bytes", "body", "offset").mapInArrow(_hashed_parts(prime), kind + ", first int")
    whole = hashed.groupBy("id", "sha", "n_bytes").agg(F.sum("f0").alias("f0"), F.sum("f1").alias("f1"), F.sum("first").alias("n"))
    whole = whole.withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int"))))
    mod = lambda c: F.expr(f"({c} div n) % {prime}")
    whole = whole.select("id", "sha", "n_bytes", mod("f0").alias("f0"), mod("f1").alias("f1"))
    return short.unionByName(whole).select("id", "sha", "n_bytes", (F.col("f0") * (1 << 31) + F.col("f1")).alias("fp"))


def _hashed_parts(prime: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (out,) = _hashed(prime)([batch])
            first = pa.array([int(o == 0) for o in batch.column("offset").to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*out.columns, first], [*out.schema.names, "first"])

    return run


def same(a: memoryview, b: memoryview) -> bool:
    """Whether two texts of equal length are equal, chunk by chunk up to the first difference."""
    return all(a[k : k + CHUNK] == b[k : k + CHUNK] for k in range(0, len(a), CHUNK))


def _compared(keys: list[str], carry: list[str]):
    """Sorted batches (keys…, carry…, body): ``kind`` numbers the different texts of equal keys, ``first`` is true for
    the first row of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kinds = None, []
        for batch in batches:
            at, first = [], []
            for key, body in zip(zip(*(batch.column(k).to_pylist() for k in keys)), batch.column("body")):
                text = memoryview(body.as_buffer()).cast("B")
                if key != now:
                    now, kinds = key, []
                k = next((k for k, known in enumerate(kinds) if same(memoryview(known), text)), None)
                first.append(k is None)
                if k is None:
                    k = len(kinds)
                    kinds.append(bytes(text))
                at.append(k)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in [*keys, *carry]), pa.array(at, pa.int32()), pa.array(first), batch.column("body")], [*keys, *carry, "kind", "first", "body"])

    return run


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", prime: int = PRIME, stream_rows: int = STREAM) -> DataFrame:
    """One row per row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are so after each run of ASCII white space has become one
    blank; null counts as empty, so nulls and empty texts are one group, and texts of
    blanks alone another.  Of equal texts the row with the smallest doc_id stays; rows
    without a doc_id come after all others, and of rows equal in doc_id and text one
    stays.  Other columns are not looked at; an empty table gives an empty one.  Texts
    of equal fingerprints that differ are kept apart (``prime`` may be tiny in tests).  Groups of more than ``stream_rows``
    members are compared in several streams.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    body = normalised(F.col(text))
    rows = docs.select(F.col(doc_id).alias("id"), body.alias("norm")).select("id", F.unhex(F.sha2("norm", 256)).alias("sha"), F.col("norm").cast("binary").alias("body"))
    prints = scratch.save(fingerprints(rows, prime), "prints")
    groups = scratch.save(prints.groupBy("fp", "n_bytes").agg(F.count("*").alias("n")).filter("n > 1"), "groups")
    met = prints.join(small(groups), ["fp", "n_bytes"], "left")
    alone = met.filter("n IS NULL").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")

    # members with their texts, dealt to streams by id
    streams = F.when(F.col("n") > stream_rows, F.ceil(F.sqrt("n"))).otherwise(1)
    stream = F.pmod(F.xxhash64("id"), streams).cast("int")
    members = scratch.save(met.filter("n IS NOT NULL").select("id", "sha", "fp", "n_bytes", "n", stream.alias("stream")).distinct(), "members")
    named = small(members.withColumnsRenamed({"id": "m_id", "sha": "m_sha"}))
    texts = rows.join(named, F.col("id").eqNullSafe(F.col("m_id")) & (F.col("sha") == F.col("m_sha"))).select(*_STREAM, "n", "id", "sha", "body")
    order = [*_STREAM, F.col("id").asc_nulls_last()]
    dealt = texts.repartition(*_STREAM).sortWithinPartitions(*order).select(*_STREAM, "n", "id", "sha", "body")
    id_kind = rows.schema["id"].dataType.simpleString()
    seen = dealt.mapInArrow(_compared(_STREAM, ["n", "id", "sha"]), f"fp long, n_bytes long, stream int, n long, id {id_kind}, sha binary, kind int, first boolean, body binary")
    seen = scratch.save(seen.withColumn("body", F.when(F.col("first") & (F.col("n") > stream_rows), F.col("body"))), "seen")
    scratch.drop("members")

    # one text of each kind of each stream meets those of the group's other streams
    local = seen.groupBy(*_STREAM, "kind").agg(F.min("id").alias("least"), F.count("*").alias("size"))
    heads = seen.filter("body IS NOT NULL").select("fp", "n_bytes", "stream", F.col("kind").alias("local"), "body")
    heads = heads.repartition("fp", "n_bytes").sortWithinPartitions("fp", "n_bytes", "stream", "local")
    merged = heads.mapInArrow(_compared(["fp", "n_bytes"], ["stream", "local"]), "fp long, n_bytes long, stream int, local int, kind int, first boolean, body binary")
    merged = merged.select("fp", "n_bytes", "stream", F.col("local").alias("kind"), F.col("kind").alias("all"))
    local = local.join(merged, [*_STREAM, "kind"], "left").withColumn("all", F.coalesce("all", "kind"))
    group = Window.partitionBy("fp", "n_bytes", "all")  # a row per stream, not per document
    local = local.select(*_STREAM, "kind", F.min("least").over(group).alias("keep_id"), F.sum("size").over(group).alias("group_size"), F.col("least").eqNullSafe(F.min("least").over(group)).alias("leads"))
    local = scratch.save(local, "local")
    found = seen.drop("body").join(small(local), [*_STREAM, "kind"])
    found = found.select("id", "keep_id", "group_size", (F.col("first") & F.col("leads")).alias("kept"), "sha")
    return alone.unionByName(found).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text an earlier doc_id has; rows that share a kept doc_id and its text all stay."""
    gone = exact_groups(docs, doc_id, text).filter("NOT kept AND NOT (doc_id <=> keep_id)").select(F.col("doc_id").alias("_gone"), F.col("text_sha256").alias("_sha")).distinct()
    hit = F.col(f"`{doc_id}`").eqNullSafe(F.col("_gone")) & (F.sha2(normalised(F.col(f"`{text}`")), 256) == F.col("_sha"))
    return docs.join(small(gone), hit, "left_anti")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
