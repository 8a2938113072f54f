"""Fuzzy line deduplication: MinHash over character shingles, banding, exact check, components.

Lines are compared in normal form (A-Z lower-cased, runs of white space as one space,
none at the ends).  A line's shingles are its windows of SHINGLE characters; a shorter
line is one shingle.  Equal lines are one node, named by 64 bits of their digest.  Nodes
that agree in a band of ROWS min-hashes are candidates (a pair at 0.75 is missed by all
BANDS bands with a chance of 1 %, one at 0.85 with less than 1 in 5,000); a pair is
linked if the Jaccard similarity of its full shingle sets, hashed to 44 bits, is 0.75 or
more.  Of each
connected component the first line, by document and line number, stays.

Texts are read twice: once for digests and bands, and once for the few lines that share
a band with another line.  (Should two different lines have one name, by chance in
n * n / 2^65 for n lines, only one of them takes part in fuzzy links.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmine.llm.common import Scratch, small, table
from litmine.llm.near_dups import SIMILAR, linked, mix

SHINGLE = 8  # a power of two
BANDS, ROWS = 12, 4
#: Equal min-hashes of BANDS * ROWS that a pair has at least before its sets are compared: at 0.75
#: it has 36 of 48 on average, and fewer than 24 with a chance of 1 in 10,000.
MATCHES = 24
#: All pairs of a band's nodes are compared up to so many nodes; see ``near_dups`` for longer lists.
SMALL_LIST = 32
#: Characters that are hashed at a time, so that their hashes stay in the processor's cache.
_CHUNK = 1 << 15

_ODD = np.random.default_rng(77).integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
#: A-Z lower-cased, ASCII white space but the line break as a space.
_PLAIN = bytes(32 if b in (9, 11, 12, 13) else b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(lines: list[str], kind: type = np.uint32) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes, of 32 or 64 bits, of non-empty lines, one after the other, and where each line starts."""
    size = np.array([len(x) for x in lines])
    fill = "\x00" * (SHINGLE - 1)
    acc = np.frombuffer((fill.join(lines) + fill).encode("utf-32-le"), np.uint32).astype(kind) + kind(1)
    # windows of 1, 2, 4 and so on characters, each from two of half the size
    bits = 8 * acc.itemsize
    width, factor = 1, 0x9E3779B97F4A7C15 >> (64 - bits) | 1
    while width < SHINGLE:
        acc = acc[:-width] * kind(factor) + acc[width:]
        width, factor = 2 * width, factor * factor % (1 << bits)
    if bits == 64:
        acc = mix(acc)
    else:
        for shift, times in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            acc ^= acc >> np.uint32(shift)
            acc *= np.uint32(times)
        acc ^= acc >> np.uint32(16)
    # full windows only, and the first, filled up, of a line that is shorter
    count = np.maximum(size - SHINGLE + 1, 1)
    starts = np.cumsum(size + SHINGLE - 1) - (size + SHINGLE - 1)
    own = np.arange(count.sum()) + np.repeat(starts - (np.cumsum(count) - count), count)
    return acc[own], np.cumsum(count) - count


def signatures(lines: list[str]) -> np.ndarray:
    """(BANDS * ROWS, lines) min-hashes of non-empty lines."""
    out, lo = np.empty((BANDS * ROWS, len(lines)), np.uint32), 0
    while lo < len(lines):
        hi, size = lo, 0
        while hi < len(lines) and (hi == lo or size + len(lines[hi]) <= _CHUNK):
            size += len(lines[hi])
            hi += 1
        x, starts = shingle_hashes(lines[lo:hi])
        turned = np.empty_like(x)
        for r, odd in enumerate(_ODD):
            out[r, lo:hi] = np.minimum.reduceat(np.multiply(x, odd, out=turned), starts)
        lo = hi
    return out


def band_keys(lines: list[str]) -> np.ndarray:
    """(lines, BANDS) keys of non-empty lines."""
    low = signatures(lines).reshape(BANDS, ROWS, len(lines))
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None], (BANDS, len(lines)))
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + low[:, r])
    return np.ascontiguousarray(key.T)


def normal_lines(text: bytes) -> list[tuple[int, bytes]]:
    """Number and normal form of the lines that have a word."""
    text = text.translate(_PLAIN)
    if b"  " in text:
        return [(k, b" ".join(words)) for k, line in enumerate(text.split(b"\n")) if (words := line.split(b" ")) and (words := [w for w in words if w])]
    return [(k, line) for k, raw in enumerate(text.split(b"\n")) if (line := raw.strip(b" "))]


_LINES = "doc_id long, line_no int, h1 long, h2 long, bands array<long>"


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of documents with the 128-bit digest of their normal form; bands where a digest comes first in its batch."""
    for batch in batches:
        seen: set[bytes] = set()
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            docs, numbers, norms = [], [], []
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary())):
                found = normal_lines(text.as_py())
                docs += [doc] * len(found)
                numbers += [k for k, _ in found]
                norms += [n for _, n in found]
            if not docs:
                continue
            digests = list(map(xxhash.xxh3_128_digest, norms))
            fresh = []
            for d in digests:
                fresh.append(d not in seen)
                seen.add(d)
            digest = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            keys = band_keys([n.decode() for n, new in zip(norms, fresh) if new])
            ends = np.concatenate(([0], np.cumsum(fresh, dtype=np.int32))) * BANDS
            bands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.ravel().view(np.int64)))
            columns = [pa.array(docs, pa.int64()), pa.array(numbers, pa.int32()), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), bands]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "line_no", "h1", "h2", "bands"])


def shingle_set(line: str) -> set[str]:
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def _picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Normal forms of the lines that are asked for, with their min-hashes: texts with their line numbers and digests."""
    for batch in batches:
        ids, seconds, norms = [], [], []
        for text, numbers, ones, twos in zip(*(batch.column(k) for k in range(4))):
            lines = dict(normal_lines(text.cast(pa.binary()).as_py()))
            for k, h1, h2 in zip(numbers.as_py(), ones.as_py(), twos.as_py()):
                norm = lines.get(k, b"")
                # rows of other texts may share the doc_id
                if xxhash.xxh3_128_digest(norm) == h1.to_bytes(8, "little", signed=True) + h2.to_bytes(8, "little", signed=True):
                    ids.append(h1)
                    seconds.append(h2)
                    norms.append(norm.decode())
        if ids:
            low = np.ascontiguousarray((signatures(norms) >> np.uint32(16)).astype(np.uint16).T)
            columns = [pa.array(ids, pa.int64()), pa.array(seconds, pa.int64()), pa.array([x.tobytes() for x in low], pa.binary()), pa.array(norms, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "h2", "sig", "norm"])


#: Bits of a shingle's hash when sets are compared, below those that number the sets or pairs.
_BITS = np.uint64(44)
#: Characters of lines whose sets are compared at a time.
_COMPARED = 1 << 21


def _owned(count: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Sorted keys of hashes that belong to 0, 1, 2 and so on, ``count`` of them each."""
    return np.sort(np.repeat(np.arange(len(count), dtype=np.uint64) << _BITS, count) | hashes)


def similar(x: list[str], y: list[str]) -> np.ndarray:
    """Whether the shingle sets of each pair of lines are similar enough."""
    number: dict[str, int] = {}
    a, b = (np.array([number.setdefault(t, len(number)) for t in side]) for side in (x, y))
    h, starts = shingle_hashes(list(number), np.uint64)
    keys = _owned(np.diff(np.append(starts, len(h))), h >> (np.uint64(64) - _BITS))
    keys = keys[np.append(True, keys[1:] != keys[:-1])]
    ends = np.searchsorted(keys, np.arange(len(number) + 1, dtype=np.uint64) << _BITS)
    n, sets = np.diff(ends), keys & ((np.uint64(1) << _BITS) - np.uint64(1))

    def of_pairs(ids: np.ndarray) -> np.ndarray:
        count = n[ids]
        at = np.arange(count.sum()) + np.repeat(ends[ids] - (np.cumsum(count) - count), count)
        return np.repeat(np.arange(len(ids), dtype=np.uint64) << _BITS, count) | sets[at]

    met = np.sort(np.concatenate([of_pairs(a), of_pairs(b)]))  # what both sets of a pair have stands twice
    both = np.bincount((met[1:][met[1:] == met[:-1]] >> _BITS).astype(np.int64), minlength=len(a))
    return SIMILAR[1] * both >= SIMILAR[0] * (n[a] + n[b] - both)


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs of lines (a, b, sa, sb, x, y) whose full shingle sets are similar enough."""
    for batch in batches:
        low = [np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for k in (2, 3)]
        near = batch.filter(pa.array((low[0] == low[1]).sum(axis=1) >= MATCHES, pa.bool_()))
        x, y = near.column(4).to_pylist(), near.column(5).to_pylist()
        part = np.cumsum([len(p) + len(q) for p, q in zip(x, y)]) // _COMPARED
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(x)] if len(x) else []
        keep = [similar(x[lo:hi], y[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]
        yield near.select(["a", "b"]).filter(pa.array(np.concatenate(keep) if keep else [], pa.bool_()))


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [[xxhash.xxh3_64_intdigest(s) - (1 << 63) for s in shingle_set(x)] for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "tokens"])


def repeated_lines(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, line_no) of every line of documents (doc_id, text) that repeats an earlier one.

    Documents have an id and a text; rows that share an id are one document, so a line of
    one of them is the same place as that of the others.  An empty table gives an empty one.
    """
    lines = scratch.save(docs.mapInArrow(_lines, _LINES), "lines")
    banded = lines.select(F.explode("bands").alias("token"), F.col("h1").alias("id"))
    # tokens of several lines; a line that stands in many documents is posted by each batch of them
    shared = banded.groupBy("token").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("token")
    shared = scratch.save(shared, "shared")
    posted = scratch.save(banded.join(small(shared), "token").distinct().withColumn("typical", F.lit(0)), "posted")
    scratch.drop("shared")
    ids = scratch.save(posted.select("id").distinct(), "ids")
    at = lines.filter(F.size("bands") > 0).join(small(ids), F.col("h1") == F.col("id")).groupBy("h1").agg(F.min(F.struct("h2", "doc_id", "line_no")).alias("first"))
    at = at.groupBy("first.doc_id").agg(F.collect_list(F.struct("first.line_no", "h1", "first.h2")).alias("at"))  # lines of one document
    at = scratch.save(at.select(F.col("doc_id").alias("of"), "at"), "at")
    texts = docs.join(small(at), F.col("doc_id") == F.col("of")).select("text", "at.line_no", "at.h1", "at.h2")
    texts = scratch.save(texts.mapInArrow(_picked, "id long, h2 long, sig binary, norm string").dropDuplicates(["id"]), "texts")
    scratch.drop("at", "ids")

    turns = iter(range(9))

    def confirm(pairs: DataFrame) -> DataFrame:
        pairs = scratch.save(pairs, f"pairs-{next(turns)}")
        of = texts.select("id", "sig", "norm")
        full = pairs.join(of.toDF("a", "sa", "x"), "a").join(of.toDF("b", "sb", "y"), "b")
        return full.select("a", "b", "sa", "sb", "x", "y").mapInArrow(_similar, "a long, b long")

    def tokens_of(ids: DataFrame) -> DataFrame:
        sets = texts.join(small(ids), "id", "left_semi").select("id", "norm").mapInArrow(_tokens, "id long, tokens array<long>")
        need = F.ceil(F.size("tokens") * SIMILAR[0] / SIMILAR[1])
        return sets.select("id", F.size("tokens").alias("size"), need.alias("need"), F.explode("tokens").alias("token"))

    label = linked(posted, confirm, tokens_of, scratch, SMALL_LIST)
    label = scratch.save(label.join(texts.select("id", "h2"), "id").select(F.col("id").alias("l1"), F.col("h2").alias("l2"), "component"), "groups")
    scratch.drop("posted", "texts", "label-0", "label-2", "pairs-0", "pairs-1", "pairs-2")
    # a line's group: its component, or all lines equal to it
    placed = lines.select("doc_id", "line_no", "h1", "h2").join(small(label), F.expr("h1 = l1 AND h2 = l2"), "left")
    placed = placed.select("doc_id", "line_no", F.coalesce("component", "h1").alias("g1"), F.when(F.col("component").isNull(), F.col("h2")).otherwise(F.lit(0)).alias("g2"))
    groups = placed.groupBy("g1", "g2").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")).filter("n > 1").drop("n")
    groups = scratch.save(groups.toDF("of1", "of2", "first_doc"), "repeated")
    members = scratch.save(placed.join(small(groups), F.expr("g1 = of1 AND g2 = of2")).select("doc_id", "line_no", "g1", "g2", "first_doc"), "members")
    first = members.filter("doc_id = first_doc").groupBy("g1", "g2").agg(F.min("line_no").alias("first_line"))
    gone = members.join(small(first.toDF("of1", "of2", "first_line")), F.expr("g1 = of1 AND g2 = of2")).filter("doc_id <> first_doc OR line_no <> first_line")
    gone = scratch.save(gone.select("doc_id", "line_no"), "gone")
    scratch.drop("lines", "groups", "repeated", "members")
    return gone


def dropped_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, dropped): line numbers, from 0, to drop, for each document that has some."""
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    found = repeated_lines(plain, Scratch(docs.sparkSession, "lines"))
    return found.groupBy("doc_id").agg(F.array_sort(F.collect_set("line_no")).alias("dropped"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``; all columns and rows stay.

    Lines without a word stay where they are.  Rows without a doc_id or a text are left
    as they are and are no reason to drop lines elsewhere.  Rows that share a doc_id
    are one document: the line that stays does so in each of them.  An empty table
    gives an empty one.  Columns of ``docs`` may have any names.
    """
    gone = dropped_lines(docs, doc_id, text).select(F.col("doc_id").alias("id"), F.col("dropped").alias("gone"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    old = F.col("row").getField(text)
    rest = F.array_join(F.filter(F.split(old, "\n"), lambda line, i: ~F.array_contains("gone", i)), "\n")
    out = rows.join(small(gone), F.col("row").getField(doc_id).cast("long") == F.col("id"), "left").withColumn("new", F.when(F.col("gone").isNull(), old).otherwise(rest))
    return out.select(*[F.col("new").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n_lines (with a word), n_dropped and the dropped line numbers."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    worded = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long")
    gone = dropped_lines(docs)
    return (
        docs.select("doc_id", worded.alias("n_lines"))
        .join(gone, "doc_id", "left")
        .select("doc_id", "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce(F.array_join("dropped", ","), F.lit("")).alias("dropped"))
    )
