"""Document structure: sections, parent and child chunks, offsets, pages."""

from __future__ import annotations

import hashlib
import itertools
import re
import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litmine.functions.scalars import dot, l2_normalize, title_case
from litmine.operators.slices import map_in_slices
from litmine.operators.titles import best_in_blocks, better_guesses, first_guesses, frequencies, grams

PARENT, CHILD, KB_CHILD = (2500, 300), (250, 50), (900, 120)
MIN_CHUNK = 50
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
#: Names that head a section when they fill a line, whatever their case.
SECTION_NAMES = (
    "Abstract", "Summary",
    "Introduction", "Background", "Literature Review", "Related Work",
    "Methods", "Methodology", "Materials and Methods", "Experimental", "Experimental Setup", "Procedure", "Protocol",
    "Results", "Findings",
    "Discussion",
    "Conclusion", "Conclusions",
    "Acknowledgment", "Acknowledgments", "Acknowledgement", "Acknowledgements",
    "References", "Bibliography", "Literature Cited",
    "Supplementary", "Supplementary Material", "Supplementary Information", "Appendix", "Appendixes",
    "Declaration", "Declarations", "Funding", "Author Contributions", "Ethics Statement", "Data Availability", "Conflict of Interest", "Conflicts of Interest",
)
_KNOWN = f"(?i)^(?:{'|'.join(SECTION_NAMES)})$"
#: Fixed value: lines with these are no headers.
_NOT_A_HEADER = r"Page [0-9]+ of|[0-9]{5,}|@|et al\."


def _header(lines: Column):
    """For a line's index: STRUCT<at, level, title> if it is a header, else null."""

    def at(i: Column) -> Column:
        s = F.get(lines, i)
        n = F.length(s)
        known = s.rlike(_KNOWN)
        after = F.filter(F.array(*[F.coalesce(F.get(lines, i + k), F.lit("")) for k in (1, 2, 3)]), lambda x: x != "")
        following = F.coalesce(F.get(after, F.lit(0)), F.lit(""))
        words = F.size(F.split(s, r"\s+"))
        generic = (n < 45) & words.between(2, 5) & ~s.rlike(r"[.:]$") & s.rlike(r"^\p{Lu}") & ~s.rlike(_NOT_A_HEADER) & (F.length(following) > 40) & ~following.startswith("#")
        level = (
            F.when(s.rlike(r"^#{1,4}\s+.+$"), F.length(F.regexp_extract(s, "^(#{1,4})", 1)))
            .when(s.rlike(r"^[0-9]+\.?\s+[A-Z]"), 1)
            .when(s.rlike(r"^[A-Z][A-Z0-9&\s\-.]{2,}$") & (n < 60) & known, 1)
            .when((n > 0) & (n < 50) & known, 1)
            .when((n > 0) & generic, 2)
        )
        title = (
            F.when(s.rlike(r"^#{1,4}\s+.+$"), F.trim(F.regexp_extract(s, r"^#{1,4}\s+(.+)$", 1)))
            .when(s.rlike(r"^[A-Z][A-Z0-9&\s\-.]{2,}$") & (n < 60) & known, title_case(s))
            .otherwise(s)
        )
        return F.when(level.isNotNull(), F.struct(i.alias("at"), level.alias("level"), title.alias("title")))

    return at


def with_sections(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` plus ``sections``, ARRAY<STRUCT<title, level, content>> of a text by its header lines.

    Text before the first header is the section "Start"; headers without lines below are
    left out.  One row at a time, without a shuffle.
    """
    names = rows.columns
    rows = rows.withColumn("_lines", F.split(F.coalesce(F.col(text), F.lit("")), "\n"))
    rows = rows.withColumn("_bare", F.transform("_lines", lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")))
    found = F.filter(F.transform(F.sequence(F.lit(0), F.size("_lines") - 1), _header(F.col("_bare"))), lambda h: h.isNotNull())
    rows = rows.withColumn("_heads", F.concat(F.array(F.struct(F.lit(-1).alias("at"), F.lit(0).alias("level"), F.lit("Start").alias("title"))), found))

    def section(h: Column, k: Column) -> Column:
        end = F.coalesce(F.get(F.col("_heads"), k + 1)["at"], F.size("_lines"))
        return F.struct(h["title"].alias("title"), h["level"].alias("level"), F.slice(F.col("_lines"), h["at"] + 2, end - h["at"] - 1).alias("body"))

    full = F.filter(F.transform("_heads", section), lambda s: F.size(s["body"]) > 0)
    joined = F.transform(full, lambda s: F.struct(s["title"].alias("title"), s["level"].alias("level"), F.array_join(s["body"], "\n").alias("content")))
    return rows.select(*names, joined.alias("sections"))


def detect_sections(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ord, title, level, content): a row per section; see ``with_sections``.

    The outer explode keeps the optimizer from inferring ``size(sections) > 0``, which it
    would push below the projections with all their arrays written out in each lambda.
    """
    rows = with_sections(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    return rows.select("doc_id", F.posexplode_outer("sections").alias("ord", "s")).filter("s IS NOT NULL").select("doc_id", "ord", "s.*")


# --- splitting ---------------------------------------------------------------------


def split_recursive(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the coarsest separator that does it.

    Neighbouring parts are packed while they fit; a piece starts with up to ``overlap``
    characters of whole parts of the one before.
    """
    if len(text) <= size:
        return [text.strip()] if text.strip() else []
    rank = next(k for k, s in enumerate(separators) if not s or s in text)
    sep = separators[rank]
    parts = list(text) if not sep else [p + sep for p in text.split(sep)[:-1]] + [text.split(sep)[-1]]
    out: list[str] = []
    held: list[str] = []
    length = 0

    def flush() -> None:
        piece = "".join(held).strip()
        if piece:
            out.append(piece)

    for part in parts:
        if len(part) > size:
            flush()
            held, length = [], 0
            out += split_recursive(part, size, overlap, separators[rank + 1 :])
            continue
        if length + len(part) > size:
            flush()
            while held and (length > overlap or length + len(part) > size):
                length -= len(held.pop(0))
        held.append(part)
        length += len(part)
    flush()
    return out


def split_column(size: int, overlap: int):
    """``split_recursive`` as a column function: string to array of strings."""

    def split(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: split_recursive(t or "", size, overlap))

    return F.pandas_udf(split, "array<string>")


def split_udtf(spark) -> None:
    """Registers ``split_text(text, size, overlap)`` as a SQL table function."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="ord int, chunk string")
    class SplitText:
        def eval(self, text: str, size: int, overlap: int):
            yield from enumerate(split_recursive(text or "", size, overlap))

    spark.udtf.register("split_text", SplitText)


def parent_id(source: Column, section: Column, body: Column, n: Column) -> Column:
    return F.concat(F.md5(F.concat_ws("::", source, section, F.substring(body, 1, 200))), F.lit("_p"), n.cast("string"))


KB_NAMESPACE = "a4f1b9d2-7e3a-4c8b-9f10-7c5d2e8a1b00"


def uuid5(name: Column, namespace: str = KB_NAMESPACE) -> Column:
    """RFC 4122 version 5 UUID of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(uuid.UUID(namespace).hex)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def locate(text: Column, body: Column) -> Column:
    """STRUCT<start, end>: where a body stands in a text, without the space around it; nulls if it doesn't."""
    bare = F.regexp_replace(body, r"^\s+|\s+$", "")
    at = F.instr(text, bare) - 1
    hit = (at >= 0) & (bare != "")
    return F.struct(F.when(hit, at).alias("start"), F.when(hit, at + F.length(bare)).alias("end"))


def parent_child_chunks(docs: DataFrame, parent: tuple[int, int] = PARENT, child: tuple[int, int] = CHILD) -> tuple[DataFrame, DataFrame]:
    """Parents and children of documents (doc_id, title, text), by section, in one pass over the texts.

    parents: doc_id, parent_id, section, n, body, start, end, page; children: doc_id,
    parent_id, chunk_id, ord, section, chunk (with its "Title > Section" header), body.
    Both read the documents; write ``chunk_corpus``'s rows first where both are needed.
    """
    rows = docs.select("doc_id", F.col("doc_id").cast("string").alias("source"), "title", "text")
    cut = chunk_corpus(rows, parent, child, distinct=False)
    parents = cut.select("doc_id", F.posexplode_outer("parents").alias("n", "p")).filter("p IS NOT NULL")
    children = cut.select("doc_id", F.posexplode_outer("chunks").alias("ord", "c")).filter("c IS NOT NULL")
    return parents.select("doc_id", "p.parent_id", "p.section", "n", "p.body", "p.start", "p.end", "p.page"), children.select("doc_id", "c.parent_id", "c.chunk_id", "ord", "c.section", "c.chunk", "c.body")


_WORDS = re.compile(r"\S+")


class Flat:
    """A text with its runs of space as single ones, made once, and where each of its characters stood."""

    def __init__(self, text: str):
        spans = [m.span() for m in _WORDS.finditer(text)]
        self.text = " ".join(text[a:b] for a, b in spans)
        self.starts, self.ends = [a for a, _ in spans], [b for _, b in spans]
        self.flat = list(itertools.accumulate((b - a + 1 for a, b in spans), initial=0))

    def _at(self, place: int) -> int:
        """First place in the flat text of what stands at ``place`` or after it, but for space."""
        k = bisect_right(self.ends, place)
        return self.flat[k] + max(0, place - self.starts[k]) if k < len(self.starts) else len(self.text)

    def find(self, words: list[str], cursor: int) -> int:
        """Start of the words, with any space between them, in the text from the cursor on; else -1."""
        at = self.text.find(" ".join(words), self._at(cursor))
        k = bisect_right(self.flat, at) - 1
        return self.starts[k] + at - self.flat[k] if at >= 0 else -1


def locate_fuzzy(text: str | Flat, chunk: str, cursor: int) -> int:
    """Start of a chunk in a text, with spaces collapsed, from the cursor on, then from 0; else -1.

    Looked for are the chunk, its first 200, 100, 80 and 50 characters if it is longer,
    and what it has before its first stop.
    """
    flat = text if isinstance(text, Flat) else Flat(text)
    stop = chunk.find(".")
    anchors = [chunk, *(chunk[:n] for n in (200, 100, 80, 50) if len(chunk) > n), *([chunk[:stop]] if stop > 20 else [])]
    for anchor in anchors:
        if words := anchor.split():
            for start in (cursor, 0):
                if (at := flat.find(words, start)) >= 0:
                    return at
    return -1


def locate_offsets_fuzzy(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, ord, start, end) of chunks (doc_id, ord, chunk); the cursor goes to the end of each chunk that is found."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for doc, text, found in rows.itertuples(index=False, name=None):
                cursor, flat = 0, Flat(text or "")
                for item in found:
                    at = locate_fuzzy(flat, item["chunk"] or "", cursor)
                    end = at + len(item["chunk"] or "") if at >= 0 else -1
                    cursor = end if at >= 0 else cursor
                    out.append((doc, item["ord"], at, end))
            yield pd.DataFrame(out, columns=["doc_id", "ord", "start", "end"])

    lists = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "chunk"))).alias("found"))  # chunks of one document
    return map_in_slices(docs.select("doc_id", "text").join(lists, "doc_id"), place, f"doc_id {kind}, ord int, start int, end int")


# --- whole documents -----------------------------------------------------------------

Splitter = Callable[[str, int, int], list[str]]
_PAGE = re.compile(r"<!-- Page (\d+) -->")
_PARENT = "struct<parent_id:string,section:string,body:string,start:int,end:int,page:int>"
_CHUNK = "struct<chunk_id:string,parent_id:string,section:string,chunk:string,body:string>"


def chunk_document(source: str, title: str, text: str, sections: list, parent: tuple[int, int], child: tuple[int, int], splitter: Splitter, distinct: bool = True) -> tuple[list[dict], list[dict]]:
    """Parents with their places, and chunks, equal ones once if ``distinct``, of one document."""
    pages = [(m.start(), int(m[1])) for m in _PAGE.finditer(text)]
    parents, chunks, seen = [], [], set()
    for s in sections:
        head = f"{title} > {s['title']}" if title else s["title"]
        for body in splitter(s["content"], *parent):
            at = text.find(body)
            name = hashlib.md5(f"{source}::{s['title']}::{body[:200]}".encode()).hexdigest()
            page = next((n for where, n in reversed(pages) if where <= at), None) if at >= 0 else None
            parents.append({"parent_id": f"{name}_p{len(parents)}", "section": s["title"], "body": body, "start": at if at >= 0 else None, "end": at + len(body) if at >= 0 else None, "page": page})
            for piece in splitter(body, *child):
                chunk = f"{head}\n\n{piece}"
                key = " ".join(chunk.lower().split()) if distinct else len(chunks)
                if key not in seen:
                    seen.add(key)
                    chunks.append({"chunk_id": f"{source}_{len(chunks)}", "parent_id": parents[-1]["parent_id"], "section": s["title"], "chunk": chunk, "body": piece})
    return parents, chunks


def chunk_corpus(docs: DataFrame, parent: tuple[int, int] = PARENT, child: tuple[int, int] = CHILD, splitter: Splitter = split_recursive, distinct: bool = True) -> DataFrame:
    """``docs`` (doc_id, source, title, text, …) without text, plus parents, chunks and error, a row per document.

    A document that fails, or has no text, has an error and no parents or chunks; the others are
    not touched by it.  Texts go through one pass, without a shuffle.  ``parents_of``,
    ``chunks_of`` and ``failures_of`` make rows of the result, which is best written first.
    """

    keep = [c for c in docs.columns if c != "text"]
    rows = with_sections(docs.select(*keep, "text"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            parents, chunks, errors = [], [], []
            for source, title, text, sections in zip(part["source"], part["title"], part["text"], part["sections"]):
                made: tuple = ([], [])
                error = None
                try:
                    if not text or not text.strip():
                        raise ValueError("no text")
                    made = chunk_document(source or "", title or "", text, list(sections), parent, child, splitter, distinct)
                except Exception as e:  # noqa: BLE001  whatever a splitter raises is this document's failure alone
                    error = str(e)[:300] or type(e).__name__
                parents.append(made[0])
                chunks.append(made[1])
                errors.append(error)
            yield part[keep].assign(parents=parents, chunks=chunks, error=errors)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields)
    return map_in_slices(rows, cut, f"{kept}, parents array<{_PARENT}>, chunks array<{_CHUNK}>, error string")


def parents_of(cut: DataFrame) -> DataFrame:
    return cut.select("doc_id", "source", F.inline("parents"))


def chunks_of(cut: DataFrame) -> DataFrame:
    """Chunks with their document's columns and total_chunks."""
    meta = [c for c in cut.columns if c not in ("parents", "chunks", "error")]
    return cut.select(*meta, F.size("chunks").alias("total_chunks"), F.inline("chunks"))


def failures_of(cut: DataFrame) -> DataFrame:
    return cut.filter("error IS NOT NULL").select("doc_id", "source", "error")


def kb_chunk_corpus(items: DataFrame, docs: DataFrame, child: tuple[int, int] = KB_CHILD) -> tuple[DataFrame, DataFrame]:
    """Parents and children of layout chunks (doc_id, ord, chunk, headings, labels, page) of documents (doc_id, text).

    Chunks of noise alone go; the section is the last heading; offsets are found with a
    moving cursor, -1 if not found; ids are version 5 UUIDs of the document and a number.
    parents: doc_id, parent_id, section, body, start, end, page; children: doc_id,
    child_id, parent_id, ord, section, page, chunk.
    """
    kept = drop_noise_items(items)
    at = locate_offsets_fuzzy(kept, docs)
    name = lambda kind, n: uuid5(F.concat_ws(":", F.col("doc_id").cast("string"), F.lit(kind), n.cast("string")))
    body = F.concat_ws("\n", F.coalesce("headings", F.array().cast("array<string>")), "chunk")
    section = F.coalesce(F.try_element_at("headings", F.lit(-1)), F.lit(""))
    parents = kept.join(at, ["doc_id", "ord"]).select("doc_id", "ord", name("parent", F.col("ord")).alias("parent_id"), section.alias("section"), body.alias("body"), "start", "end", "page")
    kids = parents.select("doc_id", "ord", "parent_id", "section", "page", F.posexplode(split_column(*child)("body")).alias("k", "chunk"))
    kids = kids.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "k")) - 1)
    children = kids.select("doc_id", name("child", F.col("n")).alias("child_id"), "parent_id", F.col("n").alias("ord"), "section", "page", "chunk")
    return parents.drop("ord"), children


def scope_to_page(text: Column, page: int) -> Column:
    """Text of page N between its marker and the next; the whole text without that marker."""
    there = F.contains(text, F.lit(f"<!-- Page {page} -->"))
    return F.when(there, F.trim(F.regexp_extract(text, rf"(?s)<!-- Page {page} -->(.*?)(?:<!-- Page [0-9]+ -->|$)", 1))).otherwise(text)


def dedupe_chunks(chunks: DataFrame) -> DataFrame:
    """The first (by ``ord``) of each document's chunks that are equal but for case and spaces; blanks go."""
    plain = F.regexp_replace(F.lower(F.trim("chunk")), r"\s+", " ")
    w = Window.partitionBy("doc_id", "_h").orderBy("ord")
    return chunks.filter(plain != "").withColumn("_h", F.md5(plain)).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_h", "_n")


def semantic_groups(sentences: DataFrame, shared: str, amount: float = 1.5, vectors: bool = True) -> DataFrame:
    """``sentences`` (doc_id, ord, sentence, embedding) plus distance to the sentence before and ``part``: a new
    one where it is above the document's mean by ``amount`` standard deviations.

    Sentences are cut into ranges of (doc_id, ord), so that a document with very many
    takes several tasks; vectors are shuffled that once, and a range is walked in its order. Its first
    sentence gets its distance afterwards, from the last vector of the range before, and a range the
    parts begun before it, one row each.  A sentence without a vector, and the one after it, has no
    distance and begins no part.  Two tables go to ``shared``, a folder that all executors share: first the
    sentences, which are read twice, to find the ranges and to cut them.  ``vectors``: the result has the embedding.
    """
    spark, ranges = sentences.sparkSession, f"{shared}/ranges"
    sentences.write.mode("overwrite").parquet(f"{shared}/sentences")
    cut = spark.read.parquet(f"{shared}/sentences").repartitionByRange("doc_id", "ord").sortWithinPartitions("doc_id", "ord")
    cut = cut.withColumn("_s", F.arrow_udf(_walked, "struct<distance:double,edge:int>")("doc_id", "embedding"))
    edge, kept = F.col("_s")["edge"], [c for c in sentences.columns if vectors or c != "embedding"]
    cut = cut.select(*kept, F.spark_partition_id().alias("_range"), F.col("_s")["distance"].alias("distance"), edge.alias("_edge"), F.when(edge > 0, F.col("embedding")).alias("_end"))
    cut.write.mode("overwrite").parquet(ranges)
    rows = spark.read.parquet(ranges)
    along, first = Window.partitionBy("doc_id").orderBy("_range"), F.col("_edge").bitwiseAND(F.lit(FIRST)) > 0
    ends = rows.filter("_edge > 0").select("doc_id", "_range", "_end", F.explode(F.when(F.col("_edge") == FIRST + LAST, F.array(F.lit(FIRST), F.lit(LAST))).otherwise(F.array("_edge"))).alias("_edge"))
    ends = ends.withColumn("_end", l2_normalize(F.col("_end"))).withColumn("_before", F.lag("_end").over(Window.partitionBy("doc_id").orderBy("_range", "_edge"))).filter(first)
    rows = _with_range(rows, ends.withColumn("_far", 1 - dot(F.col("_before"), F.col("_end"))), "_far")
    rows = rows.withColumn("distance", F.when(first, F.col("_far")).otherwise(F.col("distance"))).drop("_edge", "_end", "_far")
    of = rows.groupBy("doc_id").agg((F.avg("distance") + amount * F.coalesce(F.stddev_pop("distance"), F.lit(0.0))).alias("_limit"))
    limits = of.alias("of").join(rows.select("doc_id", "_range").distinct().alias("r"), F.expr("of.doc_id <=> r.doc_id")).select("r.doc_id", "_range", "_limit")
    rows = _with_range(rows, limits, "_limit", few=False).withColumn("_new", F.coalesce((F.col("distance") > F.col("_limit")).cast("int"), F.lit(0)))
    begun = rows.groupBy("doc_id", "_range").agg(F.sum("_new").alias("_n"))
    earlier = begun.withColumn("_earlier", F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1))).filter("_earlier > 0")
    here = Window.partitionBy("doc_id", "_range").orderBy("ord")
    return _with_range(rows, earlier, "_earlier").withColumn("part", F.sum("_new").over(here) + F.coalesce("_earlier", F.lit(0))).drop("_range", "_limit", "_new", "_earlier")


#: Places of a row in its range, added up if it has both.
FIRST, LAST = 1, 2


def _walked(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """STRUCT<distance, edge> of a task's rows (document, vector) in their order: the distance to the row before if
    that is of the document, and FIRST and LAST of the task."""
    held, before = None, None
    for docs, vectors in parts:
        if not len(docs):
            continue
        edge = np.zeros(len(docs), np.int32)
        if held is None:
            edge[0] = FIRST
        else:
            yield _steps(*held)
        mine = (docs, vectors) if before is None else (pa.concat_arrays([before[0], docs]), pa.concat_arrays([before[1], vectors]))
        far, known = _distances(*mine)
        held = (far, known, edge) if before is not None else (np.append(0.0, far), np.append(False, known), edge)
        at = pa.array([len(docs) - 1])
        before = docs.take(at), vectors.take(at)  # a copy: a slice would keep its batch
    if held is not None:
        held[2][-1] += LAST
        yield _steps(*held)


def _steps(far: np.ndarray, known: np.ndarray, edge: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(far, mask=~known), pa.array(edge)], ["distance", "edge"])


def _distances(docs: pa.Array, vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each row but the first its distance to the one before, and if it has one: not without two vectors of equal
    length, without nulls, of one document.  The steps are those of ``l2_normalize`` and ``dot``, sums in the same order."""
    a, b = docs.slice(0, len(docs) - 1), docs.slice(1)
    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(a.is_null(), b.is_null())).to_numpy(zero_copy_only=False)
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts, flat, row = np.append(0, np.cumsum(lengths)), vectors.flatten(), np.repeat(np.arange(len(lengths)), lengths)
    values = flat.to_numpy(zero_copy_only=False).astype(float)
    there = vectors.is_valid().to_numpy(zero_copy_only=False).copy()
    there[row[flat.is_null().to_numpy(zero_copy_only=False)]] = False
    norm = np.sqrt(np.bincount(row, values * values, len(lengths)))
    values /= np.where(norm > 0, norm, 1.0)[row]
    known = same & there[:-1] & there[1:] & (lengths[:-1] == lengths[1:])
    at = np.flatnonzero(known)
    n = lengths[at]
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    products = values[np.repeat(starts[at], n) + place] * values[np.repeat(starts[at + 1], n) + place]
    return 1 - np.bincount(np.repeat(at, n), products, len(known)), known


def _with_range(rows: DataFrame, of: DataFrame, column: str, few: bool = True) -> DataFrame:
    """``rows`` with a column of ``of``, by document and range; ``few``: no more rows than there are ranges."""
    there = of.select(F.col("doc_id").alias("_doc"), F.col("_range").alias("_r"), column)
    there = F.broadcast(there) if few else there
    return rows.join(there, F.expr("_range = _r AND doc_id <=> _doc"), "left").drop("_doc", "_r")


def semantic_split(sentences: DataFrame, shared: str, size: int = CHILD[0], overlap: int = CHILD[1]) -> DataFrame:
    """Chunks (doc_id, part, k, chunk) of semantic parts; short ones go, long ones are cut again."""
    parts = semantic_groups(sentences, shared, vectors=False).groupBy("doc_id", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "sentence"))), lambda x: x["sentence"]), " ").alias("text"))
    parts.filter(F.length("text") >= MIN_CHUNK).write.mode("overwrite").parquet(f"{shared}/parts")
    parts = sentences.sparkSession.read.parquet(f"{shared}/parts")  # made once for both kinds
    short = parts.filter(F.length("text") <= 2 * size).select("doc_id", "part", F.lit(0).alias("k"), F.col("text").alias("chunk"))
    long_ = parts.filter(F.length("text") > 2 * size).select("doc_id", "part", F.posexplode(split_column(size, overlap)("text")).alias("k", "chunk"))
    return short.unionByName(long_)


def attach_doc_metadata(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("doc_id"))
    words = F.size(F.filter(F.split("chunk", r"\s+"), lambda w: w != ""))
    return chunks.withColumn("total_chunks", n).withColumn("char_count", F.length("chunk")).withColumn("word_count", words).join(docs.drop("text"), "doc_id", "left")


def strip_to_body(text: Column, title: Column) -> Column:
    """A chunk without the headers on top: blanks, headings, the title, breadcrumbs."""
    lines = F.split(text, r"\r\n|\r|\n")
    name = F.trim(F.coalesce(title, F.lit("")))

    def is_body(line: Column) -> Column:
        s = F.regexp_replace(line, r"^\s+|\s+$", "")
        crumb = F.contains(s, F.lit(" > ")) & (F.length(s) < 200) & ~s.rlike(r"[.!?:]\s*$")
        named = (name != "") & ((s == name) | s.startswith(F.concat(name, F.lit(" >"))))
        return ~((s == "") | s.rlike(r"^#{1,6}\s+\S") | named | crumb)

    first = F.array_position(F.transform(lines, is_body), True)
    body = F.regexp_replace(F.array_join(F.slice(lines, first.cast("int"), F.size(lines)), "\n"), r"^\s+|\s+$", "")
    return F.when(F.coalesce(text, F.lit("")) == "", "").when((first > 0) & (body != ""), body).otherwise(F.regexp_replace(text, r"^\s+", ""))


def validate_offsets(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """``chunks`` (doc_id, chunk, start, end) plus status: ok, no-offset, out-of-bounds or mismatch, and the first difference."""
    j = chunks.join(docs.select("doc_id", "text"), "doc_id", "left")
    there = j["text"].substr(F.col("start") + 1, F.col("end") - F.col("start"))
    status = F.when(F.col("start").isNull() | F.col("end").isNull(), "no-offset").when((F.col("start") < 0) | (F.col("end") > F.length("text")) | (F.col("start") > F.col("end")), "out-of-bounds").when(there == F.col("chunk"), "ok").otherwise("mismatch")
    letters = F.split("chunk", "")  # compared letter by letter once; places in UTF-8 text are found by counting
    differ = F.zip_with(letters, F.slice(F.split(there, ""), F.lit(1), F.size(letters)), lambda x, y: ~F.coalesce(x, F.lit("")).eqNullSafe(F.coalesce(y, F.lit(""))))
    return j.withColumn("status", status).withColumn("first_diff", F.when(F.col("status") == "mismatch", F.nullif(F.array_position(differ, True), F.lit(0)) - 1)).drop("text")


def word_chunks(text: Column, n: int) -> Column:
    """The text as windows of n words, joined by single spaces."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.when(F.size(words) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / n).cast("int")), lambda i: F.array_join(F.slice(words, i * n + 1, n), " "))).otherwise(F.array().cast("array<string>"))


#: Kinds of layout items that carry no prose.
NOISE_ITEMS = ("reference", "page_header", "page_footer", "footnote")


def drop_noise_items(chunks: DataFrame) -> DataFrame:
    """Chunks but those whose every item (``labels``) is noise; chunks without items stay."""
    return chunks.filter((F.size("labels") <= 0) | ~F.forall("labels", lambda x: x.isin(*NOISE_ITEMS)))


def extract_title(items: DataFrame) -> DataFrame:
    """(doc_id, title) of layout items (doc_id, ord, label, text, stem): the first title, else section header, else the stem."""
    rank = F.when(F.col("label") == "title", 0).when(F.col("label") == "section_header", 1).otherwise(2)
    shown = F.when(rank < 2, F.trim("text")).otherwise(F.col("stem"))
    return items.groupBy("doc_id").agg(F.min_by(shown, F.struct(rank.alias("r"), "ord")).alias("title"))


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


def similarity(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp similarity of two strings, for pairs that survive native filters."""
    return F.pandas_udf(_ratio, "double")(a, b)


def match_title_to_works(titles: DataFrame, works: DataFrame, least: float = 0.6, shared: str | None = None) -> DataFrame:
    """(doc_id, work_id, score): by equal DOI, else the most similar title of ``least`` or more, of all works.

    titles: doc_id, title, doi; works: work_id, title, doi.  Case doesn't count; of equal
    scores the smallest work_id is taken; blank and null titles match nothing.  Distinct
    titles are compared, but for those that a work has as they are with all works in blocks, from a
    known similarity on (see ``titles``).
    ``shared``: a new folder that all executors share; what several steps read is then
    written there, each made once.
    """

    def saved(rows: DataFrame, name: str) -> DataFrame:
        if shared is None:
            return rows
        rows.write.parquet(f"{shared}/{name}")
        return rows.sparkSession.read.schema(rows.schema).parquet(f"{shared}/{name}")

    low = F.lower("title").alias("text")
    known = works.filter("doi IS NOT NULL").groupBy(F.col("doi").alias("w_doi")).agg(F.min("work_id").alias("work_id"))
    all_titles = titles.select("doc_id", low, "doi").join(known.hint("merge"), F.col("doi") == F.col("w_doi"), "left").select("doc_id", "text", "work_id")
    all_titles = saved(all_titles, "titles")
    by_doi = all_titles.filter("work_id IS NOT NULL").select("doc_id", "work_id", F.lit(1.0).alias("score"))
    rest = all_titles.join(by_doi.select("doc_id").distinct().hint("merge"), "doc_id", "left_anti").filter(F.trim("text") != "").select("doc_id", "text")
    records = saved(works.filter(F.trim("title") != "").groupBy(low).agg(F.min("work_id").alias("work_id")).withColumn("grams", grams(F.col("text"))), "records")
    texts = saved(rest.select("text").distinct().withColumn("grams", grams(F.col("text"))), "texts")
    often = saved(frequencies(records), "grams")
    ids = records.select("text", "work_id")
    near = saved(texts.select("text").join(ids.hint("merge"), "text").select("text", "work_id", F.lit(1.0).alias("score")), "equal")
    left = texts.join(near.select("text").hint("merge"), "text", "left_anti")
    guesses = saved(first_guesses(left, records, often), "guesses")
    near = near.unionByName(best_in_blocks(saved(better_guesses(guesses, ids), "left"), ids, least))
    return by_doi.unionByName(rest.join(near.hint("merge"), "text").select("doc_id", "work_id", "score"))


# --- JATS --------------------------------------------------------------------------

_SKIP = {"fig", "media", "supplementary-material", "inline-formula", "fn", "ack", "ref-list"}
_INLINE = {"italic": "em", "bold": "strong", "sub": "sub", "sup": "sup", "underline": "u"}


def _local(e) -> str:
    return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""


def _xml(raw: str):
    """The root of an article; an undeclared xlink prefix is declared first; None if it is malformed."""
    if "xlink:" in raw and "xmlns:xlink" not in raw:
        raw = re.sub(r"<([A-Za-z][\w.-]*)", r'<\1 xmlns:xlink="http://www.w3.org/1999/xlink"', raw, count=1)
    try:
        return ElementTree.fromstring(raw)
    except ElementTree.ParseError:
        return None


def _html(e, ids: list[int], seen: str) -> str:
    """HTML of an element's content, with its nested sections as h3."""
    out = [_escape(e.text or "")]
    for c in e:
        name = _local(c)
        if name in _SKIP:
            pass
        elif name == "title":
            text = "".join(c.itertext()).strip()
            if text and text != seen:
                slug = re.sub(r"[^a-z0-9]+", "-", text.lower()).strip("-")
                out.append(f'<h3 id="h-{ids[0]}-{slug}">{_escape(text)}</h3>')
                ids[0] += 1
        elif name == "label":
            pass
        elif name in _INLINE:
            out.append(f"<{_INLINE[name]}>{_html(c, ids, seen)}</{_INLINE[name]}>")
        elif name == "p":
            out.append(f"<p>{_html(c, ids, seen)}</p>")
        elif name == "list":
            kind = "ol" if c.get("list-type") == "order" else "ul"
            out.append(f"<{kind}>" + "".join(f"<li>{_html(i, ids, seen)}</li>" for i in c if _local(i) == "list-item") + f"</{kind}>")
        elif name == "disp-quote":
            out.append(f"<blockquote>{_html(c, ids, seen)}</blockquote>")
        elif name in {"table", "thead", "tbody", "tr", "th", "td"}:
            out.append(f"<{name}>{_html(c, ids, seen)}</{name}>")
        else:
            out.append(_html(c, ids, seen))
        out.append(_escape(c.tail or ""))
    return "".join(out)


def _escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def jats_article(raw: str) -> tuple[dict, list[tuple[str, str]]]:
    """Metadata and (title, html) sections of one article: its abstract and each section of its body."""
    root = _xml(raw or "")
    if root is None:
        return {}, []
    first = lambda path: next((("".join(e.itertext())).strip() for e in root.iter() if _local(e) == path), "")
    people = [c for c in root.iter() if _local(c) == "contrib" and c.get("contrib-type") == "author"] or [c for c in root.iter() if _local(c) == "contrib"]
    part = lambda e, name: next((x.text or "" for x in e.iter() if _local(x) == name), "")
    date = next((e for e in root.iter() if _local(e) == "pub-date"), None)
    meta = {
        "title": first("article-title"),
        "authors": [n for c in people if (n := f"{part(c, 'given-names')} {part(c, 'surname')}".strip())],
        "journal": first("journal-title") or first("abbrev-journal-title"),
        "year": part(date, "year") if date is not None else "",
        "doi": next((e.text or "" for e in root.iter() if _local(e) == "article-id" and e.get("pub-id-type") == "doi"), ""),
    }
    sections, ids = [], [0]
    for a in (e for e in root.iter() if _local(e) == "abstract"):
        html = _html(a, ids, "Abstract").strip()
        if html:
            sections.append(("Abstract", html))
    body = next((e for e in root.iter() if _local(e) == "body"), None)
    for s in body if body is not None else []:
        if _local(s) != "sec":
            continue
        name = " ".join(x for x in (part_of(s, "label"), part_of(s, "title")) if x)
        html = _html(s, ids, part_of(s, "title")).strip()
        if html:
            sections.append((name, html))
    return meta, sections


def clean_xml(raw: Column) -> Column:
    """Text of an article's body, of all of it without a body, with the tags cut out if it is malformed; single spaces."""

    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(_xml_text)

    return F.pandas_udf(clean, "string")(raw)


def _xml_text(raw: str | None) -> str:
    root = _xml(raw or "")
    if root is None:
        return " ".join(re.sub(r"<[^>]*>", " ", raw or "").split())
    body = next((e for e in root.iter() if _local(e) == "body"), root)
    return " ".join(" ".join(body.itertext()).split())


def part_of(e, name: str) -> str:
    """Text of the direct child of that name."""
    return next((("".join(x.itertext())).strip() for x in e if _local(x) == name), "")


def jats_sections(articles: DataFrame, key: str = "pmcid") -> DataFrame:
    """(key, ord, title, html) of articles (key, xml); malformed ones have none."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [(k, n, t, h) for k, x in zip(rows[key], rows["xml"]) for n, (t, h) in enumerate(jats_article(x)[1])]
            yield pd.DataFrame(out, columns=[key, "ord", "title", "html"])

    return articles.select(key, "xml").mapInPandas(parse, f"{key} string, ord int, title string, html string")


def jats_metadata(articles: DataFrame, key: str = "pmcid") -> DataFrame:
    """(key, title, authors, journal, year, doi) of articles (key, xml)."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame([{key: k, "authors": [], **jats_article(x)[0]} for k, x in zip(rows[key], rows["xml"])], columns=[key, "title", "authors", "journal", "year", "doi"])

    return articles.select(key, "xml").mapInPandas(parse, f"{key} string, title string, authors array<string>, journal string, year string, doi string")


def extract_toc(html: DataFrame, key: str) -> DataFrame:
    """(key, ord, level, text, parent): headings of pages; h3 hang on the h2 before, or stand on top without one."""
    heads = F.regexp_extract_all("html", F.lit(r"(?is)(<h[23][^>]*>.*?</h[23]>)"), F.lit(1))
    rows = html.select(key, F.posexplode(heads).alias("ord", "h"))
    rows = rows.withColumn("level", F.regexp_extract("h", "(?i)<h([23])", 1).cast("int")).withColumn("text", F.trim(F.regexp_replace("h", "<[^>]*>", "")))
    w = Window.partitionBy(key).orderBy("ord")
    return rows.withColumn("parent", F.when(F.col("level") == 3, F.last(F.when(F.col("level") == 2, F.col("text")), ignorenulls=True).over(w))).drop("h")


def render_paper_html(sections: DataFrame, key: str) -> DataFrame:
    one = F.concat(F.lit("<section id=\"s-"), F.col("ord").cast("string"), F.lit('"><h2>'), "title", F.lit("</h2>"), "html", F.lit("</section>"))
    return sections.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", one.alias("h")))), lambda x: x["h"]), "\n").alias("html"))
