"""Benchmark decontamination: windows of training words looked up in a set of test n-grams.

Test items become windows of WINDOW words.  Their hashes form a set that every task
gets with the plan, if there are at most SET_LIMIT of them; each document is scanned
in place, one row at a time, without a shuffle.  Larger benchmarks are joined to the
documents' window hashes instead, and Spark broadcasts or shuffles by their size.  A
hit counts when the words themselves are equal.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litmine.llm.common import Scratch, ascii_lower, of_row, small, table, unwrapped, wrapped

WINDOW = 10
#: Window hashes that may travel inside a plan (8 bytes each).
SET_LIMIT = 20_000
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain_words(text: Column) -> Column:
    """The words of a text as an array; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _GAP), "")


def test_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(win, len, h, items): each distinct window, its words joined by spaces, and who has it.

    An item of fewer than WINDOW words, but not none, is one window.  Items without
    an id or a text are left out.
    """
    words = benchmark.filter(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item"), plain_words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    cut = words.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - WINDOW + 1, F.lit(1))), lambda i: F.slice("w", i, WINDOW))).alias("g"))
    return cut.groupBy(F.array_join("g", " ").alias("win")).agg(F.first(F.size("g")).alias("len"), F.first(F.xxhash64("g")).alias("h"), F.collect_set("item").alias("items"))


def _spots(length: int) -> Column:
    """Where windows of that many words can start: 1 and on, none in a shorter text."""
    return F.when(F.size("words") >= length, F.sequence(F.lit(1), F.size("words") - length + 1)).otherwise(F.array().cast("array<int>"))


def _hash_at(length: int):
    return lambda i: F.xxhash64(F.slice("words", i, length))


def _tried(length: int) -> Column:
    """Every window of that length with its hash."""
    return F.transform(_spots(length), lambda i: F.struct(i.alias("at"), F.lit(length).alias("len"), _hash_at(length)(i).alias("h")))


def _found(length: int, hashes: list[int]) -> Column:
    """The windows of that length whose hash is in the set."""
    spots = F.filter(_spots(length), lambda i: _hash_at(length)(i).isin(hashes))
    return F.transform(spots, lambda i: F.struct(i.alias("at"), F.lit(length).alias("len")))


def marks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", set_limit: int = SET_LIMIT) -> DataFrame:
    """(doc_id, text_hash, n_words, copies, hit, items) per distinct (doc_id, text).

    ``hit`` holds the positions (from 1) of words inside an occurring window, ``items``
    the test items that occur, ``copies`` the number of rows of ``docs``.  Null texts
    have no words; a null doc_id is a value like others; repeated rows are one row; an
    empty table gives an empty one.  Other columns are not read.
    """
    windows = test_windows(benchmark)
    known = windows.select("len", "h").distinct()
    bounded = known.limit(set_limit + 1).collect()
    base = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), plain_words(F.col(text)).alias("words"))
    if len(bounded) <= set_limit:
        found: Column = F.array().cast("array<struct<at:int,len:int>>")
        for length in sorted({r.len for r in bounded}):
            hashes = [r.h for r in bounded if r.len == length]
            found = F.concat(found, _found(length, hashes))
        rows = base.withColumn("found", found)
    else:
        lengths = [r.len for r in known.select("len").distinct().collect()]  # WINDOW of them at most
        tried = F.concat(*map(_tried, lengths))
        seen = base.select("doc_id", "text_hash", F.explode(tried).alias("t")).select("doc_id", "text_hash", "t.*")
        seen = seen.join(small(known), ["len", "h"], "left_semi").groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("at", "len")).alias("found"))
        seen = seen.select(F.col("doc_id").alias("seen_id"), F.col("text_hash").alias("seen_hash"), "found")
        rows = base.join(seen, F.col("doc_id").eqNullSafe(F.col("seen_id")) & (F.col("text_hash") == F.col("seen_hash")), "left").drop("seen_id", "seen_hash")
    cut = F.transform("found", lambda x: F.struct(x["at"].alias("at"), x["len"].alias("len"), F.array_join(F.slice("words", x["at"], x["len"]), " ").alias("win")))
    scanned = rows.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"), F.coalesce(cut, F.array().cast("array<struct<at:int,len:int,win:string>>")).alias("cut"))
    scanned = Scratch(docs.sparkSession, "marks").save(scanned, "scanned")
    # only documents with a find go on to the words' comparison
    each = scanned.filter(F.size("cut") > 0).select("doc_id", "text_hash", F.inline("cut")).distinct()
    true = each.join(small(windows.select("win", "items")), "win")
    hits = true.groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence("at", F.col("at") + F.col("len") - 1))))).alias("hit"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")
    )
    hits = hits.select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), "hit", "items")
    counted = scanned.groupBy("doc_id", "text_hash", "n_words").agg(F.count("*").alias("copies"))
    out = counted.join(small(hits), F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash")), "left")
    kind = {f.name: f.dataType for f in hits.schema.fields}
    return out.select("doc_id", "text_hash", "n_words", "copies", *[F.coalesce(c, F.array().cast(kind[c])).alias(c) for c in ("hit", "items")])


def decontaminate(docs: DataFrame, benchmark: DataFrame, action: str = "drop", doc_id: str = "doc_id", text: str = "text", set_limit: int = SET_LIMIT) -> DataFrame:
    """``docs`` without contamination, all columns as they were, whatever their names.

    ``action``: "drop" removes documents with a hit; "cut" removes the hit words (and
    keeps what stands between words).  Null and empty texts have no words and stay;
    repeated rows fare alike; an empty benchmark removes nothing; an empty table gives
    an empty one.
    """
    if action not in ("drop", "cut"):
        raise ValueError(f"action is drop or cut, not {action!r}")
    scratch = Scratch(docs.sparkSession, "decon")
    found = marks(docs, benchmark, doc_id, text, set_limit).filter(F.size("hit") > 0)
    found = small(scratch.save(found.select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), *(["hit"] if action == "cut" else [])), "found"))
    rows, body = wrapped(docs), of_row(text)
    same = of_row(doc_id).eqNullSafe(F.col("hit_id")) & (F.xxhash64(body) == F.col("hit_hash"))
    if action == "drop":
        return unwrapped(rows.join(found, same, "left_anti"), docs.columns)
    # words and gaps alternate; word k is piece 2k-1 or 2k, as the text starts with a word or a gap
    pieces = F.regexp_extract_all(body, F.lit(r"[A-Z0-9a-z\x{80}-\x{10FFFF}]+|[^A-Z0-9a-z\x{80}-\x{10FFFF}]+"), F.lit(0))
    first = F.when(body.rlike(r"^[A-Z0-9a-z\x{80}-\x{10FFFF}]"), 0).otherwise(1)
    gone = F.transform("hit", lambda k: 2 * k - 2 + first)
    rest = F.array_join(F.filter(pieces, lambda p, i: ~F.array_contains(gone, i)), "")
    out = rows.join(found, same, "left").withColumn("new", F.when(F.col("hit").isNull(), body).otherwise(rest))
    return out.select(*[F.col("new").alias(c) if c == text else of_row(c).alias(c) for c in docs.columns])


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = marks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        "doc_id",
        "n_words",
        F.size("hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        (F.size("hit") > 0).alias("contaminated"),
    )


OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), g AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS win, len(w[i:i + 9]) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM g), p AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (
    SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
), h AS (SELECT r, i, p.n, item_id FROM p JOIN g ON p.win = g.win),
n AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM h, range(0, 10) t(k) WHERE k < n GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.r = n.r LEFT JOIN t ON d.r = t.r
"""
