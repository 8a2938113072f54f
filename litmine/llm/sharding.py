"""Sharding by proportional stratified interleaving.

Rows of each source are put in a seeded random order; a row of rank k among n stands
at the fraction (k - u) / n, with its own seeded u from 0 to 1, so that sources of few
rows are spread as well.  Sorted by fraction, all sources are spread evenly over
the order, so any contiguous cut of it has the whole table's mixture.  Cuts are at
equal counts.  Both orders are found without sorting in one place: rows go to slices
of the random key (or of the fraction), slices are counted, and a row's rank is its
rank within the slice plus the count of the slices before.  A source that holds most
rows is spread over as many slices as its rows need.  What meets in one task is one
count per slice, 1 for SLICE_ROWS rows.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litmine.llm.common import table

#: Rows that one slice of an order has on average.
SLICE_ROWS = 10_000
SEED = 17


def _ranked(rows: DataFrame, slices: DataFrame, by: list[str], order: list[str | Column], name: str) -> DataFrame:
    """``rows`` plus ``name``, their rank from 1 in (slice, order) within ``by``, which may be empty."""
    keys = [*by, "slice"]
    before = F.sum("n").over(Window.partitionBy(*by).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    starts = slices.withColumn("start", F.coalesce(before, F.lit(0)))
    starts = starts.select(*[F.col(k).alias(f"_{k}") for k in keys], "start")
    same = F.lit(True)
    for k in keys:
        same = same & rows[k].eqNullSafe(F.col(f"_{k}"))
    within = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn(name, within).join(starts, same).withColumn(name, F.col(name) + F.col("start")).drop("start", *[f"_{k}" for k in keys])


def shard(rows: DataFrame, n_shards: int, key: str = "doc_id", source: str = "source", ties: tuple[str, ...] = (), seed: int = SEED) -> DataFrame:
    """``rows`` plus ``shard`` (int, 0 to n_shards - 1) and ``slot`` (long, gapless from 0 in each shard).

    Counts of shards differ by one at most, and each shard has the table's mixture of
    sources.  The order depends on ``seed``, ``key`` and ``ties`` alone, not on how
    rows are partitioned; only rows equal in all of them may swap places.  A null
    source is a source, a null key a key; an empty table gives an empty one.  Hand in
    narrow rows: all columns are shuffled twice.  Columns called shard or slot are
    replaced.
    """
    kept = rows.drop("shard", "slot")
    names = kept.columns
    seen = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null")) for c in (key, *ties)]
    mixed = F.md5(F.concat_ws(":", F.lit(str(seed)), *seen))
    plain = kept.select(F.struct(*[f"`{n}`" for n in names]).alias("row"), F.col(f"`{source}`").alias("source"), mixed.alias("mixed"), *[F.col(f"`{t}`").alias(f"tie{i}") for i, t in enumerate(ties)])
    order: list[str] = ["mixed", *[f"tie{i}" for i in range(len(ties))]]
    total = kept.count()
    n_slices = max(1, total // SLICE_ROWS)
    part = lambda at: F.conv(F.substring("mixed", at, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    plain = plain.withColumn("slice", (part(1) * n_slices).cast("long"))
    counts = plain.groupBy("source", "slice").agg(F.count("*").alias("n"))
    sizes = counts.groupBy(F.col("source").alias("of")).agg(F.sum("n").alias("n_source"))
    at = _ranked(plain, counts, ["source"], order, "rank").join(sizes, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    at = at.withColumn("fraction", (F.col("rank") - part(9)) / F.col("n_source"))
    at = at.withColumn("slice", (F.col("fraction") * n_slices).cast("long"))
    counts = at.groupBy("slice").agg(F.count("*").alias("n"))
    place = _ranked(at, counts, [], ["fraction", F.col("source").asc_nulls_last(), *order], "place").withColumn("place", F.col("place") - 1)
    number = F.expr(f"(place * {n_shards}) div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {n_shards - 1}) div {n_shards}")
    return place.withColumn("shard", number).withColumn("slot", F.col("place") - first).select("row.*", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """One folder ``shard=k`` per shard, in files of neighbouring slots, rows in slot order.

    As many tasks write as there are files (or shuffle partitions), not one per shard.
    """
    piece = (F.col("slot") / rows_per_file).cast("long")
    sharded.repartition("shard", piece).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of documents, law "rows".

    Null texts have size 8 and the checksum of no bytes.  Null doc_ids and sources are
    values like others; rows equal in doc_id, source and text get places next to one
    another in any order; other columns are not read; an empty table gives an empty one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", "source", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shard(narrow, n_shards, ties=("text_crc32", "size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH tab AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT CAST(i AS BIGINT) AS i FROM range(256) r(i))
), d AS (
  SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 8 AS size,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda b: CAST('0x' || b AS BIGINT))),
      lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS text_crc32
  FROM documents, tab
), r AS (
  SELECT *, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || CAST(text_crc32 AS VARCHAR) || ':' || CAST(size AS VARCHAR)) AS mixed FROM d
), f AS (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY mixed, text_crc32, size) - CAST('0x' || substr(mixed, 9, 8) AS BIGINT) / 4294967296.0::DOUBLE)
    / count(*) OVER (PARTITION BY source) AS fraction FROM r
), p AS (
  SELECT *, row_number() OVER (ORDER BY fraction, source NULLS LAST, mixed, text_crc32, size) - 1 AS place, count(*) OVER () AS total FROM f
), s AS (SELECT *, place * 24 // total AS shard FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(shard AS INT) AS shard,
       CAST(place - (shard * total + 23) // 24 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard FROM s
"""
