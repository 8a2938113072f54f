"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next one's ``docs``.  All stages but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litmine.llm.common import Scratch, of_row, small, table, unwrapped, wrapped
from litmine.llm.decontamination import decontaminate
from litmine.llm.mixing import mix, shares, word_count
from litmine.llm.near_dups import near_duplicates
from litmine.llm.quality_rules import select_documents
from litmine.llm.sharding import shard_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of policy v1 rejects; null and empty texts are rejected.

    Repeated rows fare alike; extra columns, whatever their names, go through; an empty
    table gives an empty one.
    """
    return select_documents(docs, "v1")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of near duplicates.

    Equal rows of that doc_id all stay; rows without a doc_id, and null or empty texts,
    stay.  Rows that share a doc_id go by their own texts.  Extra columns, whatever their
    names, go through; an empty table gives an empty one.
    """
    scratch = Scratch(spark, "dedup")
    gone = near_duplicates(docs).filter("NOT kept").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    gone = small(scratch.save(gone, "gone"))
    same = (of_row("doc_id").cast("long") == F.col("gone_id")) & (F.xxhash64(of_row("text")) == F.col("gone_hash"))
    return unwrapped(wrapped(docs).join(gone, same, "left_anti"), docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item.

    Null and empty texts have none and stay; repeated rows fare alike; extra columns,
    whatever their names, go through; an empty table gives an empty one.
    """
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), "drop")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    Rows equal in doc_id, source and text share the copies that the mix gives them.  Null
    doc_ids, sources and texts are values like others (a null text has size 0); extra
    columns, whatever their names, go through; an empty table gives an empty one.
    """
    scratch = Scratch(spark, "copies")
    unit = lambda of: F.xxhash64(of("doc_id"), of("source"), of("text"))
    units = mix(docs.select(unit(F.col).alias("unit"), "source", word_count(F.col("text")).alias("size")))
    times = scratch.save(units.filter("times > 0").select("unit", "n_rows", "times"), "times")
    rows = wrapped(docs).withColumn("of", unit(of_row)).join(small(times), F.col("of") == F.col("unit")).drop("of")
    single = rows.filter("n_rows = 1").withColumn("at", F.lit(0).cast("long"))
    # equal rows are numbered through all tasks: by task, and in it
    many = scratch.save(rows.filter("n_rows > 1").withColumn("slice", F.spark_partition_id()), "many")
    before = Window.partitionBy("unit").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = many.groupBy("unit", "slice").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    at = F.row_number().over(Window.partitionBy("unit", "slice").orderBy(F.lit(1))) - 1 + F.col("start")
    many = many.join(small(scratch.save(starts, "starts")), ["unit", "slice"]).withColumn("at", at.cast("long")).select(*single.columns)
    rows = single.unionByName(many).withColumn("n", shares(F.col("n_rows"), F.col("times"), F.col("at")).cast("int"))
    return unwrapped(rows.filter("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "n"))), docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's shard of 24 and its slot; see ``shard_documents`` for odd rows."""
    return shard_documents(docs, 24)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", mixing),
    ("sharding", sharding),
]

#: SQL can express neither the signatures' recall nor the cube method's draws.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
