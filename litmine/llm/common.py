"""What the training-data operators share: word rules, shared-folder tables, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of the quality, dedup and mixing operators: runs without ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: Words of the benchmark and license operators: runs of a-z, 0-9 and everything beyond ASCII.
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of a table up to which joins broadcast it; larger ones shuffle.
BROADCAST_BYTES = 32 << 20


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, every other character as it is (``lower`` would change more)."""
    return F.translate(text, _UPPER, _LOWER)


def wrapped(rows: DataFrame) -> DataFrame:
    """``rows`` as one struct column ``row``: names that an operator adds can't clash with the caller's."""
    return rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))


def of_row(name: str) -> Column:
    return F.col("row").getField(name)


def unwrapped(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that ``wrapped`` packed."""
    return rows.select(*[of_row(c).alias(c) for c in columns])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables written to the folder that the driver and all executors share.

    The folder is ``spark.checkpoint.dir``; only a local session without that
    setting gets a temporary folder.  A written table cuts lineage: what follows
    an executor's loss rereads it and repeats nothing before it.
    """

    def __init__(self, spark: SparkSession, label: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="spark-litmine-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.spark, self.root = spark, f"{base.rstrip('/')}/litmine-{label}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing lazy reads any more."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _bytes(value: Column, kind: T.DataType) -> Column:
    """Bytes that a value takes in a row, about."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.octet_length(value) + 16
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType)):
        return F.aggregate(value, F.lit(16).cast("long"), lambda sum_, x: sum_ + F.coalesce(_bytes(x, kind.elementType), F.lit(8)).cast("long"))
    if isinstance(kind, T.ArrayType):
        return F.size(value) * 8 + 16
    if isinstance(kind, T.StructType):
        return sum((F.coalesce(_bytes(value[f.name], f.dataType), F.lit(8)).cast("long") for f in kind.fields), F.lit(16).cast("long"))
    return F.lit(8)


def within(rows: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the bytes of all rows, added up, are within the limit."""
    each = sum((F.coalesce(_bytes(F.col(f"`{f.name}`"), f.dataType), F.lit(8)).cast("long") for f in rows.schema.fields), F.lit(16).cast("long"))
    return (rows.agg(F.sum(each)).first()[0] or 0) <= limit


def small(rows: DataFrame) -> DataFrame:
    """``rows`` with a broadcast hint if their bytes have been added up to be few, else as they are."""
    return F.broadcast(rows) if within(rows) else rows


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Connected components as (id, component), the component being its smallest id.

    ``edges``: (a, b) longs; loops and repeats are allowed.  Alternates the
    large-star and small-star steps (Kiveris et al., 2014) until the edges stop
    changing; each round is two aggregations and two joins on node ids, written
    to the shared folder.  Only a count and a checksum reach the driver.
    """
    current = scratch.save(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        f"{name}-0",
    )
    seen, step = None, 0
    while True:
        mark = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen or mark[0] == 0:
            break
        seen = tuple(mark)
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(low, "a")
        star = hung.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select("a", F.col("m").alias("b"))
        )
        step += 1
        current = scratch.save(star.distinct(), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
    roots = current.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
