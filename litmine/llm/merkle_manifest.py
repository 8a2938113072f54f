"""A Merkle manifest of a table: nested-interval labels, proofs, verification.

Rows are leaves, ranked within their group (a source); a node of level L covers an
interval of ``FANOUT`` ^ L ranks, the last one of a level fewer.  Every node carries its
interval: the ancestor of a node is found by a join on the level's bucket of ranks and
containment of the interval, and its siblings are what the parent's interval holds
before and after the node's own.  Paths go down level by level, so that a node meets
``FANOUT`` children and no join has a hot key, however large a group is.  The groups'
tops are the leaves of one more tree, whose top is the root of the manifest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litmine.llm.common import Scratch, ascii_lower, small, table

FANOUT = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of strings put together."""
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(columns: dict[str, Column]) -> Column:
    """Digest of a row: each value as its length in bytes, a colon and the value; null as a dash."""

    def item(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return digest(*map(item, columns.values()))


def _joined(nodes: Column) -> Column:
    """The digests of an array of nodes, put together."""
    return F.array_join(F.transform(nodes, lambda x: x["digest"]), "")


def ranked(leaves: DataFrame, scratch: Scratch, name: str, by: list[str]) -> DataFrame:
    """``leaves`` (grp, digest, …) plus rank and n, the number of leaves of their group.

    Sorted by range over all tasks, nulls first, ties by the columns after them in ``by``;
    a group may lie in many tasks: what it has in each is counted, and the counts added up.
    """
    order = ["grp", *by]
    dealt = leaves.repartitionByRange(*order).sortWithinPartitions(*order)
    mine = scratch.save(dealt.withColumn("at", F.monotonically_increasing_id()).withColumn("task", F.shiftright("at", 33)), f"{name}-sorted")
    counts = mine.groupBy("grp", "task").agg(F.count("*").alias("here"), F.min("at").alias("start"))
    of = Window.partitionBy("grp")
    before = of.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    counts = counts.select(F.col("grp").alias("c_grp"), F.col("task").alias("c_task"), "start", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("before"), F.sum("here").over(of).alias("n"))
    counts = scratch.save(counts, f"{name}-counts")
    met = mine.join(small(counts), F.col("grp").eqNullSafe(F.col("c_grp")) & (F.col("task") == F.col("c_task")))
    return met.withColumn("rank", F.col("at") - F.col("start") + F.col("before")).drop("at", "task", "c_grp", "c_task", "start", "before")


def levels(leaves: DataFrame, scratch: Scratch, name: str) -> list[DataFrame]:
    """Nodes of level 1, 2, …: (grp, n, lo, hi, digest, nodes), ``nodes`` being what each covers in the level below.

    A node of level 1 has its leaves with all their columns.  Every group has a level 1;
    it has a higher one while there is more than one node.
    """
    size, out = FANOUT, []
    extra = [c for c in leaves.columns if c not in ("grp", "n", "rank", "digest")]
    below = leaves.select("grp", "n", F.struct(F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest", *extra).alias("node"))
    most = leaves.agg(F.max("n")).first()[0] or 0
    while True:
        runs = below.groupBy("grp", F.expr(f"node.lo div {size}").alias("bucket")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list("node"), _by_lo).alias("nodes"))  # FANOUT nodes at most
        runs = runs.select("grp", "n", F.get("nodes", F.lit(0))["lo"].alias("lo"), F.element_at("nodes", -1)["hi"].alias("hi"), digest(_joined(F.col("nodes"))).alias("digest"), "nodes")
        out.append(scratch.save(runs, f"{name}-{len(out) + 1}"))
        if size >= most:
            return out
        below = out[-1].filter(F.col("n") > size).select("grp", "n", F.struct("lo", "hi", "digest").alias("node"))
        size *= FANOUT


def _by_lo(a: Column, b: Column) -> Column:
    return F.when(a["lo"] < b["lo"], -1).when(a["lo"] > b["lo"], 1).otherwise(0)


def tops(nodes: list[DataFrame]) -> DataFrame:
    """(grp, digest): the one node left of each group; a lone leaf is its own top."""
    size, out = 1, None
    for level in nodes:
        here = level.filter((F.col("n") <= size * FANOUT) & ((F.col("n") > size) | F.lit(size == 1)))
        lone = F.when(F.col("n") == 1, F.get("nodes", F.lit(0))["digest"]).otherwise(F.col("digest"))
        here = here.select("grp", lone.alias("digest"))
        out = here if out is None else out.unionByName(here)
        size *= FANOUT
    return out


def siblings(nodes: Column, lo: Column, hi: Column) -> Column:
    """STRUCT<left, right>: the parent's nodes before and after an interval, digests put together."""
    left = F.filter(nodes, lambda x: x["hi"] <= lo)
    right = F.filter(nodes, lambda x: x["lo"] >= hi)
    return F.struct(_joined(left).alias("left"), _joined(right).alias("right"))


def paths(nodes: list[DataFrame], above: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The nodes of level 1 plus ``path``, their siblings and their ancestors' up to the root, and above's columns.

    ``above``: (grp, path, …), the path of each group's top, a row per group.
    """
    keep = [c for c in above.columns if c not in ("grp", "path")]
    above = above.withColumnRenamed("grp", "a_grp")
    done = None
    for k in reversed(range(len(nodes))):
        size = FANOUT ** (k + 1)
        level = nodes[k]
        highest = level.filter(F.col("n") <= size).join(small(above), F.col("grp").eqNullSafe(F.col("a_grp"))).drop("a_grp")
        if done is not None:
            parent = done.select(F.col("grp").alias("p_grp"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"), F.col("nodes").alias("p_nodes"), F.col("path").alias("p_path"), *keep)
            bucket = lambda c: F.expr(f"{c} div {size * FANOUT}")
            inside = F.col("grp").eqNullSafe(F.col("p_grp")) & (bucket("lo") == bucket("p_lo")) & (F.col("p_lo") <= F.col("lo")) & (F.col("hi") <= F.col("p_hi"))
            lower = level.filter(F.col("n") > size).join(parent, inside)
            lower = lower.withColumn("path", F.concat(F.array(siblings(F.col("p_nodes"), F.col("lo"), F.col("hi"))), "p_path"))
            highest = highest.unionByName(lower.select(*highest.columns))
        done = scratch.save(highest, f"{name}-paths-{k + 1}")
    return done


def leaves_of(nodes: DataFrame) -> DataFrame:
    """Rows (grp, leaf, path, …) of nodes of level 1: each leaf with its own siblings before the node's path."""
    keep = [c for c in nodes.columns if c not in ("n", "lo", "hi", "digest", "nodes", "path")]
    own = F.concat(F.array(siblings(F.col("nodes"), F.col("leaf.lo"), F.col("leaf.hi"))), "path")
    return nodes.withColumn("leaf", F.explode("nodes")).select(*keep, "leaf", F.when(F.col("n") == 1, F.col("path")).otherwise(own).alias("path"))


def proofs(leaves: DataFrame, by: list[str]) -> DataFrame:
    """``leaves`` (grp, digest, …) with subroot, root and path, ARRAY<STRUCT<left, right>> from leaf to root.

    Leaves go by ``by`` within a group, nulls first, then by digest, so equal rows are
    leaves of their own; groups go by name, null first, as UTF-8 bytes.  An empty table
    gives no rows.  A path has FANOUT - 1 digests a level, and as many levels as the
    logarithms of the group's leaves and of the groups.
    """
    scratch = Scratch(leaves.sparkSession, "merkle")
    nodes = levels(ranked(leaves, scratch, "leaves", [*by, "digest"]), scratch, "leaves")
    groups = scratch.save(tops(nodes).select(F.lit(0).alias("grp"), F.col("grp").alias("name"), "digest"), "groups")
    upper = levels(ranked(groups, scratch, "groups", ["name"]), scratch, "groups")
    root = tops(upper).select("grp", F.col("digest").alias("root"), F.array().cast(_PATH).alias("path"))
    above = leaves_of(paths(upper, root, scratch, "groups"))
    above = scratch.save(above.select(F.col("leaf.name").alias("grp"), F.col("leaf.digest").alias("subroot"), "root", "path"), "above")
    out = leaves_of(paths(nodes, above, scratch, "leaves"))
    scratch.drop("leaves-sorted", "leaves-counts", "groups", "groups-sorted", "groups-counts")
    return out.select("grp", "subroot", "root", "path", "leaf.*").drop("lo", "hi")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda acc, step: digest(step["left"], acc, step["right"]))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path, in order."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(docs: DataFrame, group: str = "source", order: str = "doc_id", columns: tuple[str, ...] = COLUMNS, current: dict[str, Column] | None = None) -> DataFrame:
    """One row per row: the order column, leaf, subroot, root, path and ``now``, the digest of the row as it is now.

    ``current``: columns whose values have changed since the manifest was made; without
    it ``now`` is the leaf.  Nulls in any of the columns are values like others; other
    columns are not looked at; see ``proofs`` for ties, repeated rows and empty tables.
    """
    values = {c: F.col(f"`{c}`") for c in columns}
    leaf = leaf_digest(values)
    now = leaf_digest(values | current) if current else leaf
    rows = docs.select(F.col(f"`{group}`").alias("grp"), F.col(f"`{order}`").alias("key"), leaf.alias("digest"), now.alias("now"))
    found = proofs(rows, ["key"])
    return found.select(F.col("key").alias(order), F.col("digest").alias("leaf"), "subroot", "root", "path", "now")


def verify(rows: DataFrame) -> DataFrame:
    """Rows of ``manifest`` plus proof_sha256, folded_root and verified (it equals the root)."""
    out = rows.withColumn("proof_sha256", proof_digest(F.col("path"))).withColumn("folded_root", folded(F.col("now"), F.col("path")))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose id's crc32 5 divides have their texts lower-cased after the manifest was made."""
    docs = table(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    rows = manifest(docs, current={"text": F.when(hit, ascii_lower(F.col("text"))).otherwise(F.col("text"))})
    return verify(rows).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
