"""Hard negatives from lists that the anchors of a cluster share.

Rows are dealt to cells of bounded size around pivots, anchors to clusters.  A cluster's
list is made once: its cells by the largest inner product that any of its anchors can
have with a row there (the angle between two vectors is at least the difference of their
angles to a third), and the rows of a cell by the same bound.  Every anchor walks that list
from the top until the bound is below what it has already; then no row further down can
matter.  The list is walked in rounds of growing length, and each round meets only the cells
that some anchor of the cluster still needs.  The same walk finds the positives, in cells
of the anchors' label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litmine.functions.scalars import dot
from litmine.llm.common import Scratch, small, table

#: Rows of a cell and anchors of a cluster, about: larger groups of a pivot are split by hash.
CELL, CLUSTER = 2048, 64
#: Pivots at most, taken from the rows by hash: a bounded sample for the grouping alone.
PIVOTS = 1024
#: Cells of a list walked in the first round; each later round goes on to four times as many.
FIRST = 4
_SEGMENT = 256
#: Bounds are widened by this, beyond the rounding of angles.
_SLACK = 1e-6
_MIN = -(1 << 62)
_PACK = "key int, part string, centre array<double>, spread double, most double, ids binary, labels binary, q binary"


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as a long; null for a null vector or one with a null or non-finite component."""
    sound = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return F.when(sound, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _nearest(pivots: np.ndarray):
    unit = pivots / np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), 1e-300)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.argmax(_matrix(batch.column("q"), pivots.shape[1]).astype(float) @ unit.T, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], [*batch.schema.names, "pivot"])

    return run


def _angles(x: np.ndarray, norms: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Angles of vectors to a unit vector; 0 for zero vectors."""
    return np.where(norms > 0, np.arccos(np.clip(x @ centre / np.maximum(norms, 1e-300), -1, 1)), 0.0)


def _pack(width: int):
    """One row of a group's rows (key, part, vec_id, label, q), equal ones once, by vec_id."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, labels = (group.column(c).to_numpy().astype(np.int64) for c in ("vec_id", "label"))
        q = _matrix(group.column("q").combine_chunks(), width).astype(np.int64)
        rows = np.unique(np.column_stack([ids, labels, q]), axis=0)
        ids, labels, q = rows[:, 0], rows[:, 1], rows[:, 2:]
        x = q.astype(float)
        norms = np.linalg.norm(x, axis=1)
        centre = (x / np.maximum(norms, 1e-300)[:, None]).sum(axis=0)
        size = np.linalg.norm(centre)
        if size < 1e-9:  # nothing to point at: any unit vector will do
            centre = np.zeros(width)
            centre[:1] = size = 1.0
        centre = centre / size
        out = {
            "key": group.column("key")[:1], "part": group.column("part")[:1], "centre": [centre.tolist()], "spread": [float(_angles(x, norms, centre).max())],
            "most": [float(norms.max())], "ids": [ids.tobytes()], "labels": [labels.tobytes()], "q": [q.tobytes()],
        }
        kinds = {"key": pa.int32(), "part": pa.string(), "centre": pa.list_(pa.float64()), "spread": pa.float64(), "most": pa.float64()}
        return pa.table({k: pa.chunked_array([pa.array(v if isinstance(v, list) else v.to_pylist(), kinds.get(k, pa.binary()))]) for k, v in out.items()})

    return run


def packed(rows: DataFrame, width: int, size: int, key: Column) -> DataFrame:
    """Rows (vec_id, label, q, pivot) as one row for each part of about ``size`` of them, of one key and pivot."""
    keyed = rows.withColumn("key", key.cast("int"))
    counts = keyed.groupBy("key", "pivot").agg(F.ceil(F.count("*") / size).alias("slices"))
    sliced = keyed.join(small(counts), ["key", "pivot"]).withColumn("part", F.concat_ws("-", "key", "pivot", F.pmod(F.xxhash64("vec_id"), "slices")))
    return sliced.select("key", "part", "vec_id", "label", "q").groupBy("part").applyInArrow(_pack(width), _PACK)


class _Group:
    """A packed part in a worker."""

    def __init__(self, ids: bytes, labels: bytes, q: bytes):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.q = np.frombuffer(q, np.int64).reshape(len(self.ids), -1)
        self.x = self.q.astype(float)
        self.norms = np.linalg.norm(self.x, axis=1)


def _walk(anchors: _Group, cell: _Group, centre: np.ndarray, spread: float, slots: list[dict], k: int, same_label: bool) -> Iterator[tuple[int, int, int, int]]:
    """(member, slot, score, id): of each request the k best rows of a cell that can be among its k best of all."""
    bound = cell.norms * np.cos(np.maximum(0.0, _angles(cell.x, cell.norms, centre) - spread))
    order = np.argsort(-bound, kind="stable")
    exact = anchors.norms.max(initial=0) * cell.norms.max(initial=0) < 2**52
    best: list[list[tuple[int, int]]] = [[] for _ in slots]
    least = np.array([s["tau"] for s in slots], dtype=float)
    of = np.array([s["m"] for s in slots])
    for start in range(0, len(order), _SEGMENT):
        top = anchors.norms[of] * bound[order[start]]
        live = np.flatnonzero(top + _SLACK * (np.abs(top) + 1) >= least)
        if not len(live):  # certified: no row further down can matter
            break
        at = order[start : start + _SEGMENT]
        members = np.unique(of[live])
        score = anchors.x[members] @ cell.x[at].T if exact else (anchors.q[members].astype(object) @ cell.q[at].T.astype(object))
        alike = cell.labels[at] == anchors.labels[members][:, None]
        fits = alike & (cell.ids[at] != anchors.ids[members][:, None]) if same_label else ~alike
        row_of = {m: r for r, m in enumerate(members)}
        for j in live:
            r, s = row_of[of[j]], slots[j]
            hit = np.flatnonzero(fits[r] & (score[r] >= least[j]) & (score[r] <= s["hi"]))
            if len(hit):
                best[j] = sorted(best[j] + [(-int(score[r][h]), int(cell.ids[at[h]])) for h in hit])[:k]
                if len(best[j]) == k:
                    least[j] = max(least[j], -best[j][-1][0])
    for s, found in zip(slots, best):
        for negated, i in found:
            yield int(s["m"]), int(s["slot"]), negated, i


_HIT = "cluster string, m int, slot int, ns long, id long"


def _met(k: int, same_label: bool):
    """Sorted rows of cells, each followed by the clusters that walk it, to hits; one cell is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, name = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                group = _Group(row["ids"], row["labels"], row["q"])
                if row["cluster"] is None:
                    cell, name = group, row["cell"]
                elif row["cell"] == name:
                    out += [(row["cluster"], *hit) for hit in _walk(group, cell, np.array(row["centre"]), row["spread"], row["slots"], k, same_label)]
            names = ("cluster", "m", "slot", "ns", "id")
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, kinds)], list(names))

    return run


def shared_lists(clusters: DataFrame, cells: DataFrame) -> DataFrame:
    """(cluster, cell, bound, pos): for each cluster the cells of its key, by the largest product with a unit vector of the cluster.

    Clusters meet cells in blocks of them, not all in one task.
    """
    blocks = max(1, -(-cells.count() // 256))
    left = clusters.select("key", F.col("part").alias("cluster"), F.col("centre").alias("c"), F.col("spread").alias("c_spread"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = cells.select("key", F.col("part").alias("cell"), F.col("centre").alias("p"), "spread", "most", F.pmod(F.xxhash64("part"), F.lit(blocks)).cast("int").alias("block"))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("c"), F.col("p")))))
    gap = F.greatest(F.lit(0.0), angle - F.col("c_spread") - F.col("spread"))
    pairs = left.join(right, ["key", "block"]).select("cluster", "cell", (F.col("most") * F.greatest(F.cos(gap), F.lit(0.0)) * (1 + _SLACK)).alias("bound"))
    return pairs.withColumn("pos", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("bound"), "cell")))


def walk(requests: DataFrame, clusters: DataFrame, cells: DataFrame, k: int, same_label: bool, scratch: Scratch, name: str) -> DataFrame:
    """``requests`` (cluster, m, slot, norm, lo, hi) plus ``best``, ARRAY<STRUCT<ns, id>>: the k rows of highest score from
    lo to hi, ns being the score negated, ties by id.  ``clusters`` and ``cells`` as ``packed`` makes them."""
    lists = scratch.save(shared_lists(clusters, cells), f"{name}-lists")
    longest = lists.agg(F.max("pos")).first()[0] or 0
    state = scratch.save(requests.withColumn("best", F.array().cast("array<struct<ns:bigint,id:bigint>>")), f"{name}-0")
    done, upto, step = 0, FIRST, 0
    fixed = clusters.select(F.col("part").alias("cluster"), "centre", "spread", "ids", "labels", "q")
    while done < longest:
        tau = F.when(F.size("best") == k, F.greatest("lo", -F.element_at("best", -1)["ns"])).otherwise(F.col("lo"))
        asked = state.filter("lo <= hi").select("cluster", "norm", F.struct("m", "slot", tau.alias("tau"), "hi").alias("s"))
        # what a cell's bound must reach: the least of what the cluster's requests still ask of a unit vector
        need = F.when(F.col("norm") > 0, (F.col("s.tau") - 1) / F.col("norm")).when(F.col("s.tau") <= 0, float("-inf")).otherwise(float("inf"))
        asked = asked.groupBy("cluster").agg(F.min(need).alias("need"), F.collect_list("s").alias("slots"))
        left = lists.filter(F.col("pos") > done).join(asked, "cluster").filter("bound >= need")
        if step and left.isEmpty():
            break
        now = left.filter(F.col("pos") <= upto).select("cell", "cluster", "slots").join(fixed, "cluster")
        now = now.select("cell", "cluster", "centre", "spread", "slots", "ids", "labels", "q")
        nothing = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in now.schema.fields}
        held = cells.select(F.col("part").alias("cell"), *[nothing[c] for c in ("cluster", "centre", "spread", "slots")], "ids", "labels", "q")
        stream = held.unionByName(now).repartition("cell").sortWithinPartitions("cell", F.col("cluster").asc_nulls_first())
        hits = stream.mapInArrow(_met(k, same_label), _HIT)
        found = hits.groupBy("cluster", "m", "slot").agg(F.collect_list(F.struct("ns", "id")).alias("found"))  # k a cell of the round
        best = F.slice(F.array_sort(F.concat("best", F.coalesce("found", F.array().cast("array<struct<ns:bigint,id:bigint>>")))), 1, k)
        step += 1
        state = scratch.save(state.join(found, ["cluster", "m", "slot"], "left").withColumn("best", best).drop("found"), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        done, upto = upto, upto * 4
    return state


def _members(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                g = _Group(row["ids"], row["labels"], row["q"])
                out += [(row["part"], m, int(i), float(n)) for m, (i, n) in enumerate(zip(g.ids, g.norms))]
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 4, kinds)], ["cluster", "m", "anchor_id", "norm"])

    return run


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of rows (vec_id, label, q).

    ``q``: vector of longs, its score with another the inner product.  An anchor's
    positives are the first rows of its label but those of its own vec_id, by score,
    ties by vec_id; a positive's negatives the first rows of other labels whose score is
    from low to high percent of the positive's, so none if that is negative.  Rows without
    vec_id, label or vector take no part; rows equal in all three count once; shorter
    vectors are filled up with zeros; zero vectors score 0.  An anchor without positives,
    a positive without negatives and an empty table give no rows.  Other columns are not
    looked at.
    """
    scratch = Scratch(rows.sparkSession, "negatives")
    sound = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND q IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), "q", is_anchor.alias("is_anchor"))
    n, width = sound.agg(F.count("*"), F.max(F.size("q"))).first()
    width = max(width or 1, 1)
    sound = sound.withColumn("q", F.concat("q", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("q"))))
    sample = sound.select("vec_id", "q").orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(PIVOTS, max(1, -(-n // CELL))))
    pivots = np.array([r.q for r in sample.collect()] or [[0] * width], dtype=float)  # PIVOTS rows at most
    near = scratch.save(sound.mapInArrow(_nearest(pivots), "vec_id long, label int, q array<bigint>, is_anchor boolean, pivot int"), "near")

    clusters = scratch.save(packed(near.filter("is_anchor"), width, CLUSTER, F.col("label")), "clusters")
    members = scratch.save(clusters.mapInArrow(_members(width), "cluster string, m int, anchor_id long, norm double"), "members")
    own = scratch.save(packed(near.join(small(clusters.select(F.col("key").alias("label")).distinct()), "label", "left_semi"), width, CELL, F.col("label")), "own")
    asked = members.select("cluster", "m", F.lit(0).alias("slot"), "norm", F.lit(_MIN).alias("lo"), F.lit(-_MIN).alias("hi"))
    near_own = walk(asked, clusters, own, positives, True, scratch, "positives")
    found = near_own.select("cluster", "m", "norm", F.posexplode("best").alias("slot", "p"))
    found = found.select("cluster", "m", "slot", "norm", F.col("p.id").alias("positive_id"), (-F.col("p.ns")).alias("positive_score"))
    found = scratch.save(found, "found")
    scratch.drop("own", "positives-lists")

    every = scratch.save(packed(near, width, CELL, F.lit(0)), "every")
    floor = lambda c: F.expr(f"({c} - pmod({c}, 100L)) div 100")
    lo, hi = -floor(f"positive_score * {-low}L"), floor(f"positive_score * {high}L")
    asked = found.select("cluster", "m", "slot", "norm", lo.alias("lo"), hi.alias("hi"))
    scored = walk(asked, clusters.withColumn("key", F.lit(0)), every, negatives, False, scratch, "negatives")
    out = scored.select("cluster", "m", "slot", F.posexplode("best").alias("at", "x")).join(found.drop("norm"), ["cluster", "m", "slot"]).join(members.drop("norm"), ["cluster", "m"])
    return out.select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("negative_id"), "positive_score", (-F.col("x.ns")).alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are rows whose vec_id 100 divides; labels of those that 7 divides are moved on by one first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), quantised(F.col("embedding")).alias("q"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER w AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER w <= 10
"""
