"""Mixing sources to target weights by balanced sampling with the cube method.

A source with target / size = r takes every document floor(r) times and once more
with probability r - floor(r).  Those draws are not independent: the cube method
(Deville and Tille, 2004) moves the vector of probabilities inside the unit cube along
directions that leave the sums of tokens and of documents as they are, until all but
two coordinates are 0 or 1.  Directions need three open documents only, so a block of
documents is settled in one pass; blocks run in parallel, and what each leaves open
(two documents) meets others of its source in the next round, until the source has one block.
There the flight leaves LANDING documents of all sizes alone; with those that it leaves
open they are the small landing problem, whose best rounding is found by trying all.

Documents equal in unit, source and size are one entry of the problem with a count, so
that copies without an id are no load for one block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litmine.llm.common import SPACE_WORD, Scratch, small, table

#: Documents of a block, on average.
BLOCK = 2_000
#: Documents, besides the two that a flight leaves open, whose roundings are all tried at the end.
LANDING = 12
SHARE, CAP = 1.5, 2.0
WEIGHTS = (3, 1, 2)
_OPEN = 1e-9


def flight(p: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """The probabilities after a flight that keeps sum(p) and sum(p * size); two are open at most."""
    rng = np.random.default_rng(seed)
    p = p.astype(float).tolist()
    size = size.astype(float).tolist()
    held: list[int] = []
    for i in range(len(p)):
        if not _OPEN < p[i] < 1 - _OPEN:
            p[i] = float(round(p[i]))
            continue
        held.append(i)
        if len(held) < 3:
            continue
        a, b, c = held
        # orthogonal to (1, 1, 1) and to the sizes
        u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for k, v in zip(held, u):
            if v > 0:
                up, down = min(up, (1 - p[k]) / v), min(down, p[k] / v)
            elif v < 0:
                up, down = min(up, p[k] / -v), min(down, (1 - p[k]) / -v)
        step = up if rng.random() * (up + down) < down else -down
        for k, v in zip(held, u):
            p[k] += step * v
            p[k] = 0.0 if p[k] < _OPEN else 1.0 if p[k] > 1 - _OPEN else p[k]
        held = [k for k in held if 0 < p[k] < 1]
    return np.array(p)


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The 0 and 1 for a few open documents that miss the sum of p * size least, then the sum of p."""
    choices = (np.arange(1 << len(p))[:, None] >> np.arange(len(p)) & 1).astype(float)
    tokens, documents = np.abs(choices @ size - p @ size), np.abs(choices.sum(axis=1) - p.sum())
    return choices[np.lexsort((documents, np.round(tokens, 6)))[0]]


def settled(p: np.ndarray, size: np.ndarray, seed: int, last: bool) -> np.ndarray:
    """A block's probabilities after its flight and, if it is the source's last, the landing."""
    p, kept = p.astype(float), np.zeros(len(p), bool)
    if last:
        open_ = np.flatnonzero((p > _OPEN) & (p < 1 - _OPEN))
        by_size = open_[np.argsort(size[open_], kind="stable")]
        # of all sizes: small ones for a fine fit, large ones for what is large
        kept[by_size[np.unique(np.linspace(0, len(by_size) - 1, LANDING).astype(int))] if len(by_size) else []] = True
    out = p.copy()
    out[~kept] = flight(p[~kept], size[~kept], seed)
    if last:
        rest = np.flatnonzero((out > _OPEN) & (out < 1 - _OPEN))
        out[rest] = landing(out[rest], size[rest].astype(float))
    return out


def _settle(rows: pd.DataFrame) -> pd.DataFrame:
    """A block of a source; the last one of its source, whatever other sources have left, if it is the only one."""
    # largest first, so that what is left open is small
    rows = rows.sort_values(["size", "mixed", "unit"], ascending=[False, True, True], ignore_index=True)
    rows["p"] = settled(rows["p"].to_numpy(), rows["size"].to_numpy(), int(rows["mixed"].iloc[0]) & 0x7FFFFFFF, rows["blocks"].iloc[0] == 1)
    return rows


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size), a row per source.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share``
    times all sizes; a target stops at ``cap`` times its source's size, and what is
    over goes to the others by weight.  That is target = min(cap * size, level *
    weight); the level comes from sources in order of cap * size / weight.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", w).withColumn("most", F.lit(cap) * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    total = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("all", F.lit(share) * F.sum("source_size").over(total))
    rows = rows.withColumn("full", F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    # level: if this source and all after it stay below their caps; the first one that does decides, later ones give less
    rows = rows.withColumn("level", (F.col("all") - F.col("full")) / F.col("open"))
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))).over(total)
    return rows.withColumn("level", level).select("source", "source_size", F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most"))).cast("double").alias("target"))


def mix(units: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK) -> DataFrame:
    """(unit, source, size, n_rows, source_size, target, times) per distinct (unit, source, size) of ``units``.

    ``unit`` is a long that tells rows apart for the random order; n_rows rows with equal
    units, sources and sizes are taken ``times`` times, a long, together.  Sizes are not
    negative; a null size counts as 0 and such rows are drawn like others; a null unit or
    source is a value like others.  Results depend on the units and sizes alone, so reruns
    agree.  An empty table gives an empty one.
    """
    scratch = Scratch(units.sparkSession, "mix")
    rows = units.select("unit", "source", F.coalesce("size", F.lit(0)).cast("long").alias("size")).groupBy("unit", "source", "size").agg(F.count("*").alias("n_rows"))
    rows = scratch.save(rows, "rows")
    by = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n_rows")).alias("source_size"), F.count("*").alias("n_source"))
    per = targets(by.select("source", "source_size"), weights, share, cap).join(
        by.select(F.col("source").alias("s"), "n_source"), F.col("source").eqNullSafe(F.col("s"))
    )
    per = scratch.save(per.select(F.col("source").alias("s"), "source_size", "target", "n_source"), "sources")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)) * F.col("n_rows")
    mixed = F.xxhash64(F.coalesce("unit", F.lit(-1)), "size", F.lit(7))
    drawn = rows.join(small(per), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    drawn = drawn.withColumn("whole", F.floor(rate)).withColumn("p", rate - F.floor(rate)).withColumn("mixed", mixed)
    drawn = drawn.withColumn("blocks", F.ceil(F.col("n_source") / block)).withColumn("block", F.pmod("mixed", "blocks")).drop("n_source")
    schema = drawn.schema
    now = -(-(per.agg(F.max("n_source")).first()[0] or 0) // block)  # blocks of the largest source
    current = scratch.save(drawn.groupBy("source", "block").applyInPandas(_settle, schema), "round-0")
    done, turn = [], 0
    open_ = "p > 0 AND p < 1"
    while now > 1:
        turn, now = turn + 1, max(1, 2 * now // block)
        done.append(current.filter(f"NOT ({open_})"))
        left = F.greatest(F.lit(1), F.floor(2 * F.col("blocks") / block)).cast("long")
        again = current.filter(open_).withColumn("blocks", left).withColumn("block", F.pmod("mixed", "blocks"))
        current = scratch.save(again.groupBy("source", "block").applyInPandas(_settle, schema), f"round-{turn}")
    for d in done:
        current = current.unionByName(d)
    return current.withColumn("times", (F.col("whole") + F.round("p")).cast("long")).select("unit", "source", "size", "n_rows", "source_size", "target", "times")


def word_count(text: Column) -> Column:
    """Number of words without ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def shares(n_rows: Column, times: Column, at: Column) -> Column:
    """How often row ``at``, from 0, of ``n_rows`` equal rows is taken that are taken ``times`` times together."""
    return F.floor(times / n_rows) + F.when(at < times % n_rows, 1).otherwise(0)


#: Equal rows that one step lays out.
_STEP = 10_000


def mix_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of documents, sizes in words.

    Null and empty texts have size 0; null doc_ids and sources are values like others;
    rows equal in doc_id, source and size share what they are taken together; other
    columns are not read; an empty table gives an empty one.
    """
    found = mix(docs.select(F.col("doc_id").alias("unit"), "source", word_count(F.col("text")).alias("size")))
    found = found.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_rows") - 1) / _STEP))))
    last = F.least(F.col("n_rows") - F.col("step") * _STEP, F.lit(_STEP)) - 1
    found = found.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    taken = F.col("size") * shares(F.col("n_rows"), F.col("times"), F.col("at") + F.col("step") * _STEP)
    return found.select(F.col("unit").alias("doc_id"), "size", "source_size", "target", taken.cast("long").alias("taken"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"))
