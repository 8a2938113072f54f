"""Near duplicates by an inverted join over MinHash signature coordinates.

A document's signature has COORDINATES min-hashes; each (coordinate, value) pair
is a token and the document is posted under it.  Documents with a Jaccard
similarity of 0.75 agree on 48 of 64 coordinates on average, and on fewer than
MATCHES = 32 with a chance of a few in a million, so pairs that share MATCHES
tokens are candidates.  Two steps keep the lists short:

* skip: a token that one document alone holds can't collide; it is dropped when
  tokens are counted, which is most of them;
* prefix: with tokens in order of global frequency, two sets of 64 that share 32
  must share one of the 33 rarest of either, so only those are posted.

What remains long are lists of true groups of copies.  Equal shingle sets are one
node from the start.  In a list of more than SMALL_LIST nodes, all are paired with
the most typical node only.  When the groups so found are known, the nodes of lists
that still hold several groups are joined once more by the same prefix rule, now over
their full shingle sets (of n shingles 3n/4 must be shared, so the n/4 + 1 rarest
are posted): first with the most typical node of each such list, then, with a bound from
a shared token's positions, nodes outside a list's largest group with nodes of other
groups.  The smaller set of a pair must have its first shared token in its first
seventh (see ``_across``), which one side of that join is cut to: pages of one template
that are less alike than the threshold are not paired.  No pair between different groups
is left out, pairs within a group are not made.  Pairs with MATCHES equal coordinates are confirmed on full shingle sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmine.llm.common import Scratch, components, small, table

SHINGLE = 5
COORDINATES, MATCHES = 64, 32
SMALL_LIST = 8
#: Tokens before a posting that tell repeats of a pair.
RECENT = 8
SIMILAR = (75, 100)

_RNG = np.random.default_rng(20240229)
_XOR = _RNG.integers(0, 1 << 32, COORDINATES, dtype=np.uint32)[:, None]
_ODD = (_RNG.integers(0, 1 << 32, COORDINATES, dtype=np.uint32) | np.uint32(1))[:, None]


class _Hashes(dict):
    """Hash of each word, remembered; emptied at a million words, so its size is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles of a lower-cased text."""
    words = (text or b"").lower().split()  # bytes: lowers A-Z only, splits at 0x20 and 0x09-0x0D
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(SHINGLE, len(words))
    acc = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(acc)]
    return np.unique(mix(acc))


def signature(shingles: np.ndarray) -> np.ndarray:
    low, best = (shingles >> np.uint64(32)).astype(np.uint32), np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 2048):
        np.minimum(best, ((low[i : i + 2048] ^ _XOR) * _ODD).min(axis=1), out=best)
    return best


_SIGNED = "doc_id long, text_hash long, n_shingles long, set_id string, sig array<int>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()
    for batch in batches:
        texts = batch.column(2).cast(pa.binary())
        n, ids, sigs = [], [], []
        for t in texts:
            s = shingle_set(t.as_py(), hashes)
            n.append(len(s))
            ids.append(xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None)
            sigs.append(signature(s).view(np.int32) if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(sigs, pa.list_(pa.int32()))],
            ["doc_id", "text_hash", "n_shingles", "set_id", "sig"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()
    for batch in batches:
        sets = [shingle_set(t.as_py(), hashes).tobytes() for t in batch.column(1).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "shingles"])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()
    for batch in batches:
        sets = [shingle_set(t.as_py(), hashes).view(np.int64) for t in batch.column(1).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "tokens"])


def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs that are similar enough on their full sets."""
    for batch in batches:
        left, right = batch.column(2), batch.column(3)
        keep = []
        for i in range(batch.num_rows):
            x = np.frombuffer(left[i].as_buffer(), np.uint64)
            y = np.frombuffer(right[i].as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(SIMILAR[1] * both >= SIMILAR[0] * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def postings(tokens: DataFrame, recent: int = 0) -> DataFrame:
    """(token, id, typical, size, at, before): prefix postings of sets given as rows (id, size, need, token).

    Sets that are to be found share at least ``need`` of their ``size`` tokens with one
    another.  ``typical`` is the sum of a set's token counts: high for one that many
    others resemble.  ``at`` is the token's position, from 0, in the set's order of
    rising frequency, in which tokens of one set alone come first; ``before`` has the
    ``recent`` posted tokens that stand next before it there.
    """
    shared = tokens.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1")
    lists = (
        tokens.join(shared, "token")
        .groupBy("id", "size", "need")
        .agg(F.sum("n").alias("typical"), F.sort_array(F.collect_list(F.struct("n", "token"))).alias("by_n"))
        .filter(F.size("by_n") >= F.col("need"))
    )
    prefix = F.slice("by_n", F.lit(1), (F.size("by_n") - F.col("need") + 1).cast("int"))
    each = lists.select("id", "typical", "size", (F.col("size") - F.size("by_n")).alias("alone"), prefix.alias("prefix")).select("*", F.posexplode("prefix").alias("k", "t"))
    before = F.transform(F.slice("prefix", F.greatest(F.col("k") - recent, F.lit(0)) + 1, F.least("k", F.lit(recent))), lambda x: x["token"])
    return each.select("id", "typical", "size", (F.col("alone") + F.col("k")).alias("at"), F.col("t.token").alias("token"), *([before.alias("before")] if recent else []))


def _mixed(placed: DataFrame) -> DataFrame:
    """Of (token, id, component): the lists of more than one component, with their largest as ``main``."""
    groups = placed.groupBy("token", "component").agg(F.count("*").alias("m"))
    main = groups.groupBy("token").agg(F.max_by("component", F.struct("m", "component")).alias("main"), F.count("*").alias("groups")).filter("groups > 1")
    return placed.join(main.select("token", "main"), "token")


def _across(mixed: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of different components that may be similar, from ``_mixed`` postings of full sets.

    With sizes s <= l and first shared tokens at positions p and q, an overlap of 75 / 175
    of s + l must fit into s - p and l - q.  As s + l >= 2 s, p is at most s / 7: only such
    postings can be the smaller side.  Of two nodes one is outside the list's main component.
    A token is not their first shared one if tokens before it are shared as well; such
    repeats of a pair are left out, as far as ``before`` shows them.
    """
    a, b = ([F.col(c).alias(f"{c}{side}") for c in ("id", "component", "size", "at", "before")] for side in "ab")
    main, low = F.col("component") == F.col("main"), F.col("at") * sum(SIMILAR) <= F.col("size") * (SIMILAR[1] - SIMILAR[0])
    fits = F.least(F.col("sizea") - F.col("ata"), F.col("sizeb") - F.col("atb")) * sum(SIMILAR) >= (F.col("sizea") + F.col("sizeb")) * SIMILAR[0]
    apart = (F.col("componenta") != F.col("componentb")) & (F.col("sizea") <= F.col("sizeb")) & fits & ~F.arrays_overlap("beforea", "beforeb")
    rest = mixed.filter(low & ~main).select("token", *a).join(mixed.select("token", *b), "token").filter(apart)
    hung = mixed.filter(low & main).select("token", *a).join(mixed.filter(~main).select("token", *b), "token").filter(apart)
    return rest.unionByName(hung).select(F.least("ida", "idb").alias("a"), F.greatest("ida", "idb").alias("b")).distinct()


def _placed(rows: DataFrame, label: DataFrame) -> DataFrame:
    """``rows`` plus the component of their id; a node's postings, few, are joined as one row."""
    rest = [c for c in rows.columns if c != "id"]
    each = rows.groupBy("id").agg(F.collect_list(F.struct(*rest)).alias("rows")).join(label, "id", "left")
    return each.select("id", F.coalesce("component", "id").alias("component"), F.inline("rows"))


def _to_hubs(mixed: DataFrame) -> DataFrame:
    """Pairs (a, b) of each list's most typical node with those of other components."""
    hubs = mixed.groupBy("token").agg(F.max_by(F.struct("id", "component"), F.struct("typical", -F.col("id"))).alias("hub"))
    apart = mixed.join(hubs, "token").filter(F.col("component") != F.col("hub.component"))
    return apart.select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")).distinct()


def _merged(label: DataFrame, more: DataFrame, scratch: Scratch, turn: int) -> DataFrame:
    """``label`` with the components that the links (a, b) of ``more`` join as one; nodes without one are one of their own."""
    ends = more.join(label.toDF("a", "ca"), "a", "left").join(label.toDF("b", "cb"), "b", "left").select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
    top = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")), scratch, f"turn-{turn}").toDF("component", "top")
    alone = ends.select(F.col("a").alias("id")).union(ends.select("b")).distinct().join(label, "id", "left_anti").withColumn("component", F.col("id"))
    every = label.unionByName(alone).join(top, "component", "left").select("id", F.coalesce("top", "component").alias("component"))
    return scratch.save(every, f"label-{turn}")


def linked(
    posted: DataFrame,
    confirm: Callable[[DataFrame], DataFrame],
    tokens_of: Callable[[DataFrame], DataFrame],
    scratch: Scratch,
    small_list: int = SMALL_LIST,
) -> DataFrame:
    """Component (id, component) of every node with a confirmed link.

    ``posted``: (token, id, typical), written; ``confirm`` keeps the pairs (a, b)
    that are links; ``tokens_of`` gives the full sets (id, size, need, token) of ids.
    Exact over all pairs that share a token, as described above.  Of the tables it
    writes only the result stays.
    """
    lists = scratch.save(
        posted.groupBy("token").agg(F.count("*").alias("n"), F.max_by("id", F.struct("typical", -F.col("id"))).alias("hub")).filter("n > 1"), "lists"
    )
    known = posted.join(lists, "token")
    hubs = known.filter((F.col("n") > small_list) & (F.col("id") != F.col("hub"))).select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
    few = known.filter(F.col("n") <= small_list).select("token", "id")
    every = few.alias("x").join(few.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    links = scratch.save(confirm(hubs.unionByName(every).distinct()), "links")
    label = scratch.save(components(links, scratch, "first"), "label-0")
    scratch.drop("links")
    open_ = scratch.save(_mixed(_placed(known.filter(F.col("n") > small_list).select("token", "id"), label)).select("id").distinct(), "open")
    scratch.drop("lists")
    if open_.isEmpty():
        scratch.drop("open")
        return label
    mixed = scratch.save(_mixed(_placed(postings(tokens_of(open_), RECENT), label)), "mixed-0")
    # most of what is apart is near its list's most typical node; the rest is compared across components
    more = scratch.save(confirm(_to_hubs(mixed)), "more-0")
    label = _merged(label, more, scratch, 1)
    mixed = scratch.save(_mixed(_placed(mixed.drop("component", "main"), label)), "mixed-1")
    scratch.drop("mixed-0", "more-0", "label-0")
    more = scratch.save(confirm(_across(mixed)), "more-1")
    label = _merged(label, more, scratch, 2)
    scratch.drop("mixed-1", "more-1", "label-1", "open")
    return label


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept, text_hash.

    component_id is the smallest doc_id that links reach; kept marks that document.
    Texts without words, or null, have no shingles and are linked with nothing:
    they are kept.  Repeated rows get equal results; rows that share a doc_id but not
    the text are placed by their own texts, which ``text_hash`` (xxhash64) tells apart.
    A null doc_id can't be linked: its component_id is null and it is kept.  Other
    columns of ``docs`` are not read, whatever their names; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    signed = scratch.save(plain.mapInArrow(_sign, _SIGNED), "signed")
    # equal sets are one node, and have equal signatures: its first document stands for all of them
    usable = signed.filter("set_id IS NOT NULL AND doc_id IS NOT NULL")
    firsts = usable.groupBy("set_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("m")).select("set_id", "m.*")
    one = usable.join(firsts, ["set_id", "doc_id", "text_hash"]).dropDuplicates(["set_id"]).withColumnRenamed("doc_id", "first")
    nodes = scratch.save(one.withColumn("id", F.monotonically_increasing_id()), "nodes")  # ids are settled by writing them
    token = F.shiftleft(F.col("i").cast("long"), 32).bitwiseOR(F.col("v").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    tokens = nodes.select("id", F.posexplode("sig").alias("i", "v")).select("id", F.lit(COORDINATES).alias("size"), F.lit(MATCHES).alias("need"), token.alias("token"))
    posted = scratch.save(postings(tokens), "posted")
    rounds = iter(range(9))

    def texts_of(ids: DataFrame) -> DataFrame:
        """(id, text) of nodes."""
        at = small(ids.join(nodes.select("id", F.col("first").alias("doc_id"), "text_hash"), "id"))
        return plain.join(at, ["doc_id", "text_hash"]).select("id", "text")

    def confirm(pairs: DataFrame) -> DataFrame:
        turn = next(rounds)
        left = nodes.select(F.col("id").alias("a"), F.col("n_shingles").alias("na"), F.col("sig").alias("sa"))
        right = nodes.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb"), F.col("sig").alias("sb"))
        near = pairs.join(left, "a").join(right, "b").filter(
            (F.least("na", "nb") * SIMILAR[1] >= F.greatest("na", "nb") * SIMILAR[0])
            & (F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda same: same)) >= MATCHES)
        )
        near = scratch.save(near.select("a", "b").distinct(), f"pairs-{turn}")
        ids = scratch.save(near.select(F.col("a").alias("id")).union(near.select("b")).distinct(), f"ids-{turn}")
        sets = scratch.save(texts_of(ids).mapInArrow(_sets, "id long, shingles binary").dropDuplicates(["id"]), f"sets-{turn}")
        full = near.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
        found = scratch.save(full.select("a", "b", "x", "y").mapInArrow(overlap, "a long, b long"), f"found-{turn}")
        scratch.drop(f"pairs-{turn}", f"ids-{turn}", f"sets-{turn}")
        return found

    def tokens_of(ids: DataFrame) -> DataFrame:
        rows = texts_of(ids).mapInArrow(_tokens, "id long, tokens array<long>").dropDuplicates(["id"])
        need = F.ceil(F.size("tokens") * SIMILAR[0] / SIMILAR[1])
        return rows.select("id", F.size("tokens").alias("size"), need.alias("need"), F.explode("tokens").alias("token"))

    label = linked(posted, confirm, tokens_of, scratch)
    least = label.join(nodes.select("id", "first"), "id").groupBy("component").agg(F.min("first").alias("least"))
    place = nodes.select("id", "set_id", "first").join(label, "id", "left").join(least, "component", "left")
    place = scratch.save(place.select(F.col("set_id").alias("of_set"), F.coalesce("least", "first").alias("component_id")), "place")
    scratch.drop("nodes", "posted", "label-0", "label-2", *[f"found-{i}" for i in range(3)])
    found = signed.select("doc_id", "n_shingles", "set_id", "text_hash").join(place, (F.col("set_id") == F.col("of_set")) & F.col("doc_id").isNotNull(), "left")
    found = found.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "text_hash")
    kept = F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "text_hash")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM d WHERE len(w) > 0
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY ALL HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))
), l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a
), c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(len(s.s), 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id JOIN c ON c.a = d.doc_id
"""
