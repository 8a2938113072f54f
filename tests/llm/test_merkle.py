"""Merkle manifest: roots, proofs and verification against plain Python; tampering; odd rows."""

import hashlib
import zlib

import pytest

from litmine.llm import merkle_manifest as mm

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, digest string, grp int, root string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(digests):
    """The root of some digests, and for each the (left, right) of its siblings, level by level."""
    at, proofs, level = list(range(len(digests))), [[] for _ in digests], list(digests)
    while len(level) > 1:
        for k, a in enumerate(at):
            start = a // 16 * 16
            run = level[start : start + 16]
            proofs[k].append(("".join(run[: a - start]), "".join(run[a - start + 1 :])))
            at[k] = a // 16
        level = [h(*level[k : k + 16]) for k in range(0, len(level), 16)]
    return level[0], proofs


def plain(rows):
    """doc_id, leaf, subroot, root, proof, folded root and verdict of (doc_id, source, lang, n_chars, text)."""
    low, none = {}, lambda x: (x is not None, x)
    for r in rows:
        low.setdefault(r[1], []).append(r)
    names = sorted(low, key=lambda s: (s is not None, (s or "").encode()))
    inner = {s: sorted(low[s], key=lambda r: (none(r[0]) if r[0] is not None else (False, 0), leaf(r))) for s in names}
    trees = {s: climb([leaf(r) for r in inner[s]]) for s in names}
    if not names:
        return []
    root, upper = climb([trees[s][0] for s in names])
    out = []
    for s, above in zip(names, upper):
        for r, own in zip(inner[s], trees[s][1]):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]) if tampered else r[4]
            acc = leaf((*r[:4], text))
            for left, right in own + above:
                acc = h(left, acc, right)
            out.append((r[0], leaf(r), trees[s][0], root, h(*(a + b for a, b in own + above)), acc, acc == root))
    return sorted(out, key=repr)


def run(spark, rows):
    from litmine.llm.common import ascii_lower
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    hit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    now = {"text": F.when(hit, ascii_lower(F.col("text"))).otherwise(F.col("text"))}
    got = mm.verify(mm.manifest(docs, current=now)).collect()
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got), key=repr)


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17, 257])
def test_one_source(spark, n):
    rows = [(i * 3, "s", None if i % 4 else "en", i, f"Text {i}") for i in range(n)]
    assert run(spark, rows) == plain(rows)


def test_odd_rows(spark):
    rows = [
        (1, None, "en", 1, "A"), (2, None, None, None, None), (None, None, "en", 3, "No id"), (None, "b", "de", 3, ""), (3, "", "en", 2, "Empty name"), (4, "b", "en", 2, "é Ü"), (4, "b", "en", 2, "é Ü"),
        (4, "b", "en", 2, "Other Text"), (5, "Z", "en", -1, "words " * 20_000), (6, "a", "x", 0, "-"), (7, "é", "x", 0, "1:a"), (8, "\U0001f600", "x", 0, "q"), (9, "￮", "x", 0, "Q"),
    ]
    assert run(spark, rows) == plain(rows)


def test_many_sources(spark):
    """Two levels of sources, and one of them with most rows over several tasks."""
    rows = [(i, f"s{i % 40}" if i % 2 else "hot", "en", i, f"Row {i}") for i in range(1000)]
    got = run(spark, rows)
    assert got == plain(rows)
    assert not all(r[-1] for r in got) and len({r[3] for r in got}) == 1


def test_without_changes_all_verify(spark):
    docs = spark.createDataFrame([(i, "s", "en", i, f"T{i}", "", 0, "") for i in range(40)], SCHEMA)
    assert all(r.verified for r in mm.verify(mm.manifest(docs)).collect())


def test_whole_table(spark):
    pa = pytest.importorskip("pyarrow.parquet")
    rows = [tuple(r[c] for c in mm.COLUMNS) for r in pa.read_table(f"{SF}/documents.parquet").to_pylist()]
    got = mm.op13_merkle_manifest(spark, SF).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(rows)
