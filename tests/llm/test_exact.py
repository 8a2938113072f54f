"""Exact dedup: fingerprints that compose, collisions, large groups, odd rows."""

import hashlib
import random
import re

import pytest

from litmine.llm import exact_dedup as ex

SCHEMA = "doc_id long, text string, kept boolean, sha string, id int"


def plain(rows):
    """Brute force: (doc_id, keep_id, group_size, sha) of (doc_id, text)."""
    text = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = {}
    for (i, _), t in zip(rows, text):
        groups.setdefault(t, []).append(i)
    least = {t: min((i for i in g if i is not None), default=None) for t, g in groups.items()}
    return sorted(((i, least[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for (i, _), t in zip(rows, text)), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, True, "s", 1) for i, t in rows], SCHEMA)


def check(spark, rows, **options):
    got = ex.exact_groups(frame(spark, rows), **options).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == plain(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) and all(r.doc_id == r.keep_id for r in kept)
    return got


def test_combine_is_the_whole():
    data = random.Random(1).randbytes(ex.CHUNK)
    for base in ex.BASES:
        for cut in (0, 1, 1000, ex.CHUNK):
            left, right = data[:cut], data[cut:]
            assert ex.combine(ex.chunk_hash(left, base), cut, ex.chunk_hash(right, base), base) == ex.chunk_hash(data, base)
    assert ex.chunk_hash(b"ab", 10, 1_000_003) == ord("a") + 10 * ord("b")


def test_odd_rows(spark):
    rows = [
        (1, None), (2, ""), (3, " \n"), (4, "\t"), (5, "a  b"), (6, "a\r\n b"), (7, "a b "), (8, "A b"), (8, "A b"), (None, "a b"), (None, "x"), (None, "x"),
        (9, "é  ü"), (10, "é \tü"),
    ]
    check(spark, rows)
    assert ex.exact_groups(frame(spark, [])).count() == 0


def test_huge_texts_in_chunks(spark):
    rng = random.Random(2)
    long_ = " ".join(rng.choice(("alpha", "bêta", "gamma  x")) for _ in range(40_000))
    other = long_[:-1] + "y"
    swapped = long_[ex.CHUNK :] + long_[: ex.CHUNK]
    check(spark, [(1, long_), (2, long_.replace(" ", "\n")), (3, other), (4, swapped), (5, long_), (5, long_), (6, other), (None, long_)])


@pytest.mark.parametrize("stream_rows", [256, 3])
def test_collisions_are_told_apart(spark, stream_rows):
    """With few fingerprints nearly all texts of a length collide."""
    rng = random.Random(3)
    rows = [(i, rng.choice("abcdefgh") + rng.choice("xy ")) for i in range(150)]
    check(spark, rows, prime=2, stream_rows=stream_rows)


def test_large_group_in_streams(spark):
    rows = [(i, "one  text" if i % 2 else f"text {i}") for i in range(1500)]
    got = check(spark, rows)
    assert max(r.group_size for r in got) == 750


def test_drop_copies(spark):
    left = ex.drop_copies(frame(spark, [(3, "a"), (1, "a "), (2, "a"), (2, "b"), (None, "b"), (4, None)])).collect()
    assert sorted((r.doc_id, r.text or "") for r in left) == [(1, "a "), (2, "a"), (2, "b"), (4, "")]
