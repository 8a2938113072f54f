"""Quotes in chunks, by the longest common piece."""

import random
import time
from difflib import SequenceMatcher

from hypothesis import given, settings
from hypothesis import strategies as st

from litmine.operators.citations import Runs, quote_matches_chunk


def longest(a, b):
    return SequenceMatcher(None, a, b, autojunk=False).find_longest_match(0, len(a), 0, len(b)).size


@given(st.text("abé ", max_size=40), st.text("abé ", max_size=60))
@settings(max_examples=300, deadline=None)
def test_longest_piece_equals_all_comparisons(a, b):
    assert Runs(a).longest_in(b) == longest(a, b)


def test_quotes_equal_brute_force(spark):
    rng = random.Random(4)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    rows = []
    for k in range(400):
        chunk = " ".join(rng.choice(words) for _ in range(40))
        start, n = rng.randrange(60), rng.randrange(1, 80)
        quote = list(chunk[start : start + n])
        for _ in range(rng.randrange(3)):  # damage near an end leaves 80 % in one piece, in the middle it does not
            quote[rng.choice([0, 1, len(quote) // 6, len(quote) // 2, -1]) % len(quote)] = "#"
        rows.append((k, "".join(quote), chunk))
    rows += [(1000, None, "text"), (1001, "text", None), (1002, "", "text"), (1003, "aaaaaaaaab", "a" * 9), (1004, "baaaa", "a" * 4), (1005, "bbaaa", "a" * 50)]
    df = spark.createDataFrame(rows, "k int, quote string, chunk_text string")
    from pyspark.sql import functions as F

    from litmine.functions.scalars import normalize_text

    plain = df.select("k", normalize_text(F.col("quote")).alias("q"), normalize_text(F.col("chunk_text")).alias("c")).collect()
    want = {r.k: bool(r.q) and bool(r.c) and (r.q in r.c or longest(r.q, r.c) >= 0.8 * len(r.q)) for r in plain}
    got = {r.k: bool(r.verified) for r in quote_matches_chunk(df).collect()}
    assert got == want and 100 < sum(want.values()) < 400


def test_long_chunk_takes_one_pass():
    quote, chunk = "ab" * 300 + "c", "ab" * 60_000
    runs, start = Runs(quote), time.perf_counter()
    assert runs.longest_in(chunk) == 600 and time.perf_counter() - start < 1
