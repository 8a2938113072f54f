"""Title matching is complete: equal to all pairs, for misspelt, short, long and repeated titles."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest

from litmine.operators import titles as T
from litmine.operators.chunking import match_title_to_works

WORDS = "essential oils from basil leaves composition antimicrobial activity of thymol rich extracts in vitro against fungi and the role seasonal variation".split()


def misspelt(rng, text, n):
    out = list(text)
    for _ in range(n):
        k = rng.randrange(len(out) + 1)
        out[k : k + rng.choice((0, 1))] = rng.choice(("", "x", "e", "ss", " "))
    return "".join(out)


def best(title, works, least):
    scored = [(-SequenceMatcher(None, title.lower(), w.lower()).ratio(), i) for i, w in works if w and w.strip()]
    scored = [x for x in scored if -x[0] >= least]
    return min(scored) if scored else None


def compare(spark, titles, works, least=0.6):
    t = spark.createDataFrame([(i, x, None) for i, x in titles], "doc_id long, title string, doi string")
    w = spark.createDataFrame([(i, x, None) for i, x in works], "work_id long, title string, doi string")
    got = {r.doc_id: (-r.score, r.work_id) for r in match_title_to_works(t, w, least).collect()}
    want = {i: b for i, x in titles if x and x.strip() and (b := best(x, works, least))}
    assert got == want
    return got


def test_equal_to_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(T, "LIST", 7)
    monkeypatch.setattr(T, "TITLES", 8)
    monkeypatch.setattr(T, "RECORDS", 16)
    rng = random.Random(4)
    works = [(i, " ".join(rng.sample(WORDS, rng.randint(2, 9))).capitalize()) for i in range(120)]
    titles = [(1000 + k, misspelt(rng, w, rng.choice((0, 1, 3, 8, 15)))) for k, (_, w) in enumerate(works)]
    titles += [(2000 + k, " ".join(rng.sample(WORDS, 4))) for k in range(20)]
    got = compare(spark, titles, works)
    assert sum(-s >= T.HIGH for s, _ in got.values()) > 30 and sum(-s < T.HIGH for s, _ in got.values()) > 30


def test_misspelt_long_words(spark):
    assert compare(spark, [(1, "Essential oils from basil")], [(7, "Essental oil from basils"), (8, "Oils of other plants")])[1][1] == 7


def test_odd_titles(spark):
    works = [(5, "ab"), (4, "AB"), (3, "a"), (2, ""), (1, None), (6, "the same title"), (9, "the same title"), (10, "x" * 150 + "yz" * 40), (11, "ééé ñandú")]
    titles = [(1, "Ab"), (2, "a"), (3, None), (4, "  "), (5, "The Same Title"), (6, "the same title"), (7, "x" * 149 + "yz" * 41), (8, "Ñandú ééé"), (9, "zzzz"), (5, "The Same Title")]
    compare(spark, titles, works)
    compare(spark, [], works)
    compare(spark, titles, [])


def test_doi_comes_first(spark):
    t = spark.createDataFrame([(1, "a title", "10.1/x"), (2, "a title", "10.1/none"), (3, "a title", None)], "doc_id long, title string, doi string")
    w = spark.createDataFrame([(9, "quite other", "10.1/x"), (8, "quite other", "10.1/x"), (7, "a title", None)], "work_id long, title string, doi string")
    assert {tuple(r) for r in match_title_to_works(t, w).collect()} == {(1, 8, 1.0), (2, 7, 1.0), (3, 7, 1.0)}


def test_no_table_passes_through_the_driver(spark, monkeypatch):
    """Whatever the sizes, nothing of the titles or works is broadcast, in any of the jobs."""
    monkeypatch.setattr(T, "RECORDS", 16)
    plans = []
    monkeypatch.setattr(T, "best_of", lambda found, key, f=T.best_of: (plans.append(found), f(found, key))[1])
    t = spark.createDataFrame([(k, " ".join(WORDS[k : k + 5]) + "xxxx", None) for k in range(12)], "doc_id long, title string, doi string")
    w = spark.createDataFrame([(k, " ".join(WORDS[k : k + 5]), None) for k in range(12)], "work_id long, title string, doi string")
    done = match_title_to_works(t, w)
    assert done.count() == 12
    for rows in (done, *plans):
        rows.collect()
        assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()


def test_records_below_the_floor_are_not_compared(monkeypatch):
    compared = []
    monkeypatch.setattr(T, "ratio", lambda a, b, f=T.ratio: (compared.append(b), f(a, b))[1])
    rng = random.Random(2)
    records = [" ".join(rng.sample(WORDS, 6)) for _ in range(200)]
    block = T._Block(records, list(range(200)))
    title = misspelt(rng, records[77], 3)
    known = SequenceMatcher(None, title, records[77]).ratio()
    assert block.best(title, known) == block.best(title, 0.0) == (77, known)
    compared.clear()
    assert block.best(title, known) == (77, known) and len(compared) < 5
    assert block.best(title, 0.99) is None


@pytest.mark.parametrize("length", [5, 64, 65, 200])
def test_bounds_hold(length):
    rng = random.Random(length)
    records = ["".join(rng.choice("abcd ") for _ in range(rng.randint(0, length))) for _ in range(50)]
    of = {c: k for k, c in enumerate("abcd ")}
    codes = np.full((50, length), len(of), np.int32)
    for row, text in zip(codes, records):
        row[: len(text)] = [of[c] for c in text]
    title = "".join(rng.choice("abcde ") for _ in range(length))

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for k, y in enumerate(b):
                new.append(max(new[-1], row[k + 1], row[k] + (x == y)))
            row = new
        return row[-1]

    bound = T.lcs_bounds(title, codes, of)
    for k, r in enumerate(records):
        assert bound[k] >= lcs(title, r) >= sum(m.size for m in SequenceMatcher(None, title, r).get_matching_blocks())
        assert length > 64 or bound[k] == lcs(title, r)


def test_query_equals_all_pairs(spark):
    import re

    pq = pytest.importorskip("pyarrow.parquet")
    from litmine.plans.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    found = {r["page_id"]: re.search(r"(?is)<title[^>]*>(.*?)</title>", r["html"] or "") for r in pq.read_table(f"{sf}/pages.parquet").to_pylist()}
    pages = {k: m[1] if m else "" for k, m in found.items()}

    def quoted(k, t):
        t = t[3:] if k % 3 != 1 else t
        return re.sub("[aou](.{6})", r"\1e", t) if k % 3 else t

    want = {k: (-1.0, k) if k % 2 == 0 else best(quoted(k, t), pages.items(), 0.6) for k, t in pages.items() if k % 2 == 0 or quoted(k, t).strip()}
    got = {r.doc_id: (-r.score, r.work_id) for r in QUERIES["c22_match_title_to_works"](spark, sf).collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_records_that_share_too_few_grams_are_not_bounded(monkeypatch):
    """From a known similarity on, a block's records cost a look at lists, not a bound or a comparison each."""
    bounded, compared = [], []
    monkeypatch.setattr(T, "lcs_bounds", lambda t, codes, of, f=T.lcs_bounds: (bounded.append(len(codes)), f(t, codes, of))[1])
    monkeypatch.setattr(T, "ratio", lambda a, b, f=T.ratio: (compared.append(b), f(a, b))[1])
    rng = random.Random(6)
    records = [" ".join("".join(rng.choice("aeiouthrsn") for _ in range(rng.randint(2, 7))) for _ in range(9)) for _ in range(2000)]
    block = T._Block(records, list(range(2000)))
    for n in (0, 1, 3, 5):
        title = misspelt(rng, records[1500], n)
        known = SequenceMatcher(None, title, records[1500]).ratio()
        assert known >= T.HIGH and block.best(title, known) == (1500, known)
    assert sum(bounded) == 0 and len(compared) < 20


@pytest.mark.parametrize("least", [0.85, 0.9, 0.95, 1.0])
def test_blocks_lose_nothing(least):
    """Repeated grams, short, empty and equal ones, characters beyond the plane: the same as all pairs."""
    rng = random.Random(int(1000 * least))
    parts = ["the ", "th", "e", "aaaa", "aa", "é", "😀😀", " ", "ab", "thethe"]
    records = sorted({"".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(400)}, key=len)
    block = T._Block(records, list(range(len(records))))
    titles = [misspelt(rng, rng.choice(records), rng.choice((0, 1, 2, 3))) for _ in range(200)]
    for title, lists in zip(titles, block.lists(titles)):
        scored = [(-SequenceMatcher(None, title, r).ratio(), i) for i, r in enumerate(records)]
        first = min(x for x in scored) if scored else None
        want = (first[1], -first[0]) if -first[0] >= least else None
        assert block.best(title, least, lists) == block.best(title, least) == want


def test_titles_without_a_rare_gram(spark, monkeypatch):
    """What starts from no rare gram's record starts from the one that shares most short grams."""
    monkeypatch.setattr(T, "LIST", 0)
    monkeypatch.setattr(T, "RECORDS", 16)
    rng = random.Random(8)
    works = [(i, " ".join(rng.sample(WORDS, rng.randint(2, 9)))) for i in range(60)]
    titles = [(1000 + k, misspelt(rng, w, rng.choice((1, 2, 6)))) for k, (_, w) in enumerate(works)]
    compare(spark, titles, works)
    t, w = spark.createDataFrame([(x, None) for _, x in titles], "text string, floor double"), spark.createDataFrame(works, "work_id long, text string")
    got = {r.text: r.floor for r in T.better_guesses(t, w).collect()}
    near = {x: max(SequenceMatcher(None, x, y).ratio() for _, y in works) for _, x in titles}
    assert set(got) == set(near) and all((got[x] or 0) <= near[x] for x in near) and sum(got[x] == near[x] for x in near) > 50
