"""Fuzzy places are those of a pattern search, without a pattern for each chunk."""

import random
import re

from litmine.operators import chunking


def plain(text, chunk, cursor):
    stop = chunk.find(".")
    anchors = [chunk, *(chunk[:n] for n in (200, 100, 80, 50) if len(chunk) > n), *([chunk[:stop]] if stop > 20 else [])]
    for anchor in anchors:
        if pattern := r"\s+".join(map(re.escape, anchor.split())):
            for start in (cursor, 0):
                if m := re.compile(pattern).search(text, start):
                    return m.start()
    return -1


def test_places_equal_a_pattern_search():
    rng = random.Random(5)
    some = lambda n: "".join(rng.choice(["a", "b", "é", ".", " ", "  ", "\n", "\t", "\x1c", " "]) for _ in range(n))
    seen = set()
    for _ in range(4000):
        text = some(rng.randrange(0, 120))
        k = rng.randrange(0, len(text) + 1)
        chunk = text[k : k + rng.randrange(0, 70)].replace(" ", "  ") + rng.choice(["", "", "zz", some(5)])
        cursor = rng.randrange(0, len(text) + 2)
        want = plain(text, chunk, cursor)
        assert chunking.locate_fuzzy(text, chunk, cursor) == want, (text, chunk, cursor)
        seen.add((want >= 0) + (want >= cursor))
    assert seen == {0, 1, 2}


def test_no_pattern_is_made_for_a_chunk(monkeypatch):
    monkeypatch.setattr(chunking.re, "compile", None)
    assert chunking.locate_fuzzy("one  two\nthree", "two three", 0) == 5
