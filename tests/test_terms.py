"""Stored dictionaries against tries and all comparisons."""

import json
import random

import numpy as np
import pandas as pd
import pytest

from litmine.operators import ner, terms

KEY = ["doc_id", "start", "end", "label", "canonical", "text"]


def rows(found):
    return sorted(map(repr, found.select(KEY).collect()))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    some = ["leaf", "leaf oil", "gas-chromatography", "gas", "α-pinene", "alpha pinene", "basil", "oil of basil", "(E)-2-hexenal", "mass", "a b c d", "b c", "!"]
    labels = ["PLANT PART", "SPECIES", "CHEMICAL", "ANALYTICAL TECHNIQUE", "SEASON"]
    entries = [(label, w.lower(), w.upper()) for w in some for label in labels if rng.random() < 0.6]
    entries += [("SPECIES", "leaf", "second"), ("SPECIES", "leaf", "second"), ("SEASON", " ", "no pieces"), ("SEASON", "mass", None)]
    docs = [(k, " ".join(rng.choice([*some, "gas–chromatography", "a", "b", "c", "D", ","]) for _ in range(40))) for k in range(40)]
    docs += [(100, None), (101, ""), (102, "a b c d " * 5000)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(entries, "label string, pattern string, canonical string")


@pytest.mark.parametrize("match", [ner.match_trie, ner.match_chemicals, ner.match_techniques, ner.match_all])
def test_stored_dictionary_equals_tries(spark, corpus, tmp_path, match):
    docs, dictionary = corpus
    dictionary = dictionary.filter("canonical IS NOT NULL") if match is ner.match_all else dictionary  # it sorts by the name
    got = rows(match(spark, docs, ner.store_dictionary(dictionary, str(tmp_path))))
    assert got == rows(match(spark, docs, dictionary)) and len(got) > 100


def test_many_buckets_equal_all_comparisons(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(terms, "BUCKET", 50)
    rng = random.Random(6)
    known = sorted({" ".join(rng.choice("abcdefghijkl") * rng.choice([1, 2]) for _ in range(rng.randint(1, 4))) for _ in range(4000)})
    dictionary = spark.createDataFrame([("SPECIES", w, w.upper()) for w in known], "label string, pattern string, canonical string")
    texts = [[rng.choice("abcdefghijkl") * rng.choice([1, 2]) for _ in range(300)] for _ in range(20)]
    path = ner.store_dictionary(dictionary, str(tmp_path))
    assert spark.read.parquet(path).filter("which = 0").count() > 60
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    got = sorted((r.doc_id, r.canonical, r.text) for r in ner.match_trie(spark, docs, path).collect())
    held = set(known)
    want = [(k, g.upper(), g) for k, t in enumerate(texts) for n in range(1, 5) for i in range(len(t) - n + 1) if (g := " ".join(t[i : i + n])) in held]
    assert got == sorted(want) and len(got) > 1000


def test_no_terms(spark, corpus, tmp_path):
    docs, dictionary = corpus
    assert ner.match_all(spark, docs, ner.store_dictionary(dictionary.filter("false"), str(tmp_path / "none"))).count() == 0
    nulls = dictionary.selectExpr("label", "CAST(NULL AS STRING) AS pattern", "canonical", "1 AS text")
    assert ner.match_trie(spark, docs, ner.store_dictionary(nulls, str(tmp_path / "nulls"))).count() == 0


def test_larger_dictionaries_are_to_be_stored(spark, corpus, monkeypatch):
    monkeypatch.setattr(ner, "MAX_TERMS", 3)
    with pytest.raises(ValueError, match="store_dictionary"):
        ner.match_trie(spark, *corpus)


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(terms, "_hashes", lambda pieces: np.zeros(len(pieces), np.uint64))
    ends = [json.dumps([[w], "L", w.upper()]) for w in ("a", "b")]
    packed = terms._packed(pd.DataFrame({"which": 0, "bucket": 0, "hash": np.zeros(2, np.int64), "term": ends})).iloc[0]
    table = object.__new__(terms.Terms)
    table.keys, table.first, table._decoded = np.frombuffer(packed["keys"], np.uint64), np.array([0, 2]), {}
    table.ends, table.data = np.append(0, np.cumsum(np.frombuffer(packed["sizes"], np.uint32))).astype(int), np.frombuffer(packed["data"], np.uint8)
    assert list(table.find([("b", 0, 1), ("c", 2, 3), ("a", 4, 5)])) == [("L", "B", 0, 1), ("L", "A", 4, 5)]
    assert "a" in table and "c" not in table
