"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import random

import pytest

from litmine.llm import decontamination, license_scans, line_dedup, mixing, near_dups, quality_rules, secret_scans, sharding, token_counts, url_filters

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size int, shard string, words string, id string"


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with nulls, blanks, a long text, ties and repeats, and columns that operators also use."""
    long_ = words(3000, 1)
    rows = [
        (1, None, "en", "a"), (2, "", "en", None), (3, " \n\t ", "en", "a"), (4, long_, "en", "a"), (5, long_, "en", "b"), (5, long_, "en", "b"),
        (None, "some text of no one", "en", "b"), (6, "one two", "de", "b"), (7, "one two", "de", None), (8, "Ünïcode – “text”\nsecond line é", "fr", "a"),
    ]
    return spark.createDataFrame([(*r, 0, True, 1, "s", "w", "i") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality(odd, none):
    rows = quality_rules.apply_policy(quality_rules.ledger(odd), "v1")
    got = {r.doc_id: r for r in rows.collect()}
    assert len(rows.collect()) == 10 and not got[1].kept and got[4].kept
    assert got[1].measured.n_words == got[2].measured.n_words == 0
    assert quality_rules.ledger(none).count() == 0
    ab = {r.rule: r for r in quality_rules.ablation(rows, "v1").collect()}
    failed = [r for r in rows.collect() if r.fail_bits & 1]
    assert ab["too_few_words"].n_failed == len(failed)
    assert ab["too_few_words"].n_only_this == sum(r.fail_bits == 1 for r in failed)


def test_near_duplicates(odd, none):
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in near_dups.near_duplicates(odd).collect())
    assert len(got) == 10
    by = {g[0]: g for g in got}
    assert by[5][2] == 4 and not by[5][3] and by[4][3]
    assert by[7][2] == 6 and by[1][1:] == (0, 1, True) and by[-1][2] is None and by[-1][3]
    assert near_dups.near_duplicates(none).count() == 0


def test_decontamination(spark, odd, none):
    items = spark.createDataFrame([(1, "One two"), (2, None), (3, "Second LINE é"), (None, "one"), (4, "--")], "item_id long, text string")
    m = {r.doc_id: r for r in decontamination.marks(odd, items).collect()}
    assert len(m[6].hit) == 2 and m[6]["items"] == [1] and m[5].copies == 2 and not m[1].hit
    for limit in (0, 100):
        assert {r.doc_id for r in decontamination.decontaminate(odd, items, set_limit=limit).collect()} == {1, 2, 3, 4, 5, None}
    cut = {r.doc_id: r.text for r in decontamination.decontaminate(odd, items, "cut").collect()}
    assert cut[6].strip() == "" and "one" not in cut[7] and cut[8].startswith("Ünïcode")
    assert decontamination.decontaminate(odd, items.limit(0)).count() == 10
    assert decontamination.decontaminate(none, items).count() == 0


def test_sharding(odd, none):
    rows = sharding.shard_documents(odd, 3).collect()
    assert len(rows) == 10
    sizes = [sum(r.shard == s for r in rows) for s in range(3)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(3):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    assert sharding.shard_documents(none).count() == 0
    assert sharding.shard(odd, 2).columns[-2:] == ["shard", "slot"]


def test_mixing(odd, none):
    rows = mixing.mix_documents(odd).collect()
    assert len(rows) == 10 and all(0 <= r.taken <= 2 * r["size"] for r in rows)
    assert mixing.mix_documents(none).count() == 0
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_documents(odd).collect()))


def test_secrets(odd, none):
    rows = secret_scans.scan_secrets(odd).collect()
    assert len(rows) == 10 and all(r.spans == "" for r in rows if r.doc_id in (1, 2, 3))
    assert secret_scans.scan_secrets(none).count() == 0


def test_licenses(odd, none):
    rows = license_scans.scan_licenses(odd).collect()
    assert len(rows) == 10 and all(r.n_base == 0 and r.labels == "" and r.score == 0 for r in rows)
    assert license_scans.scan_licenses(none).count() == 0


def test_lines(odd, none):
    got = {r.doc_id: r.dropped for r in line_dedup.dropped_lines(odd).collect()}
    assert got == {5: [0], 7: [0]}
    out = line_dedup.dedup_lines(odd)
    assert out.count() == 10 and {r.doc_id: r.text for r in out.collect()}[7] == ""
    assert line_dedup.dedup_lines(none).count() == 0


def test_urls(spark, none):
    model = url_filters.train(spark)
    rows = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "no scheme", "x"), (4, "http://A.Example.org/es/1?q#f", "x"), (5, "http://cheap-pills.example.net", "x"), (6, "x://y.com/fr/", "x")], "page_id int, url string, host string")
    got = {r.page_id: r for r in url_filters.filter_urls(rows, model).collect()}
    assert got[1].host == got[3].host == got[3].path == "" and got[4].host == "a.example.org" and got[4].path == "/es/1"
    assert (got[4].rule, got[4].verdict) == ("example.org/es/", "block") and got[5].verdict == "block" and got[6].rule == "com/fr/"
    assert url_filters.filter_urls(rows.limit(0), model).count() == 0


def test_tokens(odd, none):
    tokenizers = pytest.importorskip("public_tokenizers")
    path = tokenizers.path("piece_bpe_32k.model")
    rows = token_counts.token_counts(odd, path).collect()
    assert len(rows) == 10 and {r.doc_id: r.n_tokens for r in rows}[1] == 0
    assert token_counts.token_counts(none, path).count() == 0
