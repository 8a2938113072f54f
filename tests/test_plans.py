"""Plans and edge cases of operators that were slow or scanned twice."""

import re
import random

import pytest
from pyspark.sql import functions as F

from litmine.operators import chunking, citations, dashboard, ner


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sections_plan_stays_small(spark):
    docs = spark.createDataFrame([(1, "# One\nbody\n## Two\nmore")], "doc_id long, text string")
    rows = chunking.detect_sections(docs)
    for df in (rows, rows.filter("ord > 0"), rows.filter("title = 'Two' AND content <> ''"), rows.filter(F.length("content") > 3).select("doc_id")):
        assert len(plan(df)) < 12_000
    assert [(r.ord, r.title, r.content) for r in rows.orderBy("ord").collect()] == [(0, "One", "body"), (1, "Two", "more")]


def test_parents_and_children(spark):
    text = "<!-- Page 3 -->\n# Head\n" + "A sentence of some words here. " * 30
    docs = spark.createDataFrame([(1, "T", text), (2, "T", None), (3, "", " \n ")], "doc_id long, title string, text string")
    parents, children = chunking.parent_child_chunks(docs, (400, 50), (100, 20))
    p, c = parents.orderBy("n").collect(), children.orderBy("ord").collect()
    assert {r.doc_id for r in p} == {r.doc_id for r in c} == {1}
    assert [r.n for r in p] == list(range(len(p))) and [r.ord for r in c] == list(range(len(c)))
    assert all(text[r.start : r.end] == r.body for r in p) and all(r.page == 3 for r in p if r.section == "Head")
    assert all(r.chunk == f"T > {r.section}\n\n{r.body}" and r.chunk_id == f"1_{r.ord}" for r in c)
    assert {r.parent_id for r in c} <= {r.parent_id for r in p}


def test_dashboard_scans_once(spark, tmp_path):
    spark.createDataFrame([(1, "J", 2001), (2, "J", None), (3, None, 2001)], "id long, journal string, year int").write.parquet(f"{tmp_path}/p")
    rows = [(1, "LOCATION", "Rome", '{"country": "Italy"}'), (2, "LOCATION", "Rome", '{"country": "Italy"}'), (2, "LOCATION", None, "{}"), (1, "PLANT PART", "leaf", None), (1, "PLANT PART", "leaf", None)]
    spark.createDataFrame(rows, "paper_id long, label string, canonical_text string, metadata string").write.parquet(f"{tmp_path}/e")
    papers, entities = spark.read.parquet(f"{tmp_path}/p"), spark.read.parquet(f"{tmp_path}/e")
    out = dashboard.dashboard_metrics(papers, entities)
    assert plan(out).count("Relation") == 2
    got = {(r.metric, r.key): r.value for r in out.collect()}
    assert got == {
        ("papers", ""): 3, ("journals", ""): 1, ("entities", ""): 3, ("by_journal", "J"): 2, ("by_year", "2001"): 2,
        ("by_label", "Location"): 1, ("by_label", "Plant Part"): 1, ("by_country", "Italy"): 2,
    }
    empty = dashboard.dashboard_metrics(papers.filter("id < 0"), entities.filter("paper_id < 0")).collect()
    assert {(r.metric, r.key, r.value) for r in empty} == {("papers", "", 0), ("journals", "", 0), ("entities", "", 0)}


def test_overlaps_against_plain(spark):
    rng = random.Random(1)
    rows = [(d, a, a + rng.randint(1, 9), "L", f"t{k}") for d in range(5) for k in range(200) for a in [rng.randrange(300)]]
    want = []
    for d in range(5):
        upto = -1
        for r in sorted((r for r in rows if r[0] == d), key=lambda r: (r[1], -r[2], r[3], r[4])):
            if r[1] >= upto:
                want.append(r)
                upto = r[2]
    df = spark.createDataFrame([*rows, (9, None, 4, "L", "x")], "doc_id long, start int, end int, label string, text string")
    assert sorted(map(tuple, ner.resolve_overlaps(df).collect()), key=repr) == sorted([*want, (9, None, 4, "L", "x")], key=repr)


@pytest.mark.parametrize("few", [10_000, 1])
def test_ngrams_with_and_without_the_set(spark, monkeypatch, few):
    monkeypatch.setattr(ner, "FEW_GRAMS", few)
    docs = spark.createDataFrame([(1, "Of the basil, of the  BASIL leaf"), (2, None), (3, "leaf")], "doc_id long, text string")
    terms = spark.createDataFrame([("A", "of the basil", "x"), ("B", "basil", "y"), ("B", "leaf", "z"), ("C", "the basil leaf", "w")], "label string, pattern string, canonical string")
    got = sorted(map(tuple, ner.match_ngrams(docs, terms).select("doc_id", "text", "start", "end").collect()))
    assert got == [(1, "basil", 2, 3), (1, "basil", 5, 6), (1, "leaf", 6, 7), (1, "of the basil", 0, 3), (1, "of the basil", 3, 6), (1, "the basil leaf", 4, 7), (3, "leaf", 0, 1)]


def test_apart_as_pattern():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("ab -") for _ in range(40))
        term = "".join(rng.choice("ab -") for _ in range(rng.randint(1, 4)))
        assert ner._apart(text, term) == len(re.findall(rf"(?<!\w){re.escape(term)}(?!\w)", text))


def test_counts_of_documents_without_text(spark):
    entities = spark.createDataFrame([(1, "L", "basil", "Basil"), (2, "L", "basil", "basil")], "doc_id long, label string, canonical string, text string")
    docs = spark.createDataFrame([(1, "Basil, basil oil; basils")], "doc_id long, text string")
    assert {(r.doc_id, r.display, r["count"]) for r in ner.group_with_counts(entities, docs).collect()} == {(1, "Basil", 2), (2, "basil", 1)}


def test_first_difference(spark):
    rows = [(1, "abé", 0, 3), (2, "abx", 0, 3), (3, "éb", 2, 4), (4, "", 0, 2), (5, "ab", 0, 3)]
    docs = spark.createDataFrame([(i, "abéz") for i in range(1, 6)], "doc_id long, text string")
    out = chunking.validate_offsets(spark.createDataFrame(rows, "doc_id long, chunk string, start int, end int"), docs)
    assert [(r.doc_id, r.status, r.first_diff) for r in out.orderBy("doc_id").collect()] == [(1, "ok", None), (2, "mismatch", 2), (3, "mismatch", 1), (4, "mismatch", 0), (5, "mismatch", None)]


def test_sentences_are_as_before():
    text = "Basil (Ocimum B. L.) grows. It smells, e.g. of cloves! See Fig. 2. Done?\n- item. one\n## Head. two\nlast"
    assert [s for s, _, _ in citations.sentence_spans(text)] == ["Basil (Ocimum B. L.) grows.", "It smells, e.g. of cloves!", "See Fig. 2.", "Done?", "- item. one", "## Head. two", "last"]


def test_span_pairs_against_plain(spark):
    from litmine.operators import evaluation

    rng = random.Random(9)
    span = lambda: (rng.randrange(3), rng.choice("AB"), s := rng.randrange(60), s + rng.randint(1, 12))
    gold, pred = [span() for _ in range(80)], [span() for _ in range(90)]
    pred += gold[::4] + gold[:2]
    want = {}
    for d, label in {x[:2] for x in gold + pred}:
        g, p = (sorted([x[2:] for x in xs if x[:2] == (d, label)], key=lambda x: (x[0], -x[1])) for xs in (gold, pred))
        sizes, strict, partial = (len(g), len(p)), 0, 0
        for x in list(g):
            if x in p:
                strict += 1
                g.remove(x)
                p.remove(x)
        for a, b in g:
            hit = next((y for y in p if y[0] < b and a < y[1]), None)
            if hit:
                partial += 1
                p.remove(hit)
        want[d, label] = (strict, partial, *sizes)
    schema = "doc_id long, label string, start int, end int"
    got = evaluation.match_spans(spark.createDataFrame(gold, schema), spark.createDataFrame(pred, schema)).collect()
    assert {(r.doc_id, r.label): tuple(r)[2:] for r in got} == want
