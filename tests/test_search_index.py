"""The stored index gives what a search over the chunks gives; the stemmer agrees with its published sample."""

import random

import pytest

from litmine.functions.stemming import english_stem
from litmine.operators import retrieval, search_index
from litmine.operators.search_index import Bm25Index

#: The sample vocabulary that is published with the stemmer: word and stem.
SAMPLE = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist
consistently consist consisting consist consists consist consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol
consolidate consolid consolidated consolid consolidating consolid consoling consol consolingly consol consols consol consonant conson consort consort consorted consort
consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir
conspiring conspir constable constabl constables constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri knacks knack knag knag
knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt
knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob
knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot""".split()
RULES = {
    "hopping": "hop", "hoping": "hope", "falling": "fall", "happy": "happi", "say": "say", "by": "by", "cry": "cri", "generously": "generous", "communism": "communism", "relational": "relat", "ties": "tie",
    "cries": "cri", "gaps": "gap", "gas": "gas", "this": "this", "skies": "sky", "youth": "youth", "agreed": "agre", "feed": "feed", "analogies": "analog", "sized": "size", "innings": "inning", "luxuriated": "luxuri",
}


def test_published_sample():
    assert [(w, english_stem(w)) for w in SAMPLE[::2]] == list(zip(SAMPLE[::2], SAMPLE[1::2]))
    assert {w: english_stem(w) for w in RULES} == RULES
    assert [english_stem(w) for w in ("", "a", "é", "extraídos", "2024")] == ["", "a", "é", "extraído", "2024"]


def test_equal_before_and_after_changes(spark, tmp_path):
    rng = random.Random(3)
    vocabulary = "extracting extracts leaf leaves oils oil basil thyme active activity the".split()
    text = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 12)))
    frame = lambda rows: spark.createDataFrame(rows, "chunk_id string, source string, text string")
    live = {(f"{s}{k}", s): text() for s in "abc" for k in range(8)}
    live[("a0", "a")], live[("a1", "a")] = None, ""
    rows = lambda: [(c, s, t) for (c, s), t in live.items()]
    questions = spark.createDataFrame([(1, "Extracted oils of leaves"), (2, "activities"), (3, "nowhere"), (4, None)], "question_id long, question string")
    index = Bm25Index(spark, str(tmp_path), buckets=4)

    def same():
        found = [{tuple(r[c] if c != "score" else round(r[c], 9) for c in ("question_id", "chunk_id", "score", "rank")) for r in df.collect()} for df in (index.topk(questions, 5), retrieval.bm25_topk(questions, frame(rows()), 5))]
        assert found[0] == found[1] and len(found[0]) > 5
        n, avgdl = index.stats().first()
        assert n == len(live) and avgdl == pytest.approx(sum(len((t or "").split()) for t in live.values()) / len(live))
        df = {}
        for t in live.values():
            for w in {english_stem(w) for w in (t or "").split()}:
                df[w] = df.get(w, 0) + 1
        assert {tuple(r) for r in index.terms().collect()} == set(df.items())

    index.add(frame(rows()), 0)
    same()
    for key in [k for k in live if k[1] == "b"]:
        del live[key]
    live |= {(f"b{k}", "b"): text() for k in range(3)} | {("d0", "d"): "extract of thyme"}
    new = frame([(c, s, t) for (c, s), t in live.items() if s in "bd"])
    index.add(new, 1)
    same()
    index.add(new, 1)  # repeated
    same()
    gone = spark.createDataFrame([("a",), ("x",)], "source string")
    index.remove(gone, 2)
    live = {k: t for k, t in live.items() if k[1] != "a"}
    same()
    index.remove(gone, 2)
    index.remove(gone, 3)  # not there any more
    same()
    plan = index.topk(questions)._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in plan


def test_empty_index(spark, tmp_path):
    index = Bm25Index(spark, str(tmp_path))
    questions = spark.createDataFrame([(1, "oil")], "question_id long, question string")
    assert index.topk(questions).count() == 0
    index.add(spark.createDataFrame([], "chunk_id string, source string, text string"), 0)
    assert index.topk(questions).count() == 0 and index.stats().first().n == 0


def test_tasks_keep_their_size(spark, tmp_path, monkeypatch):
    """More texts or questions are more partitions; a bucket of the index is written by several tasks; results stay."""
    rows = spark.createDataFrame([(k, "s", f"extracting leaf oils {'thyme ' * (k % 5)}") for k in range(40)], "chunk_id long, source string, text string")
    questions = spark.createDataFrame([(1, "Extracted oils of leaves"), (2, "thyme")], "question_id long, question string")
    ranked = lambda df: sorted((r.question_id, r.chunk_id, round(r.score, 9), r["rank"]) for r in df.collect())
    want = ranked(retrieval.bm25_topk(questions, rows, 7))
    monkeypatch.setattr(retrieval, "TEXT_BYTES", 64)
    monkeypatch.setattr(retrieval, "PAIRS", 4)
    monkeypatch.setattr(search_index, "WORDS", 8)
    assert retrieval.dealt(rows, "text", "chunk_id").rdd.getNumPartitions() > 15
    assert ranked(retrieval.bm25_topk(questions, rows, 7, shared=str(tmp_path / "shared"))) == want
    index = Bm25Index(spark, str(tmp_path / "index"), buckets=1, id_type="long")
    index.add(rows, 0)
    assert ranked(index.topk(questions, 7)) == want
    assert len(list((tmp_path / "index/postings/step=0/bucket=0").glob("*.parquet"))) > 5


def test_each_word_is_stemmed_once(spark):
    """The stemmer stands above the distinct words, not below them."""
    rows = spark.createDataFrame([(1, "oils oils leaf")], "chunk_id long, text string")
    plan = retrieval._asked_words(rows, spark.createDataFrame([("oil",)], "term string"), retrieval.stem)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("Aggregate [word")
