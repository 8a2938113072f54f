"""Operators on hand-written rows."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from litmine.functions import scalars as S
from litmine.operators import chunking, citations, kb, ner, retrieval
from litmine.sources import readers


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def test_identifiers(spark):
    raw = ["https://doi.org/10.1/AB", "pmc12", "12345", "10.3/x", "some title", "HTTPS://EUROPEPMC.ORG/article/med/77", "doi: 10.5/q", None]
    got = [tuple(r.p) for r in spark.createDataFrame([(r,) for r in raw], "raw string").select(S.parse_identifier(F.col("raw")).alias("p")).collect()]
    assert got == [("doi", "10.1/AB"), ("pmcid", "PMC12"), ("pmid", "12345"), ("doi", "10.3/x"), (None, "some title"), ("pmid", "77"), ("doi", "10.5/q"), (None, None)]


def test_text_functions(spark):
    assert one(spark, S.title_case(F.col("a")), a="DEVELOPMENT stage-two") == "Development Stage-Two"
    assert one(spark, S.normalize_greek(F.col("a")), a="6α-ol Β") == "6-alpha-ol beta"
    assert one(spark, S.strip_markers(F.col("a")), a="Eugenol works [c1] [ 2 ].") == "Eugenol works ."
    assert one(spark, S.mcq_option(F.col("a")), a="I think option: c") == "C"
    assert one(spark, S.reconstruct_abstract(F.create_map(F.lit("a"), F.array(F.lit(0), F.lit(3)), F.lit("b"), F.array(F.lit(1)))), a=1) == "a b  a"


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=300), st.integers(5, 60), st.integers(0, 4))
def test_split_recursive(text, size, overlap):
    pieces = chunking.split_recursive(text, size, overlap)
    assert all(0 < len(p) <= size and p in text for p in pieces)
    assert pieces or not text.strip()


def test_sentences():
    text = "Ocimum L. is a herb. See Fig. 2 now! Yes\n- an item. with a stop\n# Head"
    assert [s for s, _, _ in citations.sentence_spans(text)] == ["Ocimum L. is a herb.", "See Fig. 2 now!", "Yes", "- an item. with a stop", "# Head"]
    assert all(text[a:b].strip() == s for s, a, b in citations.sentence_spans(text))


def test_uuid5(spark):
    import uuid

    want = str(uuid.uuid5(uuid.UUID(chunking.KB_NAMESPACE), "p:child:3"))
    assert one(spark, chunking.uuid5(F.col("a")), a="p:child:3") == want


def test_sections(spark):
    body = "This line is long enough to follow a generic header."
    text = f"front\n# One\nbody one\n2. Methods and more\nx\nABSTRACT\ny\nSoil preparation\n{body}\nEmpty\n"
    got = [(r.title, r.content) for r in chunking.detect_sections(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("ord").collect()]
    assert got == [("Start", "front"), ("One", "body one"), ("2. Methods and more", "x"), ("Abstract", "y"), ("Soil preparation", f"{body}\nEmpty\n")]


def test_jats():
    xml = '<article><front><article-meta><article-id pub-id-type="doi">10.1/x</article-id><title-group><article-title>T</article-title></title-group><contrib-group><contrib contrib-type="author"><name><surname>B</surname><given-names>A</given-names></name></contrib></contrib-group><abstract><p>Abs <italic>it</italic></p></abstract></article-meta></front><body><sec><label>1</label><title>Intro</title><p>Text <xref xlink:href="a">ref</xref></p><fig><p>no</p></fig><sec><title>Sub</title><list><list-item><p>a</p></list-item></list></sec></sec></body></article>'
    meta, sections = chunking.jats_article(xml)
    assert meta["authors"] == ["A B"] and meta["doi"] == "10.1/x" and meta["title"] == "T"
    assert [t for t, _ in sections] == ["Abstract", "1 Intro"]
    assert "<em>it</em>" in sections[0][1] and '<h3 id="h-0-sub">' in sections[1][1] and "no" not in sections[1][1]
    assert chunking.jats_article("<a><b></a>") == ({}, [])


def test_chemical_matching(spark):
    words = spark.createDataFrame([("CHEMICAL", "6-alpha-ol", "6-alpha-ol"), ("CHEMICAL", "germacrene d", "germacrene D"), ("CHEMICAL", "6", "six")], "label string, pattern string, canonical string")
    docs = spark.createDataFrame([(1, "We saw 6α-ol and germacrene D. in 6 samples")], "doc_id long, text string")
    got = {(r.text, r.start) for r in ner.match_chemicals(spark, docs, words).collect()}
    assert got == {("6α-ol", 7), ("germacrene D", 17)}


def test_species_and_chemical_dictionaries(spark):
    s = spark.createDataFrame([(1, "Ocimum sanctum", "holy basil"), (2, "Olea sanctum", "")], "ord int, scientific_name string, common_name string")
    got = {r.pattern: (r.canonical, r.is_pattern) for r in ner.build_species_dictionary(s).collect()}
    assert got["o. sanctum"] == ("Ocimum sanctum", True) and got["holy basil"] == ("Ocimum sanctum", False)
    c = spark.createDataFrame([(1, "(E)-nerolidol", "peruviol"), (2, "peruviol", None)], "ord int, name string, synonyms string")
    got = {r.pattern: r.canonical for r in ner.build_chemical_dictionary(c).collect()}
    assert got["nerolidol"] == "(E)-nerolidol" and got["e-nerolidol"] == "(E)-nerolidol" and got["peruviol"] == "peruviol"


def test_overlaps_never_overlap(spark):
    rng = random.Random(2)
    rows = [(d, "L", (a := rng.randint(0, 60)), a + rng.randint(1, 9)) for d in range(3) for _ in range(40)]
    got = ner.resolve_overlaps(spark.createDataFrame(rows, "doc_id long, label string, start int, end int")).collect()
    for d in range(3):
        spans = sorted((r.start, r.end) for r in got if r.doc_id == d)
        assert spans and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_highlight(spark):
    s = spark.createDataFrame([(1, 0, '<p title="clove">Clove oil, cloves</p>')], "doc_id long, ord int, html string")
    e = spark.createDataFrame([(1, "clove", "PLANT PART"), (1, "clove oil", "CHEMICAL")], "doc_id long, text string, label string")
    html = ner.highlight_entities(s, e).first().html
    assert html == '<p title="clove"><span class="ent-chemical">Clove oil</span>, cloves</p>'


def test_diversify_and_budget(spark):
    rows = [(1, 1, "a b c d"), (1, 2, "a b c e"), (1, 3, "x y z"), (1, 4, "")]
    df = spark.createDataFrame(rows, "question_id long, rank int, text string")
    assert [r.text for r in retrieval.diversify(df).orderBy("rank").collect()] == ["a b c d", "x y z", ""]
    big = spark.createDataFrame([(1, 1, "x" * 2000), (1, 2, "y" * 10), (1, 3, "z" * 900)], "question_id long, rank int, text string")
    got = {r.rank: r.context_status for r in retrieval.context_budget(big, window=0, reserve=0).collect()}
    assert got == {1: "full", 2: "omitted_budget", 3: "omitted_budget"}


def test_citations(spark):
    src = spark.createDataFrame([(1, "c1", "Eugenol is the main compound in clove oil."), (1, "c2", "Quercetin shows antioxidant activity in assays.")], "question_id long, chunk_id string, chunk_text string")
    cites = spark.createDataFrame([(1, "c1", "the main  compound in clove", 1), (1, "c2", "an invented quote of nothing", 2), (1, "c9", "x", 3)], "question_id long, chunk_id string, quote string, ord int")
    assert [r.chunk_id for r in citations.verify_citations(cites, src).collect()] == ["c1"]
    assert citations.locate_in("Eugenol is  the main\ncompound", "is the main compound") == (8, 29)


def test_upsert(spark):
    old = spark.createDataFrame([("d", "L", "x", 2, None)], "doi string, label string, canonical_text string, frequency long, metadata string")
    new = spark.createDataFrame([("d", "L", "x", "m1", 1), ("d", "L", "x", "m2", 2), ("d", "L", "y", None, 3)], "doi string, label string, canonical_text string, metadata string, ord long")
    got = {r.canonical_text: (r.frequency, r.metadata) for r in kb.upsert_entities(old, new).collect()}
    assert got == {"x": (4, "m1"), "y": (1, None)}


def test_readers(spark, tmp_path):
    (tmp_path / "t.csv").write_text("﻿term,synonyms\nLeaf,leaves|foliage\n# note,x\n,\n", encoding="utf-8")
    assert [(r.term, r.synonyms) for r in readers.read_term_dictionary(spark, str(tmp_path / "t.csv")).collect()] == [("leaf", "leaves|foliage")]
    (tmp_path / "w.csv").write_bytes("a,b\ncaf\xe9,1\n".encode("cp1252"))
    assert readers.read_with_encoding_fallback(spark, str(tmp_path / "w.csv")).first().a == "café"
    (tmp_path / "qa.json").write_text('[{"id": "1", "type": "mcq", "question": "q", "correct_option": "A"}, {"id": "2", "type": "open", "question": "q", "reference": "r"},')
    mcq, open_ = readers.split_qa_dataset(spark, str(tmp_path / "qa.json"))
    assert mcq.count() == open_.count() == 1
    (tmp_path / "gold.json").write_text('[{"id": "7", "data": {"text": "t"}, "annotations": [{"result": [{"value": {"start": 0, "end": 1, "text": "t", "labels": ["CHEMICAL"]}}]}]}, {"id": "8", "annotations": []}]')
    assert [(r.doc_id, r.label) for r in readers.read_gold_annotations(spark, str(tmp_path / "gold.json")).collect()] == [("7", "CHEMICAL")]
    (tmp_path / "p.json").write_text('{"7": [{"text": "t", "label": "X", "start": 0, "end": 1}]}')
    assert readers.read_predictions(spark, str(tmp_path / "p.json")).first().end == 1


def test_dense_search_of_many_questions(spark):
    """More questions than one block, and than the 5,000 that were once the most."""
    import numpy as np

    from litmine.operators import retrieval

    rng = np.random.default_rng(1)
    q, v = rng.normal(size=(5_100, 8)), rng.normal(size=(300, 8))
    rows = lambda m, name: spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], f"{name} long, embedding array<double>")
    got = retrieval.dense_topk(rows(q, "question_id"), rows(v, "chunk_id"), 5).toPandas().sort_values(["question_id", "rank"])
    score = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T
    assert got["chunk_id"].tolist() == np.argsort(-score, axis=1)[:, :5].ravel().tolist()
    assert np.allclose(got["score"], -np.sort(-score, axis=1)[:, :5].ravel())
