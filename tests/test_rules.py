"""Operators that SQL can't express, against rules written out by hand and plain versions on small tables."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from litmine.operators import chunking, citations, ner, retrieval

TEXT = "Intro line.\n\nThe  leaves of basil\nhold linalool and eugenol in large amounts. Roots hold none of them at all, said Dr. A. Smith et al. in 2009."


@pytest.mark.parametrize(
    ("quote", "want"),
    [
        ("THE LEAVES of basil hold", "The  leaves of basil\nhold"),
        ("basil", None),
        ("x" * 200, None),
        ("entirely different words first and then hold linalool and eugenol in large amounts", "place"),
    ],
)
def test_locate_quote(quote, want):
    got = citations.locate_in(TEXT, quote)
    if want is None:
        assert got is None
    elif want == "place":
        assert got is not None and got[1] - got[0] <= len(quote)
        assert "linalool" in TEXT[got[0] : got[1]]
    else:
        assert TEXT[slice(*got)] == want


def test_locate_quote_by_windows():
    text = " ".join(f"word{k} and other things" for k in range(60)) + " the stem is cut, dried for days; then milled twice " + "filler " * 50
    got = citations.locate_in(text, "the stem is cut, dried for hours; then milled again")
    assert got and abs(got[0] - text.find("the stem")) < 30


def test_sentences():
    text = "One two. Dr A. Smith et al. wrote it! Is it so?\n- item one. still item\n## Head. ing\nlast"
    got = [s for s, _, _ in citations.sentence_spans(text)]
    assert got == ["One two.", "Dr A. Smith et al. wrote it!", "Is it so?", "- item one. still item", "## Head. ing", "last"]
    for s, a, b in citations.sentence_spans(text):
        assert text[a:b].strip() == s


def test_collapse_references(spark):
    rows = [("a\n\n## References\nx\n---\n**References**\n\ny", "a\n\n---\n\n**References**\ny"), ("a\nReferences:\nb\n## references\nc", None), ("## References\nx\n# References\ny", "**References**\ny")]
    got = [r[0] for r in spark.createDataFrame([(a,) for a, _ in rows], "answer string").select(citations.collapse_references(F.col("answer"))).collect()]
    assert got == [b if b is not None else a for a, b in rows]


def test_verbatim_match_takes_the_first_of_equals(spark):
    said = "The leaves of basil hold much linalool."
    claims = spark.createDataFrame([(1, 0, said), (1, 1, "Too short to count.")], "question_id long, ord int, sentence string")
    sources = spark.createDataFrame([(1, "c10", said), (1, "c9", f"Short one. {said} More."), (1, "c11", "other words stand here and do not match it")], "question_id long, chunk_id string, chunk_text string")
    assert [(r.ord, r.chunk_id, r.ratio) for r in citations.verbatim_match(claims, sources).collect()] == [(0, "c9", 1.0)]


def test_verbatim_match_equals_all_pairs(spark):
    """Pieces of sentences cut anywhere, also inside words, whole ones, near ones and others, on both sides; some conversations repeat themselves."""
    rng = random.Random(8)
    words = "the leaf oil of basil holds much linalool and thymol in rich old samples grown near warm coasts".split()
    said, asked = [], []
    for q in range(6):
        lines = [" ".join(rng.choices(words, k=rng.randint(6, 14))) for _ in range(12)]
        lines += lines[:3]
        said += [(q, f"c{k}", "  ".join([f"{x}." for x in lines[k : k + 3]])) for k in range(0, 15, 3)]
        for n, x in enumerate([*lines, *lines]):
            a, b = rng.randint(0, 6), len(x) - rng.randint(0, 6)
            cut = (x, x[a:b], f"in short {x}. and more", x.replace("a", "e", 1), x.upper(), " ".join(rng.choices(words, k=7)), f"\t{x[a:b]}\n")[rng.randrange(7)]
            asked.append((q, n, cut))
    claims = spark.createDataFrame(asked, "question_id long, ord int, sentence string")
    sources = spark.createDataFrame(said, "question_id long, chunk_id string, chunk_text string")
    plain = lambda x: re.sub(r"\s+", " ", x.strip(" ").lower())
    want = {}
    for q, n, x in asked:
        if len(x.split()) < 6:
            continue
        for p, chunk, text in said:
            for y in re.split(r"(?<=[.!?])\s+", text) if p == q else ():
                if len(y.split()) >= 6:
                    a, b = plain(x), plain(y)
                    r = 1.0 if a in b or b in a else SequenceMatcher(None, a, b).ratio()
                    if r >= 0.9:
                        want[q, n] = min(want.get((q, n), (0.0, 0)), (-r, int(chunk[1:])))
    got = {(r.question_id, r.ord): (-r.ratio, int(r.chunk_id[1:])) for r in citations.verbatim_match(claims, sources).collect()}
    assert got == want and sum(r == -1.0 for r, _ in got.values()) > 30 and any(r > -1.0 for r, _ in got.values())


def test_claims_with_a_verbatim_match_are_not_scored(spark):
    said = "The leaves of this basil hold very much linalool indeed."
    other = "These eight words are not in any source."
    answers = spark.createDataFrame([(1, f"{said} {other}")], "question_id long, answer string")
    sources = spark.createDataFrame([(1, f"c{k}", f"{said} Short.") for k in range(3)], "question_id long, chunk_id string, chunk_text string")
    scored = lambda a, b: F.when(a == other, F.lit(0.5)).otherwise(F.raise_error(F.lit("scored")).cast("double"))
    got = citations.attribute_sentences(answers, sources, scored)
    assert sorted((r.ord, r.chunk_id, r.score) for r in got.collect()) == [(0, "c0", 1.0), (1, "c1", 0.5)]


def test_diversify(spark):
    texts = ["alpha beta gamma delta", "alpha beta gamma epsilon", "Alpha", "alpha!", "", "zeta eta theta"]
    rows = [(1, k, t, k + 1) for k, t in enumerate(texts)]
    got = retrieval.diversify(spark.createDataFrame(rows, "question_id long, chunk_id long, text string, rank int")).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [0, 2, 4, 5]


def test_locate_offsets(spark):
    text = "Head\n\nfirst part of it stands here, with words. " + "x y z " * 20 + "first part of it stands here, again."
    assert chunking.locate_fuzzy(text, "first  part of\nit stands", 0) == 6
    assert chunking.locate_fuzzy(text, "first part of it stands", 10) == text.rfind("first")
    assert chunking.locate_fuzzy(text, "first part of it stands here, with words. Unseen words follow after that, many of them.", 0) == 6
    assert chunking.locate_fuzzy(text, "nothing like it", 0) == -1


def test_chunk_corpus(spark):
    def failing(text, size, overlap):
        if "boom" in text:
            raise RuntimeError("bad document")
        return chunking.split_recursive(text, size, overlap)

    body = "Abstract\n" + "Some words about it. " * 200 + "\n<!-- Page 2 -->\nResults\n" + "We found more of it here. " * 150
    docs = spark.createDataFrame([(1, "a.pdf", "Title", body), (2, "b.pdf", "Bad", "boom"), (3, "c.pdf", None, None), (4, "d.pdf", "", "Short text of one line")], "doc_id long, source string, title string, text string")
    cut = chunking.chunk_corpus(docs, splitter=failing)
    assert {(r.doc_id, r.error) for r in chunking.failures_of(cut).collect()} == {(2, "bad document"), (3, "no text")}
    parents = chunking.parents_of(cut).filter("doc_id = 1").collect()
    for p in parents:
        assert body[p.start : p.end] == p.body and p.page == (2 if p.start >= body.find("<!--") else None)
    chunks = chunking.chunks_of(cut).filter("doc_id = 1").collect()
    assert {c.parent_id for c in chunks} <= {p.parent_id for p in parents} and [c.chunk_id for c in chunks] == [f"a.pdf_{k}" for k in range(len(chunks))]
    assert len({c.chunk.lower() for c in chunks}) == len(chunks) == chunks[0].total_chunks and all(c.chunk.startswith(f"Title > {c.section}") for c in chunks)
    assert {c.section for c in chunks} == {"Abstract", "Results"}


def test_kb_chunk_corpus(spark):
    import uuid

    items = [(1, 0, "First  chunk here", ["A", "B"], ["text"], 1), (1, 1, "a footnote", ["A"], ["footnote"], 1), (1, 2, "Second chunk", [], ["text", "footnote"], 2), (1, 3, "unseen", None, [], None)]
    rows = spark.createDataFrame(items, "doc_id long, ord int, chunk string, headings array<string>, labels array<string>, page int")
    parents, children = chunking.kb_chunk_corpus(rows, spark.createDataFrame([(1, "First chunk here. Second chunk")], "doc_id long, text string"))
    got = {r.parent_id: (r.section, r.start, r.page) for r in parents.collect()}
    name = lambda kind, n: str(uuid.uuid5(uuid.UUID(chunking.KB_NAMESPACE), f"1:{kind}:{n}"))
    assert got == {name("parent", 0): ("B", 0, 1), name("parent", 2): ("", 18, 2), name("parent", 3): ("", -1, None)}
    kids = {r.child_id: (r.parent_id, r.chunk) for r in children.collect()}
    assert kids[name("child", 0)] == (name("parent", 0), "A\nB\nFirst  chunk here") and set(kids) == {name("child", k) for k in range(3)}


def test_semantic_split_and_embedders(spark, tmp_path):
    rows = spark.createDataFrame([(1, k, f"{'red apples grow' if k < 6 else 'steel bridges span'} sentence of its own kind here") for k in range(12)], "doc_id long, ord int, sentence string")
    out = chunking.semantic_split(retrieval.embed(rows, retrieval.hashing_embedder, "sentence"), str(tmp_path)).orderBy("part").collect()
    assert len({r.part for r in out}) == 2 and all(("red" in r.chunk) != ("steel" in r.chunk) for r in out)
    none = retrieval.embed(spark.createDataFrame([(1, None), (2, " ")], "i int, text string"), retrieval.hashing_embedder)
    assert all(r.embedding is None for r in none.collect())


def test_all_matchers_in_one_pass_equal_the_single_ones(spark):
    rng = random.Random(2)
    words = ["leaf", "leaf oil", "gas-chromatography", "gas", "α-pinene", "alpha pinene", "basil", "oil of basil", "(E)-2-hexenal", "mass"]
    labels = ["PLANT PART", "PLANT PART", "ANALYTICAL TECHNIQUE", "ANALYTICAL TECHNIQUE", "CHEMICAL", "CHEMICAL", "SPECIES", "SPECIES", "CHEMICAL", "ANALYTICAL TECHNIQUE"]
    dictionary = spark.createDataFrame([(a, w.lower(), w.upper()) for a, w in zip(labels, words)], "label string, pattern string, canonical string")
    docs = spark.createDataFrame([(k, " ".join(rng.choice([*words, "gas–chromatography", "x", ","]) for _ in range(30))) for k in range(30)], "doc_id long, text string")
    parts = ner.match_trie(spark, docs, dictionary.filter("label NOT IN ('CHEMICAL', 'ANALYTICAL TECHNIQUE')"))
    parts = parts.unionByName(ner.match_techniques(spark, docs, dictionary)).unionByName(ner.match_chemicals(spark, docs, dictionary)).distinct()
    order = "array_position(array('PLANT PART','ANALYTICAL TECHNIQUE','EXTRACTION METHOD','DEVELOPMENT STAGE','SEASON','SPECIES','CHEMICAL','BIOACTIVITY'), label) AS ord"
    want = ner.resolve_overlaps(parts.selectExpr("doc_id", "start", "end", order, "label", "canonical", "text"))
    got = ner.match_all(spark, docs, dictionary)
    key = ["doc_id", "start", "end", "label", "canonical", "text"]
    assert sorted(map(repr, got.select(key).collect())) == sorted(map(repr, want.select(key).collect())) and got.count() > 100


def test_species_common_names_are_looked_up_only(spark):
    species = spark.createDataFrame([(1, "Ocimum basilicum", "sweet basil")], "ord int, scientific_name string, common_name string")
    dictionary = ner.build_species_dictionary(species)
    docs = spark.createDataFrame([(1, "sweet basil is O. basilicum or Ocimum basilicum")], "doc_id long, text string")
    assert {r.text for r in ner.match_all(spark, docs, dictionary).collect()} == {"O. basilicum", "Ocimum basilicum"}
    assert ner.lookup(spark.createDataFrame([("Sweet Basil",)], "text string"), dictionary).first().canonical == "Ocimum basilicum"


def test_counts_and_places(spark):
    docs = spark.createDataFrame([(1, "The oil of the Oil-plant; oils. aaa")], "doc_id long, text string")
    terms = spark.createDataFrame([(1, t) for t in ("oil", "the oil", "oil-plant", "none")], "doc_id long, term string")
    assert {r.term: r.n for r in ner.whole_words(terms, docs).collect()} == {"oil": 2, "the oil": 2, "oil-plant": 1, "none": 0}
    e = spark.createDataFrame([(1, "L", "aa"), (1, "L", "oil")], "doc_id long, label string, text string")
    assert sorted((r.text, r.start) for r in ner.find_occurrences(e, docs).collect()) == [("aa", 32), ("aa", 33), ("oil", 4), ("oil", 26)]


def test_files_by_encoding(spark, tmp_path):
    from litmine.sources import readers

    (tmp_path / "a.csv").write_bytes("term,synonyms\ncafé,x\n".encode())
    (tmp_path / "b.csv").write_bytes("term,synonyms\nnaïve €,y\n".encode("cp1252"))
    assert {r.term for r in readers.read_with_encoding_fallback(spark, str(tmp_path)).collect()} == {"café", "naïve €"}


# --- plain versions on small random tables -----------------------------------------------

SHORT = [a + b + c for a in "bdfg" for b in "aeiou" for c in "lmnr"]


def said(rng, n):
    """A sentence of n words of three letters, which have no ending to cut."""
    return " ".join(rng.choice(SHORT) for _ in range(n)).capitalize() + "."


def share(a, b):
    words = lambda t: set(t.lower().replace(".", " ").split())
    return len(words(a) & words(b)) / len(words(a))


def answers_and_chunks(rng, questions=12):
    answers = {q: [said(rng, rng.choice([5, 9, 12])) for _ in range(6)] for q in range(questions)}
    chunks = {q: {f"c{k}": [said(rng, 10) for _ in range(4)] for k in range(1, 5)} for q in range(questions)}
    for q in range(0, questions, 2):  # some claims are taken from a chunk word for word
        answers[q][2] = chunks[q]["c3"][1]
    return answers, chunks


def tables(spark, answers, chunks):
    a = spark.createDataFrame([(q, " ".join(s)) for q, s in answers.items()], "question_id long, answer string")
    c = spark.createDataFrame([(q, k, " ".join(s)) for q, of in chunks.items() for k, s in of.items()], "question_id long, chunk_id string, chunk_text string")
    return a, c


def test_attribute_sentences_equals_a_plain_version(spark):
    answers, chunks = answers_and_chunks(random.Random(5))
    want = []
    for q, claims in answers.items():
        used = set()
        for n, claim in enumerate(claims):
            if len(claim.split()) < 8:
                continue
            exact = [k for k, s in chunks[q].items() if claim in s]
            order = sorted(chunks[q], key=lambda k: (-share(claim, " ".join(chunks[q][k])), k))
            free = [k for k in order if k not in used]
            # the margin is 1: a used chunk gives way unless it is better by that
            top = exact[0] if exact else order[0] if order[0] not in used or not free else free[0]
            used.add(top)
            want.append((q, n, top, 1.0 if exact else round(share(claim, " ".join(chunks[q][top])), 9)))
    got = citations.attribute_sentences(*tables(spark, answers, chunks))
    assert sorted((r.question_id, r.ord, r.chunk_id, round(r.score, 9)) for r in got.collect()) == sorted(want) and any(w[3] == 1.0 for w in want)


def test_best_sentences_equal_a_plain_version(spark):
    answers, chunks = answers_and_chunks(random.Random(6))
    a, c = tables(spark, answers, chunks)
    claims = spark.createDataFrame([(q, k, s[q % 6]) for q, s in answers.items() for k in ("c1", "c4")], "question_id long, chunk_id string, claim string")
    want = {(q, k): max(chunks[q][k], key=lambda s: share(answers[q][q % 6], s)) for q in answers for k in ("c1", "c4")}  # the first of equals
    assert {(r.question_id, r.chunk_id): r.quote for r in citations.best_sentence(claims, c).collect()} == want
    other = citations.best_sentence(claims, c, spark.createDataFrame([(0, want[0, "c1"])], "question_id long, quote string"))
    assert other.filter("question_id = 0 AND chunk_id = 'c1'").first().quote != want[0, "c1"]
    places = citations.reattribute(a, c, claims.select("question_id", "chunk_id"))
    for r in places.collect():
        text = " ".join(chunks[r.question_id][r.chunk_id])
        s = answers[r.question_id]
        assert r.ord == max(range(6), key=lambda n: (share(s[n], text), -n)) and " ".join(s)[: r.end].rstrip().endswith(s[r.ord])  # the end is after the space
    assert places.count() == len(want)


def test_paper_references(spark):
    answers = spark.createDataFrame([(1, "One [c2]. Two [c1][c3]. Three [c2]."), (2, "None.")], "question_id long, answer string")
    rows = [(1, "c1", "a.pdf", "A", "10.1/a"), (1, "c2", "b.pdf", "B", None), (1, "c3", "a.pdf", "A", "10.1/a"), (2, "c1", "a.pdf", "A", None)]
    sources = spark.createDataFrame(rows, "question_id long, chunk_id string, source string, doc_title string, doi string")
    assert [tuple(r) for r in citations.paper_references(answers, sources).collect()] == [(1, "B\nA — 10.1/a")]


def test_parents_and_children_hold_the_whole_text(spark):
    rng = random.Random(7)
    lines = ["## Methods"] + [" ".join(f"w{rng.randrange(10**9)}" for _ in range(rng.randrange(1, 30))) + "." for _ in range(25)] + ["## Results"] + [f"last words x{k} here." for k in range(30)]
    text = "\n".join(lines)
    docs = spark.createDataFrame([(1, "T", text), (2, "T", ""), (3, "T", None)], "doc_id long, title string, text string")
    parents, children = (p.collect() for p in chunking.parent_child_chunks(docs, (400, 0), (100, 20)))
    assert {p.doc_id for p in parents} == {1} == {c.doc_id for c in children}
    assert all(text[p.start : p.end] == p.body and len(p.body) <= 400 for p in parents)
    assert {p.section for p in parents} == {"Methods", "Results"}
    body = {p.parent_id: p for p in parents}
    assert all(len(c.body) <= 100 and c.body in body[c.parent_id].body and c.chunk == f"T > {c.section}\n\n{c.body}" for c in children)
    assert [c.chunk_id for c in sorted(children, key=lambda c: c.ord)] == [f"1_{k}" for k in range(len(children))]
    words = set(" ".join(x for x in lines if x[0] != "#").split())
    assert words <= {w for c in children for w in c.body.split()} and words <= {w for p in parents for w in p.body.split()}


def test_sections_are_matched_one_by_one(spark):
    dictionary = spark.createDataFrame([("PLANT PART", "leaf", "Leaf"), ("CHEMICAL", "linalool", "Linalool")], "label string, pattern string, canonical string")
    rows = [(1, 0, "Intro", "A leaf."), (1, 1, "Results", "Linalool of the leaf"), (1, 2, "End", "  "), (2, 0, "Intro", None)]
    sections = spark.createDataFrame(rows, "doc_id long, ord int, title string, content string")
    got = ner.match_sections(spark, sections, dictionary).collect()
    assert sorted((r.doc_id, r.section, r.text, r.start) for r in got) == [(1, "Intro", "leaf", 2), (1, "Results", "Linalool", 0), (1, "Results", "leaf", 16)]


def test_bm25_equals_a_plain_version_with_and_without_broadcast(spark, monkeypatch):
    from collections import Counter
    from math import log

    rng = random.Random(8)
    texts = [" ".join(rng.choice(SHORT) for _ in range(rng.randrange(0, 40))) for _ in range(60)]
    asked = [" ".join(rng.choice(SHORT) for _ in range(4)) for _ in range(7)]
    tf, n = [Counter(t.split()) for t in texts], len(texts)
    mean = sum(map(Counter.total, tf)) / n
    df = Counter(w for c in tf for w in c)
    gain = lambda w, c: log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * c.total() / mean))
    want = set()
    for q, question in enumerate(asked):
        scores = {k: round(sum(gain(w, c) for w in set(question.split()) if c[w]), 9) for k, c in enumerate(tf)}
        hit = sorted((k for k, s in scores.items() if s), key=lambda k: (-scores[k], k))[:5]
        want |= {(q, k, r, round(scores[k], 6)) for r, k in enumerate(hit, 1)}
    chunks = spark.createDataFrame([*enumerate(texts)], "chunk_id long, text string")
    questions = spark.createDataFrame([*enumerate(asked)], "question_id long, question string")
    for limit in (retrieval.BROADCAST_BYTES, 0):
        monkeypatch.setattr(retrieval, "BROADCAST_BYTES", limit)
        got = retrieval.bm25_topk(questions, chunks, 5).collect()
        assert {(r.question_id, r.chunk_id, r["rank"], round(r.score, 6)) for r in got} == want
