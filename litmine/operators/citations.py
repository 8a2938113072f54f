"""Answer and citation operators over answers(question_id, answer) and sources(question_id, chunk_id, chunk_text, …)."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litmine.functions.scalars import MARKER, is_chrome_sentence, is_non_factual, normalize_text, parse_markers, strip_markers
from litmine.operators.retrieval import lexical_scorer

FLOOR, MARGIN = 0.0, 1.0
#: Words after which a stop ends no sentence.
ABBREVIATIONS = {"al", "fig", "eq", "sp", "spp", "var", "cf", "eg", "ie", "e.g", "i.e", "vs", "no", "ref", "etc"}
_GAP = r"[^\S\n]"
_OPEN = "".join(f"(?<!{edge}{w})" for w in ["[A-ZÀ-ÖØ-Þ]", *(f"(?i:{re.escape(x)})" for x in sorted(ABBREVIATIONS))] for edge in (r"\s", "^"))
_STOP = rf"{_OPEN}[.!?](?:{_GAP}+|$)"
#: A list item or heading, else a run of a line up to a stop that ends a sentence, or up to the line's end.  Only stops are looked at one by one.
_UNIT = re.compile(rf"^{_GAP}*(?:[-*+]|\d+[.)]|#{{1,6}}){_GAP}[^\n]*|[^\n][^\n.!?]*+(?:(?!{_STOP})[.!?][^\n.!?]*+)*+(?:{_STOP}|$)", re.MULTILINE)


def sentence_spans(text: str) -> list[tuple[str, int, int]]:
    """(sentence, start, end) of a text; the end takes in the space after it.

    List items and headings are one unit; a stop after a single capital or a known
    abbreviation ends nothing.
    """
    return [(m[0].strip(), *m.span()) for m in _UNIT.finditer(text or "") if m[0].strip()]


def _split(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        each = [sentence_spans(t) for t in batch.to_pylist()]
        found = [[x[k] for spans in each for x in spans] for k in range(3)]
        units = pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(found, (pa.string(), pa.int32(), pa.int32()))], ["text", "start", "end"])
        yield pa.ListArray.from_arrays(np.append(0, np.cumsum([len(spans) for spans in each])).astype(np.int32), units)


def split_sentences(text: Column) -> Column:
    """ARRAY<STRUCT<text, start, end>>."""
    return F.arrow_udf(_split, "array<struct<text:string,start:int,end:int>>")(text)


def sentences(rows: DataFrame, text: str, *keep: str) -> DataFrame:
    each = rows.select(*keep, F.posexplode(split_sentences(F.col(text))).alias("ord", "s"))
    return each.select(*keep, "ord", F.col("s.text").alias("sentence"), F.col("s.start").alias("start"), F.col("s.end").alias("end"))


def words_of(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def _with_pairs(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``pairs``: neighbouring words of a normalised text, as strings."""
    w = rows.withColumn("w", F.filter(F.split(text, " "), lambda x: x != "")).withColumn("n", F.greatest(F.size("w") - 1, F.lit(0)))
    return w.withColumn("pairs", F.zip_with(F.slice("w", F.lit(1), F.col("n")), F.slice("w", F.lit(2), F.col("n")), lambda a, b: F.concat(a, F.lit(" "), b))).drop("w", "n")


def _inside(short: DataFrame, long: DataFrame, x: str, y: str) -> DataFrame:
    """(question_id, x, y): texts of six words or more that are a piece of another of their question.

    Words of a piece but its first and last are words of the other as they are, so its longest
    pair of neighbours among them is one of the other's: they are joined by that, then compared.
    Exploded words are many times their file, so no join here is left to be broadcast by its size.
    """
    inner = F.transform(F.slice("pairs", F.lit(2), F.size("pairs") - 2), lambda p: F.struct(F.length(p).alias("n"), p.alias("p")))
    asked = _with_pairs(short.select("question_id", x), x).select("question_id", x, F.array_max(inner)["p"].alias("key"))
    there = _with_pairs(long.select("question_id", y), y).select("question_id", y, F.explode(F.array_distinct("pairs")).alias("key"))
    return asked.join(there.hint("merge"), ["question_id", "key"]).filter(F.contains(y, F.col(x))).select("question_id", "x", "y")


def _ratio_if(least: float) -> Callable[[pd.Series, pd.Series], pd.Series]:
    """Similarities; 0 where the characters in common already are too few for ``least``."""

    def one(a: str, b: str) -> float:
        m = SequenceMatcher(None, a, b)
        return m.ratio() if m.quick_ratio() >= least else 0.0

    def ratios(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=float)

    return ratios


def verbatim_match(claims: DataFrame, sources: DataFrame, least: float = 0.90, shared: str | None = None) -> DataFrame:
    """(question_id, ord, chunk_id, ratio): claims of six words or more that a source sentence has, holds or nearly equals.

    Source sentences have six words or more as well.  Of equally good chunks the first by
    the number in its id, then by id, counts.  Distinct texts of a question are compared, and
    by similarity only claims that no sentence has or holds.  ``shared``: a new folder that
    all executors share; what several steps read is then written there, each made once.
    """
    saved = functools.partial(_saved, shared)
    c = claims.filter(words_of(F.col("sentence")) >= 6).select("question_id", "ord", normalize_text(F.col("sentence")).alias("x"))
    said = sources.select("question_id", "chunk_id", F.explode(F.split("chunk_text", r"(?<=[.!?])\s+")).alias("sentence"))
    s = said.filter(words_of(F.col("sentence")) >= 6).select("question_id", "chunk_id", normalize_text(F.col("sentence")).alias("y"))
    number = F.coalesce(F.regexp_extract("chunk_id", "([0-9]+)", 1).try_cast("long"), F.lit(0)).alias("number")
    s = saved(s.groupBy("question_id", "y").agg(F.min(F.struct(number, "chunk_id")).alias("first")), "said")
    texts = c.select("question_id", "x").distinct()
    held = _inside(texts, s, "x", "y").unionByName(_inside(s, texts, "y", "x"))
    near = held.join(s.hint("merge"), ["question_id", "y"]).groupBy("question_id", "x").agg(F.min("first").alias("first"))
    near = saved(near.select("question_id", "x", "first", F.lit(1.0).alias("ratio")), "held")
    pairs = texts.join(near.select("question_id", "x").hint("merge"), ["question_id", "x"], "left_anti").join(s.hint("merge"), "question_id")
    la, lb = F.length("x"), F.length("y")
    rest = pairs.filter(2 * F.least(la, lb) >= least * (la + lb)).withColumn("ratio", F.pandas_udf(_ratio_if(least), "double")("x", "y")).filter(F.col("ratio") >= least)
    both = near.unionByName(rest.select(near.columns))
    best = both.groupBy("question_id", "x").agg(F.min_by("first", F.struct(-F.col("ratio"), "first"))["chunk_id"].alias("chunk_id"), F.max("ratio").alias("ratio"))
    return c.join(best.hint("merge"), ["question_id", "x"]).select("question_id", "ord", "chunk_id", "ratio")


def _saved(shared: str | None, rows: DataFrame, name: str) -> DataFrame:
    if shared is None:
        return rows
    rows.write.parquet(f"{shared}/{name}")
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{shared}/{name}")


def attribute_sentences(answers: DataFrame, sources: DataFrame, scorer: Callable[[Column, Column], Column] = lexical_scorer, floor: float = FLOOR, margin: float = MARGIN, shared: str | None = None) -> DataFrame:
    """(question_id, ord, sentence, end, chunk_id, score): the source of each claim of an answer.

    Headings, claims under eight words and refusals have none.  A verbatim match counts
    1, and such a claim meets no other chunk; else the best chunk counts if its score reaches
    ``floor`` or beats the mean by ``margin``.  A chunk that was used gives way to the best
    unused one, unless it is better by ``margin``.  ``shared``: as for ``verbatim_match``.
    """
    s = sentences(answers.withColumn("answer", strip_markers(F.col("answer"))), "answer", "question_id")
    claims = _saved(shared, s.filter((words_of(F.col("sentence")) >= 8) & ~F.col("sentence").startswith("#") & ~is_non_factual(F.col("sentence"))), "claims")
    exact = verbatim_match(claims, sources, shared=shared).select("question_id", "ord", F.col("chunk_id").alias("exact_id"))
    claims = _saved(shared, claims.join(exact.hint("merge"), ["question_id", "ord"], "left").select("question_id", "ord", "sentence", "end", "exact_id"), "exact")
    pairs = claims.filter("exact_id IS NULL").join(sources.select("question_id", "chunk_id", "chunk_text").hint("merge"), "question_id")
    pairs = pairs.withColumn("score", scorer(F.col("sentence"), F.col("chunk_text")).cast("double"))
    sure = claims.filter("exact_id IS NOT NULL").withColumns({"chunk_id": F.col("exact_id"), "score": F.lit(1.0)})

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ord", "score", "chunk_id"], ascending=[True, False, True])
        ords, scores = rows["ord"].to_numpy(), rows["score"].to_numpy()
        chunks, exact, said, ends = (rows[c].tolist() for c in ("chunk_id", "exact_id", "sentence", "end"))
        starts = np.flatnonzero(np.concatenate([[True], ords[1:] != ords[:-1]])).tolist()
        question, used = rows["question_id"].iloc[0], set()
        out = []
        for a, b in zip(starts, [*starts[1:], len(rows)]):
            chunk, score = chunks[a], scores[a]
            if not isinstance(exact[a], str):
                if not (score >= floor or score - rows["score"].iloc[a:b].mean() >= margin):
                    continue
                if chunk in used:
                    fresh = next((k for k in range(a, b) if chunks[k] not in used), None)
                    if fresh is not None and score - scores[fresh] < margin:
                        chunk, score = chunks[fresh], scores[fresh]
            used.add(chunk)
            out.append((question, ords[a], said[a], ends[a], chunk, score))
        return pd.DataFrame(out, columns=["question_id", "ord", "sentence", "end", "chunk_id", "score"])

    columns = ["question_id", "ord", "sentence", "end", "chunk_id", "score", "exact_id"]
    flat = pairs.select(columns).unionByName(sure.select(columns))
    return flat.groupBy("question_id").applyInPandas(choose, "question_id long, ord int, sentence string, end int, chunk_id string, score double")


def best_sentence(claims: DataFrame, sources: DataFrame, used: DataFrame | None = None, scorer: Callable[[Column, Column], Column] = lexical_scorer) -> DataFrame:
    """(question_id, chunk_id, quote): the best sentence of each cited chunk for its claim.

    ``claims``: (question_id, chunk_id, claim).  Sentences have 20 characters or more;
    page furniture is left out unless there is nothing else; quotes in ``used`` are not
    given again.
    """
    plain = sources.withColumn("chunk_text", F.regexp_replace("chunk_text", r"(?m)^#{1,6}\s*", ""))
    s = sentences(plain, "chunk_text", "question_id", "chunk_id").filter(F.length("sentence") >= 20).withColumn("furniture", is_chrome_sentence(F.col("sentence")))
    only = F.min(F.col("furniture").cast("int")).over(Window.partitionBy("question_id", "chunk_id"))
    s = s.withColumn("_only", only).filter(~F.col("furniture") | (F.col("_only") == 1))
    if used is not None:
        s = s.join(used.select("question_id", F.col("quote").alias("sentence")), ["question_id", "sentence"], "left_anti")
    j = claims.join(s, ["question_id", "chunk_id"])
    return j.groupBy("question_id", "chunk_id", "claim").agg(F.max_by("sentence", F.struct(scorer(F.col("claim"), F.col("sentence")), -F.col("ord"))).alias("quote"))


def top_chunks_for_answer(answers: DataFrame, sources: DataFrame, n: int = 2, scorer: Callable[[Column, Column], Column] | None = lexical_scorer) -> DataFrame:
    """The n sources of each answer with the best scores; in their own order without a scorer."""
    j = answers.join(sources, "question_id")
    j = j.withColumn("score", scorer(F.col("answer"), F.col("chunk_text")) if scorer else F.lit(0.0))
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), F.length("chunk_id"), "chunk_id")
    return j.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).select("question_id", "chunk_id", "score", "place")


def reattribute(answers: DataFrame, sources: DataFrame, wanted: DataFrame, scorer: Callable[[Column, Column], Column] | None = lexical_scorer) -> DataFrame:
    """(question_id, chunk_id, ord, end): for each wanted chunk the answer's sentence that fits it best; the last without a scorer."""
    s = sentences(answers, "answer", "question_id")
    j = wanted.join(sources.select("question_id", "chunk_id", "chunk_text"), ["question_id", "chunk_id"]).join(s, "question_id")
    order = F.struct(scorer(F.col("sentence"), F.col("chunk_text")) if scorer else F.lit(0.0), F.col("ord") * (-1 if scorer else 1))
    return j.groupBy("question_id", "chunk_id").agg(F.max_by(F.struct("ord", "end"), order).alias("s")).select("question_id", "chunk_id", "s.*")


def inject_markers(answers: DataFrame, marks: DataFrame) -> DataFrame:
    """Answers with markers set after the sentences that end at ``end``, several of a place in order of their ids."""
    at = marks.groupBy("question_id", "end").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct(F.length("chunk_id").alias("n"), "chunk_id"))), lambda x: F.concat(F.lit("["), x["chunk_id"], F.lit("]"))), "").alias("m"))
    lists = at.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("end", "m"))).alias("at"))
    j = answers.join(lists, "question_id", "left")
    text = F.col("answer")
    cuts = F.concat(F.array(F.lit(0)), F.transform("at", lambda x: _before_space(text, x["end"])), F.array(F.length(text)))
    parts = F.transform(F.sequence(F.lit(1), F.size(cuts) - 1), lambda i: F.concat(text.substr(F.element_at(cuts, i) + 1, F.element_at(cuts, i + 1) - F.element_at(cuts, i)), F.coalesce(F.concat(F.lit(" "), F.get(F.col("at"), i - 1)["m"]), F.lit(""))))
    return j.select("question_id", F.when(F.col("at").isNull(), text).otherwise(F.array_join(parts, "")).alias("answer"))


def _before_space(text: Column, end: Column) -> Column:
    """``end`` without the space before it."""
    return F.length(F.regexp_replace(text.substr(F.lit(1), end), r"\s+$", ""))


def references_block(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(question_id, references): a line per cited source in the order of first mention."""
    ids = answers.select("question_id", F.posexplode(parse_markers(F.col("answer"))).alias("k", "chunk_id"))
    j = ids.join(sources, ["question_id", "chunk_id"])
    place = F.concat_ws(" — ", F.nullif("section", F.lit("")), F.nullif("doc_title", F.lit("")))
    page = F.when(F.col("page").isNotNull(), F.concat(F.lit(" (p. "), F.col("page").cast("string"), F.lit(")"))).otherwise("")
    file = F.when((F.col("source") != "") & ~F.coalesce(F.col("source") == F.col("doc_title"), F.lit(False)), F.concat(F.lit(" — "), "source")).otherwise("")
    line = F.concat(F.lit("["), "chunk_id", F.lit("] "), place, page, file)
    return j.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", line.alias("l")))), lambda x: x["l"]), "\n").alias("references"))


def paper_references(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(question_id, references): a line per cited file, with title and DOI."""
    ids = answers.select("question_id", F.posexplode(parse_markers(F.col("answer"))).alias("k", "chunk_id"))
    one = ids.join(sources, ["question_id", "chunk_id"]).groupBy("question_id", "source").agg(F.min("k").alias("k"), F.min_by(F.concat_ws(" — ", "doc_title", "doi"), "k").alias("l"))
    return one.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "l"))), lambda x: x["l"]), "\n").alias("references"))


#: Fixed value: the shape of a references heading, case-sensitive.
REFERENCES = r"(?m)^[ \t]*(?:#{1,6}[ \t]+References|\*\*References\*\*)[ \t]*$"


def collapse_references(answer: Column) -> Column:
    """An answer with its last References section only, under one heading after a rule; as it is with one section or none."""
    parts = F.split(answer, REFERENCES)
    bare = lambda c: F.regexp_replace(c, r"\s+$", "")
    head = bare(F.regexp_replace(bare(F.element_at(parts, 1)), r"\n[ \t]*---[ \t]*$", ""))
    rule = F.when(head != "", "\n\n---\n\n").otherwise("")
    return F.when(F.size(parts) > 2, F.concat(head, rule, F.lit("**References**\n"), F.regexp_replace(F.element_at(parts, -1), r"^\s+", ""))).otherwise(answer)


class Runs:
    """The suffix automaton of a text: finds the longest piece of it in another text in one pass."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.size = [-1], [0]
        last = 0
        for c in text:
            new, at = self._state({}, self.size[last] + 1), last
            while at >= 0 and c not in self.next[at]:
                self.next[at][c] = new
                at = self.link[at]
            if at < 0:
                self.link[new] = 0
            else:
                seen = self.next[at][c]
                if self.size[seen] > self.size[at] + 1:
                    twin = self._state(dict(self.next[seen]), self.size[at] + 1)
                    self.link[twin] = self.link[seen]
                    self.link[seen] = twin
                    while at >= 0 and self.next[at].get(c) == seen:
                        self.next[at][c] = twin
                        at = self.link[at]
                    seen = twin
                self.link[new] = seen
            last = new

    def _state(self, follow: dict[str, int], size: int) -> int:
        self.next.append(follow)
        self.link.append(0)
        self.size.append(size)
        return len(self.size) - 1

    def longest_in(self, other: str) -> int:
        """Length of the longest piece that both texts hold."""
        best = at = long = 0
        for c in other:
            while at and c not in self.next[at]:
                at = self.link[at]
                long = self.size[at]
            if c in self.next[at]:
                at, long = self.next[at][c], long + 1
                best = max(best, long)
        return best


def _common(quotes: pd.Series, chunks: pd.Series) -> pd.Series:
    return pd.Series([Runs(q).longest_in(c) for q, c in zip(quotes.fillna(""), chunks.fillna(""))], dtype="int32")


def quote_matches_chunk(quotes: DataFrame, least: float = 0.8) -> DataFrame:
    """``quotes`` (…, quote, chunk_text) plus verified: the chunk holds the quote, or ``least`` of it in one piece.

    A piece of L of a quote's n characters covers its characters n - L to L, wherever it
    lies; chunks without these are passed over natively, others are read once along the
    quote's suffix automaton.
    """
    q, c = normalize_text(F.col("quote")), normalize_text(F.col("chunk_text"))
    rows = quotes.withColumn("_q", q).withColumn("_c", c).withColumn("_in", (F.col("_q") != "") & F.contains("_c", F.col("_q")))
    sure = rows.filter("_in").withColumn("verified", F.lit(True))
    n = F.length("_q")
    piece = F.ceil(least * n).cast("int")
    middle = F.when(2 * piece > n, F.substring(F.col("_q"), n - piece + 1, 2 * piece - n)).otherwise("")
    rest = rows.filter("NOT coalesce(_in, false)").withColumn("_near", (F.col("_q") != "") & F.contains("_c", middle))
    size = F.pandas_udf(_common, "int")("_q", "_c")
    near = rest.filter("_near").withColumn("verified", size >= piece)
    far = rest.filter("NOT coalesce(_near, false)").withColumn("verified", (F.col("_q") != "") & F.lit(False))
    return sure.unionByName(near.unionByName(far).drop("_near")).drop("_q", "_c", "_in")


def verify_citations(citations: DataFrame, sources: DataFrame) -> DataFrame:
    """Verified citations (question_id, chunk_id, quote, ord): of known chunks, one each, whose quote the chunk holds."""
    j = citations.join(sources.select("question_id", "chunk_id", "chunk_text"), ["question_id", "chunk_id"])
    good = quote_matches_chunk(j).filter("verified")
    w = Window.partitionBy("question_id", "chunk_id").orderBy("ord")
    return good.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "chunk_text")


def citation_completeness(answer: Column, verified: Column) -> Column:
    """STRUCT<total, verified, rate, missing> of an answer's markers against an array of verified ids."""
    ids = parse_markers(answer)
    good = F.size(F.array_intersect(ids, verified))
    return F.struct(F.size(ids).alias("total"), good.alias("verified"), F.when(F.size(ids) > 0, good / F.size(ids)).otherwise(F.lit(1.0)).alias("rate"), F.array_except(ids, verified).alias("missing"))


def validate_selected_ids(raw: Column, valid: Column) -> Column:
    """STRUCT<ids, error> of JSON like {"chunk_ids": […]}: valid ids once each, in order; the kind of error else."""
    ids = F.from_json(raw, "chunk_ids array<string>")["chunk_ids"]
    good = F.filter(F.array_distinct(F.transform(ids, lambda x: F.trim(x))), lambda x: F.array_contains(valid, x))
    error = F.when(F.try_parse_json(raw).isNull(), "invalid_json").when(ids.isNull(), "missing_chunk_ids").when(F.size(good) == 0, "no_valid_ids")
    return F.struct(F.coalesce(good, F.array().cast("array<string>")).alias("ids"), error.alias("error"))


#: Fixed values of quote location: least quote, slices, least slice, window of characters, their step, least hits.
LEAST_QUOTE, SLICE, LEAST_SLICE, GRAM, STEP, LEAST_HITS = 8, 60, 24, 8, 4, 3


def locate_in(text: str, quote: str) -> tuple[int, int] | None:
    """Where a quote stands in a text, whatever the case, with runs of white space as one space.

    The whole quote; else the longest of five slices of it that is found, extended to the
    quote's length; else where windows of 8 characters of it, with a letter or digit, stand
    most densely, if three or more do within the quote's length.
    """
    low = lambda x: x.lower() if len(x.lower()) == len(x) else x
    needle = low(" ".join(quote.split()))
    pieces = list(re.finditer(r"\s+|\S", text))
    flat = "".join(" " if m[0].isspace() else low(m[0]) for m in pieces)
    at = [m.start() for m in pieces]
    n = len(needle)
    if n < LEAST_QUOTE or not at:
        return None
    if (k := flat.find(needle)) >= 0:
        return at[k], at[k + n - 1] + 1
    offsets = (0, n // 4, n // 2, 3 * n // 4, max(0, n - SLICE))
    slices = [(needle[o : o + SLICE], o) for o in offsets if len(needle[o : o + SLICE]) >= LEAST_SLICE]
    found = [(len(x), flat.find(x), o) for x, o in slices if x in flat]
    if found:
        _, k, o = max(found, key=lambda f: f[0])
        start = max(0, at[k] - o)
        return start, min(len(text), start + len(quote))
    grams = {g for i in range(0, n - GRAM + 1, STEP) if re.search("[a-z0-9]", g := needle[i : i + GRAM])}
    hits = np.array([i for i in range(len(flat) - GRAM + 1) if flat[i : i + GRAM] in grams], int)
    if len(grams) < LEAST_HITS or not len(hits):
        return None
    left = np.searchsorted(hits, hits - n)
    size = np.arange(len(hits)) - left + 1
    if size.max() < LEAST_HITS:
        return None
    start = at[hits[left[size.argmax()]]]
    return start, min(len(text), start + len(quote))


def locate_quotes(rows: DataFrame) -> DataFrame:
    """``rows`` (…, text, quote) plus at, a STRUCT<start, end> or null."""

    def find(texts: pd.Series, quotes: pd.Series) -> pd.DataFrame:
        found = [locate_in(t or "", q or "") or (None, None) for t, q in zip(texts, quotes)]
        return pd.DataFrame(found, columns=["start", "end"]).astype("Int32")

    return rows.withColumn("at", F.pandas_udf(find, "start int, end int")("text", "quote"))


def sentence_start(text: Column, pos: Column) -> Column:
    """Where the sentence that holds a position (from 0) begins."""
    before = text.substr(F.lit(1), pos)
    last = F.regexp_extract(before, r"(?s)^(.*(?:[.!?][ \n]|\n\s*\n))", 1)
    return F.length(last)


def markers_in(answer: Column) -> Column:
    return F.regexp_count(answer, F.lit(MARKER))
