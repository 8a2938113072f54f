"""Dictionary entity recognition, normalisation and counting.

Matching runs in one of three ways: small dictionaries become n-grams joined to the text's
n-grams (native; words only), larger ones a token trie that each Python worker builds once
from the broadcast patterns and keeps, and those of any size are stored first
(``store_dictionary``) and mapped into the workers' memory.  Matchers take a DataFrame or
the path of a stored dictionary.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litmine.functions.markup import Highlighter
from litmine.functions.scalars import GREEK, flatten_entity
from litmine.operators import terms
from litmine.operators.slices import map_in_slices

#: Terms of a dictionary that may be broadcast; a larger one is refused, not cut, and is to be stored.
MAX_TERMS = 300_000
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
#: Labels in the order in which matchers run.
MATCH_ORDER = ("PLANT PART", "ANALYTICAL TECHNIQUE", "EXTRACTION METHOD", "DEVELOPMENT STAGE", "SEASON", "SPECIES", "CHEMICAL", "BIOACTIVITY")
MODEL_LABELS = ("CHEMICAL", "SPECIES", "LOCATION", "BIOACTIVITY", "DISEASE")


# --- dictionaries --------------------------------------------------------------------


def build_simple_dictionary(terms: DataFrame, label: str) -> DataFrame:
    """(label, pattern, canonical) of (ord, term, synonyms): each term and its synonyms; the last row wins."""
    rows = terms.filter(F.trim("term") != "").filter(~F.trim("term").startswith("#"))
    names = F.concat(F.array("term"), F.coalesce(F.split("synonyms", r"\|"), F.array().cast("array<string>")))
    flat = rows.select("ord", F.lower(F.trim("term")).alias("canonical"), F.explode(names).alias("p")).select("ord", "canonical", F.lower(F.trim("p")).alias("pattern")).filter("pattern <> ''")
    return flat.groupBy("pattern").agg(F.max_by("canonical", "ord").alias("canonical")).select(F.lit(label).alias("label"), "pattern", "canonical")


def build_species_dictionary(species: DataFrame) -> DataFrame:
    """(label, pattern, canonical, is_pattern) of (ord, scientific_name, common_name).

    Two-word names add "g. epithet" and "g.epithet", which the first species to claim
    one keeps; common names can be looked up but are not matched.
    """
    s = species.filter(F.trim("scientific_name") != "").select("ord", F.trim("scientific_name").alias("canonical"), F.lower(F.trim("common_name")).alias("common"))
    words = F.split(F.lower("canonical"), r"\s+")
    short = F.when(F.size(words) == 2, F.array(F.concat(F.substring(words[0], 1, 1), F.lit(". "), words[1]), F.concat(F.substring(words[0], 1, 1), F.lit("."), words[1]))).otherwise(F.array().cast("array<string>"))
    full = s.select(F.lower("canonical").alias("pattern"), "canonical", "ord", F.lit(0).alias("rank"), F.lit(True).alias("is_pattern"))
    abbr = s.select(F.explode(short).alias("pattern"), "canonical", "ord", F.lit(1).alias("rank"), F.lit(True).alias("is_pattern"))
    common = s.filter("common <> ''").select(F.col("common").alias("pattern"), "canonical", "ord", F.lit(2).alias("rank"), F.lit(False).alias("is_pattern"))
    one = full.unionByName(abbr).unionByName(common).groupBy("pattern").agg(F.min_by(F.struct("canonical", "is_pattern"), F.struct("rank", "ord")).alias("e"))
    return one.select(F.lit("SPECIES").alias("label"), "pattern", "e.*")


def chemical_alias_variants(name: Column) -> Column:
    """A name with hyphens as spaces, without punctuation, without parentheses, without stereo prefix; distinct."""
    t = F.trim(name)
    spaced = F.trim(F.regexp_replace(F.regexp_replace(t, "[-_/]+", " "), r"\s+", " "))
    bare = F.trim(F.regexp_replace(F.regexp_replace(t, r"[^A-Za-z0-9\s]", ""), r"\s+", " "))
    return F.filter(F.array_distinct(F.array(t, spaced, bare, *_light_variants(t))), lambda v: v != "")


def _light_variants(t: Column) -> list[Column]:
    return [F.regexp_replace(t, "[()]", ""), F.regexp_replace(t, r"^\([A-Z](?:,[A-Z])*\)-", "")]


def build_chemical_dictionary(chemicals: DataFrame) -> DataFrame:
    """(label, pattern, canonical, cid) of (ord, name, synonyms): collisions go to names, then variants, then synonyms, then the shortest canonical."""
    c = chemicals.select("ord", F.trim("name").alias("canonical"), F.coalesce(F.split("synonyms", r"\|"), F.array().cast("array<string>")).alias("syn")).filter("canonical <> ''")
    names = c.select("ord", "canonical", F.posexplode(chemical_alias_variants(F.col("canonical"))).alias("k", "alias")).withColumn("priority", F.when(F.col("k") == 0, 2).otherwise(1)).drop("k")
    syn = c.select("ord", "canonical", F.explode("syn").alias("s")).select("ord", "canonical", F.explode(F.array_distinct(F.array(F.trim("s"), *_light_variants(F.trim("s"))))).alias("alias"), F.lit(0).alias("priority"))
    return resolve_alias_collisions(names.unionByName(syn.select(names.columns)))


def resolve_alias_collisions(aliases: DataFrame) -> DataFrame:
    """One canonical per alias of (ord, canonical, alias, priority)."""
    low = aliases.withColumn("pattern", F.lower(F.trim("alias"))).filter("pattern <> ''")
    w = Window.partitionBy("pattern").orderBy(F.desc("priority"), F.length("canonical"), "ord")
    return low.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(F.lit("CHEMICAL").alias("label"), "pattern", "canonical")


def lookup(names: DataFrame, dictionary: DataFrame, column: str = "text") -> DataFrame:
    """``names`` plus canonical: by lower-cased name, for chemicals also by letters and digits alone."""
    exact = dictionary.groupBy("pattern").agg(F.min("canonical").alias("by_name"))
    bare = dictionary.filter("label = 'CHEMICAL'").groupBy(F.regexp_replace("pattern", "[^a-z0-9]", "").alias("bare")).agg(F.min("canonical").alias("by_bare"))
    j = names.withColumn("pattern", F.lower(F.trim(column))).withColumn("bare", F.regexp_replace("pattern", "[^a-z0-9]", ""))
    return j.join(exact, "pattern", "left").join(bare, "bare", "left").withColumn("canonical", F.coalesce("by_name", "by_bare")).drop("pattern", "bare", "by_name", "by_bare")


def aliases_for_canonical(dictionary: DataFrame) -> DataFrame:
    return dictionary.groupBy("label", "canonical").agg(F.array_sort(F.collect_set("pattern")).alias("aliases"))


# --- matching ------------------------------------------------------------------------

#: Patterns up to which n-grams are told apart by a set inside the plan, before the join.
FEW_GRAMS = 10_000


def match_ngrams(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(doc_id, label, text, canonical, start, end) of every dictionary phrase, by n-grams and an equality join.

    Places are word numbers from 0, the end exclusive; texts are split at what is
    neither letter nor digit, and so are the patterns.
    """
    split = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    p = _patterns(dictionary).withColumn("w", split(F.col("pattern"))).filter(F.size("w") > 0).select("label", F.array_join("w", " ").alias("gram"), "canonical", F.size("w").alias("n"))
    lengths = [r.n for r in p.select("n").distinct().collect()]  # the lengths that patterns have, a few
    few = sorted(tuple(r) for r in p.select("n", "gram").distinct().limit(FEW_GRAMS + 1).collect())
    rows = docs.select("doc_id", split(F.coalesce("text", F.lit(""))).alias("w"))
    if not lengths:
        return rows.select("doc_id", *[F.lit(None).cast(t).alias(c) for c, t in (("label", "string"), ("text", "string"), ("canonical", "string"), ("start", "int"), ("end", "int"))]).limit(0)
    of = {n: [g for k, g in few if k == n] if len(few) <= FEW_GRAMS else None for n in sorted(lengths)}
    grams = F.flatten(F.array(*[_grams(n, wanted) for n, wanted in of.items()]))
    p = F.broadcast(p) if len(few) <= FEW_GRAMS else p
    each = rows.select("doc_id", F.explode_outer(grams).alias("g")).filter("g IS NOT NULL").select("doc_id", "g.*")
    return each.join(p.select("label", "gram", "canonical"), "gram").select("doc_id", "label", F.col("gram").alias("text"), "canonical", "start", "end")


def _grams(n: int, wanted: list[str] | None) -> Column:
    """STRUCT<gram, start, end>s of n words; of the wanted ones alone, told apart by the first word, then by all."""
    room = F.size("w") - n
    gram = lambda i: F.get("w", i) if n == 1 else F.concat_ws(" ", *[F.get("w", i + k) for k in range(n)])
    one = lambda i: F.struct(gram(i).alias("gram"), i.alias("start"), (i + n).alias("end"))
    places = F.sequence(F.lit(0), room)
    if wanted is not None:
        places = F.filter(places, lambda i: F.get("w", i).isin(sorted({g.split(" ")[0] for g in wanted})))
        places = F.filter(places, lambda i: gram(i).isin(wanted)) if n > 1 else places
    return F.when(room >= 0, F.transform(places, one)).otherwise(F.array().cast("array<struct<gram:string,start:int,end:int>>"))


_WORD = re.compile(r"\w+")
_PIECE = re.compile(r"\w+|[^\w\s]")


class Trie:
    """Token sequences with their (label, canonical)s."""

    def __init__(self, patterns: Iterator[tuple[str, str, str]]):
        self.root: dict = {}
        for label, pattern, canonical in patterns:
            node = self.root
            for m in _PIECE.finditer(pattern.lower()):
                node = node.setdefault(m.group(), {})
            node.setdefault(None, []).append((label, canonical))

    def find(self, text: str) -> Iterator[tuple[str, str, int, int]]:
        """(label, canonical, start, end) of every phrase, places in characters."""
        words = [(m.group().lower(), m.start(), m.end()) for m in _PIECE.finditer(text)]
        for i in range(len(words)):
            node, k = self.root, i
            while k < len(words) and words[k][0] in node:
                node = node[words[k][0]]
                for label, canonical in node.get(None, ()):
                    yield label, canonical, words[i][1], words[k][2]
                k += 1


def _rewritten(text: str, pattern: re.Pattern, new: Callable[[re.Match], str]) -> tuple[str, list[int]]:
    """The text with ``new`` of each match in its place, and every character's place in the text before."""
    out, at, last = [], [], 0
    for m in pattern.finditer(text):
        out += [text[last : m.start()], new(m)]
        at += [*range(last, m.start()), *(min(m.start() + k, m.end() - 1) for k in range(len(out[-1])))]
        last = m.end()
    return "".join([*out, text[last:]]), [*at, *range(last, len(text))]


_GREEK = re.compile(f"[{''.join(GREEK)}]", re.IGNORECASE)
_CHEM_PUNCT = str.maketrans("/>,′‘’", "      ")
_CAPITAL_STOP = re.compile(r"(?<!\w)([A-Z])\.")
_SEPARATORS = str.maketrans("–—―−/", "-----")


def _greek_name(m: re.Match) -> str:
    name = GREEK.get(m[0]) or GREEK.get(m[0].lower()) or m[0]
    return f"-{name}" if m.string[: m.start()][-1:].isalnum() else name


def chemical_form(text: str) -> tuple[str, list[int]]:
    """A text as chemical patterns see it, and each character's place in the text."""
    named, at = _rewritten(text, _GREEK, _greek_name)
    out, places = _rewritten(named.translate(_CHEM_PUNCT), _CAPITAL_STOP, lambda m: f"{m[1]} .")
    return out, [at[k] for k in places]


def _chemical_noise(text: str) -> bool:
    return len(text) <= 1 or text.isdigit() or re.fullmatch(r"\(\d+", text) is not None


_SPANS = "doc_id long, label string, text string, canonical string, start int, end int"
Span = tuple[int, int, str, str]  # start, end, label, canonical
#: Tries of a worker by the dictionary's digest.
_BUILT: dict[str, tuple] = {}


def _patterns(dictionary: DataFrame) -> DataFrame:
    """Entries that are matched in texts; those with ``is_pattern`` false can only be looked up."""
    return dictionary.filter(F.coalesce("is_pattern", F.lit(True))) if "is_pattern" in dictionary.columns else dictionary


def _shared(spark: SparkSession, dictionary: DataFrame):
    """The patterns as a broadcast and their digest; reference data, of MAX_TERMS terms at most."""
    rows = sorted(tuple(r) for r in _patterns(dictionary).select("label", "pattern", "canonical").limit(MAX_TERMS + 1).collect())
    if len(rows) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} terms: store the dictionary (store_dictionary) and hand in its path")
    return spark.sparkContext.broadcast(rows), hashlib.sha256(repr(rows).encode()).hexdigest()


def _bare(text: str) -> str:
    return re.sub("[^a-z0-9]", "", chemical_form(text)[0].lower())


def _tries(digest: str, patterns) -> tuple:
    """(simple, techniques, chemicals, names of chemicals) of a dictionary, built once per worker."""
    if digest not in _BUILT:
        if len(_BUILT) > 3:
            _BUILT.clear()
        rows = patterns.value
        chemicals = [(lab, p, c) for lab, p, c in rows if lab == "CHEMICAL"]
        _BUILT[digest] = (
            Trie((lab, p, c) for lab, p, c in rows if lab not in ("CHEMICAL", "ANALYTICAL TECHNIQUE")),
            Trie((lab, p.translate(_SEPARATORS), c) for lab, p, c in rows if lab == "ANALYTICAL TECHNIQUE"),
            Trie((lab, chemical_form(p)[0], c) for lab, p, c in chemicals),
            {_bare(p) for _, p, _ in chemicals},
        )
    return _BUILT[digest]


#: Tables of a stored dictionary: those of ``_tries``, then chemicals and techniques in their plain form.
STORED = 5


def _pieces(text: str) -> list[str]:
    return [m.group() for m in _PIECE.finditer(text.lower())]


def _forms(label: str, pattern: str) -> list[tuple[int, list[str]]]:
    """Tables of a stored dictionary that a pattern is in, and as what."""
    if label == "CHEMICAL":
        return [(2, _pieces(chemical_form(pattern)[0])), (3, [_bare(pattern)]), (4, _pieces(pattern))]
    if label == "ANALYTICAL TECHNIQUE":
        return [(1, _pieces(pattern.translate(_SEPARATORS))), (4, _pieces(pattern))]
    return [(0, _pieces(pattern))]


def store_dictionary(dictionary: DataFrame, path: str) -> str:
    """Writes a dictionary's patterns, however many, to ``path``, a folder that executors can read; returns it for the matchers.

    It is built once; see ``terms``.  Patterns that are null or have no pieces match nothing.
    """
    terms.store_terms(_patterns(dictionary), path, _forms)
    return path


class StoredTrie:
    """A stored table with the interface of ``Trie``."""

    def __init__(self, table: terms.Terms):
        self.table = table

    def find(self, text: str) -> Iterator[tuple[str, str, int, int]]:
        if not len(self.table.keys):
            return iter(())
        return self.table.find([(m.group().lower(), m.start(), m.end()) for m in _PIECE.finditer(text)])


def _stored(files: list[str]) -> tuple:
    """As ``_tries``, of a stored dictionary's files."""
    key = repr(files)
    if key not in _BUILT:
        tables = terms.opened(files, STORED)
        _BUILT[key] = (*map(StoredTrie, tables[:3]), tables[3], StoredTrie(tables[4]))
    return _BUILT[key]


def _simple_spans(trie: Trie, text: str) -> set[Span]:
    return {(a, b, label, canonical) for label, canonical, a, b in trie.find(text)}


def _technique_spans(trie: Trie, text: str) -> set[Span]:
    """Dashes and slashes are read as hyphens; spans inside a longer one go."""
    found = _simple_spans(trie, text.translate(_SEPARATORS))
    widest, reach = set(), (-1, -1)
    for a, b in sorted({(a, b) for a, b, _, _ in found}, key=lambda x: (x[0], -x[1])):
        if b > reach[1]:
            widest.add((a, b))
            reach = (a, b)
    return {x for x in found if x[:2] in widest}


def _chemical_spans(trie: Trie, names: set[str], text: str) -> set[Span]:
    """Texts are read in their chemical form; mere digits, single characters and what no name resolves go."""
    seen, at = chemical_form(text)
    found = {(at[a], at[b - 1] + 1, label, canonical) for label, canonical, a, b in trie.find(seen)}
    return {x for x in found if not _chemical_noise(text[x[0] : x[1]]) and _bare(text[x[0] : x[1]]) in names}


def _matched(spark: SparkSession, docs: DataFrame, dictionary: DataFrame | str, spans: Callable[[tuple, str], set[Span]], keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, label, text, canonical, start, end) of what ``spans`` finds with a worker's tries in each text, and ``keep`` of its row."""
    if isinstance(dictionary, str):
        load = functools.partial(_stored, terms.ship(spark, dictionary))
    else:
        patterns, digest = _shared(spark, dictionary)
        load = functools.partial(_tries, digest, patterns)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tries = load()
        for rows in batches:
            mine = zip(rows["text"].fillna(""), *(rows[c] for c in ("doc_id", *keep)))
            out = [(doc, label, text[a:b], canonical, a, b, *rest) for text, doc, *rest in mine for a, b, label, canonical in spans(tries, text)]
            yield pd.DataFrame(out, columns=["doc_id", "label", "text", "canonical", "start", "end", *keep])

    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return map_in_slices(docs.select("doc_id", "text", *keep), find, _SPANS + kinds)


def match_trie(spark: SparkSession, docs: DataFrame, dictionary: DataFrame | str) -> DataFrame:
    """(doc_id, label, text, canonical, start, end) of every phrase, whatever its label, places in characters."""
    if isinstance(dictionary, str):
        return _matched(spark, docs, dictionary, lambda tries, text: _simple_spans(tries[0], text) | _simple_spans(tries[4], text))
    plain = dictionary.withColumn("canonical", F.to_json(F.struct("label", "canonical"))).withColumn("label", F.lit("any"))
    found = _matched(spark, docs, plain, lambda tries, text: _simple_spans(tries[0], text))
    named = F.from_json("canonical", "label string, canonical string")
    return found.withColumn("label", named["label"]).withColumn("canonical", named["canonical"])


def match_chemicals(spark: SparkSession, docs: DataFrame, dictionary: DataFrame | str) -> DataFrame:
    """Matches of the chemicals of a dictionary; see ``_chemical_spans``."""
    return _matched(spark, docs, dictionary, lambda tries, text: _chemical_spans(tries[2], tries[3], text))


def match_techniques(spark: SparkSession, docs: DataFrame, dictionary: DataFrame | str) -> DataFrame:
    """Matches of the techniques of a dictionary; see ``_technique_spans``."""
    return _matched(spark, docs, dictionary, lambda tries, text: _technique_spans(tries[1], text))


def resolve_overlaps(spans: DataFrame) -> DataFrame:
    """Per document the spans that stay: earliest start, then longest, each clear of those kept; spans without places all stay."""
    placed = spans.filter("start IS NOT NULL AND end IS NOT NULL")
    rest = [c for c in spans.columns if c not in ("doc_id", "start", "end")]
    item = F.struct("start", (-F.col("end")).alias("_minus_end"), *rest)
    lists = placed.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("s"))
    kept = F.pandas_udf(_clear_of_kept, "array<int>")(F.col("s.start"), F.col("s._minus_end"))
    out = lists.select("doc_id", "s", F.explode(kept).alias("k")).select("doc_id", F.get("s", F.col("k")).alias("x")).select("doc_id", "x.*")
    out = out.withColumn("end", -F.col("_minus_end")).drop("_minus_end").select(spans.columns)
    return out.unionByName(spans.filter("start IS NULL OR end IS NULL"))


def _clear_of_kept(starts: pd.Series, minus_ends: pd.Series) -> pd.Series:
    """Of each list of spans in order, the numbers of those that start where the last one kept has ended."""

    def one(a, b) -> list[int]:
        out, upto = [], -1
        for k, (start, minus_end) in enumerate(zip(a, b)):
            if start >= upto:
                out.append(k)
                upto = -minus_end
        return out

    return pd.Series([one(a, b) for a, b in zip(starts, minus_ends)])


def _all_spans(tries: tuple, text: str) -> list[Span]:
    """All matchers' spans, then as ``resolve_overlaps``; of equal places the matcher that runs first wins."""
    simple, techniques, chemicals, names = tries[:4]
    found = _simple_spans(simple, text) | _technique_spans(techniques, text) | _chemical_spans(chemicals, names, text)
    rank = {label: k for k, label in enumerate(MATCH_ORDER)}
    kept, upto = [], -1
    for x in sorted(found, key=lambda x: (x[0], -x[1], rank.get(x[2], -1), x[2], x[3])):
        if x[0] >= upto:
            kept.append(x)
            upto = x[1]
    return kept


def match_all(spark: SparkSession, docs: DataFrame, dictionary: DataFrame | str) -> DataFrame:
    """Spans (doc_id, label, text, canonical, start, end) of all matchers, one per place, in one pass over the texts."""
    return _matched(spark, docs, dictionary, _all_spans)


def match_sections(spark: SparkSession, sections: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``match_all`` per non-blank section (doc_id, ord, title, content), tagged with its title."""
    rows = sections.filter(F.trim("content") != "").select("doc_id", F.col("title").alias("section"), F.col("content").alias("text"))
    return _matched(spark, rows, dictionary, _all_spans, keep=("section",))


# --- model output, canonical forms, counts -----------------------------------------------

_ENTITY = "struct<span:string,text:string,type:string,label:string,score:double,start:int,end:int>"


def normalize_model_entities(rows: DataFrame) -> DataFrame:
    """(doc_id, label, text, score, start, end) of model output (doc_id, raw).

    A list, one object, or a list under entities, data, results or items; a reasoning
    block before it is dropped; unknown labels and blank texts go.
    """
    body = F.trim(F.regexp_replace("raw", r"(?s)<think>.*?</think>|```(?:json)?", ""))
    named = F.from_json(body, f"struct<entities:array<{_ENTITY}>,data:array<{_ENTITY}>,results:array<{_ENTITY}>,items:array<{_ENTITY}>>")
    lists = F.when(body.startswith("["), F.from_json(body, f"array<{_ENTITY}>")).otherwise(F.coalesce(*[named[k] for k in ("entities", "data", "results", "items")], F.array(F.from_json(body, _ENTITY))))
    e = rows.select("doc_id", F.explode(lists).alias("e"))
    label = F.upper(F.trim(F.coalesce("e.type", "e.label")))
    out = e.select("doc_id", F.when(label == "DRUG", "CHEMICAL").otherwise(label).alias("label"), F.trim(F.coalesce("e.span", "e.text")).alias("text"), F.coalesce("e.score", F.lit(1.0)).alias("score"), "e.start", "e.end")
    return out.filter(F.col("label").isin(*MODEL_LABELS) & (F.col("text") != ""))


def union_hybrid(dictionary: DataFrame, model: DataFrame) -> DataFrame:
    """Both systems' spans, equal (place, label) once, the dictionary's first."""
    both = dictionary.withColumn("_s", F.lit(0)).unionByName(model.withColumn("_s", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy("doc_id", "start", "end", "label").orderBy("_s")
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_s", "_n")


def canonicalize(entities: DataFrame, dictionary: DataFrame, overwrite: bool = True) -> DataFrame:
    """``entities`` plus canonical: the dictionary's, else the text; an existing one stays unless ``overwrite``."""
    known = dictionary.groupBy("label", F.col("pattern").alias("_low")).agg(F.min("canonical").alias("_canonical"))
    j = entities.withColumn("_low", F.lower(F.trim("text"))).join(known, ["label", "_low"], "left")
    fresh = F.coalesce("_canonical", "text")
    old = F.col("canonical") if "canonical" in entities.columns and not overwrite else F.lit(None).cast("string")
    return j.withColumn("canonical", F.coalesce(old, fresh)).drop("_low", "_canonical")


def _each_term(terms: DataFrame, docs: DataFrame, places: Callable[[str, list[str]], list[tuple[str, int]]]) -> DataFrame:
    """``terms`` (doc_id, term, …) with n, a row for each of ``places(text, terms)``: a text meets its terms once, as one list; a missing one is empty."""
    rest = [c for c in terms.columns if c not in ("doc_id", "term")]
    lists = terms.groupBy("doc_id").agg(F.collect_list(F.struct("term", *rest)).alias("terms"))  # a document's own terms
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for doc, text, found in rows.itertuples(index=False, name=None):
                at: dict[str, list[int]] = {}
                for term, n in places(text or "", list({x["term"] for x in found})):
                    at.setdefault(term, []).append(n)
                out += [(doc, x["term"], *(x[c] for c in rest), n) for x in found for n in at.get(x["term"], ())]
            yield pd.DataFrame(out, columns=["doc_id", "term", *rest, "n"])

    kinds = "".join(f", `{c}` {terms.schema[c].dataType.simpleString()}" for c in rest)
    return map_in_slices(docs.select("doc_id", "text").join(lists, "doc_id", "right"), count, f"doc_id {kind}, term string{kinds}, n int")


def _word_counts(text: str, terms: list[str]) -> list[tuple[str, int]]:
    low = text.lower()
    words = Counter(_WORD.findall(low))
    return [(t, words[t.lower()] if _WORD.fullmatch(t) else _apart(low, t.lower())) for t in terms]


def _apart(text: str, term: str) -> int:
    """Places of a term, none in another, with no word character beside it."""
    n, at = 0, text.find(term)
    while at >= 0 and term:
        end = at + len(term)
        free = not (_WORD.match(text[at - 1 : at]) or _WORD.match(text[end : end + 1]))
        n += free
        at = text.find(term, end if free else at + 1)
    return n


def _starts(text: str, terms: list[str]) -> list[tuple[str, int]]:
    out = []
    for t in terms:
        at = text.find(t)
        while at >= 0:
            out.append((t, at))
            at = text.find(t, at + 1)
    return out


def whole_words(terms: DataFrame, docs: DataFrame) -> DataFrame:
    """``terms`` (doc_id, term, …) with n: how often the term stands in the text with no word character beside it, whatever the case."""
    return _each_term(terms, docs, _word_counts)


def summarize_entities(entities: DataFrame, docs: DataFrame, least: float = 0.7) -> DataFrame:
    """(doc_id, label, text, score, count): confident entities by lower-cased text, most used casing, mean score, count in the text."""
    good = entities.filter(F.coalesce("score", F.lit(1.0)) >= least).withColumn("low", F.lower("text"))
    casing = good.groupBy("doc_id", "label", "low", "text").agg(F.count("*").alias("k"), F.min("start").alias("first"), F.sum(F.coalesce("score", F.lit(1.0))).alias("s"))
    one = casing.groupBy("doc_id", "label", "low").agg(F.max_by("text", F.struct(F.col("k"), -F.coalesce("first", F.lit(0)))).alias("text"), F.bround(F.sum("s") / F.sum("k"), 2).alias("score"))
    n = whole_words(one.withColumnRenamed("low", "term"), docs)
    return n.filter("n > 0").select("doc_id", "label", "text", "score", F.col("n").alias("count"))


def find_occurrences(entities: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, label, text, start, end): every place of each distinct (text, label), overlapping ones too."""
    one = entities.select("doc_id", F.col("text").alias("term"), "label").filter("term <> ''").distinct()
    at = _each_term(one, docs, _starts)
    return at.select("doc_id", "label", F.col("term").alias("text"), F.col("n").alias("start"), (F.col("n") + F.length("term")).alias("end"))


def merge_by_canonical(entities: DataFrame) -> DataFrame:
    """(doc_id, label, canonical, count, aliases): counts per lower-cased canonical with the texts seen."""
    return entities.groupBy("doc_id", "label", F.lower("canonical").alias("canonical")).agg(F.sum("count").alias("count"), F.array_sort(F.collect_set("text")).alias("aliases"))


def group_with_counts(entities: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, label, canonical, display, count): whole-word counts of all aliases, 1 at least; shown by the most frequent."""
    alias = entities.select("doc_id", "label", F.lower(F.coalesce("canonical", "text")).alias("canonical"), F.col("text").alias("alias")).distinct()
    n = whole_words(alias.withColumn("term", F.lower("alias")), docs)
    low = n.groupBy("doc_id", "label", "canonical", F.lower("alias").alias("a")).agg(F.max("n").alias("n"), F.min("alias").alias("alias"))
    return low.groupBy("doc_id", "label", "canonical").agg(F.greatest(F.sum("n"), F.lit(1)).alias("count"), F.max_by("alias", F.struct("n", F.length("alias"))).alias("display"))


def highlight_entities(sections: DataFrame, entities: DataFrame) -> DataFrame:
    """``sections`` (doc_id, ord, html) with the entities (doc_id, text, label, perhaps meta) of their document marked.

    Names are found whole, whatever their case, longest first, over presenting tags too;
    see ``markup.Highlighter``.  ``meta``, MAP<string, string>, gives species their data
    attributes.  Sections without html, and documents without entities, stay as they are.
    """
    meta = F.col("meta") if "meta" in entities.columns else F.lit(None).cast("map<string,string>")
    # a map can't be told apart in a set, so it goes along as its sorted entries
    item = F.struct("text", "label", F.array_sort(F.map_entries(meta)).alias("meta"))
    lists = entities.filter("text <> ''").groupBy("doc_id").agg(F.collect_set(item).alias("e"))  # a document's own entities
    kind = sections.schema["doc_id"].dataType.simpleString()

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for doc, n, html, found in rows.itertuples(index=False, name=None):
                if found is not None and len(found) and html:
                    html = Highlighter([(x["text"], x["label"] or "", {m["key"]: m["value"] for m in x["meta"]} if x["meta"] is not None else {}) for x in found]).mark(html)
                out.append((doc, n, html))
            yield pd.DataFrame(out, columns=["doc_id", "ord", "html"])

    return map_in_slices(sections.join(lists, "doc_id", "left").select("doc_id", "ord", "html", "e"), mark, f"doc_id {kind}, ord int, html string")


def load_precomputed(cached: DataFrame, stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """Entities of the cache; for documents that it lacks, those of the database."""
    return cached.unionByName(stored.join(cached.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def export_entities(entities: DataFrame) -> DataFrame:
    """Rows of a paper's export: Type, Name, Count, Variants, the name first and each variant once whatever its case."""
    e = entities.withColumn("all", F.concat(F.array("canonical"), F.array_sort("aliases")))
    low = F.transform("all", lambda x: F.lower(x))
    once = F.filter("all", lambda x, i: F.array_position(low, F.lower(x)) == i + 1)
    return e.select("doc_id", F.col("label").alias("Type"), F.col("canonical").alias("Name"), F.col("count").alias("Count"), F.array_join(once, "; ").alias("Variants")).orderBy("doc_id", "Type", "Name")


def spread_metadata(entities: DataFrame) -> DataFrame:
    return entities.withColumn("m", flatten_entity(F.col("metadata")))
