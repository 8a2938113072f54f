"""Scalar functions of the record and text normalisers, as native Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _cut(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


# --- identifiers ---------------------------------------------------------------

#: Patterns of identifiers in the order in which they are tried,
#: (pattern, kind, group, upper-cased).
IDENTIFIER_RULES = (
    (r"(?i)^https?://(?:www\.)?europepmc\.org/article/PMC/(PMC[0-9]+)", "pmcid", 1, False),
    (r"(?i)^https?://(?:www\.)?europepmc\.org/article/MED/([0-9]+)", "pmid", 1, False),
    (r"(?i)^https?://(?:www\.)?pubmed\.ncbi\.nlm\.nih\.gov/([0-9]+)", "pmid", 1, False),
    (r"(?i)^https?://(?:www\.)?ncbi\.nlm\.nih\.gov/pmc/articles/(PMC[0-9]+)", "pmcid", 1, True),
    (r"(?i)^https?://pmc\.ncbi\.nlm\.nih\.gov/articles/(PMC[0-9]+)", "pmcid", 1, True),
    (r"^https?://(?:dx\.)?doi\.org/(.+)", "doi", 1, False),
    (r"(?i)^doi:(.+)", "doi", 1, False),
    (r"(?i)^(PMC[0-9]+)$", "pmcid", 1, True),
    (r"^(10\..*)$", "doi", 1, False),
    (r"^([0-9]+)$", "pmid", 1, False),
)


def parse_identifier(raw: Column) -> Column:
    """STRUCT<type, value>: what kind of identifier a string is; the type is null for others."""
    val = F.trim(raw)
    kind, value = F.lit(None).cast("string"), val
    for pattern, name, group, upper in reversed(IDENTIFIER_RULES):
        found = F.trim(F.regexp_extract(val, pattern, group))
        hit = val.rlike(pattern)
        kind = F.when(hit, name).otherwise(kind)
        value = F.when(hit, F.upper(found) if upper else found).otherwise(value)
    return F.struct(kind.alias("type"), value.alias("value"))


def normalize_identifier(raw: Column) -> Column:
    """``parse_identifier`` with DOIs lower-cased."""
    p = parse_identifier(raw)
    return F.struct(p["type"].alias("type"), F.when(p["type"] == "doi", F.lower(p["value"])).otherwise(p["value"]).alias("value"))


def normalize_doi(raw: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.trim(F.coalesce(raw, F.lit("")))), r"^https?://(dx\.)?doi\.org/", "")
    return F.trim(F.regexp_replace(bare, "^doi:", ""))


def normalize_pmid(raw: Column) -> Column:
    return F.regexp_extract(F.coalesce(raw, F.lit("")), "([0-9]+)", 1)


def normalize_pmcid(raw: Column) -> Column:
    return F.regexp_extract(F.upper(F.coalesce(raw, F.lit(""))), "(PMC[0-9]+)", 1)


def dedupe_key(doi: Column, pmid: Column, pmcid: Column, title: Column, year: Column) -> Column:
    """The strongest identifier of a record, else its title and year."""
    by = [F.concat(F.lit(f"{n}:"), F.nullif(v, F.lit(""))) for n, v in (("doi", normalize_doi(doi)), ("pmid", normalize_pmid(pmid)), ("pmcid", normalize_pmcid(pmcid)))]
    plain = F.regexp_replace(F.lower(F.trim(F.coalesce(title, F.lit("")))), r"\s+", " ")
    return F.coalesce(*by, F.concat(F.lit("title:"), plain, F.lit("|year:"), F.coalesce(year.cast("string"), F.lit(""))))


def extract_doi(text: Column, variant: str = "pages") -> Column:
    """The first DOI in a text by the rules for "pages", "kb" or "ner"; empty if none."""
    if variant == "pages":
        return F.rtrim(F.regexp_extract(text, r"(10\.[0-9]{4,}/[^\s,;\"'>]+)", 1), F.lit("."))
    if variant == "kb":
        found = F.regexp_extract(F.substring(text, 1, 3000), r"(?i)\b(?:https?://doi\.org/|doi:\s*)?(10\.[0-9]{4,9}/[^\s\"'<>)]+)", 1)
        return F.rtrim(found, F.lit(".,;)"))
    return F.substring(F.regexp_extract(text, r"(10\.[0-9]{4,}/[^\s]+)", 1), 1, 100)


def extract_journal(text: Column) -> Column:
    """A journal name by two patterns in turn, 100 characters at most; null if none."""
    named = _cut(text, r"(?i)(?:Published in|Journal of|Proceedings of)[:\s]+([^\n]+)")
    kinds = "Journal|Review|Letters|Research|Science|Chemistry|Pharmacology|Phytochemistry|Biochemistry|Biology"
    shaped = _cut(text, rf"(?i)(?:^|\n)([A-Z][a-z]+(?: [A-Z][a-z]+)* (?:{kinds})[^\n]*)")
    return F.substring(F.trim(F.coalesce(named, shaped)), 1, 100)


# --- values ----------------------------------------------------------------------


def first_nonblank(*cols: Column) -> Column:
    """The first value that is not blank, trimmed; else empty (CSV loader)."""
    return F.coalesce(*map(blank_to_null, cols), F.lit(""))


def first_value(*cols: Column) -> Column:
    """The first value that is neither blank nor "nan", trimmed; else null (sheet loader)."""
    known = [F.when(F.lower(F.trim(c)) != "nan", blank_to_null(c)) for c in cols]
    return F.coalesce(*known)


def to_int(c: Column) -> Column:
    return F.when(F.trim(c).rlike(r"^[+-]?[0-9]+$"), F.trim(c).try_cast("int"))


def truthy(c: Column, loader: str = "csv") -> Column:
    if loader == "csv":
        return F.coalesce(F.upper(F.trim(c)).isin("TRUE", "1", "YES"), F.lit(False))
    return F.coalesce(F.lower(F.trim(c)).isin("yes", "true", "1", "open"), F.lit(False))


def coerce_year(c: Column) -> Column:
    return F.coalesce(blank_to_null(c.cast("string")), F.lit("Unknown year"))


def join_authors(names: Column) -> Column:
    """The first ten non-blank names, comma-joined; else "Unknown authors"."""
    real = F.filter(F.transform(names, lambda n: F.trim(n)), lambda n: n.isNotNull() & (n != ""))
    return F.coalesce(F.nullif(F.array_join(F.slice(real, 1, 10), ", "), F.lit("")), F.lit("Unknown authors"))


def reconstruct_abstract(index: Column) -> Column:
    """Text of a MAP<word, positions>: the first word wins a position, gaps stay as empty words."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e, k: F.transform(e["value"], lambda p: F.struct(p.alias("p"), k.alias("k"), e["key"].alias("w")))))
    # in order, each beside the one before it: words are set apart by as many spaces as places
    placed = F.array_sort(pairs)
    before = F.slice(F.concat(F.array(F.lit(-1).cast("long")), F.transform(placed, lambda x: x["p"].cast("long"))), F.lit(1), F.size(placed))
    words = F.zip_with(placed, before, lambda x, b: F.when(x["p"] == b, "").otherwise(F.concat(F.repeat(F.lit(" "), (x["p"] - b).cast("int")), x["w"])))
    return F.when(F.size(pairs) > 0, F.trim(F.array_join(words, ""))).otherwise(F.lit(""))


def format_publication_date(raw: Column, month: Column, year: Column, pub_year: Column) -> Column:
    """``dd Month yyyy`` of Y-M-D and Y-M; other dates as they are; else month and year, or the year."""
    day = F.date_format(F.try_to_timestamp(raw, F.lit("yyyy-MM-dd")), "dd MMMM yyyy")
    first = F.date_format(F.try_to_timestamp(raw, F.lit("yyyy-MM")), "dd MMMM yyyy")
    parts = F.size(F.split(raw, "-"))
    dated = F.when(parts == 3, F.coalesce(day, raw)).when(parts == 2, F.coalesce(first, raw)).otherwise(raw)
    number = F.when(month.rlike("^[0-9]+$"), F.lpad(month, 2, "0"))
    named = F.date_format(F.try_to_timestamp(F.concat_ws("-", year, F.initcap(F.substring(month, 1, 3))), F.lit("yyyy-MMM")), "dd MMMM yyyy")
    issue = F.date_format(F.try_to_timestamp(F.concat_ws("-", year, number), F.lit("yyyy-MM")), "dd MMMM yyyy")
    return F.coalesce(F.when(F.trim(raw) != "", dated), F.when(month.isNotNull() & year.isNotNull(), F.coalesce(issue, named)), year, pub_year)


def map_article_type(c: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(t == "research-article", "article").otherwise(t)


def title_case(c: Column) -> Column:
    """Upper case after every character that is not a letter, lower case after letters."""
    low = F.lower(c)
    marks = F.transform(F.sequence(F.lit(1), F.length(low)), _title_at(low))
    return F.when(F.length(c) > 0, F.array_join(marks, "")).otherwise(c)


def _title_at(low: Column):
    return lambda i: F.when((i > 1) & low.substr(i - 1, F.lit(1)).rlike(r"^\p{L}$"), low.substr(i, F.lit(1))).otherwise(F.upper(low.substr(i, F.lit(1))))


def flatten_entity(meta: Column) -> Column:
    """STRUCT<aliases, rest> of a JSON object: its alias list ([] if not a list) and its other keys."""
    fields = F.from_json(meta, "map<string,string>")
    aliases = F.coalesce(F.from_json(F.when(F.substring(F.trim(fields["aliases"]), 1, 1) == "[", fields["aliases"]), "array<string>"), F.array().cast("array<string>"))
    return F.struct(aliases.alias("aliases"), F.map_filter(fields, lambda k, v: k != "aliases").alias("rest"))


def flatten_metadata_values(df: DataFrame, *columns: str) -> Column:
    """MAP<string,string> of columns: nulls are empty, lists, maps and structs JSON, all else its text."""
    pairs = []
    for c in columns:
        kind = df.schema[c].dataType
        plain = not isinstance(kind, (T.ArrayType, T.MapType, T.StructType))
        value = F.col(f"`{c}`").cast("string") if plain else F.to_json(F.col(f"`{c}`"))
        pairs += [F.lit(c), F.coalesce(value, F.lit(""))]
    return F.create_map(*pairs)


def embedding_version(model: Column, dim: Column) -> Column:
    return F.substring(F.md5(F.concat_ws(":", model, dim.cast("string"))), 1, 8)


# --- text ------------------------------------------------------------------------


def normalize_text(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")


def html_to_text(html: Column, side: str = "server") -> Column:
    """Text of HTML: without comments, scripts and styles; tags vanish ("server") or become spaces ("client")."""
    body = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->", "")
    body = F.regexp_replace(body, r"(?is)<(script|style)\b[^>]*>.*?</(?:script|style)>", "")
    body = F.regexp_replace(body, r"(?s)<[^>]*>", "" if side == "server" else " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        body = F.replace(body, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(body, r"[\s ]+", " "))


def normalize_separators(c: Column) -> Column:
    """Dashes, bars and slashes as hyphens; lengths stay."""
    return F.translate(c, "–—―−/", "-----")


def normalize_chem_punct(c: Column) -> Column:
    """``/ > ,`` and primes as one space each; lengths stay."""
    return F.translate(c, "/>,′‘’", "      ")


#: Greek letters and their Latin names, in alphabetical order.
GREEK = dict(
    zip(
        "αβγδεζηθικλμνξοπρστυφχψω",
        "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split(),
    )
) | {"ς": "sigma"}


def normalize_greek(c: Column) -> Column:
    """Greek letters as Latin names, with a hyphen after a letter or digit."""

    def step(text: Column, item: tuple[str, str]) -> Column:
        letter, name = item
        both = f"[{letter}{letter.upper()}]" if letter != "ς" else letter
        text = F.regexp_replace(text, rf"(?<=[\p{{L}}\p{{N}}]){both}", f"-{name}")
        return F.regexp_replace(text, both, name)

    marked = reduce(step, GREEK.items(), c)
    return marked


def split_abbreviations(c: Column) -> Column:
    """A stop after a single capital stands apart: ``D.`` becomes ``D .``."""
    return F.regexp_replace(c, r"(?<![\p{L}\p{N}])([A-Z])\.", "$1 .")


def page_for_offset(text: Column, offset: Column) -> Column:
    """Number of the last ``<!-- Page N -->`` before an offset (from 0), or null."""
    marks = F.regexp_extract_all(F.substring(text, F.lit(1), offset), F.lit(r"<!-- Page ([0-9]+) -->"), F.lit(1))
    return F.try_element_at(marks, F.lit(-1)).cast("int")


#: Fragments by which an answer says that it has none.
REFUSALS = (
    "does not mention", "do not mention", "does not contain", "do not contain", "no information", "not enough information",
    "insufficient information", "cannot answer", "can't answer", "unable to answer", "don't know", "do not know",
    "not provided", "not in the context", "unclear from", "cannot determine", "can't determine", "is not available",
)


def is_non_factual(sentence: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(F.lower(sentence), F.lit(x)) for x in REFUSALS])


def is_chrome_sentence(sentence: Column) -> Column:
    """Links, copyright lines, and all-capital lines of ten characters or more."""
    low = F.lower(sentence)
    linked = low.rlike(r"https?://|doi\.org|©|all rights reserved")
    shouted = (F.length(F.trim(sentence)) >= 10) & (F.upper(sentence) == sentence) & (F.regexp_count(sentence, F.lit(r"\p{L}")) >= 2)
    return linked | shouted


MARKER = r"\[\s*[Cc]?\s*([0-9]+)\s*\]"


def parse_markers(answer: Column, valid: Column | None = None) -> Column:
    """Ids ``cN`` that an answer cites, in the order of first mention; only valid ones if given."""
    ids = F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(MARKER), F.lit(1)), lambda n: F.concat(F.lit("c"), n)))
    return ids if valid is None else F.array_intersect(ids, valid)


def strip_markers(answer: Column) -> Column:
    bare = F.regexp_replace(answer, r"\[\s*[Cc]?\s*[0-9]+\s*\]|\[†\]", "")
    return F.trim(F.regexp_replace(bare, "  +", " "))


def mask_markers(answer: Column) -> Column:
    return F.regexp_replace(answer, MARKER, "[†]")


def keyword_score(query: Column, title: Column, abstract: Column) -> Column:
    """Share of the query's words inside title or abstract, plus 0.1 for each in the title, at most 1."""
    words = F.filter(F.split(F.lower(F.trim(query)), r"\s+"), lambda w: w != "")
    t, a = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(abstract, F.lit("")))
    hits = F.size(F.filter(words, lambda w: F.contains(t, w) | F.contains(a, w)))
    bonus = F.size(F.filter(words, lambda w: F.contains(t, w)))
    return F.when(F.size(words) > 0, F.least(F.lit(1.0), hits / F.size(words) + bonus * 0.1)).otherwise(F.lit(0.5))


def recency_score(year: Column, as_of: int) -> Column:
    age = F.lit(as_of) - year
    return F.when(year.isNull(), 0.5).when(age <= 0, 1.0).when(age >= 20, 0.0).otherwise(1 / (1 + age / 5))


def relevance_bucket(score: Column) -> Column:
    return F.when(score >= 0.85, 0).when(score >= 0.6, 1).otherwise(2)


def l2_normalize(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    # bound by a lambda, the norm is computed once, not for each element
    return F.transform(F.array(norm), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v))[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def mcq_option(answer: Column) -> Column:
    """The option A to D that an answer names, by labelled patterns, then a lone letter; null if none."""
    up = F.upper(answer)
    shapes = (r"OPTION\s*[:\-]?\s*([ABCD])", r"ANSWER\s*[:\-]?\s*([ABCD])", r"CORRECT\s+OPTION\s*[:\-]?\s*([ABCD])", r"\b([ABCD])\b")
    return F.coalesce(*[_cut(up, s) for s in shapes])


def register_functions(spark: SparkSession) -> None:
    """The scalars that plain SQL can say, as temporary SQL functions."""
    rules = {
        "lit_normalize_doi(s STRING) RETURNS STRING": "trim(regexp_replace(regexp_replace(lower(trim(coalesce(s, ''))), '^https?://(dx[.])?doi[.]org/', ''), '^doi:', ''))",
        "lit_normalize_pmid(s STRING) RETURNS STRING": "regexp_extract(coalesce(s, ''), '([0-9]+)', 1)",
        "lit_normalize_pmcid(s STRING) RETURNS STRING": "regexp_extract(upper(coalesce(s, '')), '(PMC[0-9]+)', 1)",
        "lit_normalize_text(s STRING) RETURNS STRING": "regexp_replace(lower(trim(s)), '[ \\\\t\\\\n\\\\r\\\\f]+', ' ')",
        "lit_recency_score(y INT, as_of INT) RETURNS DOUBLE": "CASE WHEN y IS NULL THEN 0.5D WHEN as_of - y <= 0 THEN 1D WHEN as_of - y >= 20 THEN 0D ELSE 1 / (1 + (as_of - y) / 5) END",
        "lit_is_chrome(s STRING) RETURNS BOOLEAN": "lower(s) rlike 'https?://|doi[.]org|©|all rights reserved'",
        "lit_page_for_offset(t STRING, o INT) RETURNS INT": "CAST(try_element_at(regexp_extract_all(substring(t, 1, o), '<!-- Page ([0-9]+) -->', 1), -1) AS INT)",
        "lit_keyword_score(q STRING, t STRING) RETURNS DOUBLE": "least(1D, size(filter(split(lower(trim(q)), ' +'), w -> contains(lower(t), w))) / size(split(lower(trim(q)), ' +')))",
    }
    for head, body in rules.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
