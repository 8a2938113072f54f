"""Literature search over works(id, doi, pmid, pmcid, title, abstract, authors, journal, year, citations, …)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litmine.functions.scalars import dedupe_key, keyword_score, normalize_doi, normalize_text, recency_score, relevance_bucket

MAX_QUERIES = 1000
CITATION_WEIGHT, RECENCY_WEIGHT, NOISE = 0.08, 0.05, 0.15


def minmax(value: Column, *by: str) -> Column:
    """Values scaled to 0..1 within a partition; 0.5 for all if they hardly differ."""
    w = Window.partitionBy(*by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high - low < 1e-4, 0.5).otherwise((value - low) / (high - low))


def seeded_noise(score: Column, *seed: Column) -> Column:
    """Noise that only the seed decides, smaller for better scores."""
    u = F.conv(F.substring(F.sha2(F.concat_ws("|", *seed), 256), 1, 8), 16, 10).cast("double") / 2**32
    return NOISE * (1 - score) * (u - 0.5)


def score_works(queries: DataFrame, works: DataFrame, as_of: int) -> DataFrame:
    """Each query's works that share a word with it, with relevance, citation, recency and hybrid scores.

    ``queries``: (query_id, query), a stated set of MAX_QUERIES at most that every task
    gets; words are looked for inside words, which no equality join can find.
    """
    if queries.limit(MAX_QUERIES + 1).count() > MAX_QUERIES:
        raise ValueError(f"more than {MAX_QUERIES} queries at once; hand them in in blocks")
    pairs = works.join(F.broadcast(queries), _shares_word(F.col("query"), F.col("title"), F.col("abstract")))
    rel = keyword_score(F.col("query"), F.col("title"), F.col("abstract"))
    scored = pairs.withColumn("relevance", rel)
    scored = scored.withColumn("citation", minmax(F.log1p(F.coalesce("citations", F.lit(0)).cast("double")), "query_id"))
    scored = scored.withColumn("recency", recency_score(F.col("year"), as_of))
    hybrid = (1 - CITATION_WEIGHT - RECENCY_WEIGHT) * F.col("relevance") + CITATION_WEIGHT * F.col("citation") + RECENCY_WEIGHT * F.col("recency")
    return scored.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), hybrid)))


def _shares_word(query: Column, title: Column, abstract: Column) -> Column:
    text = F.lower(F.concat_ws(" ", title, abstract))
    return F.exists(F.split(F.lower(F.trim(query)), r"\s+"), lambda w: (w != "") & F.contains(text, w))


def ranked_search(queries: DataFrame, works: DataFrame, as_of: int, day: str) -> DataFrame:
    """``score_works`` with relevance bucket, seeded noise and rank."""
    scored = score_works(queries, works, as_of).withColumn("bucket", relevance_bucket(F.col("score")))
    noisy = scored.withColumn("final", F.col("score") + seeded_noise(F.col("score"), F.lit(day), F.col("bucket").cast("string"), F.col("query"), F.col("id").cast("string")))
    return noisy.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("final"), "id")))


def dedupe_keep_last(works: DataFrame) -> DataFrame:
    """One work per DOI, else per title and year: the last one, at the place (``ord``) of the first; without either it goes."""
    title = F.nullif(normalize_text(F.coalesce("title", F.lit(""))), F.lit(""))
    key = F.coalesce(F.concat(F.lit("doi:"), F.nullif(normalize_doi(F.col("doi")), F.lit(""))), F.concat(F.lit("t:"), title, F.lit("|"), F.coalesce(F.col("year").cast("string"), F.lit(""))))
    rest = [c for c in works.columns if c != "ord"]
    keyed = works.withColumn("_key", key).filter("_key IS NOT NULL")
    one = keyed.groupBy("_key").agg(F.max_by(F.struct(*rest), "ord").alias("w"), F.min("ord").alias("ord"))
    return one.select("w.*", "ord")


def dedupe_works(works: DataFrame) -> DataFrame:
    """The first work (by ``ord``) of each strongest identifier."""
    key = dedupe_key(F.col("doi"), F.col("pmid"), F.col("pmcid"), F.col("title"), F.col("year"))
    rest = [c for c in works.columns if c != "ord"]
    one = works.withColumn("_key", key).groupBy("_key").agg(F.min_by(F.struct(*rest), "ord").alias("w"), F.min("ord").alias("ord"))
    return one.select("w.*", "ord", F.col("_key").alias("dedupe_key"))


def merge_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """All sources' works with their label and place, the first source first."""
    labelled = [df.withColumn("source", F.lit(name)).withColumn("source_ord", F.lit(k)) for k, (name, df) in enumerate(sources.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), labelled)


def sort_results(works: DataFrame, by: str = "relevance") -> DataFrame:
    if by == "cited":
        return works.orderBy(F.desc_nulls_last("citations"), "id")
    if by in ("date", "date_asc"):
        return works.orderBy(F.asc_nulls_last("year") if by == "date_asc" else F.desc_nulls_last("year"), "id")
    return works


def full_text_filter(works: DataFrame) -> DataFrame:
    return works.filter(F.coalesce("has_full_text", F.lit(False)) | F.coalesce("is_open_access", F.lit(False)) | (F.coalesce("pmcid", F.lit("")) != ""))


def search_works(works: DataFrame, open_access: bool = False, full_text: bool = False, article_type: str | None = None, quality: bool = False, domain: str | None = None) -> DataFrame:
    out = works
    if open_access:
        out = out.filter("is_open_access")
    if full_text:
        out = out.filter("has_full_text")
    if article_type:
        out = out.filter(F.col("article_type") == article_type)
    if quality:
        out = out.filter("coalesce(doi, '') <> '' AND has_pdf AND is_open_access")
    if domain:
        out = out.filter(F.col("domain") == domain)
    return out


def paginate(ranked: DataFrame, page: int, size: int = 25, by: str = "query_id", rank: str = "rank") -> DataFrame:
    """Page (from 1) of each query's ranks, with has_more."""
    last = F.max(rank).over(Window.partitionBy(by))
    return ranked.withColumn("has_more", last > page * size).filter(F.col(rank).between((page - 1) * size + 1, page * size))


def type_counts(works: DataFrame) -> DataFrame:
    name = F.initcap(F.regexp_replace(F.trim("article_type"), "[-_]", " "))
    return works.filter("trim(coalesce(article_type, '')) <> ''").groupBy(name.alias("type")).agg(F.count("*").alias("n"))


def resolve_best_source(found: DataFrame) -> DataFrame:
    """One record per identifier: best content (2 full text, 1 abstract, 0), earlier source on ties."""
    content = F.when(F.coalesce("full_text", F.lit("")) != "", 2).when(F.coalesce("abstract", F.lit("")) != "", 1).otherwise(0)
    w = Window.partitionBy("identifier").orderBy(F.desc("content"), "source_ord")
    return found.withColumn("content", content).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def abstract_fallback(first: DataFrame, second: DataFrame, key: str = "identifier") -> DataFrame:
    """The first source's record if it has an abstract, else the second's; missing fields from the other."""
    fields = [c for c in first.columns if c != key]
    a, b = first.alias("a"), second.alias("b")
    j = a.join(b, key, "full_outer")
    use_a = F.coalesce(F.col("a.abstract"), F.lit("")) != ""
    return j.select(key, *[F.when(use_a, F.coalesce(f"a.{c}", f"b.{c}")).otherwise(F.coalesce(f"b.{c}", f"a.{c}")).alias(c) for c in fields])
