"""Literature-search queries over documents as works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmine.operators import search
from litmine.plans.registry import query, table


def works(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    return table(spark, d, "documents").select(
        k.alias("id"),
        k.alias("ord"),
        F.when(k % 3 == 0, F.concat(F.lit("https://doi.org/10.1/"), (k % 200).cast("string"))).alias("doi"),
        F.when(k % 3 == 1, (k % 300).cast("string")).alias("pmid"),
        F.when(k % 5 == 0, F.concat(F.lit("PMC"), k.cast("string"))).alias("pmcid"),
        F.substring("text", 1, 80).alias("title"),
        F.expr("substring(text, 81)").alias("abstract"),
        (1990 + k % 35).cast("int").alias("year"),
        (k * 7 % 113).alias("citations"),
        (k % 2 == 0).alias("is_open_access"),
        (k % 7 == 0).alias("has_full_text"),
        (k % 4 == 0).alias("has_pdf"),
        F.when(k % 3 == 0, "research-article").when(k % 3 == 1, "review").otherwise("").alias("article_type"),
        F.col("source").alias("domain"),
    )


CTE = """WITH works AS (
  SELECT doc_id AS id, doc_id AS ord, CASE WHEN doc_id % 3 = 0 THEN '10.1/' || (doc_id % 200) END AS doi, CASE WHEN doc_id % 3 = 1 THEN CAST(doc_id % 300 AS VARCHAR) END AS pmid,
    CASE WHEN doc_id % 5 = 0 THEN 'PMC' || doc_id END AS pmcid, text[1:80] AS title, text[81:] AS abstract, CAST(1990 + doc_id % 35 AS INT) AS year, doc_id * 7 % 113 AS citations,
    doc_id % 2 = 0 AS is_open_access, doc_id % 7 = 0 AS has_full_text, doc_id % 4 = 0 AS has_pdf,
    CASE doc_id % 3 WHEN 0 THEN 'research-article' WHEN 1 THEN 'review' ELSE '' END AS article_type, source AS domain FROM documents
)
"""
QUERIES = ["the erating", "les de la", "und der", "xq"]
_Q_SQL = ", ".join(f"({k}, '{q}')" for k, q in enumerate(QUERIES))
SCORED = (
    CTE
    + f""", q AS (SELECT * FROM (VALUES {_Q_SQL}) t(query_id, query)), p AS (
  SELECT query_id, id, year, citations, lower(title) AS t, lower(abstract) AS a, string_split(query, ' ') AS w FROM works, q
), s AS (
  SELECT query_id, id, year, citations, len(list_filter(w, lambda x: contains(t, x) OR contains(a, x))) AS hits, len(list_filter(w, lambda x: contains(t, x))) AS th, len(w) AS n FROM p
), r AS (SELECT *, least(1.0, hits / n + th * 0.1) AS relevance, ln(1 + citations) AS c FROM s WHERE hits > 0
), m AS (
  SELECT *, CASE WHEN max(c) OVER w - min(c) OVER w < 1e-4 THEN 0.5 ELSE (c - min(c) OVER w) / (max(c) OVER w - min(c) OVER w) END AS citation,
    CASE WHEN 2024 - year <= 0 THEN 1.0 WHEN 2024 - year >= 20 THEN 0.0 ELSE 1 / (1 + (2024 - year) / 5) END AS recency FROM r WINDOW w AS (PARTITION BY query_id)
)
"""
)


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, query string")


@query("l01_l05_hybrid_score", SCORED + "SELECT query_id, id, round(relevance, 6) AS relevance, round(citation, 6) AS citation, round(recency, 6) AS recency, round(least(1.0, greatest(0.0, 0.87 * relevance + 0.08 * citation + 0.05 * recency)), 6) AS score FROM m")
def _(spark, d):
    s = search.score_works(questions(spark), works(spark, d), 2024)
    return s.select("query_id", "id", *[F.round(c, 6).alias(c) for c in ("relevance", "citation", "recency", "score")])


@query("l06_relevance_bucket", SCORED + ", z AS (SELECT query_id, 0.87 * relevance + 0.08 * citation + 0.05 * recency AS score FROM m) SELECT query_id, CASE WHEN score >= 0.85 THEN 0 WHEN score >= 0.6 THEN 1 ELSE 2 END AS bucket, count(*) AS n FROM z GROUP BY ALL")
def _(spark, d):
    from litmine.functions.scalars import relevance_bucket

    s = search.score_works(questions(spark), works(spark, d), 2024)
    return s.groupBy("query_id", relevance_bucket(F.col("score")).alias("bucket")).agg(F.count("*").alias("n"))


@query(
    "l07_l08_ranked_search",
    SCORED
    + """, z AS (SELECT query_id, id, least(1.0, greatest(0.0, 0.87 * relevance + 0.08 * citation + 0.05 * recency)) AS score FROM m
), b AS (SELECT z.*, query, CASE WHEN score >= 0.85 THEN 0 WHEN score >= 0.6 THEN 1 ELSE 2 END AS bucket FROM z JOIN q USING (query_id)
), f AS (SELECT query_id, id, score + 0.15 * (1 - score) * (CAST('0x' || sha256('2024-01-01|' || bucket || '|' || query || '|' || id)[1:8] AS BIGINT) / 4294967296 - 0.5) AS final FROM b)
SELECT query_id, id, round(final, 6) AS final FROM f""",
)
def _(spark, d):
    s = search.ranked_search(questions(spark), works(spark, d), 2024, "2024-01-01")
    return s.select("query_id", "id", F.round("final", 6).alias("final"))


@query("l09_dedupe_key", CTE + r"SELECT id, CASE WHEN doi IS NOT NULL THEN 'doi:' || doi WHEN pmid IS NOT NULL THEN 'pmid:' || pmid WHEN pmcid IS NOT NULL THEN 'pmcid:' || pmcid ELSE 'title:' || regexp_replace(lower(trim(title)), '\s+', ' ', 'g') || '|year:' || year END AS key FROM works")
def _(spark, d):
    from litmine.functions.scalars import dedupe_key

    return works(spark, d).select("id", dedupe_key(F.col("doi"), F.col("pmid"), F.col("pmcid"), F.col("title"), F.col("year")).alias("key"))


_KEY = r"coalesce('doi:' || doi, 't:' || regexp_replace(lower(trim(title)), '\s+', ' ', 'g') || '|' || year)"


@query("l10_dedupe_keep_last", CTE + f"SELECT max(id) AS id, min(ord) AS ord FROM works GROUP BY {_KEY}")
def _(spark, d):
    return search.dedupe_keep_last(works(spark, d)).select("id", "ord")


@query("l11_merge_sources", CTE + "SELECT source, source_ord, count(*) AS n FROM (SELECT 'a' AS source, 0 AS source_ord FROM works WHERE id % 2 = 0 UNION ALL SELECT 'b', 1 FROM works WHERE id % 3 = 0) GROUP BY ALL")
def _(spark, d):
    w = works(spark, d)
    return search.merge_sources({"a": w.filter("id % 2 = 0"), "b": w.filter("id % 3 = 0").drop("domain")}).groupBy("source", "source_ord").agg(F.count("*").alias("n"))


@query("l12_sort_results", CTE + "SELECT id, row_number() OVER (ORDER BY citations DESC NULLS LAST, id) AS place FROM works ORDER BY place LIMIT 200")
def _(spark, d):
    top = search.sort_results(works(spark, d).select("id", "citations"), "cited").limit(200)
    return top.selectExpr("id", "CAST(row_number() OVER (ORDER BY citations DESC NULLS LAST, id) AS BIGINT) AS place")


@query("l13_full_text_filter", CTE + "SELECT id FROM works WHERE has_full_text OR is_open_access OR pmcid IS NOT NULL")
def _(spark, d):
    return search.full_text_filter(works(spark, d)).select("id")


@query("l14_search_works", CTE + "SELECT id FROM works WHERE is_open_access AND doi IS NOT NULL AND has_pdf AND domain = 'src0' AND article_type = 'research-article'")
def _(spark, d):
    return search.search_works(works(spark, d), open_access=True, article_type="research-article", quality=True, domain="src0").select("id")


@query("l15_paginate", CTE + ", r AS (SELECT domain, id, row_number() OVER (PARTITION BY domain ORDER BY id) AS rank, count(*) OVER (PARTITION BY domain) AS n FROM works) SELECT domain, id, rank, n > 50 AS has_more FROM r WHERE rank BETWEEN 26 AND 50")
def _(spark, d):
    r = works(spark, d).selectExpr("domain", "id", "CAST(row_number() OVER (PARTITION BY domain ORDER BY id) AS BIGINT) AS rank")
    return search.paginate(r, 2, by="domain")


@query("l16_type_counts", CTE + "SELECT CASE article_type WHEN 'review' THEN 'Review' ELSE 'Research Article' END AS type, count(*) AS n FROM works WHERE article_type <> '' GROUP BY 1")
def _(spark, d):
    return search.type_counts(works(spark, d))


FOUND = CTE + ", f AS (SELECT 'k' || (id % 400) AS identifier, id % 4 AS source_ord, id, CASE WHEN id % 7 = 0 THEN 'x' ELSE '' END AS full_text, CASE WHEN id % 2 = 0 THEN title ELSE '' END AS abstract FROM works)"


def found(spark, d):
    return works(spark, d).select(F.concat(F.lit("k"), (F.col("id") % 400).cast("string")).alias("identifier"), (F.col("id") % 4 * 1_000_000 + F.col("id")).alias("source_ord"), "id", F.when(F.col("id") % 7 == 0, "x").otherwise("").alias("full_text"), F.when(F.col("id") % 2 == 0, F.col("title")).otherwise("").alias("abstract"))


@query("l17_resolve_best_source", FOUND + ", c AS (SELECT *, CASE WHEN full_text <> '' THEN 2 WHEN abstract <> '' THEN 1 ELSE 0 END AS content FROM f) SELECT identifier, id, content FROM (SELECT *, row_number() OVER (PARTITION BY identifier ORDER BY content DESC, source_ord, id) AS n FROM c) WHERE n = 1")
def _(spark, d):
    return search.resolve_best_source(found(spark, d)).select("identifier", "id", "content")


@query("l18_abstract_fallback", CTE + ", a AS (SELECT * FROM works WHERE id % 3 = 0), b AS (SELECT * FROM works) SELECT coalesce(a.id, b.id) AS id, coalesce(b.title) AS title, b.abstract AS abstract FROM b LEFT JOIN a ON a.id = b.id")
def _(spark, d):
    w = works(spark, d).select("id", "title", "abstract")
    first = w.filter("id % 3 = 0").withColumn("abstract", F.lit("")).withColumn("title", F.lit(None).cast("string"))
    return search.abstract_fallback(first, w, "id")
