"""Knowledge-base, dashboard and cross-paper queries over the star schema as papers and entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmine.functions.scalars import title_case
from litmine.operators import analytics, dashboard, kb
from litmine.plans.registry import query, table


def papers(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("10.1000/"), F.col("o_orderkey").cast("string")).alias("doi"),
        F.concat(F.lit("Order "), "o_orderkey", F.lit(" of "), "o_custkey").alias("title"),
        F.col("o_orderpriority").alias("journal"),
        F.year("o_orderdate").alias("year"),
        (F.col("o_orderstatus") == "O").alias("is_open_access"),
    )


def entities(spark: SparkSession, d: str) -> DataFrame:
    li, p, s, n = (table(spark, d, t) for t in ("lineitem", "part", "supplier", "nation"))
    goods = li.join(p, li.l_partkey == p.p_partkey).groupBy(F.col("l_orderkey").alias("paper_id"), F.upper("p_type").alias("label"), F.col("p_name").alias("canonical_text")).agg(F.count("*").alias("frequency"))
    at = li.join(s, li.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey)
    places = at.groupBy(F.col("l_orderkey").alias("paper_id"), F.lit("LOCATION").alias("label"), F.col("n_name").alias("canonical_text")).agg(F.count("*").alias("frequency"))
    places = places.withColumn("metadata", F.to_json(F.struct(F.col("canonical_text").alias("country"))))
    return goods.withColumn("metadata", F.lit(None).cast("string")).unionByName(places)


CTE = r"""
WITH papers AS (
  SELECT o_orderkey AS id, '10.1000/' || o_orderkey AS doi, 'Order ' || o_orderkey || ' of ' || o_custkey AS title,
         o_orderpriority AS journal, year(o_orderdate) AS year, o_orderstatus = 'O' AS is_open_access FROM orders
), entities AS (
  SELECT l_orderkey AS paper_id, upper(p_type) AS label, p_name AS canonical_text, count(*) AS frequency, CAST(NULL AS VARCHAR) AS country
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL
  UNION ALL
  SELECT l_orderkey, 'LOCATION', n_name, count(*), n_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL
)
"""


@query("d01_total_papers", "SELECT count(*) AS n FROM orders")
def _(spark, d):
    return dashboard.total_papers(papers(spark, d))


@query("d02_total_entities", CTE + "SELECT count(*) AS n FROM (SELECT DISTINCT label, canonical_text FROM entities)")
def _(spark, d):
    return dashboard.total_entities(entities(spark, d))


@query("d03_total_journals", "SELECT count(DISTINCT o_orderpriority) AS n FROM orders")
def _(spark, d):
    return dashboard.total_journals(papers(spark, d))


@query("d04_top_journals", CTE + "SELECT string_agg(journal, ', ' ORDER BY n DESC, journal) AS journals FROM (SELECT journal, count(*) AS n FROM papers GROUP BY 1 ORDER BY n DESC, journal LIMIT 3)")
def _(spark, d):
    return dashboard.top_journals(papers(spark, d))


@query("d05_papers_by_journal", CTE + "SELECT journal, count(*) AS n FROM papers WHERE journal IS NOT NULL GROUP BY 1")
def _(spark, d):
    return dashboard.papers_by_journal(papers(spark, d))


@query("d06_entity_distribution", CTE + "SELECT array_to_string(list_transform(string_split(lower(label), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS label, count(DISTINCT canonical_text) AS n FROM entities GROUP BY label")
def _(spark, d):
    return dashboard.entity_distribution(entities(spark, d))


@query("d07_papers_by_year", CTE + "SELECT CAST(year AS VARCHAR) AS year, count(*) AS n FROM papers GROUP BY 1")
def _(spark, d):
    return dashboard.papers_by_year(papers(spark, d))


@query("d08_geo_distribution", CTE + "SELECT country, count(DISTINCT paper_id) AS n FROM entities WHERE label = 'LOCATION' AND trim(country) <> '' GROUP BY 1")
def _(spark, d):
    return dashboard.geo_distribution(entities(spark, d))


@query(
    "d09_dashboard_metrics",
    CTE
    + """SELECT 'papers' AS metric, '' AS key, count(*) AS value FROM papers
UNION ALL SELECT 'entities', '', count(*) FROM (SELECT DISTINCT label, canonical_text FROM entities)
UNION ALL SELECT 'journals', '', count(DISTINCT journal) FROM papers
UNION ALL SELECT 'by_journal', journal, count(*) FROM papers GROUP BY 2
UNION ALL SELECT 'by_year', CAST(year AS VARCHAR), count(*) FROM papers GROUP BY 2
UNION ALL SELECT 'by_label', array_to_string(list_transform(string_split(lower(label), ' '), lambda w: upper(w[1]) || w[2:]), ' '), count(DISTINCT canonical_text) FROM entities GROUP BY 2
UNION ALL SELECT 'by_country', country, count(DISTINCT paper_id) FROM entities WHERE label = 'LOCATION' GROUP BY 2""",
)
def _(spark, d):
    return dashboard.dashboard_metrics(papers(spark, d), entities(spark, d))


@query(
    "d10_list_papers",
    CTE
    + """, f AS (SELECT * FROM papers WHERE year = 1996 AND (title ILIKE '%of 1%' OR journal ILIKE '%of 1%')
  AND id IN (SELECT paper_id FROM entities WHERE label = 'LOCATION' AND country = (SELECT min(n_name) FROM nation)))
SELECT f.*, (SELECT count(*) FROM f) AS total FROM f ORDER BY id DESC LIMIT 50 OFFSET 10""",
)
def _(spark, d):
    land = table(spark, d, "nation").agg(F.min("n_name")).first()[0]
    return dashboard.list_papers(papers(spark, d), entities(spark, d), 50, 10, country=land, query="of 1", year=1996)


@query("d11_paper_id_by_doi", CTE + "SELECT 'https://doi.org/' || doi AS doi, id FROM papers")
def _(spark, d):
    p = papers(spark, d)
    return dashboard.paper_id_by_doi(p.select(F.concat(F.lit("https://doi.org/"), "doi").alias("doi")), p)


@query("d12_entities_for_papers", CTE + "SELECT paper_id, label, canonical_text, frequency, country, 0 AS n_aliases FROM entities WHERE paper_id IN (SELECT id FROM papers WHERE year = 1995)")
def _(spark, d):
    ids = papers(spark, d).filter("year = 1995").select(F.col("id").alias("paper_id"))
    e = dashboard.entities_for_papers(ids, entities(spark, d))
    return e.select("paper_id", "label", "canonical_text", "frequency", F.try_element_at("rest", F.lit("country")).alias("country"), F.greatest(F.size("aliases"), F.lit(0)).alias("n_aliases"))


@query("d13_contains_filter", CTE + "SELECT id, title FROM papers WHERE contains(lower(title), 'of 12')")
def _(spark, d):
    return dashboard.contains_filter(papers(spark, d), "title", "OF 12").select("id", "title")


@query("d14_journal_dominance", CTE + "SELECT row_number() OVER (ORDER BY n DESC, journal) AS place, journal, n, CAST(floor(n / (SELECT count(*) FROM papers) * 100 + 0.5) AS BIGINT) AS percent FROM (SELECT journal, count(*) AS n FROM papers GROUP BY 1)")
def _(spark, d):
    return dashboard.journal_dominance(papers(spark, d)).withColumn("place", F.col("place").cast("long"))


@query("d15_peak_year", CTE + "SELECT year, count(*) AS n FROM papers GROUP BY 1 ORDER BY n DESC, year LIMIT 1")
def _(spark, d):
    return dashboard.peak_year(papers(spark, d))


@query(
    "d16_normalize_countries",
    """WITH v AS (SELECT CASE s_suppkey % 3 WHEN 0 THEN n_name WHEN 1 THEN 'x' || n_name ELSE n_name || ' And ' || (SELECT min(n_name) FROM nation) END AS name, s_suppkey % 7 AS value, s_suppkey % 3 AS kind, n_name
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT country, CAST(sum(value) AS BIGINT) AS value FROM (
  SELECT n_name AS country, value FROM v UNION ALL SELECT (SELECT min(n_name) FROM nation), value FROM v WHERE kind = 2) GROUP BY 1""",
)
def _(spark, d):
    n = table(spark, d, "nation")
    least = n.agg(F.min("n_name").alias("least"))
    kind = F.col("s_suppkey") % 3
    s = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).crossJoin(F.broadcast(least))
    name = F.when(kind == 0, F.col("n_name")).when(kind == 1, F.concat(F.lit("x"), "n_name")).otherwise(F.concat_ws(" And ", "n_name", "least"))
    values = s.select(name.alias("name"), (F.col("s_suppkey") % 7).alias("value"))
    aliases = n.select(F.concat(F.lit("X"), "n_name").alias("alias"), F.col("n_name").alias("country"))
    return dashboard.normalize_countries(values, n.select(F.col("n_name").alias("country")), aliases)


# --- knowledge base ----------------------------------------------------------------


def wide(spark: SparkSession, d: str) -> DataFrame:
    """Line items as wide curation rows, one per mention, in order of their keys."""
    li, p, o = (table(spark, d, t) for t in ("lineitem", "part", "orders"))
    j = li.join(p, F.col("l_partkey") == F.col("p_partkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(
        F.concat(F.lit(" 10.1/"), "o_custkey", F.lit(" ")).alias("doi"),
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10_000_000 + F.col("l_partkey")).alias("ord"),
        F.col("p_name").alias("compound"),
        F.col("l_shipmode" if "l_shipmode" in li.columns else "p_brand").alias("species"),
        F.col("o_orderpriority").alias("title"),
        F.when(F.col("l_linenumber") == 1, F.lit(" ")).otherwise(F.col("p_brand")).alias("journal"),
        F.col("p_type").alias("journal_alt"),
        F.concat(F.lit(" "), F.year("o_orderdate").cast("string")).alias("year"),
        F.when(F.col("o_orderstatus") == "O", "yes").otherwise("").alias("is_open_access"),
    )


WIDE = r"""
WITH wide AS (
  SELECT '10.1/' || o_custkey AS doi, (l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey AS ord, p_name AS compound, p_brand AS species, o_orderpriority AS title,
    CASE WHEN l_linenumber = 1 THEN p_type ELSE p_brand END AS journal, year(o_orderdate) AS year, o_orderstatus = 'O' AS is_open_access
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)
"""


@query("k01_load_papers", WIDE + "SELECT doi, arg_min(title, ord) AS title, arg_min(journal, ord) AS journal, CAST(arg_min(year, ord) AS INT) AS year, arg_min(is_open_access, ord) AS is_open_access FROM wide GROUP BY doi")
def _(spark, d):
    return kb.load_papers(wide(spark, d))


@query("k02_count_chemicals", WIDE + "SELECT doi, 'CHEMICAL' AS label, compound AS canonical_text, count(*) AS frequency FROM wide GROUP BY ALL")
def _(spark, d):
    return kb.count_mentions(wide(spark, d).withColumn("doi", F.trim("doi")), "compound", "CHEMICAL")


@query("k03_paper_level_entities", WIDE + "SELECT doi, 'SPECIES' AS label, species AS canonical_text, 1 AS frequency, '{\"family\":\"' || arg_min(title, ord) || '\"}' AS metadata FROM wide GROUP BY doi, species")
def _(spark, d):
    rows = wide(spark, d).withColumn("doi", F.trim("doi"))
    return kb.paper_level_entities(rows, {"SPECIES": "species"}, {"SPECIES": F.to_json(F.struct(F.col("title").alias("family")))})


@query("k04_location_entity", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name || ', ' ELSE '' END || n_name AS text, n_name AS country FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    at = kb.location_of([F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")), F.lit("  "), F.col("n_name"), F.lit(None).cast("string")])
    return s.select("s_suppkey", at["text"].alias("text"), at["country"].alias("country"))


@query("k05_stage_entity", "SELECT p_partkey, p_brand || '; ' || p_type AS stage FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", kb.stage_of([F.col("p_brand"), F.lit(""), F.col("p_type")]).alias("stage"))


@query("k06_merge_insert_ignore", WIDE + ", f AS (SELECT doi, compound AS canonical_text, count(*) AS n FROM wide GROUP BY ALL) SELECT doi, canonical_text, CASE WHEN n > 1 THEN 100 ELSE n END AS n FROM f")
def _(spark, d):
    f = wide(spark, d).groupBy(F.trim("doi").alias("doi"), F.col("compound").alias("canonical_text")).agg(F.count("*").alias("n"))
    return kb.merge_insert_ignore(f.filter("n > 1").withColumn("n", F.lit(100).cast("long")), f, ["doi", "canonical_text"])


@query("k07_refresh_entity_count", CTE + "SELECT id, count(paper_id) AS entity_count FROM papers LEFT JOIN entities ON id = paper_id GROUP BY id")
def _(spark, d):
    e = entities(spark, d).withColumnRenamed("paper_id", "id")
    return kb.refresh_entity_count(papers(spark, d), e, "id").select("id", "entity_count")


@query(
    "k08_unpivot_curated",
    "SELECT CAST(p_partkey AS VARCHAR) AS doi, label, v AS canonical_text FROM part, LATERAL (VALUES ('CHEMICAL', lower(p_name)), ('SPECIES', p_brand), ('LOCATION', array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1]) || w[2:]), ' '))) t(label, v)",
)
def _(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("doi"), F.col("p_partkey").alias("ord"), "p_name", "p_brand", "p_type", F.lit("nan").alias("where"))
    return kb.unpivot_curated(p, {"CHEMICAL": "p_name", "SPECIES": "p_brand"}, "where", "p_type").select("doi", "label", "canonical_text")


@query("k09_enrich_from_dictionary", WIDE + ", n AS (SELECT DISTINCT compound FROM wide) SELECT CASE WHEN length(compound) % 2 = 0 THEN upper(compound) ELSE compound END AS canonical_text, CASE WHEN length(compound) % 5 <> 0 THEN compound END AS of FROM n")
def _(spark, d):
    n = wide(spark, d).select("compound").distinct()
    facts = n.select(F.lit("CHEMICAL").alias("label"), F.when(F.length("compound") % 2 == 0, F.upper("compound")).otherwise(F.col("compound")).alias("canonical_text"))
    words = n.filter(F.length("compound") % 5 != 0).select(F.lit("CHEMICAL").alias("label"), F.col("compound").alias("pattern"), F.create_map(F.lit("of"), F.col("compound")).alias("metadata"))
    return kb.enrich_from_dictionary(facts, words).select("canonical_text", F.try_element_at("found", F.lit("of")).alias("of"))


@query(
    "k10_merge_metadata",
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '{"brand":"' || p_brand || '"}' WHEN p_partkey % 3 = 1 THEN '{"brand":"' || p_brand || '","kind":"x"}' END AS metadata FROM part""",
)
def _(spark, d):
    k = F.col("p_partkey") % 3
    dictionary = F.when(k < 2, F.create_map(F.lit("brand"), F.lit("old"), F.lit("score"), F.lit("1")))
    row = F.when(k == 0, F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("kind"), F.lit(""))).when(k == 1, F.create_map(F.lit("kind"), F.lit("x"), F.lit("brand"), F.col("p_brand")))
    return table(spark, d, "part").select("p_partkey", kb.merge_metadata(dictionary, row).alias("metadata"))


@query("k11_upsert_entities", WIDE + "SELECT doi, 'CHEMICAL' AS label, compound AS canonical_text, CAST(count(*) + CASE WHEN min(ord) % 2 = 0 THEN 5 ELSE 0 END AS BIGINT) AS frequency, arg_min(title, ord) AS metadata FROM wide GROUP BY doi, compound")
def _(spark, d):
    rows = wide(spark, d).select(F.trim("doi").alias("doi"), F.lit("CHEMICAL").alias("label"), F.col("compound").alias("canonical_text"), F.col("title").alias("metadata"), "ord")
    old = rows.groupBy("doi", "label", "canonical_text").agg(F.min("ord").alias("o")).filter("o % 2 = 0").select("doi", "label", "canonical_text", F.lit(5).cast("long").alias("frequency"), F.lit(None).cast("string").alias("metadata"))
    return kb.upsert_entities(old, rows)


@query(
    "k12_upsert_papers",
    CTE + "SELECT doi, CASE WHEN id % 3 = 0 THEN title WHEN id % 3 = 1 THEN 'sheet' ELSE journal END AS title, CASE WHEN id % 3 = 0 THEN year ELSE NULL END AS year, CASE WHEN id % 3 = 0 THEN is_open_access ELSE false END AS is_open_access, journal FROM papers",
)
def _(spark, d):
    p = papers(spark, d)
    sheet = p.select("doi", F.when(F.col("id") % 3 == 1, "sheet").alias("title"), F.lit(None).cast("string").alias("journal"), F.lit(None).cast("int").alias("year"), F.lit(None).cast("boolean").alias("is_open_access"))
    works = p.select("doi", F.col("journal").alias("title"), "journal", F.lit(None).cast("int").alias("year"), F.lit(None).cast("boolean").alias("is_open_access"))
    return kb.upsert_papers(p.filter("id % 3 = 0").select(sheet.columns), sheet, works)


@query("k13_validate_json", "SELECT count(*) FILTER (WHERE event_id % 4 <> 1) AS valid, count(*) FILTER (WHERE event_id % 4 = 1) AS broken FROM events")
def _(spark, d):
    e = table(spark, d, "events").select(F.when(F.col("event_id") % 4 == 1, F.concat("props", F.lit("}"))).when(F.col("event_id") % 4 != 0, F.col("props")).alias("metadata"))
    ok, bad = kb.validate_json(e)
    return ok.agg(F.count("*").alias("valid")).crossJoin(bad.agg(F.count("*").alias("broken")))


@query("k14_cascade_delete", CTE + "SELECT (SELECT count(*) FROM papers WHERE year <> 1994) AS papers, count(*) AS facts FROM entities WHERE paper_id NOT IN (SELECT id FROM papers WHERE year = 1994)")
def _(spark, d):
    p = papers(spark, d).withColumnRenamed("id", "paper_id")
    left, facts = kb.cascade_delete(p, entities(spark, d), p.filter("year = 1994").select("paper_id"))
    return left.agg(F.count("*").alias("papers")).crossJoin(facts.agg(F.count("*").alias("facts")))


# --- cross-paper analytics ------------------------------------------------------------


def mentions(spark: SparkSession, d: str) -> DataFrame:
    """Entities of the papers of one year as counts per paper."""
    e = entities(spark, d).filter("label <> 'LOCATION'")
    return e.select("paper_id", "label", F.col("canonical_text").alias("text"), F.lower("canonical_text").alias("canonical"), F.col("frequency").alias("count"))


MENTIONS = CTE + ", m AS (SELECT paper_id, label, canonical_text AS text, lower(canonical_text) AS canonical, frequency AS count FROM entities WHERE label <> 'LOCATION')"


@query("x01_merge_papers", MENTIONS + "SELECT label, canonical, CAST(sum(count) AS BIGINT) AS total, count(DISTINCT paper_id) AS papers, arg_max(text, count) AS display FROM m GROUP BY label, canonical")
def _(spark, d):
    return analytics.merge_papers(mentions(spark, d)).select("label", "canonical", "total", F.size("papers").cast("long").alias("papers"), "display")


@query("x02_compare_matrix", MENTIONS + "SELECT label, canonical AS name, paper_id, CAST(sum(count) AS BIGINT) AS n, count(*) OVER (PARTITION BY label, canonical) AS papers FROM m GROUP BY label, canonical, paper_id")
def _(spark, d):
    return analytics.compare_cells(mentions(spark, d))


@query("x03_group_totals", MENTIONS + "SELECT label, CAST(sum(count) AS BIGINT) AS total, count(DISTINCT canonical) AS terms FROM m GROUP BY label UNION ALL SELECT 'NONE', 0, 0")
def _(spark, d):
    m = mentions(spark, d)
    labels = m.select("label").distinct().unionByName(spark.createDataFrame([("NONE",)], "label string"))
    return analytics.group_totals(m, labels)


@query("x04_graph_nodes", MENTIONS + "SELECT label || ':' || canonical AS id, label AS kind, CAST(sum(count) AS BIGINT) AS n, least(22, greatest(8, 8 + 3.5 * sqrt(sum(count)))) AS size FROM m GROUP BY label, canonical UNION ALL SELECT 'paper:' || paper_id, 'PAPER', 1, 22 FROM (SELECT DISTINCT paper_id FROM m)")
def _(spark, d):
    return analytics.graph_nodes(mentions(spark, d)).withColumn("size", F.col("size").cast("double"))


@query("x05_graph_edges", MENTIONS + "SELECT DISTINCT label || ':' || canonical AS src, 'paper:' || paper_id AS dst FROM m")
def _(spark, d):
    return analytics.graph_edges(mentions(spark, d))


@query("x06_type_legend", MENTIONS + "SELECT label, count(DISTINCT canonical) AS n FROM m GROUP BY label")
def _(spark, d):
    return analytics.type_legend(mentions(spark, d))


@query("title_case", "SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS t FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", title_case(F.col("p_type")).alias("t"))
