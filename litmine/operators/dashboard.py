"""Dashboard and explorer queries over papers(id, doi, title, journal, year) and
entities(paper_id, label, canonical_text, frequency, metadata)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litmine.functions.scalars import blank_to_null, flatten_entity, normalize_doi, title_case


def total_papers(papers: DataFrame) -> DataFrame:
    return papers.agg(F.count("id").alias("n"))


def total_entities(entities: DataFrame) -> DataFrame:
    """Distinct (label, canonical_text), null texts counted too."""
    return entities.select("label", "canonical_text").distinct().agg(F.count("*").alias("n"))


def total_journals(papers: DataFrame) -> DataFrame:
    return papers.agg(F.count_distinct("journal").alias("n"))


def papers_by_journal(papers: DataFrame) -> DataFrame:
    return papers.filter("journal IS NOT NULL").groupBy("journal").agg(F.count("*").alias("n"))


def top_journals(papers: DataFrame, n: int = 3) -> DataFrame:
    """The n journals with most papers, by name where equal, as one string."""
    top = papers_by_journal(papers).orderBy(F.desc("n"), "journal").limit(n)
    return top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "journal"))), lambda x: x["journal"]), ", ").alias("journals"))


def entity_distribution(entities: DataFrame) -> DataFrame:
    return entities.groupBy("label").agg(F.count_distinct("canonical_text").alias("n")).select(title_case(F.col("label")).alias("label"), "n")


def papers_by_year(papers: DataFrame) -> DataFrame:
    return papers.filter("year IS NOT NULL").groupBy(F.col("year").cast("string").alias("year")).agg(F.count("*").alias("n"))


def country_of(metadata: Column) -> Column:
    return blank_to_null(F.get_json_object(metadata, "$.country"))


def geo_distribution(entities: DataFrame) -> DataFrame:
    """Distinct papers per country of LOCATION entities."""
    at = entities.filter("label = 'LOCATION'").select("paper_id", country_of(F.col("metadata")).alias("country")).filter("country IS NOT NULL")
    return at.groupBy("country").agg(F.count_distinct("paper_id").alias("n"))


def dashboard_metrics(papers: DataFrame, entities: DataFrame) -> DataFrame:
    """(metric, key, value) of all of the above, from one scan of each table.

    Papers are counted by grouping sets; an entity row gives up to two facts, which are
    made distinct before they are counted, so that no distinct count meets in one task.
    Empty tables have zero papers, journals and entities.
    """
    sets = papers.select("id", "journal", F.col("year").cast("string").alias("year"))
    sets = sets.groupingSets([["journal"], ["year"], []], "journal", "year")
    sets = sets.agg(F.grouping("journal").alias("no_journal"), F.grouping("year").alias("no_year"), F.count("*").alias("rows"), F.count("id").alias("ids"), F.count_distinct("journal").alias("journals"))
    fact = lambda metric, key, value: F.struct(F.lit(metric).alias("metric"), key.alias("key"), value.cast("long").alias("value"))
    none = F.lit("")
    of_papers = (
        F.when(F.col("no_journal") == 0, F.when(F.col("journal").isNotNull(), F.array(fact("by_journal", F.col("journal"), F.col("rows")))))
        .when(F.col("no_year") == 0, F.when(F.col("year").isNotNull(), F.array(fact("by_year", F.col("year"), F.col("rows")))))
        .otherwise(F.array(fact("papers", none, F.col("ids")), fact("journals", none, F.col("journals"))))
    )
    named = F.struct(F.lit("by_label").alias("metric"), F.col("label").alias("key"), F.col("canonical_text").alias("member"))
    country = F.when(F.col("label") == "LOCATION", country_of(F.col("metadata")))
    placed = F.struct(F.lit("by_country").alias("metric"), country.alias("key"), F.col("paper_id").cast("string").alias("member"))
    each = entities.select(F.explode(F.array_compact(F.array(named, F.when(country.isNotNull(), placed)))).alias("x")).select("x.*").distinct()
    each = each.groupBy("metric", "key").agg(F.count("*").alias("all"), F.count("member").alias("named"))
    own = fact("", F.col("key"), F.col("named")).withField("metric", F.col("metric"))
    of_entities = F.when(F.col("metric") == "by_label", F.array(own, fact("entities", none, F.col("all")))).otherwise(F.array(own))
    zero = papers.sparkSession.createDataFrame([("papers", "", 0), ("journals", "", 0), ("entities", "", 0)], "metric string, key string, value long")
    out = sets.select(F.explode(of_papers).alias("f")).unionByName(each.select(F.explode(of_entities).alias("f"))).select("f.*").unionByName(zero)
    out = out.groupBy("metric", "key").agg(F.sum("value").alias("value"))
    return out.withColumn("key", F.when(F.col("metric") == "by_label", title_case(F.col("key"))).otherwise(F.col("key")))


def list_papers(papers: DataFrame, entities: DataFrame, limit: int = 50, offset: int = 0, country: str | None = None, query: str | None = None, year: int | None = None, literal: bool = False) -> DataFrame:
    """A page of papers, newest id first, with the total as a column.

    ``query`` is matched against title and journal without regard to case; ``%`` and
    ``_`` are wildcards unless ``literal``.
    """
    if not 1 <= limit <= 500:
        raise ValueError("limit is 1 to 500")
    found = papers
    if year is not None:
        found = found.filter(F.col("year") == year)
    if query:
        if literal:
            low = query.lower()
            found = found.filter(F.contains(F.lower("title"), F.lit(low)) | F.contains(F.lower("journal"), F.lit(low)))
        else:
            found = found.filter(F.col("title").ilike(f"%{query}%") | F.col("journal").ilike(f"%{query}%"))
    if country:
        there = entities.filter("label = 'LOCATION'").filter(F.get_json_object("metadata", "$.country") == country)
        found = found.join(there.select(F.col("paper_id").alias("id")), "id", "left_semi")
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy(F.desc("id")).offset(offset).limit(limit).crossJoin(F.broadcast(total))  # total is one row


def paper_id_by_doi(asked: DataFrame, papers: DataFrame) -> DataFrame:
    """``asked`` (doi) plus the id of the paper with the cleaned DOI, else with the raw one."""
    known = papers.select(F.col("doi").alias("known"), F.col("id"))
    clean = known.select(F.col("known").alias("clean"), F.col("id").alias("by_clean"))
    raw = known.select(F.col("known").alias("doi"), F.col("id").alias("by_raw"))
    return asked.withColumn("clean", normalize_doi(F.col("doi"))).join(clean, "clean", "left").join(raw, "doi", "left").select("doi", F.coalesce("by_clean", "by_raw").alias("id"))


def entities_for_papers(ids: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities of papers, their metadata spread into aliases and the rest."""
    e = entities.join(ids, "paper_id", "left_semi").withColumn("m", flatten_entity(F.col("metadata")))
    return e.select("paper_id", "label", "canonical_text", "frequency", F.col("m.aliases").alias("aliases"), F.col("m.rest").alias("rest"))


def contains_filter(rows: DataFrame, column: str, text: str) -> DataFrame:
    return rows.filter(F.contains(F.lower(column), F.lit(text.lower())))


def journal_dominance(papers: DataFrame, ranks: int = 9) -> DataFrame:
    """The leading journals with their rank and share of all papers in whole percent, halves up."""
    by = papers_by_journal(papers)
    total = by.agg(F.sum("n").alias("total"))
    top = by.orderBy(F.desc("n"), "journal").limit(ranks)
    place = F.row_number().over(Window.orderBy(F.desc("n"), "journal"))
    share = F.floor(F.col("n") / F.col("total") * 100 + 0.5).cast("long")
    return top.withColumn("place", place).crossJoin(F.broadcast(total)).select("place", "journal", "n", share.alias("percent"))


def peak_year(papers: DataFrame) -> DataFrame:
    """The first year with most papers."""
    by = papers.filter("year IS NOT NULL").groupBy("year").agg(F.count("*").alias("n"))
    return by.agg(F.max_by("year", F.struct(F.col("n"), -F.col("year"))).alias("year"), F.max("n").alias("n"))


def normalize_countries(values: DataFrame, countries: DataFrame, aliases: DataFrame) -> DataFrame:
    """(country, value): values of free names summed per canonical country.

    A name counts by itself, by its alias, or else in full for each part between
    `` And `` or ``, ``; parts that are unknown are dropped.
    """
    names = countries.select(F.lower(F.trim("country")).alias("low"), "country").unionByName(aliases.select(F.lower(F.trim("alias")).alias("low"), "country")).dropDuplicates(["low"])
    names = F.broadcast(names)  # a row per name of a country
    rows = values.withColumn("low", F.lower(F.trim("name"))).join(names, "low", "left")
    direct = rows.filter("country IS NOT NULL").select("country", "value")
    parts = rows.filter("country IS NULL").select("value", F.explode(F.split("name", r" And |, ")).alias("part"))
    split = parts.withColumn("low", F.lower(F.trim("part"))).join(names, "low").select("country", "value")
    return direct.unionByName(split).groupBy("country").agg(F.sum("value").alias("value"))
