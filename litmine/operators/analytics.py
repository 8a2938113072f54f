"""Cross-paper analytics over mentions (paper_id, label, text, canonical, count) and species records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labels in the order in which reports show them.
LABELS = (
    "CHEMICAL", "SPECIES", "PLANT PART", "DEVELOPMENT STAGE", "EXTRACTION METHOD", "ANALYTICAL TECHNIQUE", "BIOACTIVITY",
    "DISEASE", "SEASON", "LOCATION",
)


def merge_papers(mentions: DataFrame) -> DataFrame:
    """Per label and lower-cased canonical: total, papers, and the text of the largest single count."""
    shown = F.max_by("text", F.struct(F.col("count"), -F.col("paper_id")))
    return mentions.groupBy("label", F.lower(F.coalesce("canonical", "text")).alias("canonical")).agg(F.sum("count").alias("total"), F.array_sort(F.collect_set("paper_id")).alias("papers"), shown.alias("display"))


def compare_cells(mentions: DataFrame) -> DataFrame:
    """The compare matrix in long form: (label, name, paper_id, n, papers)."""
    cells = mentions.groupBy("label", F.coalesce("canonical", "text").alias("name"), "paper_id").agg(F.sum("count").alias("n"))
    return cells.withColumn("papers", F.count("*").over(Window.partitionBy("label", "name")))


def compare_matrix(mentions: DataFrame, papers: list) -> DataFrame:
    """The matrix of a stated list of papers, one column each, with total and papers-with-mention."""
    few = mentions.filter(F.col("paper_id").isin(papers))
    wide = few.groupBy("label", F.coalesce("canonical", "text").alias("name")).pivot("paper_id", papers).agg(F.sum("count"))
    cells = [F.coalesce(F.col(f"`{p}`"), F.lit(0)).alias(str(p)) for p in papers]
    there = sum((F.col(f"`{p}`").isNotNull().cast("int") for p in papers), F.lit(0))
    place = F.array_position(F.array(*map(F.lit, LABELS)), F.col("label"))
    return wide.select("label", "name", *cells, there.alias("papers")).orderBy(place, "name")


def group_totals(mentions: DataFrame, labels: DataFrame) -> DataFrame:
    """Total count and number of terms per label; labels without any are there with 0."""
    got = mentions.groupBy("label").agg(F.sum("count").alias("total"), F.count_distinct(F.lower("canonical")).alias("terms"))
    return labels.join(got, "label", "left").select("label", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"))


def _node(label: Column, canonical: Column) -> Column:
    return F.concat_ws(":", label, F.lower(canonical))


def graph_nodes(mentions: DataFrame) -> DataFrame:
    """(id, kind, n, size) of entities and papers; sizes between 8 and 22 grow with the root of the count."""
    size = F.least(F.lit(22.0), F.greatest(F.lit(8.0), 8 + 3.5 * F.sqrt("n")))
    things = mentions.groupBy(_node(F.col("label"), F.col("canonical")).alias("id"), F.col("label").alias("kind")).agg(F.sum(F.coalesce("count", F.lit(1))).alias("n"))
    papers = mentions.select(F.concat(F.lit("paper:"), F.col("paper_id").cast("string")).alias("id"), F.lit("PAPER").alias("kind"), F.lit(1).cast("long").alias("n")).distinct()
    return things.withColumn("size", size).unionByName(papers.withColumn("size", F.lit(22.0)))


def graph_edges(mentions: DataFrame) -> DataFrame:
    return mentions.select(_node(F.col("label"), F.col("canonical")).alias("src"), F.concat(F.lit("paper:"), F.col("paper_id").cast("string")).alias("dst")).distinct()


def type_legend(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("label").agg(F.count_distinct(F.lower("canonical")).alias("n"))


def export_compare(mentions: DataFrame) -> DataFrame:
    """Rows of the compare export: type, name, count and the papers' names, in label order, then by count."""
    by = mentions.groupBy("label", F.lower("canonical").alias("k")).agg(F.sum("count").alias("Count"), F.max_by("text", "count").alias("name"), F.array_join(F.array_sort(F.collect_set(F.col("paper_id").cast("string"))), "; ").alias("Papers"))
    place = F.array_position(F.array(*map(F.lit, LABELS)), F.col("label"))
    return by.orderBy(place, F.desc("Count"), "name").select(F.col("label").alias("Entity Type"), F.col("name").alias("Entity Name"), "Count", "Papers")


#: Weights of a species record's filled fields.
SPECIES_WEIGHTS = {
    "accepted_name": 32, "verified_name": 16, "scientific_name": 8, "common_name": 4, "canonical": 2, "source_db": 2, "source_url": 2,
    "taxon_id": 2, "match_status": 1, "review_required": 1,
}


def metadata_score(meta: Column) -> Column:
    """Weight of the filled fields of a species' MAP<string,string>."""
    parts = [F.when(F.trim(F.try_element_at(meta, F.lit(k))) != "", w).otherwise(0) for k, w in SPECIES_WEIGHTS.items()]
    return sum(parts[1:], parts[0])


def species_primary_name(meta: Column, text: Column) -> Column:
    fields = ("accepted_name", "verified_name", "scientific_name", "canonical")
    return F.coalesce(*[F.nullif(F.trim(F.try_element_at(meta, F.lit(k))), F.lit("")) for k in fields], text)


def representative(entities: DataFrame, *by: str) -> DataFrame:
    """Per group the entity (text, meta) of the highest score, then the longest text."""
    order = F.struct(metadata_score(F.col("meta")), F.length("text"), F.col("text"))
    return entities.groupBy(*by).agg(F.max_by(F.struct("text", "meta"), order).alias("e")).select(*by, "e.*")


def alias_lookup(entities: DataFrame) -> DataFrame:
    """(alias, label, text): the best-described entity of each lower-cased alias."""
    flat = entities.select("label", "text", "meta", F.explode(F.array_union(F.array("text"), "aliases")).alias("a")).withColumn("alias", F.lower(F.trim("a")))
    order = F.struct(metadata_score(F.col("meta")) + F.size(F.map_filter("meta", lambda k, v: v != "")), F.length("text"), F.col("text"))
    return flat.groupBy("alias").agg(F.max_by(F.struct("label", "text"), order).alias("e")).select("alias", "e.*")
