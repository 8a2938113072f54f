"""Knowledge-base load: wide curation rows to papers and their entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmine.functions.scalars import blank_to_null, first_nonblank, first_value, title_case, to_int, truthy

#: Metadata keys that never reach the stored JSON.
INTERNAL_KEYS = ("text", "span", "type", "label", "score", "linked_to", "canonical", "start", "end", "aliases")
FACT = ["doi", "label", "canonical_text"]


def load_papers(rows: DataFrame) -> DataFrame:
    """One paper per DOI from wide rows with ``ord``: the first row's values win."""
    parsed = rows.filter(blank_to_null(F.col("doi")).isNotNull()).select(
        F.trim("doi").alias("doi"),
        "ord",
        F.struct(
            first_nonblank(F.col("title")).alias("title"),
            first_nonblank(F.col("journal"), F.col("journal_alt")).alias("journal"),
            to_int(F.col("year")).alias("year"),
            truthy(F.col("is_open_access")).alias("is_open_access"),
        ).alias("p"),
    )
    return parsed.groupBy("doi").agg(F.min_by("p", "ord").alias("p")).select("doi", "p.*")


def count_mentions(rows: DataFrame, column: str, label: str) -> DataFrame:
    """Facts (doi, label, canonical_text, frequency): rows per DOI and value."""
    value = first_nonblank(F.col(column))
    return rows.select("doi", F.lit(label).alias("label"), value.alias("canonical_text")).filter("canonical_text <> ''").groupBy(*FACT).agg(F.count("*").alias("frequency"))


def paper_level_entities(rows: DataFrame, columns: dict[str, str], meta: dict[str, Column] | None = None) -> DataFrame:
    """Facts of frequency 1 per DOI, label and value; metadata of the first row by ``ord``.

    ``columns``: label -> column; ``meta``: label -> JSON column.
    """
    meta = meta or {}
    each = F.array(*[F.struct(F.lit(label).alias("label"), first_nonblank(F.col(c)).alias("canonical_text"), meta.get(label, F.lit(None).cast("string")).alias("metadata")) for label, c in columns.items()])
    flat = rows.select("doi", "ord", F.explode(each).alias("e")).select("doi", "ord", "e.*").filter("canonical_text <> ''")
    first = flat.groupBy(*FACT).agg(F.min_by(F.struct("metadata"), "ord").alias("m"))
    return first.select(*FACT, F.lit(1).cast("long").alias("frequency"), "m.metadata")


def location_of(parts: list[Column]) -> Column:
    """STRUCT<text, country>: the non-blank parts joined, and the last of them."""
    real = F.filter(F.array(*map(blank_to_null, parts)), lambda x: x.isNotNull())
    return F.struct(F.array_join(real, ", ").alias("text"), F.try_element_at(real, F.lit(-1)).alias("country"))


def stage_of(parts: list[Column]) -> Column:
    return F.array_join(F.filter(F.array(*map(blank_to_null, parts)), lambda x: x.isNotNull()), "; ")


def merge_insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` plus the rows of ``new`` whose keys it lacks."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti").select(old.columns))


def refresh_entity_count(papers: DataFrame, facts: DataFrame, key: str = "doi") -> DataFrame:
    """``papers`` plus entity_count, the number of their facts."""
    n = facts.groupBy(key).agg(F.count("*").alias("entity_count"))
    return papers.drop("entity_count").join(n, key, "left").withColumn("entity_count", F.coalesce("entity_count", F.lit(0)))


def unpivot_curated(rows: DataFrame, columns: dict[str, str], location: str, country: str) -> DataFrame:
    """(doi, ord, label, canonical_text, metadata) per filled column; a blank location gives its country, in title case."""
    pick = [F.struct(F.lit(label).alias("label"), (first_value(F.col(c)) if label == "SPECIES" else F.lower(first_value(F.col(c)))).alias("canonical_text"), F.lit(None).cast("string").alias("metadata")) for label, c in columns.items()]
    where = title_case(F.lower(F.coalesce(first_value(F.col(location)), first_value(F.col(country)))))
    land = F.when(first_value(F.col(country)).isNotNull(), F.to_json(F.struct(title_case(F.lower(first_value(F.col(country)))).alias("country"))))
    pick.append(F.struct(F.lit("LOCATION").alias("label"), where.alias("canonical_text"), land.alias("metadata")))
    flat = rows.select("doi", "ord", F.explode(F.array(*pick)).alias("e"))
    return flat.select("doi", "ord", "e.*").filter("canonical_text IS NOT NULL")


def enrich_from_dictionary(facts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``facts`` plus ``found``, the metadata map of CHEMICAL and SPECIES names: exact, then lower-cased."""
    exact = dictionary.select("label", F.col("pattern").alias("canonical_text"), F.col("metadata").alias("by_exact"))
    low = dictionary.select("label", F.lower(F.trim("pattern")).alias("low"), "metadata").groupBy("label", "low").agg(F.min_by("metadata", F.map_keys("metadata")).alias("by_low"))
    out = facts.withColumn("low", F.lower(F.trim("canonical_text"))).join(exact, ["label", "canonical_text"], "left").join(low, ["label", "low"], "left")
    known = F.col("label").isin("CHEMICAL", "SPECIES")
    return out.withColumn("found", F.when(known, F.coalesce("by_exact", "by_low"))).drop("low", "by_exact", "by_low")


def merge_metadata(dictionary: Column, row: Column) -> Column:
    """JSON of two MAP<string,string>s, the row's values winning; internal keys and blanks go, empty becomes null."""
    none = F.create_map().cast("map<string,string>")
    d, r = F.coalesce(dictionary, none), F.coalesce(row, none)
    both = F.map_concat(F.map_filter(d, lambda k, v: ~F.map_contains_key(r, k)), r)
    kept = F.map_filter(both, lambda k, v: ~k.isin(*INTERNAL_KEYS) & v.isNotNull() & (v != ""))
    return F.when(F.size(kept) > 0, F.to_json(F.map_from_entries(F.array_sort(F.map_entries(kept)))))


def upsert_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    """Facts after a load: frequency grows by one for every new row; the first known metadata wins.

    ``old``: (doi, label, canonical_text, frequency, metadata); ``new``: the same
    with ``ord`` in place of frequency.
    """
    both = old.withColumn("ord", F.lit(-1).cast("long")).unionByName(new.withColumn("frequency", F.lit(1).cast("long")).withColumn("ord", F.col("ord").cast("long")))
    first = F.min_by("metadata", F.when(F.col("metadata").isNotNull(), F.col("ord")))
    return both.groupBy(*FACT).agg(F.sum("frequency").alias("frequency"), first.alias("metadata"))


def upsert_papers(papers: DataFrame, sheet: DataFrame, works: DataFrame) -> DataFrame:
    """Known papers as they are; new ones from the sheet's values, else the looked-up record's."""
    new = sheet.join(papers.select("doi"), "doi", "left_anti").alias("s").join(works.alias("w"), "doi", "left")
    made = new.select(
        "doi",
        F.coalesce("s.title", "w.title").alias("title"),
        F.coalesce("s.journal", "w.journal").alias("journal"),
        F.coalesce("s.year", "w.year").alias("year"),
        F.coalesce("s.is_open_access", "w.is_open_access", F.lit(False)).alias("is_open_access"),
    )
    return papers.select(made.columns).unionByName(made)


def validate_json(facts: DataFrame, column: str = "metadata") -> tuple[DataFrame, DataFrame]:
    """Rows whose JSON is null or valid, and the others."""
    # in brackets, as the parser would pass over what follows a complete value
    ok = F.col(column).isNull() | F.try_parse_json(F.concat(F.lit("["), F.col(column), F.lit("]"))).isNotNull()
    return facts.filter(ok), facts.filter(~ok)


def cascade_delete(papers: DataFrame, facts: DataFrame, gone: DataFrame, key: str = "paper_id") -> tuple[DataFrame, DataFrame]:
    """Papers and facts without those of the ids in ``gone``."""
    return papers.join(gone, key, "left_anti"), facts.join(gone, key, "left_anti")
