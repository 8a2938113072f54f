"""Sources and sinks: CSV, JSON, XML and text files to DataFrames with stated schemas, and back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litmine.functions.scalars import blank_to_null, coerce_year, first_nonblank, join_authors, normalize_doi, reconstruct_abstract

_SPAN = "struct<start:int,end:int,text:string,labels:array<string>>"


def _clean(df: DataFrame) -> DataFrame:
    """Column names without a byte-order mark and outer space."""
    return df.toDF(*[c.replace("﻿", "").strip() for c in df.columns])


def read_csv(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8", ordered: bool = False) -> DataFrame:
    """Rows as strings; with ``ord``, their number in file order, if ``ordered``."""
    rows = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, sep=sep, escape='"', encoding=encoding)
    return _clean(in_file_order(rows) if ordered else rows)


def in_file_order(rows: DataFrame) -> DataFrame:
    """``rows``, just read from files, plus ``ord``, their number from 0 by file name and place in the file.

    Tasks get files, and parts of them, in order of size: ids that count through tasks
    follow that, and only within a part do they follow the file.  Rows of each part are
    counted and the counts added up, a row for each part of a file.
    """
    placed = rows.select("*", F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")).alias("_part"), F.monotonically_increasing_id().alias("_at"))
    parts = placed.groupBy("_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return placed.join(parts, "_part").withColumn("ord", F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_before")


def read_ner_csv(spark: SparkSession, path: str) -> DataFrame:
    """Curation rows with a DOI, in file order as ``ord``."""
    rows = read_csv(spark, path, ordered=True)
    return rows.filter(blank_to_null(F.col("DOI")).isNotNull())


def read_curated_rows(spark: SparkSession, path: str) -> DataFrame:
    """Curated rows with a DOI, in file order as ``ord``."""
    rows = in_file_order(spark.read.parquet(path)) if path.endswith(".parquet") else read_csv(spark, path, ordered=True)
    return rows.filter(blank_to_null(F.col("`DOI number`")).isNotNull())


def read_term_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(ord, term, synonyms) of a term list; the second column counts if it is called alias or synonym."""
    rows = read_csv(spark, path, ordered=True)
    first, second = rows.columns[0], rows.columns[1] if len(rows.columns) > 2 else None
    named = second is not None and any(w in second.lower() for w in ("alias", "synonym"))
    out = rows.select("ord", F.lower(F.trim(f"`{first}`")).alias("term"), (F.col(f"`{second}`") if named else F.lit(None).cast("string")).alias("synonyms"))
    return out.filter(blank_to_null(F.col("term")).isNotNull() & ~F.col("term").startswith("#"))


#: What windows-1252 has in place of the control characters 0x80 to 0x9F; five are not assigned.
_CP1252 = "".join(bytes([b]).decode("cp1252", "replace") for b in range(0x80, 0xA0))
_CONTROLS = "".join(map(chr, range(0x80, 0xA0)))


def files_by_encoding(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """The files under a path that are valid UTF-8, and the others; a name per file comes to the driver."""
    files = spark.read.format("binaryFile").load(path).select("path", F.is_valid_utf8(F.col("content").cast("string")).alias("valid"))
    names = [(r.path, r.valid) for r in files.collect()]
    return [p for p, valid in names if valid], [p for p, valid in names if not valid]


def read_with_encoding_fallback(spark: SparkSession, path: str) -> DataFrame:
    """CSV files of equal columns, each in UTF-8 or else in windows-1252.

    The latter are read as ISO-8859-1, which Spark knows, and its control characters mapped.
    """
    valid, other = files_by_encoding(spark, path)
    parts = [read_csv(spark, valid)] if valid else []
    if other:
        rows = read_csv(spark, other, encoding="ISO-8859-1")
        parts.append(rows.select(*[F.translate(f"`{c}`", _CONTROLS, _CP1252).alias(c) for c in rows.columns]))
    return reduce(DataFrame.unionByName, parts)


def read_species_dictionary(rows: DataFrame) -> DataFrame:
    have = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    name = first_nonblank(have("scientific_name"), have("scientific_name_input"), have("scientific_name_verified"))
    return rows.withColumn("scientific_name", name).filter("scientific_name <> ''")


def read_chemical_dictionary(rows: DataFrame) -> DataFrame:
    have = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    extra = [first_nonblank(have(c)).alias(c) for c in ("inchikey", "smiles", "molecular_formula", "source_db", "source_url")]
    return rows.select(first_nonblank(have("term"), have("preferred_name")).alias("name"), have("synonyms").alias("synonyms"), *extra).filter("name <> ''")


def read_gold_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, end, text, label) of an annotation export: each task's first annotation."""
    schema = f"id string, data struct<text:string,doc_id:string,doi:string>, annotations array<struct<result:array<struct<value:{_SPAN}>>>>"
    tasks = spark.read.json(path, schema=schema, multiLine=True).filter(F.size("annotations") > 0)
    r = tasks.select(F.coalesce(blank_to_null(F.col("data.doc_id")), blank_to_null(F.col("data.doi")), F.col("id")).alias("doc_id"), F.explode(F.col("annotations")[0]["result"]).alias("r"))
    return r.select("doc_id", "r.value.start", "r.value.end", "r.value.text", F.get("r.value.labels", F.lit(0)).alias("label"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True)
    spans = F.from_json("value", "map<string,array<struct<text:string,label:string,start:int,end:int>>>")
    return text.select(F.explode(spans).alias("doc_id", "spans")).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")


def split_qa_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Multiple-choice and open-ended items of a JSON list that may lack its bracket or end in a comma."""
    item = "struct<id:string,type:string,question:string,option_a:string,option_b:string,option_c:string,option_d:string,correct_option:string,reference:string,difficulty:string>"
    body = F.regexp_replace(F.trim(F.regexp_replace("value", r",(\s*[\]}])", "$1")), r",\s*$", "")
    whole = F.when(body.endswith("]"), body).otherwise(F.concat(body, F.lit("]")))
    items = spark.read.text(path, wholetext=True).select(F.explode(F.from_json(whole, f"array<{item}>")).alias("q")).select("q.*")
    return items.filter("lower(type) = 'mcq'").drop("reference", "type"), items.filter("lower(type) <> 'mcq'").select("id", "question", "reference", "difficulty")


WORK = (
    "id string, doi string, display_name string, title string, publication_year int, cited_by_count int, has_fulltext boolean, type string, ids struct<pmid:string,pmcid:string>, "
    "authorships array<struct<author:struct<display_name:string>>>, primary_location struct<source:struct<display_name:string>>, best_oa_location struct<pdf_url:string>, "
    "locations array<struct<pdf_url:string>>, open_access struct<is_oa:boolean>, abstract_inverted_index map<string,array<int>>"
)


def flatten_work(works: DataFrame) -> DataFrame:
    """Nested works to flat records."""
    pdf = F.coalesce("best_oa_location.pdf_url", F.get(F.filter("locations", lambda x: x["pdf_url"].isNotNull()), F.lit(0))["pdf_url"])
    return works.select(
        F.coalesce(F.nullif(normalize_doi(F.col("doi")), F.lit("")), F.col("ids.pmid"), F.col("id")).alias("id"),
        normalize_doi(F.col("doi")).alias("doi"),
        F.regexp_extract(F.coalesce("ids.pmid", F.lit("")), "([0-9]+)", 1).alias("pmid"),
        F.upper(F.regexp_extract(F.coalesce("ids.pmcid", F.lit("")), "(?i)(PMC[0-9]+)", 1)).alias("pmcid"),
        first_nonblank(F.col("display_name"), F.col("title"), F.lit("Untitled")).alias("title"),
        join_authors(F.transform("authorships", lambda a: a["author"]["display_name"])).alias("authors"),
        F.coalesce("primary_location.source.display_name", F.lit("")).alias("journal"),
        "publication_year",
        coerce_year(F.col("publication_year")).alias("year_display"),
        F.coalesce("cited_by_count", F.lit(0)).alias("citations"),
        F.coalesce("open_access.is_oa", F.lit(False)).alias("is_open_access"),
        (pdf.isNotNull() | F.coalesce("has_fulltext", F.lit(False))).alias("has_full_text"),
        pdf.alias("pdf_url"),
        reconstruct_abstract(F.col("abstract_inverted_index")).alias("abstract"),
    )


def read_work_records(spark: SparkSession, path: str) -> DataFrame:
    return flatten_work(spark.read.json(path, schema=WORK))


EPMC = "id string, pmid string, pmcid string, doi string, title string, authorString string, pubYear string, journalTitle string, journalInfo struct<journal:struct<title:string,medlineAbbreviation:string>>, citedByCount int, isOpenAccess string, inEPMC string, hasPDF string, abstractText string"


def flatten_epmc(records: DataFrame) -> DataFrame:
    yes = lambda c: F.coalesce(F.upper(c) == "Y", F.lit(False))
    return records.select(
        F.coalesce("pmcid", "pmid", "id").alias("id"), "pmid", "pmcid", normalize_doi(F.col("doi")).alias("doi"), first_nonblank(F.col("title")).alias("title"),
        first_nonblank(F.col("authorString"), F.lit("Unknown authors")).alias("authors"),
        first_nonblank(F.col("journalTitle"), F.col("journalInfo.journal.title"), F.col("journalInfo.journal.medlineAbbreviation")).alias("journal"),
        coerce_year(F.col("pubYear")).alias("year_display"), F.coalesce("citedByCount", F.lit(0)).alias("citations"), yes(F.col("isOpenAccess")).alias("is_open_access"),
        yes(F.col("inEPMC")).alias("has_full_text"), yes(F.col("hasPDF")).alias("has_pdf"), F.coalesce("abstractText", F.lit("")).alias("abstract"),
    )


def read_epmc_records(spark: SparkSession, path: str) -> DataFrame:
    return flatten_epmc(spark.read.json(path, schema=EPMC))


def read_jats_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(pmcid, xml): an article per file, named by it."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("pmcid"), F.col("value").alias("xml"))


def read_pubchem_bulk(spark: SparkSession, path: str, value: str, partitions: int = 64) -> DataFrame:
    """(cid, value, ord) of a tab-separated file; a compressed one is one split, so rows are dealt out after reading."""
    rows = in_file_order(spark.read.csv(path, sep="\t", schema=f"cid string, {value} string", quote=""))
    return rows.filter(F.col(value).isNotNull()).repartition(partitions)


def document_pages(text: Column) -> Column:
    """ARRAY<STRUCT<page, text>> of a text with ``<!-- Page N -->`` marks; empty pages go."""
    parts = F.split(text, r"(?=<!-- Page [0-9]+ -->)")
    page = lambda p: F.struct(F.regexp_extract(p, "<!-- Page ([0-9]+) -->", 1).try_cast("int").alias("page"), F.trim(F.regexp_replace(F.regexp_replace(p, "<!-- Page [0-9]+ -->", ""), r"^\s+|\s+$", "")).alias("text"))
    return F.filter(F.transform(parts, page), lambda p: p["text"] != "")


def write_kb_tables(papers: DataFrame, facts: DataFrame, path: str, files_per_label: int = 32) -> None:
    papers.write.mode("overwrite").parquet(f"{path}/papers")
    # spread, so that a large label is written by many tasks
    facts.repartition("label", F.pmod(F.xxhash64(*facts.columns), F.lit(files_per_label))).write.mode("overwrite").partitionBy("label").parquet(f"{path}/paper_entities")


def write_eval_csv(rows: DataFrame, path: str) -> None:
    """CSV with doubles in four decimals."""
    shown = [F.format_string("%.4f", c).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes]
    rows.select(*shown).write.mode("overwrite").csv(path, header=True)
