"""Readers and writers: given tables are written as files of the formats, several each, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from litmine.plans.registry import query, shared_folder, table
from litmine.plans.relational import CTE, entities, papers
from litmine.sources import readers


def sheets(spark, rows, order: str, sep: str = ",", header: bool = True) -> str:
    """A folder of CSV files in order, the first of them far smaller than the others."""
    folder = shared_folder(spark)
    n = rows.count()
    at = F.when(F.col(order) <= rows.select(F.min(order)).first()[0] + n // 100, 0).otherwise(1)
    rows.withColumn("_at", at).repartitionByRange(4, "_at", order).sortWithinPartitions("_at", order).drop("_at", order).write.csv(folder, sep=sep, header=header, escape='"', quote="" if sep == "\t" else '"')
    return folder


@query("s01_read_ner_csv", "SELECT * FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS ord, CASE WHEN o_orderkey % 7 <> 0 THEN '10.1/' || o_orderkey END AS doi, 'A ' || chr(34) || 'quoted' || chr(34) || ', ' || chr(10) || o_orderpriority AS title FROM orders) WHERE doi IS NOT NULL")
def _(spark, d):
    o = table(spark, d, "orders")
    doi = F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit("10.1/"), "o_orderkey"))
    rows = o.select("o_orderkey", doi.alias("DOI"), F.concat(F.lit('A "quoted", \n'), "o_orderpriority").alias("title "))
    return readers.read_ner_csv(spark, sheets(spark, rows, "o_orderkey")).select("ord", F.col("DOI").alias("doi"), "title")


@query("s02_read_curated_rows", "SELECT * FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS ord, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE '10.2/' || o_orderkey END AS doi FROM orders) WHERE doi IS NOT NULL")
def _(spark, d):
    o = table(spark, d, "orders")
    doi = F.when(F.col("o_orderkey") % 5 == 0, F.lit("  ")).otherwise(F.concat(F.lit("10.2/"), "o_orderkey"))
    return readers.read_curated_rows(spark, sheets(spark, o.select("o_orderkey", doi.alias("DOI number"), F.lit("x").alias("Journal")), "o_orderkey")).select("ord", F.col("DOI number").alias("doi"))


@query("s03_read_term_dictionary", "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS ord, lower(p_name) AS term, p_brand || '|' || p_type AS synonyms FROM part")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit(" "), F.upper("p_name")).alias("Term"), F.concat_ws("|", "p_brand", "p_type").alias("Synonyms"))
    return readers.read_term_dictionary(spark, sheets(spark, p, "p_partkey"))


@query("s05_read_species_dictionary", "SELECT s_suppkey, s_name AS scientific_name FROM supplier WHERE s_suppkey % 4 <> 3")
def _(spark, d):
    k = F.col("s_suppkey") % 4
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("o"), "s_suppkey", F.when(k == 0, F.col("s_name")).alias("scientific_name"), F.when(k < 2, F.col("s_name")).alias("scientific_name_input"), F.when(k < 3, F.col("s_name")).otherwise(" ").alias("scientific_name_verified"))
    rows = readers.read_species_dictionary(readers.read_csv(spark, sheets(spark, s, "o")))
    return rows.select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "scientific_name")


@query("s06_read_chemical_dictionary", "SELECT p_name AS name, p_brand AS synonyms, CASE WHEN p_size > 20 THEN p_type END AS smiles FROM part")
def _(spark, d):
    big = F.col("p_size") > 20
    p = table(spark, d, "part").select("p_partkey", F.when(big, F.col("p_name")).alias("term"), F.col("p_name").alias("preferred_name"), F.col("p_brand").alias("synonyms"), F.when(big, F.col("p_type")).alias("smiles"))
    return readers.read_chemical_dictionary(readers.read_csv(spark, sheets(spark, p, "p_partkey"))).select("name", "synonyms", F.nullif("smiles", F.lit("")).alias("smiles"))


@query("s13_read_pubchem_bulk", "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS ord, CAST(p_partkey AS VARCHAR) AS cid, 'The ' || chr(34) || p_name AS title FROM part")
def _(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("o"), "p_partkey", F.concat(F.lit('The "'), "p_name").alias("title"))
    return readers.read_pubchem_bulk(spark, sheets(spark, p, "o", "\t", header=False), "title", 4).select("ord", "cid", "title")


@query("s15_write_kb_tables", CTE + "SELECT label, count(*) AS facts, CAST(sum(frequency) AS BIGINT) AS frequency, (SELECT count(*) FROM papers) AS papers FROM entities GROUP BY 1")
def _(spark, d):
    folder = shared_folder(spark)
    readers.write_kb_tables(papers(spark, d), entities(spark, d), folder, 2)
    n = spark.read.parquet(f"{folder}/papers").agg(F.count("*").alias("papers"))
    facts = spark.read.parquet(f"{folder}/paper_entities").groupBy("label").agg(F.count("*").alias("facts"), F.sum("frequency").alias("frequency"))
    return facts.crossJoin(n)  # one row


@query("s16_write_eval_csv", "SELECT CAST(p_partkey AS VARCHAR) AS id, CAST(p_size AS VARCHAR) AS size, format('{:.4f}', p_size / 8.0) AS share FROM part")
def _(spark, d):
    folder = shared_folder(spark)
    readers.write_eval_csv(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"), (F.col("p_size") / 8.0).cast("double").alias("share")), folder)
    return readers.read_csv(spark, folder)
