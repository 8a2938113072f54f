"""Incremental corpus maintenance over files, catalog, parents, chunks and collisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_id(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 24)


def plan_increment(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Action per file name: skip, index, replace (with the stale paper_id) or missing.

    ``files``: (filename, paper_id); ``catalog``: (filename, paper_id, status).
    """
    c = catalog.select("filename", F.col("paper_id").alias("old_id"), "status")
    j = files.join(c, "filename", "full_outer")
    same = F.col("paper_id") == F.col("old_id")
    action = F.when(F.col("paper_id").isNull(), "missing").when(F.col("old_id").isNull(), "index").when(same & (F.col("status") == "indexed"), "skip").when(same, "index").otherwise("replace")
    return j.withColumn("action", action).select("filename", "paper_id", F.when(F.col("action") == "replace", F.col("old_id")).alias("stale_id"), "action")


def apply_increment(old: DataFrame, new: DataFrame, key: str = "paper_id") -> DataFrame:
    """``old`` with all rows of the keys in ``new`` replaced; running it again changes nothing."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new.select(old.columns))


def record_failures(catalog: DataFrame, failed: DataFrame, at: float) -> DataFrame:
    """The catalog with failed files (paper_id, filename, error) marked, to be tried again next time."""
    rows = failed.select("paper_id", "filename", F.lit("error").alias("status"), "error", F.lit(at).alias("indexed_at"))
    rest = [F.lit(None).cast(catalog.schema[c].dataType).alias(c) for c in catalog.columns if c not in rows.columns]
    return apply_increment(catalog, rows.select("*", *rest))


def detect_doi_collisions(catalog: DataFrame) -> DataFrame:
    """(doi, paper_new, paper_existing): each later paper of a DOI with the first one, by indexed_at and id."""
    known = catalog.filter("coalesce(doi, '') <> ''").select("doi", "paper_id", "indexed_at")
    first = known.groupBy("doi").agg(F.min_by("paper_id", F.struct("indexed_at", "paper_id")).alias("paper_existing"))
    return known.join(first, "doi").filter("paper_id <> paper_existing").select("doi", F.col("paper_id").alias("paper_new"), "paper_existing")


def delete_papers(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the papers in ``gone`` (paper_id); collisions go by either side."""
    out = {}
    for name, df in tables.items():
        keys = ["paper_id"] if "paper_id" in df.columns else [c for c in ("paper_new", "paper_existing") if c in df.columns]
        for k in keys:
            df = df.join(gone.select(F.col("paper_id").alias(k)), k, "left_anti")
        out[name] = df
    return out


def find_papers(catalog: DataFrame, keyword: str) -> DataFrame:
    return catalog.filter(F.col("filename").like(f"%{keyword}%") | F.col("title").like(f"%{keyword}%")).orderBy("filename")


def catalog_status(catalog: DataFrame) -> DataFrame:
    """Papers per status, and in all."""
    return catalog.rollup("status").agg(F.count("*").alias("n")).select(F.coalesce("status", F.lit("total")).alias("status"), "n")


def replace_sources(chunks: DataFrame, new: DataFrame) -> DataFrame:
    return apply_increment(chunks, new, "source")


def prune_orphan_parents(parents: DataFrame, chunks: DataFrame) -> DataFrame:
    return parents.join(chunks.select("parent_id"), "parent_id", "left_semi")


def list_indexed_files(chunks: DataFrame) -> DataFrame:
    """Per source that isn't blank: number of chunks, and the metadata of the first by ``ord``."""
    meta = [c for c in ("file_type", "indexed_at", "parser", "authors", "doi", "journal") if c in chunks.columns]
    first = F.min_by(F.struct(*meta), "ord").alias("m")
    return chunks.filter("trim(coalesce(source, '')) <> ''").groupBy("source").agg(F.count("*").alias("chunk_count"), first).select("source", "chunk_count", "m.*")


def delete_source(chunks: DataFrame, source: str) -> DataFrame:
    return chunks.filter(~F.col("source").eqNullSafe(F.lit(source)))


def get_parents(parents: DataFrame, ids: DataFrame) -> DataFrame:
    return parents.join(ids, "parent_id", "left_semi")


def reset_corpus(tables: dict[str, DataFrame], corpus_id: str) -> dict[str, DataFrame]:
    """Every table of a store (with a ``corpus_id``) without the rows of one corpus; the others stay."""
    return {name: df.filter(~F.col("corpus_id").eqNullSafe(F.lit(corpus_id))) for name, df in tables.items()}
