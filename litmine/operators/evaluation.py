"""Evaluation of entity extraction and question answering, and reference-data enrichment."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litmine.functions.scalars import mcq_option

SPAN = ["doc_id", "start", "end", "label"]


def filter_to_types(gold: DataFrame, predicted: DataFrame, labels: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides limited to a system's labels and to documents that both have."""
    docs = gold.select("doc_id").distinct().join(predicted.select("doc_id").distinct(), "doc_id")
    return tuple(df.filter(F.col("label").isin(labels)).join(docs, "doc_id", "left_semi") for df in (gold, predicted))


def match_spans(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(doc_id, label, strict, partial, n_gold, n_predicted) per document and label.

    Strict matches have equal places and labels; partial ones, of what is left, overlap
    and are paired greedily, earliest and longest first.
    """
    g = gold.select(*SPAN).withColumn("side", F.lit("g"))
    both = g.unionByName(predicted.select(*SPAN).withColumn("side", F.lit("p")))
    place = F.struct(F.col("start").cast("long").alias("start"), (-F.col("end")).cast("long").alias("minus_end"))
    of = lambda side: F.array_sort(F.collect_list(F.when(F.col("side") == side, place)))  # noqa: E731  spans of one document
    lists = both.groupBy("doc_id", "label").agg(of("g").alias("g"), of("p").alias("p"))
    pair = F.pandas_udf(_pairs, "struct<strict: long, partial: long>")
    found = lists.withColumn("n", pair("g.start", "g.minus_end", "p.start", "p.minus_end"))
    return found.select("doc_id", "label", "n.strict", "n.partial", F.size("g").cast("long").alias("n_gold"), F.size("p").cast("long").alias("n_predicted"))


def _pairs(gold_starts: pd.Series, gold_ends: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
    """(strict, partial) of lists of spans in order, ends negated."""

    def one(gold: list[tuple[int, int]], found: list[tuple[int, int]]) -> tuple[int, int]:
        equal = Counter(gold) & Counter(found)
        gold, found = (sorted((Counter(xs) - equal).elements(), key=lambda x: (x[0], -x[1])) for xs in (gold, found))
        partial = 0
        for a, b in gold:
            found = [y for y in found if y[1] > a]  # what ends before this one ends before all later ones
            hit = next((k for k, y in enumerate(found) if y[0] < b), None)
            if hit is not None:
                partial += 1
                del found[hit]
        return equal.total(), partial

    spans = lambda s, e: [(int(a), -int(b)) for a, b in zip(s, e)]
    return pd.DataFrame([one(spans(a, b), spans(c, d)) for a, b, c, d in zip(gold_starts, gold_ends, starts, ends)], columns=["strict", "partial"])


def _rate(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _prf(hit: Column) -> list[Column]:
    p, r = _rate(hit, F.col("n_predicted")), _rate(hit, F.col("n_gold"))
    return [p, r, _rate(2 * p * r, p + r)]


def precision_recall_f1(matches: DataFrame, *by: str) -> DataFrame:
    """Micro strict and partial precision, recall and F1, in all or by columns; a partial match counts half."""
    t = matches.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("strict", "partial", "n_gold", "n_predicted")])
    names = ("precision", "recall", "f1")
    strict = [c.alias(f"strict_{n}") for n, c in zip(names, _prf(F.col("strict")))]
    partial = [c.alias(f"partial_{n}") for n, c in zip(names, _prf(F.col("strict") + 0.5 * F.col("partial")))]
    return t.select(*by, *strict, *partial)


def macro_f1(matches: DataFrame) -> DataFrame:
    """Mean strict F1 over the labels that occur in gold."""
    return precision_recall_f1(matches.withColumn("in_gold", F.sum("n_gold").over(Window.partitionBy("label"))).filter("in_gold > 0"), "label").agg(F.avg("strict_f1").alias("macro_f1"))


def fp_fn(gold: DataFrame, predicted: DataFrame, docs: DataFrame, around: int = 40) -> DataFrame:
    """False positives and negatives by place and label, with their context; repeated rows stay."""
    fp = predicted.join(gold.select(*SPAN).distinct(), SPAN, "left_anti").select(*SPAN).withColumn("kind", F.lit("FP"))
    fn = gold.join(predicted.select(*SPAN).distinct(), SPAN, "left_anti").select(*SPAN).withColumn("kind", F.lit("FN"))
    j = fp.unionByName(fn).join(docs.select("doc_id", "text"), "doc_id")
    lo = F.greatest(F.col("start") - around, F.lit(0))
    return j.withColumn("context", F.col("text").substr(lo + 1, F.col("end") + around - lo)).drop("text")


def fp_fn_by_type(errors: DataFrame) -> DataFrame:
    return errors.groupBy("kind", "label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind", "label")


def mcq_accuracy(rows: DataFrame) -> DataFrame:
    """(difficulty, n, accuracy) over rows (answer, correct_option, difficulty); null difficulty is all."""
    right = F.coalesce(mcq_option(F.col("answer")) == F.upper(F.trim("correct_option")), F.lit(False))
    return rows.withColumn("right", right.cast("int")).rollup("difficulty").agg(F.count("*").alias("n"), F.avg("right").alias("accuracy"))


def build_mcq_prompt(question: Column, *options: Column) -> Column:
    return F.concat(question, F.lit("\n"), *[F.concat(F.lit(f"{x}) "), o, F.lit("\n")) for x, o in zip("ABCD", options)], F.lit("Answer with one letter."))


METRICS = ("faithfulness", "answer_relevancy", "answer_correctness", "context_precision", "context_recall")


def check_eval_rows(rows: DataFrame) -> DataFrame:
    """Rows with ``error`` for what is missing, their metrics null then."""
    error = F.concat_ws("; ", F.when(F.coalesce(F.size("contexts"), F.lit(0)) <= 0, "missing contexts"), F.when(F.trim(F.coalesce("answer", F.lit(""))) == "", "missing answer"))
    out = rows.withColumn("error", F.nullif(error, F.lit("")))
    for m in METRICS:
        out = out.withColumn(m, F.when(F.col("error").isNull(), F.col(m)))
    return out


def summarize_metrics(rows: DataFrame) -> DataFrame:
    means = [F.avg(F.when(~F.isnan(m), F.col(m))).alias(m) for m in METRICS]
    ok = F.count_if(F.col("error").isNull())
    return rows.agg(F.count("*").alias("total"), ok.alias("ok"), F.count("error").alias("failed"), _rate(ok, F.count("*")).alias("rate"), *means)


def resume(rows: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(done.select(key), key, "left_anti")


def match_pubchem_titles(names: DataFrame, titles: DataFrame) -> DataFrame:
    """(name, cid): by equal lower-cased title; the last line (``ord``) wins."""
    low = titles.groupBy(F.lower(F.trim("title")).alias("low")).agg(F.max_by("cid", "ord").alias("cid"))
    return names.withColumn("low", F.lower(F.trim("name"))).join(low, "low").select("name", "cid")


def match_pubchem_synonyms(names: DataFrame, matched: DataFrame, synonyms: DataFrame, parts: int = 30) -> DataFrame:
    """(name, cid) of names without a title match: the first synonym line that has one."""
    flat = synonyms.select("cid", "ord", F.explode(F.slice(F.split("synonym", r"\|"), 1, parts)).alias("s"))
    first = flat.groupBy(F.lower(F.trim("s")).alias("low")).agg(F.min_by("cid", "ord").alias("cid"))
    rest = names.join(matched.select("name"), "name", "left_anti")
    return rest.withColumn("low", F.lower(F.trim("name"))).join(first, "low").select("name", "cid")


_INCHIKEY = "^[A-Z]{14}-[A-Z]{10}-[A-Z]$"


def assemble_chemicals(matched: DataFrame, smiles: DataFrame, properties: DataFrame, synonyms: DataFrame, most: int = 10) -> DataFrame:
    """Chemical records of (name, cid): SMILES, checked InChIKey, source URL and other names."""
    syn = synonyms.groupBy("cid").agg(F.array_sort(F.collect_set(F.struct("ord", "synonym"))).alias("s"))
    j = matched.join(smiles, "cid", "left").join(properties, "cid", "left").join(syn, "cid", "left")
    other = F.filter(F.array_distinct(F.transform("s", lambda x: F.trim(x["synonym"]))), lambda x: ~x.startswith("InChI=") & ~x.rlike(_INCHIKEY) & (F.lower(x) != F.lower("name")))
    return j.select("name", "cid", "smiles", F.when(F.col("inchikey").rlike(_INCHIKEY), F.col("inchikey")).alias("inchikey"), F.concat(F.lit("https://pubchem.ncbi.nlm.nih.gov/compound/"), F.col("cid").cast("string")).alias("source_url"), F.array_join(F.slice(other, 1, most), "|").alias("synonyms"))


def enrich_species(names: DataFrame, backbone: DataFrame, vernacular: DataFrame) -> DataFrame:
    """(name, key, common_name): backbone key by name and the first English common name; unknown names stay, blank."""
    keys = backbone.groupBy(F.lower(F.trim("name")).alias("low")).agg(F.min("key").alias("key"))
    english = vernacular.filter(F.lower("language").isin("en", "eng", "english")).groupBy("key").agg(F.min_by(F.col("name"), "ord").alias("common_name"))
    return names.withColumn("low", F.lower(F.trim("name"))).join(keys, "low", "left").join(english, "key", "left").select("name", "key", "common_name")
