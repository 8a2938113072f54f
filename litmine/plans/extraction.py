"""Entity-recognition, evaluation, streaming and source queries; frequent words of the texts are the dictionary."""

from __future__ import annotations

from pyspark.sql import functions as F

from litmine.functions.scalars import normalize_text
from litmine.operators import analytics, evaluation, ner
from litmine.plans.registry import query, shared_folder, table
from litmine.sources import readers
from litmine.streaming import ingest

#: Terms of the queries' dictionary: (label, term, synonyms).
TERMS = (
    ("PLANT PART", "the", "erating|le la"), ("PLANT PART", "und der", "dem"), ("ANALYTICAL TECHNIQUE", "of the", "to-the|the and"),
    ("EXTRACTION METHOD", "que", "une|les de"), ("SPECIES", "los un", "del"), ("CHEMICAL", "is it", "that|of the and"), ("SEASON", "en la", "de la"),
)
_PAIRS = sorted({(label, w, term) for label, term, syn in TERMS for w in (term, *syn.split("|"))})
_NATIVE = [(a, b, c) for a, b, c in _PAIRS if "-" not in b]
_VALUES = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in _NATIVE)


def dictionary(spark):
    return spark.createDataFrame(_PAIRS, "label string, pattern string, canonical string")


def native(spark):
    return spark.createDataFrame(_NATIVE, "label string, pattern string, canonical string")


def docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


MATCHES = rf"""WITH p AS (SELECT *, len(string_split(pattern, ' ')) AS n FROM (VALUES {_VALUES}) v(label, pattern, canonical)),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, n, i AS start, i + n AS "end", array_to_string(w[i + 1:i + n], ' ') AS gram FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM w, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
m AS (SELECT doc_id, label, gram AS text, canonical, start, "end" FROM g JOIN p ON gram = pattern)
"""


def found(spark, d):
    return ner.match_ngrams(docs(spark, d), native(spark))


@query("n01_build_simple_dictionary", "WITH p AS (SELECT p_partkey, lower(p_name) AS canonical, unnest([lower(p_name), lower(p_brand), lower(p_type)]) AS pattern FROM part) SELECT 'PLANT PART' AS label, pattern, arg_max(canonical, p_partkey) AS canonical FROM p GROUP BY pattern")
def _(spark, d):
    terms = table(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.upper("p_name").alias("term"), F.concat_ws("|", "p_brand", "p_type").alias("synonyms"))
    return ner.build_simple_dictionary(terms, "PLANT PART")


@query(
    "n02_build_species_dictionary",
    """WITH s AS (SELECT s_suppkey AS ord, 'Genus' || (s_suppkey % 5) || ' epithet' || (s_suppkey % 7) AS c, CASE WHEN s_suppkey % 3 = 0 THEN lower(s_name) ELSE '' END AS common FROM supplier),
e AS (SELECT lower(c) AS pattern, c, ord, 0 AS rank, true AS is_pattern FROM s UNION ALL SELECT 'g' || dot || split_part(lower(c), ' ', 2), c, ord, 1, true FROM s, (VALUES ('. '), ('.')) v(dot)
  UNION ALL SELECT common, c, ord, 2, false FROM s WHERE common <> '')
SELECT 'SPECIES' AS label, pattern, arg_min(c, rank * 100000000 + ord) AS canonical, arg_min(is_pattern, rank * 100000000 + ord) AS is_pattern FROM e GROUP BY pattern""",
)
def _(spark, d):
    """Two-word names that share genera, epithets and so abbreviations; a third have a common name."""
    k = F.col("s_suppkey")
    name = F.concat(F.lit("Genus"), (k % 5).cast("string"), F.lit(" epithet"), (k % 7).cast("string"))
    s = table(spark, d, "supplier").select(k.alias("ord"), name.alias("scientific_name"), F.when(k % 3 == 0, F.col("s_name")).otherwise("").alias("common_name"))
    return ner.build_species_dictionary(s)


@query("n03_n05_build_chemical_dictionary", "SELECT p AS pattern, arg_min(c, length(c) * 100000 + ord) AS canonical FROM (SELECT DISTINCT lower('(E)-' || p_name) AS p, '(E)-' || p_name AS c, 0 AS ord FROM part) GROUP BY 1")
def _(spark, d):
    p = table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("ord"))
    chem = p.select("ord", F.concat(F.lit("(E)-"), "p_name").alias("name"), F.lit("").alias("synonyms"))
    return ner.build_chemical_dictionary(chem).filter(F.col("pattern").startswith("(e)-")).select("pattern", "canonical")


@query("n06_match_ngrams", MATCHES + "SELECT * FROM m")
def _(spark, d):
    return found(spark, d)


@query("n06_match_trie")
def _(spark, d):
    return ner.match_trie(spark, docs(spark, d), dictionary(spark))


@query(
    "n06_stored_terms",
    r"""WITH b AS (SELECT regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS w FROM benchmark), d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS w FROM documents),
t AS (SELECT DISTINCT n, w[i:i + n - 1] AS g FROM (SELECT w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b, (VALUES (2), (3)) v(n))),
g AS (SELECT doc_id, n, w[i:i + n - 1] AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (VALUES (2), (3)) v(n)))
SELECT doc_id, count(*) AS n_spans, count(DISTINCT g) AS n_terms FROM g JOIN t USING (n, g) GROUP BY doc_id""",
)
def _(spark, d):
    """All runs of two and three pieces of the benchmark are the dictionary."""
    w = F.regexp_extract_all(F.lower("text"), F.lit(f"({ner.TOKEN})"))
    runs = lambda n: F.transform(F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - n + 1)), lambda i: F.array_join(F.slice("w", i, n), " "))
    b = table(spark, d, "benchmark").select(w.alias("w"))
    terms = b.select(F.explode(runs(2)).alias("p")).union(b.select(F.explode(runs(3)))).distinct()
    path = ner.store_dictionary(terms.select(F.lit("SPECIES").alias("label"), F.col("p").alias("pattern"), F.col("p").alias("canonical")), shared_folder(spark))
    return ner.match_trie(spark, docs(spark, d), path).groupBy("doc_id").agg(F.count("*").alias("n_spans"), F.count_distinct("canonical").alias("n_terms"))


@query("n07_match_chemicals")
def _(spark, d):
    return ner.match_chemicals(spark, docs(spark, d), dictionary(spark))


@query("n08_match_techniques")
def _(spark, d):
    return ner.match_techniques(spark, docs(spark, d), dictionary(spark))


@query("n09_lookup", f"SELECT doc_id, (SELECT min(canonical) FROM (VALUES {_VALUES}) v(label, pattern, canonical) WHERE pattern = lower(string_split(text, ' ')[1])) AS canonical FROM documents")
def _(spark, d):
    names = docs(spark, d).select("doc_id", F.split("text", " ")[0].alias("text"))
    return ner.lookup(names, native(spark).withColumn("label", F.lit("X"))).select("doc_id", "canonical")


@query("n10_aliases_for_canonical", "SELECT p_type AS label, p_brand AS canonical, string_agg(DISTINCT p_name, ',' ORDER BY p_name) AS aliases FROM part GROUP BY 1, 2")
def _(spark, d):
    dictionary = table(spark, d, "part").select(F.col("p_type").alias("label"), F.col("p_name").alias("pattern"), F.col("p_brand").alias("canonical"))
    return ner.aliases_for_canonical(dictionary).withColumn("aliases", F.array_join("aliases", ","))


@query("n11_resolve_overlaps")
def _(spark, d):
    return ner.resolve_overlaps(found(spark, d))


@query("n12_match_all")
def _(spark, d):
    spans = ner.match_all(spark, docs(spark, d), dictionary(spark))
    return spans.groupBy("label").agg(F.count_distinct("doc_id").alias("papers"), F.count("*").alias("mentions"))


@query("n13_match_sections")
def _(spark, d):
    from litmine.operators.chunking import detect_sections

    return ner.match_sections(spark, detect_sections(docs(spark, d)), dictionary(spark)).groupBy("section", "label").agg(F.count("*").alias("n"))


@query("n14_normalize_model_entities", "SELECT conv_id, turn, 'CHEMICAL' AS label, role AS text, CASE WHEN turn % 2 = 0 THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END AS score FROM conversations")
def _(spark, d):
    span = F.concat(F.lit('"span": "'), "role", F.lit('", "type": "'), F.when(F.col("turn") % 2 == 0, 'drug", "score": 0.9').otherwise('CHEMICAL"'))
    one = F.concat(F.lit("{"), span, F.lit("}"))
    k = F.col("turn") % 3
    raw = F.when(k == 0, F.concat(F.lit("<think>hm</think>["), one, F.lit(', {"span": "x", "type": "ODD"}]'))).when(k == 1, one).otherwise(F.concat(F.lit('{"data": ['), one, F.lit("]}")))
    c = table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("doc_id"), raw.alias("raw"))
    return ner.normalize_model_entities(c).select("doc_id.*", "label", "text", "score")


@query("n15_union_hybrid", MATCHES + """SELECT DISTINCT doc_id, label, start, "end" FROM m""")
def _(spark, d):
    m = found(spark, d)
    return ner.union_hybrid(m.filter("start % 2 = 0"), m).select("doc_id", "label", "start", "end")


@query("n16_canonicalize", MATCHES + "SELECT doc_id, text, CASE WHEN start % 2 = 0 THEN 'kept' ELSE canonical END AS canonical, start FROM m")
def _(spark, d):
    m = found(spark, d).withColumn("canonical", F.when(F.col("start") % 2 == 0, F.lit("kept")))
    return ner.canonicalize(m, native(spark), overwrite=False).select("doc_id", "text", "canonical", "start")


#: Whole-word counts: every sign is doubled, so that neighbouring hits don't share one.
COUNTED = MATCHES + r""", t AS (SELECT doc_id, ' ' || regexp_replace(lower(text), '([^\p{L}\p{N}_])', '\1\1', 'g') || ' ' AS t FROM documents), c AS (SELECT DISTINCT doc_id, label, canonical, text FROM m),
n AS (SELECT doc_id, label, canonical, text, len(regexp_extract_all(t, '[^\p{L}\p{N}_]' || replace(text, ' ', '  ') || '[^\p{L}\p{N}_]')) AS n FROM c JOIN t USING (doc_id))
"""


@query("n17_summarize_entities", COUNTED + "SELECT DISTINCT doc_id, label, text, 1.0::DOUBLE AS score, CAST(n AS INT) AS count FROM n WHERE n > 0")
def _(spark, d):
    return ner.summarize_entities(found(spark, d).withColumn("score", F.lit(1.0)), docs(spark, d))


@query("n18_find_occurrences", "WITH w AS (SELECT doc_id, text, unnest(['the', 'de la']) AS t FROM documents), p AS (SELECT doc_id, t, string_split(text, t) AS p FROM w) SELECT doc_id, t AS text, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * length(t) AS INT) AS start FROM (SELECT doc_id, t, p, unnest(range(1, len(p))) AS i FROM p)")
def _(spark, d):
    x = docs(spark, d)
    e = x.select("doc_id", F.lit("L").alias("label"), F.explode(F.array(F.lit("the"), F.lit("de la"))).alias("text"))
    return ner.find_occurrences(e, x).select("doc_id", "text", "start")


@query("n19_merge_by_canonical", MATCHES + ", c AS (SELECT doc_id, label, canonical, text, count(*) AS n FROM m GROUP BY ALL) SELECT doc_id, label, canonical, CAST(sum(n) AS BIGINT) AS count, string_agg(text, ',' ORDER BY text) AS aliases FROM c GROUP BY 1, 2, 3")
def _(spark, d):
    c = found(spark, d).groupBy("doc_id", "label", "canonical", "text").agg(F.count("*").alias("count"))
    return ner.merge_by_canonical(c).withColumn("aliases", F.array_join("aliases", ","))


@query("n20_highlight_entities")
def _(spark, d):
    """Whole pages with the words of the dictionary marked, species with their data."""
    pages = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.lit(0).alias("ord"), "html")
    meta = F.create_map(F.lit("common_name"), F.col("doc_id").cast("string"))
    e = pages.select("doc_id", F.explode(F.array(*[F.struct(F.lit(b).alias("text"), F.lit(a).alias("label")) for a, b, _ in _NATIVE])).alias("e")).select("doc_id", "e.*", meta.alias("meta"))
    return ner.highlight_entities(pages, e)


@query("n21_group_with_counts", COUNTED + "SELECT doc_id, label, canonical, CAST(greatest(sum(n), 1) AS BIGINT) AS count FROM n GROUP BY 1, 2, 3")
def _(spark, d):
    return ner.group_with_counts(found(spark, d), docs(spark, d)).select("doc_id", "label", "canonical", F.col("count").cast("long").alias("count"))


@query("n22_representative", "SELECT s_nationkey, arg_max(s_name, (CASE WHEN s_suppkey % 2 = 0 THEN 32 ELSE 8 END) * 1000000 + s_suppkey) AS text FROM supplier GROUP BY 1")
def _(spark, d):
    even = F.col("s_suppkey") % 2 == 0
    s = table(spark, d, "supplier").select("s_nationkey", F.col("s_name").alias("text"), F.create_map(F.when(even, "accepted_name").otherwise("scientific_name"), F.lit("x")).alias("meta"))
    return analytics.representative(s, "s_nationkey").select("s_nationkey", "text")


@query("n23_alias_lookup", "SELECT lower(s_name) AS alias, 'SPECIES' AS label, s_name AS text FROM supplier")
def _(spark, d):
    s = table(spark, d, "supplier").select(F.lit("SPECIES").alias("label"), F.col("s_name").alias("text"), F.create_map(F.lit("canonical"), F.col("s_name")).alias("meta"), F.array(F.upper("s_name")).alias("aliases"))
    return analytics.alias_lookup(s)


@query("n24_load_precomputed", MATCHES + "SELECT doc_id, count(*) AS n FROM m GROUP BY 1")
def _(spark, d):
    m = found(spark, d)
    return ner.load_precomputed(m.filter("doc_id % 2 = 0"), m).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("s17_export_entities", MATCHES + ", c AS (SELECT doc_id, label, canonical, text, count(*) AS n FROM m GROUP BY ALL) SELECT doc_id, label AS Type, canonical AS Name, CAST(sum(n) AS BIGINT) AS Count, array_to_string(list_distinct(list_prepend(canonical, list(text ORDER BY text))), '; ') <> '' AS ok FROM c GROUP BY 1, 2, 3")
def _(spark, d):
    c = found(spark, d).groupBy("doc_id", "label", "canonical", "text").agg(F.count("*").alias("count"))
    return ner.export_entities(ner.merge_by_canonical(c)).select("doc_id", "Type", "Name", "Count", (F.col("Variants") != "").alias("ok"))


# --- evaluation --------------------------------------------------------------------------

GOLD = MATCHES + """, gold AS (SELECT doc_id, label, start, "end" FROM m), pred AS (SELECT doc_id, label, CASE WHEN start % 5 = 1 THEN start + 100000 ELSE start END AS start, CASE WHEN start % 5 = 1 THEN "end" + 100000 ELSE "end" END AS "end" FROM m WHERE start % 3 <> 0)"""


def gold(spark, d):
    return found(spark, d).select("doc_id", "label", "start", "end")


def predicted(spark, d):
    far = F.when(F.col("start") % 5 == 1, 100000).otherwise(0)
    return gold(spark, d).filter("start % 3 <> 0").select("doc_id", "label", (F.col("start") + far).alias("start"), (F.col("end") + far).alias("end"))


@query("e01_filter_to_types", GOLD + "SELECT label, count(*) AS n FROM gold WHERE label IN ('SEASON', 'SPECIES') AND doc_id IN (SELECT doc_id FROM pred) GROUP BY 1")
def _(spark, d):
    return evaluation.filter_to_types(gold(spark, d), predicted(spark, d), ["SEASON", "SPECIES"])[0].groupBy("label").agg(F.count("*").alias("n"))


PARTIAL = """WITH l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS k FROM documents),
gold AS (SELECT doc_id, 'L' || (k % 3) AS label, 1000 * k AS start, 1000 * k + 500 AS "end" FROM l),
pred AS (SELECT doc_id, label, start + moved AS start, "end" + moved AS "end" FROM gold JOIN (VALUES (0, 0), (1, 200), (1, -100), (2, 499), (3, 500)) v(kind, moved) ON start // 1000 % 5 = kind),
g AS (SELECT *, (doc_id, label, start, "end") IN (SELECT (doc_id, label, start, "end") FROM pred) AS strict FROM gold),
p AS (SELECT * FROM pred WHERE (doc_id, label, start, "end") NOT IN (SELECT (doc_id, label, start, "end") FROM gold)),
m AS (SELECT g.doc_id, g.label, g.strict, NOT g.strict AND EXISTS (SELECT 1 FROM p WHERE p.doc_id = g.doc_id AND p.label = g.label AND p.start < g."end" AND g.start < p."end") AS partial FROM g),
c AS (SELECT doc_id, label, CAST(count(*) FILTER (WHERE strict) AS BIGINT) AS strict, CAST(count(*) FILTER (WHERE partial) AS BIGINT) AS partial, count(*) AS n_gold FROM m GROUP BY ALL),
t AS (SELECT c.*, CAST(coalesce(n, 0) AS BIGINT) AS n_predicted FROM c LEFT JOIN (SELECT doc_id, label, count(*) AS n FROM pred GROUP BY ALL) USING (doc_id, label))
"""


def placed(spark, d):
    """Spans of lines as gold; predictions that equal them, overlap once or twice, just touch, or are missing."""
    lines = docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "_"))
    gold = lines.select("doc_id", F.concat(F.lit("L"), (F.col("k") % 3).cast("string")).alias("label"), (1000 * F.col("k")).alias("start"), (1000 * F.col("k") + 500).alias("end"))
    kind = F.floor(F.col("start") / 1000) % 5
    moves = F.when(kind == 0, F.array(F.lit(0))).when(kind == 1, F.array(F.lit(200), F.lit(-100))).when(kind == 2, F.array(F.lit(499))).when(kind == 3, F.array(F.lit(500)))
    pred = gold.withColumn("moved", F.explode(moves)).select("doc_id", "label", (F.col("start") + F.col("moved")).alias("start"), (F.col("end") + F.col("moved")).alias("end"))
    return gold, pred


@query("e02_match_spans", PARTIAL + "SELECT * FROM t")
def _(spark, d):
    return evaluation.match_spans(*placed(spark, d))


@query(
    "e03_partial_f1",
    PARTIAL
    + """, s AS (SELECT label, sum(strict) + 0.5 * sum(partial) AS hit, sum(n_gold) AS g, sum(n_predicted) AS p FROM t GROUP BY 1)
SELECT label, round(hit / p, 6) AS partial_precision, round(hit / g, 6) AS partial_recall, round(2 * (hit / p) * (hit / g) / (hit / p + hit / g), 6) AS partial_f1 FROM s""",
)
def _(spark, d):
    t = evaluation.precision_recall_f1(evaluation.match_spans(*placed(spark, d)), "label")
    return t.select("label", *[F.round(f"partial_{c}", 6).alias(f"partial_{c}") for c in ("precision", "recall", "f1")])


@query("e03_precision_recall_f1", GOLD + """, s AS (SELECT (SELECT count(*) FROM gold JOIN pred USING (doc_id, label, start, "end")) AS hit, (SELECT count(*) FROM gold) AS g, (SELECT count(*) FROM pred) AS p) SELECT round(hit / p, 6) AS strict_precision, round(hit / g, 6) AS strict_recall, round(2 * hit / (p + g), 6) AS strict_f1 FROM s""")
def _(spark, d):
    t = evaluation.precision_recall_f1(evaluation.match_spans(gold(spark, d), predicted(spark, d)))
    return t.select(*[F.round(f"strict_{c}", 6).alias(f"strict_{c}") for c in ("precision", "recall", "f1")])


TYPES = GOLD + """, t AS (SELECT label, (SELECT count(*) FROM gold g JOIN pred p USING (doc_id, label, start, "end") WHERE g.label = l.label) AS hit, (SELECT count(*) FROM gold g WHERE g.label = l.label) AS g, (SELECT count(*) FROM pred p WHERE p.label = l.label) AS p FROM (SELECT DISTINCT label FROM gold) l)"""


@query("e04_per_type_f1", TYPES + " SELECT label, round(2 * hit / (p + g), 6) AS f1 FROM t")
def _(spark, d):
    return evaluation.precision_recall_f1(evaluation.match_spans(gold(spark, d), predicted(spark, d)), "label").select("label", F.round("strict_f1", 6).alias("f1"))


@query("e05_macro_f1", TYPES + " SELECT round(avg(2 * hit / (p + g)), 6) AS macro_f1 FROM t")
def _(spark, d):
    return evaluation.macro_f1(evaluation.match_spans(gold(spark, d), predicted(spark, d))).select(F.round("macro_f1", 6).alias("macro_f1"))


@query("e06_fp_fn", GOLD + """SELECT doc_id, label, start, "end", 'FP' AS kind FROM pred WHERE start >= 100000 UNION ALL SELECT doc_id, label, start, "end", 'FN' FROM gold WHERE start % 3 = 0 OR start % 5 = 1""")
def _(spark, d):
    return evaluation.fp_fn(gold(spark, d), predicted(spark, d), docs(spark, d)).drop("context")


@query("e07_fp_fn_by_type", GOLD + """, e AS (SELECT label, 'FP' AS kind FROM pred WHERE start >= 100000 UNION ALL SELECT label, 'FN' FROM gold WHERE start % 3 = 0 OR start % 5 = 1) SELECT kind, label, count(*) AS n FROM e GROUP BY ALL""")
def _(spark, d):
    return evaluation.fp_fn_by_type(evaluation.fp_fn(gold(spark, d), predicted(spark, d), docs(spark, d)))


def mcq(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", F.concat(F.lit("Answer: "), F.when(F.col("turn") % 3 == 0, "B").otherwise("C")).alias("answer"), F.lit("b").alias("correct_option"), F.col("role").alias("difficulty"))


@query("e09_mcq_accuracy", "SELECT role AS difficulty, count(*) AS n, round(avg(CASE WHEN turn % 3 = 0 THEN 1 ELSE 0 END), 6) AS accuracy FROM conversations GROUP BY ROLLUP (role)")
def _(spark, d):
    return evaluation.mcq_accuracy(mcq(spark, d)).withColumn("accuracy", F.round("accuracy", 6))


@query("e10_build_mcq_prompt", "SELECT doc_id, md5(source || chr(10) || 'A) ' || lang || chr(10) || 'B) b' || chr(10) || 'C) c' || chr(10) || 'D) d' || chr(10) || 'Answer with one letter.') AS prompt FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(evaluation.build_mcq_prompt(F.col("source"), F.col("lang"), F.lit("b"), F.lit("c"), F.lit("d"))).alias("prompt"))


def scored(spark, d):
    c = table(spark, d, "conversations")
    m = [(F.col("turn") / (k + 1)).alias(name) for k, name in enumerate(evaluation.METRICS)]
    return evaluation.check_eval_rows(c.select("conv_id", "turn", F.when(F.col("turn") % 4 != 0, F.array("text")).otherwise(F.array().cast("array<string>")).alias("contexts"), F.when(F.col("turn") % 3 == 0, " ").otherwise(F.col("text")).alias("answer"), *m))


@query("e11_check_eval_rows", "SELECT conv_id, turn, nullif(concat_ws('; ', CASE WHEN turn % 4 = 0 THEN 'missing contexts' END, CASE WHEN turn % 3 = 0 THEN 'missing answer' END), '') AS error FROM conversations")
def _(spark, d):
    return scored(spark, d).select("conv_id", "turn", "error")


@query("e12_summarize_metrics", "SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS ok, count(*) FILTER (WHERE NOT ok) AS failed, round(avg(CASE WHEN ok THEN turn END), 6) AS faithfulness FROM (SELECT turn, turn % 4 <> 0 AND turn % 3 <> 0 AS ok FROM conversations)")
def _(spark, d):
    return evaluation.summarize_metrics(scored(spark, d)).select("total", "ok", "failed", F.round("faithfulness", 6).alias("faithfulness"))


@query("e13_resume", "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    return evaluation.resume(table(spark, d, "documents").select(F.col("doc_id").alias("id")), table(spark, d, "labels").select(F.col("doc_id").alias("id")))


@query("e14_match_pubchem_titles", "SELECT p_name AS name, max(p_partkey) AS cid FROM part GROUP BY 1")
def _(spark, d):
    p = table(spark, d, "part")
    titles = p.select(F.col("p_partkey").alias("cid"), F.upper("p_name").alias("title"), F.col("p_partkey").alias("ord"))
    return evaluation.match_pubchem_titles(p.select(F.col("p_name").alias("name")).distinct(), titles)


@query("e15_match_pubchem_synonyms", "SELECT p_name AS name, min(p_partkey) AS cid FROM part WHERE p_name <> (SELECT min(p_name) FROM part) GROUP BY 1")
def _(spark, d):
    p = table(spark, d, "part")
    syn = p.select(F.col("p_partkey").alias("cid"), F.concat(F.lit("x|"), "p_name").alias("synonym"), F.col("p_partkey").alias("ord"))
    return evaluation.match_pubchem_synonyms(p.select(F.col("p_name").alias("name")).distinct(), p.agg(F.min("p_name").alias("name")), syn)


@query("e16_assemble_chemicals", "SELECT p_partkey AS cid, 'C' || p_partkey AS smiles, p_brand AS synonyms FROM part")
def _(spark, d):
    p = table(spark, d, "part").withColumn("cid", F.col("p_partkey"))
    syn = p.select("cid", F.lit(1).alias("ord"), F.lit("InChI=1").alias("synonym")).unionByName(p.select("cid", F.lit(2).alias("ord"), F.col("p_brand").alias("synonym")))
    out = evaluation.assemble_chemicals(p.select(F.col("p_name").alias("name"), "cid"), p.select("cid", F.concat(F.lit("C"), "cid").alias("smiles")), p.select("cid", F.lit("bad").alias("inchikey")), syn)
    return out.filter("inchikey IS NULL").select("cid", "smiles", "synonyms")


@query("e17_enrich_species", "SELECT s_name AS name, s_suppkey AS key, CASE WHEN s_suppkey % 2 = 0 THEN n_name END AS common_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    v = s.select(F.col("s_suppkey").alias("key"), F.when(F.col("s_suppkey") % 2 == 0, "en").otherwise("fr").alias("language"), F.col("n_name").alias("name"), F.lit(1).alias("ord"))
    return evaluation.enrich_species(s.select(F.col("s_name").alias("name")), s.select(F.upper("s_name").alias("name"), F.col("s_suppkey").alias("key")), v)


# --- sources and streams ---------------------------------------------------------------------


@query("s14_document_pages", r"""WITH p AS (SELECT doc_id, regexp_replace(text[1:60], '^\s+|\s+$', '', 'g') AS a, regexp_replace(text[61:], '^\s+|\s+$', '', 'g') AS b FROM documents)
SELECT doc_id, CAST((a <> '')::INT + (b <> '')::INT AS INT) AS n, CASE WHEN a <> '' THEN md5(a) WHEN b <> '' THEN md5(b) END AS first FROM p""")
def _(spark, d):
    """Documents as a page of 60 characters, an empty one and the rest."""
    x = docs(spark, d)
    marked = F.concat(F.lit("<!-- Page 1 -->\n"), F.substring("text", 1, 60), F.lit("\n<!-- Page 2 -->\n\n<!-- Page 3 -->"), F.expr("substring(text, 61)"))
    p = readers.document_pages(marked)
    return x.select("doc_id", F.size(p).alias("n"), F.md5(F.get(p, F.lit(0))["text"]).alias("first"))


@query("s18_export_compare", MATCHES + """SELECT label AS "Entity Type", lower(canonical) AS name, count(*) AS "Count" FROM m GROUP BY 1, 2""")
def _(spark, d):
    m = found(spark, d).select(F.col("doc_id").alias("paper_id"), "label", F.col("canonical").alias("text"), "canonical", F.lit(1).alias("count"))
    return analytics.export_compare(m).select("Entity Type", F.lower("Entity Name").alias("name"), "Count")


@query(
    "t01_stream_ingest",
    """WITH v AS (SELECT 'f' || CAST(floor(doc_id / 3) AS BIGINT) AS filename, arg_max(doc_id, doc_id) AS doc_id FROM documents GROUP BY 1)
SELECT filename, substr(sha256(coalesce(text, '')), 1, 24) AS paper_id, CASE WHEN regexp_matches(coalesce(text, ''), '\\S') THEN 'indexed' ELSE 'error' END AS status, doc_id AS version FROM v JOIN documents USING (doc_id)""",
)
def _(spark, d):
    """Documents as versions of a third as many files, arriving as a stream: what each file is in the end."""
    stream = spark.readStream.schema(table(spark, d, "documents").schema).option("maxFilesPerTrigger", 8).parquet(f"{d}/documents.parquet*")
    text = F.coalesce("text", F.lit(""))
    files = stream.select(F.concat(F.lit("f"), F.floor(F.col("doc_id") / 3).cast("string")).alias("filename"), ingest.corpus.content_id(text).alias("paper_id"), F.timestamp_seconds("doc_id").alias("modified"), text.alias("text"))
    store = ingest.CorpusStore(spark, shared_folder(spark))
    ingest.stream_ingest(files, store).awaitTermination()
    return store.catalog().select("filename", "paper_id", "status", F.unix_seconds("modified").alias("version"))


@query("t02_stream_extract")
def _(spark, d):
    """Entities of documents arriving as a stream, read back from the stream's table."""
    stream = spark.readStream.schema(table(spark, d, "documents").schema).parquet(f"{d}/documents.parquet*")
    return _drained(spark, ingest.stream_extract(spark, stream.select("doc_id", "text"), dictionary(spark)), "append")


@query("t03_stream_counts", MATCHES + "SELECT CAST(doc_id % 10 AS VARCHAR) AS doi, lang AS label, source AS canonical_text, count(*) AS frequency FROM documents GROUP BY 1, 2, 3")
def _(spark, d):
    stream = spark.readStream.schema(table(spark, d, "documents").schema).parquet(f"{d}/documents.parquet*")
    facts = stream.select((F.col("doc_id") % 10).cast("string").alias("doi"), F.col("lang").alias("label"), F.col("source").alias("canonical_text"))
    return _drained(spark, ingest.stream_counts(facts), "complete")


@query("t03_upsert_counts", "SELECT CAST(doc_id % 10 AS VARCHAR) AS doi, lang AS label, source AS canonical_text, count(*) AS frequency FROM documents GROUP BY 1, 2, 3")
def _(spark, d):
    """The same counts from a stored table that batches are merged into."""
    stream = spark.readStream.schema(table(spark, d, "documents").schema).option("maxFilesPerTrigger", 8).parquet(f"{d}/documents.parquet*")
    facts = stream.select((F.col("doc_id") % 10).cast("string").alias("doi"), F.col("lang").alias("label"), F.col("source").alias("canonical_text"))
    store = ingest.CountStore(spark, shared_folder(spark))
    ingest.upsert_counts(facts, store).awaitTermination()
    return store.table().drop("metadata")


def _drained(spark, stream, mode: str):
    """All rows of a stream, run until it has read what is there."""
    out = shared_folder(spark)
    if mode == "append":
        stream.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").option("path", f"{out}/rows").trigger(availableNow=True).start().awaitTermination()
    else:
        def keep(rows, number):
            rows.write.mode("overwrite").parquet(f"{out}/rows")

        stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows")


@query("s38_normalised_words", r"SELECT doc_id, len(regexp_split_to_array(regexp_replace(lower(trim(text)), '\s+', ' ', 'g'), ' ')) AS n FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.size(F.split(normalize_text(F.col("text")), " ")).cast("long").alias("n"))
