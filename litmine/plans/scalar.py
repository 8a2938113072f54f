"""Queries of the scalar functions over the driver's texts, URLs and records."""

from __future__ import annotations

from pyspark.sql import functions as F

from litmine.functions import scalars as S
from litmine.plans.registry import query, table

#: Page URLs dressed as the kinds of identifiers, by page number.
RAW = (
    "https://europepmc.org/article/PMC/PMC{}", "HTTP://www.europepmc.org/article/MED/{}", "https://pubmed.ncbi.nlm.nih.gov/{}/",
    "https://www.ncbi.nlm.nih.gov/pmc/articles/pmc{}/", "https://pmc.ncbi.nlm.nih.gov/articles/PMC{}", "https://dx.doi.org/10.1/A{}",
    "DOI: 10.2/b{}", "pmc{}", "10.3/C{}", "{}", "title {}",
)
_RAW_SQL = "CASE page_id % 11 " + " ".join(f"WHEN {k} THEN replace('{x}', '{{}}', CAST(page_id AS VARCHAR))" for k, x in enumerate(RAW)) + " END"
#: Kind and form of each of the above.
_KIND = ("pmcid", "pmid", "pmid", "pmcid", "pmcid", "doi", "doi", "pmcid", "doi", "pmid", None)
_FORM = ("PMC{}", "{}", "{}", "PMC{}", "PMC{}", "10.1/A{}", "10.2/b{}", "PMC{}", "10.3/C{}", "{}", "title {}")
_KIND_SQL = "CASE page_id % 11 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(_KIND) if x) + " END"
_FORM_SQL = "CASE page_id % 11 " + " ".join(f"WHEN {k} THEN replace('{x}', '{{}}', CAST(page_id AS VARCHAR))" for k, x in enumerate(_FORM)) + " END"


def raw_identifiers(spark, d):
    raw = F.element_at(F.array(*map(F.lit, RAW)), (F.col("page_id") % 11 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", "url", F.replace(raw, F.lit("{}"), F.col("page_id").cast("string")).alias("raw"))


@query("s20_parse_identifier", f"SELECT page_id, {_KIND_SQL} AS type, {_FORM_SQL} AS value FROM pages")
def _(spark, d):
    return raw_identifiers(spark, d).select("page_id", S.parse_identifier(F.col("raw")).alias("p")).select("page_id", "p.*")


@query("s21_normalize_identifier", f"SELECT page_id, {_KIND_SQL} AS type, CASE WHEN page_id % 11 IN (5, 6, 8) THEN lower({_FORM_SQL}) ELSE {_FORM_SQL} END AS value FROM pages")
def _(spark, d):
    return raw_identifiers(spark, d).select("page_id", S.normalize_identifier(F.col("raw")).alias("p")).select("page_id", "p.*")


@query(
    "s22_normalize_ids",
    f"""WITH r AS (SELECT page_id, {_RAW_SQL} AS raw FROM pages)
SELECT page_id, trim(regexp_replace(regexp_replace(lower(trim(raw)), '^https?://(dx\\.)?doi\\.org/', ''), '^doi:', '')) AS doi,
       regexp_extract(raw, '([0-9]+)', 1) AS pmid, regexp_extract(upper(raw), '(PMC[0-9]+)', 1) AS pmcid FROM r""",
)
def _(spark, d):
    raw = F.col("raw")
    return raw_identifiers(spark, d).select("page_id", S.normalize_doi(raw).alias("doi"), S.normalize_pmid(raw).alias("pmid"), S.normalize_pmcid(raw).alias("pmcid"))


@query("s23_reconstruct_abstract", "SELECT doc_id, md5(trim(text)) AS abstract FROM documents WHERE trim(text) <> ''")
def _(spark, d):
    """Whole texts as inverted indexes, word to places, and back."""
    words = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("p", "w")).filter("w <> ''")
    index = words.groupBy("doc_id", "w").agg(F.collect_list("p").alias("ps")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("index"))
    return index.select("doc_id", F.md5(S.reconstruct_abstract(F.col("index"))).alias("abstract"))


@query("s25_join_authors", "SELECT conv_id, coalesce(nullif(array_to_string(list(trim(role) ORDER BY turn)[1:10], ', '), ''), 'Unknown authors') AS authors FROM conversations GROUP BY conv_id")
def _(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"))
    return c.select("conv_id", S.join_authors(F.flatten(F.array(F.array(F.lit(" "), F.lit(None).cast("string")), F.transform("r", lambda x: x["role"])))).alias("authors"))


@query("s26_coerce_year", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'Unknown year' ELSE CAST(year(ts) AS VARCHAR) END AS year FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", S.coerce_year(F.when(F.col("event_id") % 3 != 0, F.concat(F.lit(" "), F.year("ts").cast("string")))).alias("year"))


@query("s27_first_nonblank", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE source END AS csv, CASE WHEN doc_id % 2 = 0 THEN lang WHEN doc_id % 3 = 0 THEN source END AS sheet FROM documents")
def _(spark, d):
    even, third = F.col("doc_id") % 2 == 0, F.col("doc_id") % 3 == 0
    return table(spark, d, "documents").select(
        "doc_id",
        S.first_nonblank(F.when(even, F.concat(F.lit(" "), "lang")).otherwise(F.lit("  ")), F.col("source")).alias("csv"),
        S.first_value(F.when(even, F.col("lang")).otherwise(F.lit("NaN")), F.when(third, F.col("source"))).alias("sheet"),
    )


@query("s28_to_int", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN CAST(n_chars AS INT) WHEN 1 THEN CAST(-n_chars AS INT) END AS n FROM documents")
def _(spark, d):
    k, n = F.col("doc_id") % 3, F.col("n_chars").cast("string")
    return table(spark, d, "documents").select("doc_id", S.to_int(F.when(k == 0, F.concat(F.lit(" "), n)).when(k == 1, F.concat(F.lit("-"), n)).otherwise(F.concat(n, F.lit(".0")))).alias("n"))


@query("s29_truthy", "SELECT event_id, event_id % 4 < 2 AS csv, event_id % 4 IN (0, 3) AS sheet FROM events")
def _(spark, d):
    k = F.col("event_id") % 4
    word = F.when(k == 0, " yes").when(k == 1, "True").when(k == 2, "no").otherwise("OPEN")
    sheet = F.when(k == 1, "x").otherwise(word)
    return table(spark, d, "events").select("event_id", S.truthy(word).alias("csv"), S.truthy(sheet, "sheet").alias("sheet"))


@query(
    "s30_format_publication_date",
    "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%d %B %Y') WHEN 1 THEN '01 ' || strftime(o_orderdate, '%B %Y') WHEN 2 THEN CAST(year(o_orderdate) AS VARCHAR) ELSE '01 ' || strftime(o_orderdate, '%B %Y') END AS date FROM orders",
)
def _(spark, d):
    k, day = F.col("o_orderkey") % 4, F.date_format("o_orderdate", "yyyy-MM-dd")
    raw = F.when(k == 0, day).when(k == 1, F.substring(day, 1, 7)).when(k == 2, F.substring(day, 1, 4)).otherwise(F.lit(""))
    month = F.when(F.col("o_orderkey") % 8 == 3, F.date_format("o_orderdate", "M")).otherwise(F.date_format("o_orderdate", "MMMM"))
    year = F.year("o_orderdate").cast("string")
    return table(spark, d, "orders").select("o_orderkey", S.format_publication_date(raw, month, year, year).alias("date"))


@query("s31_extract_doi", "SELECT page_id, '10.1234/ab.' || page_id AS pages, '10.1234/ab.' || page_id AS kb, '10.1234/ab.' || page_id || '.' AS ner FROM pages")
def _(spark, d):
    text = F.concat(F.col("url"), F.lit(" see doi: 10.1234/ab."), F.col("page_id").cast("string"), F.lit(". End"))
    return table(spark, d, "pages").select("page_id", *[S.extract_doi(text, v).alias(v) for v in ("pages", "kb", "ner")])


@query("s32_extract_journal", "SELECT doc_id, 'Odd Things ' || source AS journal FROM documents")
def _(spark, d):
    text = F.concat(F.lit("x\nJournal of : Odd Things "), "source", F.lit("\n"), F.substring("text", 1, 50))
    return table(spark, d, "documents").select("doc_id", S.extract_journal(text).alias("journal"))


_HTML = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
 '(?is)<(?:script)\b[^>]*>.*?</script>|<(?:style)\b[^>]*>.*?</style>', '', 'g'), '(?s)<[^>]*>', '{}', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[\s ]+', ' ', 'g'))"""


@query("s33_html_to_text", f"SELECT page_id, {_HTML.format('')} AS server, {_HTML.format(' ')} AS client FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", S.html_to_text(F.col("html")).alias("server"), S.html_to_text(F.col("html"), "client").alias("client"))


@query("s36_map_article_type", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'article' ELSE lower(event_type) END AS t FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", S.map_article_type(F.when(F.col("event_id") % 2 == 0, " Research-Article ").otherwise(F.upper("event_type"))).alias("t"))


@query("s37_entity_row_flatten", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 0 END AS n_aliases, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events")
def _(spark, d):
    extra = F.when(F.col("event_id") % 2 == 0, '{"aliases":["a","b"],').otherwise('{"aliases":"a",')
    m = S.flatten_entity(F.concat(extra, F.expr("substring(props, 2)")))
    return table(spark, d, "events").select("event_id", m.alias("m")).select("event_id", F.size("m.aliases").alias("n_aliases"), F.try_element_at("m.rest", F.lit("k")).alias("k"))


@query("s38_normalize_text", r"SELECT doc_id, md5(regexp_replace(lower(trim(text)), '\s+', ' ', 'g')) AS h FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(S.normalize_text(F.col("text"))).alias("h"))


@query("s39_s42_name_normalisers", "SELECT p_partkey, '6-alpha-' || p_name || ' beta' AS greek, p_name || '-a-b' AS separators, p_name || ' a b ' AS punct, 'Ocimum L . ' || p_name AS abbr FROM part")
def _(spark, d):
    name = F.col("p_name")
    return table(spark, d, "part").select(
        "p_partkey",
        S.normalize_greek(F.concat(F.lit("6α-"), name, F.lit(" β"))).alias("greek"),
        S.normalize_separators(F.concat(name, F.lit("–a/b"))).alias("separators"),
        S.normalize_chem_punct(F.concat(name, F.lit("/a,b′"))).alias("punct"),
        S.split_abbreviations(F.concat(F.lit("Ocimum L. "), name)).alias("abbr"),
    )


@query("s43_embedding_version", "SELECT vec_id, md5('model' || label || ':' || len(embedding))[1:8] AS version FROM embeddings")
def _(spark, d):
    return table(spark, d, "embeddings").select("vec_id", S.embedding_version(F.concat(F.lit("model"), F.col("label").cast("string")), F.size("embedding")).alias("version"))


# --- answers ------------------------------------------------------------------------

_ANSWER = "text || ' [' || (turn % 3) || '] [ C' || conv_id % 5 || ' ] [c' || (turn % 3) || ']'"


def answers(spark, d):
    c = table(spark, d, "conversations").filter("role = 'assistant'")
    return c.select("conv_id", "turn", F.concat("text", F.lit(" ["), (F.col("turn") % 3).cast("string"), F.lit("] [ C"), (F.col("conv_id") % 5).cast("string"), F.lit(" ] [c"), (F.col("turn") % 3).cast("string"), F.lit("]")).alias("answer"))


@query(
    "a02_parse_markers",
    "SELECT conv_id, turn, CASE WHEN turn % 3 = conv_id % 5 THEN 'c' || (turn % 3) ELSE 'c' || (turn % 3) || ',c' || (conv_id % 5) END AS ids FROM conversations WHERE role = 'assistant'",
)
def _(spark, d):
    return answers(spark, d).select("conv_id", "turn", F.array_join(S.parse_markers(F.col("answer")), ",").alias("ids"))


@query("a03_strip_markers", "SELECT conv_id, turn, trim(regexp_replace(text, '  +', ' ', 'g')) AS answer FROM conversations WHERE role = 'assistant'")
def _(spark, d):
    return answers(spark, d).select("conv_id", "turn", S.strip_markers(F.col("answer")).alias("answer"))


@query("a04_mask_markers", "SELECT conv_id, turn, text || ' [†] [†] [†]' AS answer FROM conversations WHERE role = 'assistant'")
def _(spark, d):
    return answers(spark, d).select("conv_id", "turn", S.mask_markers(F.col("answer")).alias("answer"))


@query("a06_is_non_factual", "SELECT conv_id, turn, turn % 2 = 0 AS refusal FROM conversations")
def _(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", S.is_non_factual(F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit(" It is NOT PROVIDED here"))).otherwise(F.col("text"))).alias("refusal"))


@query("a07_is_chrome_sentence", "SELECT page_id, page_id % 3 <> 2 AS chrome FROM pages")
def _(spark, d):
    k = F.col("page_id") % 3
    return table(spark, d, "pages").select("page_id", S.is_chrome_sentence(F.when(k == 0, F.col("url")).when(k == 1, "ALL CAPITAL LINE").otherwise("An ordinary line")).alias("chrome"))


@query("e08_mcq_extract_option", "SELECT conv_id, turn, chr(CAST(65 + turn % 4 AS INT)) AS option FROM conversations")
def _(spark, d):
    letter = F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("turn") % 4 + 1).cast("int"))
    text = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("The answer: "), F.lower(letter))).otherwise(F.concat(F.lit("so "), letter, F.lit(") it is")))
    return table(spark, d, "conversations").select("conv_id", "turn", S.mcq_option(text).alias("option"))


@query("u01_sql_functions", "SELECT page_id, lower(regexp_replace(url, '^https?://', 'https://doi.org/')) AS x, 0.5 AS r, CAST(3 AS INT) AS page FROM pages WHERE false UNION ALL SELECT page_id, regexp_extract(url, '([0-9]+)', 1), 0.5, 3 FROM pages")
def _(spark, d):
    S.register_functions(spark)
    return table(spark, d, "pages").selectExpr("page_id", "lit_normalize_pmid(url) AS x", "lit_recency_score(CAST(NULL AS INT), 2024) AS r", "lit_page_for_offset('<!-- Page 2 --> a <!-- Page 3 --> b', 34) AS page")


@query("s34_clean_xml", r"SELECT doc_id, md5(array_to_string(list_filter(regexp_split_to_array(regexp_replace(text, '[<>&]', ' ', 'g'), '\s+'), lambda w: w <> ''), ' ')) AS h FROM documents")
def _(spark, d):
    from litmine.operators.chunking import clean_xml

    body = F.regexp_replace("text", "[<>&]", " ")
    xml = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<a><front>x</front><body><p>"), body, F.lit("</p></body></a>"))).otherwise(F.concat(F.lit("<p>"), body))
    return table(spark, d, "documents").select("doc_id", F.md5(clean_xml(xml)).alias("h"))


@query("s35_flatten_metadata_values", "SELECT vec_id, CAST(label AS VARCHAR) AS label, '' AS missing, len(embedding) AS n FROM embeddings")
def _(spark, d):
    e = table(spark, d, "embeddings").withColumn("missing", F.lit(None).cast("string"))
    m = S.flatten_metadata_values(e, "label", "missing", "embedding")
    return e.select("vec_id", m.alias("m")).select("vec_id", F.col("m")["label"].alias("label"), F.col("m")["missing"].alias("missing"), F.size(F.from_json(F.col("m")["embedding"], "array<float>")).cast("long").alias("n"))


@query("s10_s24_flatten_work", "SELECT doc_id, '10.1/' || doc_id AS doi, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'Untitled' END AS title, lang AS authors, doc_id % 3 = 0 AS has_full_text, 'w1 w2' AS abstract FROM documents")
def _(spark, d):
    from litmine.sources import readers

    k = F.col("doc_id")
    raw = table(spark, d, "documents").select(
        F.to_json(
            F.struct(
                k.cast("string").alias("id"), F.concat(F.lit("https://doi.org/10.1/"), k.cast("string")).alias("doi"), F.when(k % 2 == 0, F.col("source")).alias("display_name"),
                F.array(F.struct(F.struct(F.col("lang").alias("display_name")).alias("author"))).alias("authorships"),
                F.array(F.struct(F.when(k % 3 == 0, F.lit("u")).alias("pdf_url"))).alias("locations"),
                F.create_map(F.lit("w2"), F.array(F.lit(1)), F.lit("w1"), F.array(F.lit(0))).alias("abstract_inverted_index"),
            )
        ).alias("j"),
        "doc_id",
    )
    w = raw.select("doc_id", F.from_json("j", readers.WORK).alias("w")).select("doc_id", "w.*")
    flat = readers.flatten_work(w.drop("doc_id").withColumn("id", F.col("id")))
    return flat.select(F.substring_index("doi", "/", -1).cast("long").alias("doc_id"), "doi", "title", "authors", "has_full_text", "abstract")
