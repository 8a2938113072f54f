"""Document-structure and corpus-maintenance queries over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from litmine.operators import chunking as C
from litmine.operators import corpus
from litmine.operators import retrieval as R
from litmine.operators.citations import sentences
from litmine.plans.registry import query, shared_folder, table

_WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"


def docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", F.substring("text", 1, 40).alias("title"), "text", "lang")


def lines(spark, d):
    """Lines of documents as chunks (doc_id, ord, chunk)."""
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "chunk"))


LINES = "WITH l AS (SELECT doc_id, generate_subscripts(s, 1) - 1 AS ord, unnest(s) AS chunk FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))"


@query(
    "c05_detect_sections",
    LINES
    + r""", n AS (
  SELECT doc_id, ord, chunk, regexp_replace(chunk, '^\s+|\s+$', '', 'g') AS s FROM l
), f AS (
  SELECT *, coalesce(nullif(lead(s, 1) OVER w, ''), nullif(lead(s, 2) OVER w, ''), nullif(lead(s, 3) OVER w, ''), '') AS nxt, len(regexp_split_to_array(s, '\s+')) AS words FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY ord)
), h AS (
  SELECT *, CASE WHEN regexp_matches(s, '^#{1,4}\s+.+$') OR regexp_matches(s, '^[0-9]+\.?\s+[A-Z]') OR (length(s) < 60 AND regexp_full_match(s, 'ABSTRACT|SUMMARY|RESULTS|METHODS|DISCUSSION'))
    OR (length(s) BETWEEN 1 AND 44 AND words BETWEEN 2 AND 5 AND NOT regexp_matches(s, '[.:]$') AND regexp_matches(s, '^\p{Lu}') AND NOT regexp_matches(s, 'Page [0-9]+ of|[0-9]{5,}|@|et al\.') AND length(nxt) > 40 AND nxt[1] <> '#')
    THEN 1 ELSE 0 END AS head FROM f
), g AS (SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY ord) AS part FROM h)
SELECT doc_id, md5(string_agg(chunk, chr(10) ORDER BY ord)) AS content FROM g WHERE head = 0 GROUP BY doc_id, part""",
)
def _(spark, d):
    return C.detect_sections(docs(spark, d)).select("doc_id", F.md5("content").alias("content"))


@query("c06_split_recursive")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(C.split_column(*C.PARENT)("text")).alias("ord", "piece"))


@query("c07_parent_child_chunks")
def _(spark, d):
    return C.parent_child_chunks(docs(spark, d))[1]


@query(
    "c08_chunk_ids",
    LINES
    + """, u AS (SELECT doc_id, ord, md5(doc_id || '::start::' || chunk[1:200]) || '_p' || ord AS parent_id, doc_id || ':child:' || ord AS name FROM l)
SELECT doc_id, ord, parent_id, length(name) + 0 AS n FROM u""",
)
def _(spark, d):
    x = lines(spark, d)
    name = F.concat_ws(":", F.col("doc_id").cast("string"), F.lit("child"), F.col("ord").cast("string"))
    rows = x.select("doc_id", "ord", C.parent_id(F.col("doc_id").cast("string"), F.lit("start"), F.col("chunk"), F.col("ord")).alias("parent_id"), C.uuid5(name).alias("uuid"), F.length(name).alias("n"))
    return rows.filter(F.length("uuid") == 36).drop("uuid")


@query("c09_locate_offsets", LINES + r""", b AS (SELECT l.doc_id, ord, text, regexp_replace(chunk, '^\s+|\s+$', '', 'g') AS s FROM l JOIN documents d ON l.doc_id = d.doc_id) SELECT doc_id, ord, CASE WHEN s <> '' THEN strpos(text, s) - 1 END AS start, CASE WHEN s <> '' THEN strpos(text, s) - 1 + length(s) END AS "end" FROM b""")
def _(spark, d):
    x = lines(spark, d).join(docs(spark, d).select("doc_id", "text"), "doc_id")
    return x.select("doc_id", "ord", C.locate(F.col("text"), F.col("chunk")).alias("at")).select("doc_id", "ord", "at.*")


@query("c10_locate_offsets_fuzzy")
def _(spark, d):
    chunks = lines(spark, d).withColumn("chunk", F.regexp_replace("chunk", " ", "  "))
    return C.locate_offsets_fuzzy(chunks, docs(spark, d))


@query("c11_page_for_offset", "SELECT doc_id, CASE WHEN length(text) > 100 THEN 2 ELSE 1 END AS page FROM documents")
def _(spark, d):
    from litmine.functions.scalars import page_for_offset

    marked = F.concat(F.lit("<!-- Page 1 -->\n"), F.substring("text", 1, 100), F.lit("\n<!-- Page 2 -->\n"), F.expr("substring(text, 101)"))
    at = F.when(F.length("text") > 100, F.length(marked)).otherwise(F.lit(20))
    return docs(spark, d).select("doc_id", page_for_offset(marked, at).alias("page"))


@query("c12_scope_to_page", "SELECT doc_id, md5(trim(text[1:100])) AS page FROM documents")
def _(spark, d):
    marked = F.concat(F.lit("<!-- Page 1 -->"), F.substring("text", 1, 100), F.lit("<!-- Page 2 -->"), F.expr("substring(text, 101)"))
    return docs(spark, d).select("doc_id", F.md5(C.scope_to_page(marked, 1)).alias("page"))


@query("c13_dedupe_chunks", LINES + r", k AS (SELECT *, regexp_replace(lower(trim(chunk)), '\s+', ' ', 'g') AS p FROM l) SELECT doc_id, min(ord) AS ord FROM k WHERE p <> '' GROUP BY doc_id, p")
def _(spark, d):
    return C.dedupe_chunks(lines(spark, d)).select("doc_id", "ord")


@query("c14_semantic_groups", """WITH p AS (SELECT vec_id, label, embedding AS e, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings),
q AS (SELECT vec_id, label, 1 - list_cosine_similarity(CAST(b AS DOUBLE[]), CAST(e AS DOUBLE[])) AS distance FROM p),
r AS (SELECT *, CASE WHEN distance > avg(distance) OVER w + 1.5 * coalesce(stddev_pop(distance) OVER w, 0) THEN 1 ELSE 0 END AS cut FROM q WINDOW w AS (PARTITION BY label))
SELECT vec_id, label, CAST(sum(cut) OVER (PARTITION BY label ORDER BY vec_id) AS BIGINT) AS part FROM r""")
def _(spark, d):
    e = table(spark, d, "embeddings").select(F.col("label").alias("doc_id"), F.col("vec_id").alias("ord"), F.lit("").alias("sentence"), "embedding")
    return C.semantic_groups(e, shared_folder(spark)).select(F.col("ord").alias("vec_id"), F.col("doc_id").alias("label"), "part")


@query("c15_attach_doc_metadata", LINES + r" SELECT l.doc_id, ord, count(*) OVER (PARTITION BY l.doc_id) AS total_chunks, length(chunk) AS char_count, len(list_filter(regexp_split_to_array(chunk, '\s+'), lambda w: w <> '')) AS word_count, source, lang FROM l JOIN documents d ON l.doc_id = d.doc_id")
def _(spark, d):
    return C.attach_doc_metadata(lines(spark, d), docs(spark, d).drop("title")).drop("chunk")


@query("c16_strip_to_body", r"""WITH t AS (SELECT doc_id, 'My title > Methods' || chr(10) || chr(10) || '## Part' || chr(10) || text AS t FROM documents),
l AS (SELECT doc_id, t, regexp_split_to_array(t, '\r\n|\r|\n') AS l FROM t),
b AS (SELECT doc_id, t, l, list_position(list_transform(list_transform(l, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda s: NOT (s = '' OR regexp_matches(s, '^#{1,6}\s+\S') OR s = 'My title' OR starts_with(s, 'My title >')
  OR (contains(s, ' > ') AND length(s) < 200 AND NOT regexp_matches(s, '[.!?:]\s*$')))), true) AS k FROM l)
SELECT doc_id, md5(CASE WHEN k > 0 THEN regexp_replace(array_to_string(l[k:], chr(10)), '^\s+|\s+$', '', 'g') ELSE regexp_replace(t, '^\s+', '') END) AS body FROM b""")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.md5(C.strip_to_body(F.concat(F.lit("My title > Methods\n\n## Part\n"), "text"), F.lit("My title"))).alias("body"))


@query("c17_validate_offsets", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'no-offset' WHEN 2 THEN 'out-of-bounds' ELSE 'mismatch' END AS status, CASE WHEN doc_id % 4 = 3 THEN 0 END AS first_diff FROM documents")
def _(spark, d):
    x = docs(spark, d)
    k, n = F.col("doc_id") % 4, F.least(F.length("text"), F.lit(20))
    chunk = F.when(k == 3, F.concat(F.lit("\x01"), F.substring("text", 2, 19))).otherwise(F.substring("text", 1, 20))
    rows = x.select("doc_id", chunk.alias("chunk"), F.when(k != 1, F.lit(0)).alias("start"), F.when(k == 2, F.length("text") + 5).otherwise(n).alias("end"))
    return C.validate_offsets(rows, x).select("doc_id", "status", "first_diff")


@query("c18_word_chunks", rf"WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents), c AS (SELECT doc_id, unnest(range(0, len(w), 250)) AS i, w FROM w) SELECT doc_id, CAST(i / 250 AS INT) AS ord, md5(array_to_string(w[i + 1:i + 250], ' ')) AS chunk FROM c")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(C.word_chunks(F.col("text"), 250)).alias("ord", "chunk")).select("doc_id", "ord", F.md5("chunk").alias("chunk"))


@query("c19_first_n_chunks", rf"SELECT doc_id, least(3, (len({_WORDS}) + 249) // 250) AS n FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.size(F.slice(C.word_chunks(F.col("text"), 250), 1, 3)).cast("long").alias("n"))


@query("c20_drop_noise_items", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0")
def _(spark, d):
    k = F.col("doc_id") % 3
    rows = docs(spark, d).select("doc_id", F.when(k == 0, F.array(F.lit("footnote"), F.lit("reference"))).when(k == 1, F.array(F.lit("footnote"), F.lit("text"))).otherwise(F.array().cast("array<string>")).alias("labels"))
    return C.drop_noise_items(rows).select("doc_id")


@query("c21_extract_title", LINES + ", i AS (SELECT l.doc_id, ord, chunk, source FROM l JOIN documents d ON l.doc_id = d.doc_id) SELECT doc_id, CASE WHEN max(ord) >= 2 THEN trim(arg_min(chunk, CASE WHEN ord = 2 THEN 0 ELSE 1 END)) WHEN max(ord) >= 1 THEN trim(arg_min(chunk, CASE WHEN ord = 1 THEN 0 ELSE 1 END)) ELSE any_value(source) END AS title FROM i GROUP BY doc_id")
def _(spark, d):
    label = F.when(F.col("ord") == 2, "title").when(F.col("ord") == 1, "section_header").otherwise("text")
    items = lines(spark, d).join(docs(spark, d).select("doc_id", F.col("source").alias("stem")), "doc_id").select("doc_id", "ord", label.alias("label"), F.col("chunk").alias("text"), "stem")
    return C.extract_title(items)


@query("c22_match_title_to_works")
def _(spark, d):
    """Titles of pages as they might be quoted, a third each cut, misspelt and both, to the pages; even ones by a DOI."""
    pages = table(spark, d, "pages").select("page_id", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"))
    k = F.col("page_id") % 3
    cut = F.when(k != 1, F.expr("substring(title, 4)")).otherwise(F.col("title"))
    quoted = F.when(k != 0, F.regexp_replace(cut, "[aou](.{6})", "$1e")).otherwise(cut)
    titles = pages.select(F.col("page_id").alias("doc_id"), quoted.alias("title"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("10.1/"), "page_id")).alias("doi"))
    works = pages.select(F.col("page_id").alias("work_id"), F.concat(F.lit("10.1/"), "page_id").alias("doi"), "title")
    return C.match_title_to_works(titles, works, shared=shared_folder(spark))


@query("c03_extract_toc", r"SELECT page_id, len(regexp_extract_all(html, '(?is)<h1[^>]*>')) AS n FROM pages WHERE contains(html, '<h1')")
def _(spark, d):
    pages = table(spark, d, "pages").filter(F.contains("html", F.lit("<h1"))).select("page_id", F.regexp_replace("html", r"(?i)(</?)h1", "$1h2").alias("html"))
    return C.extract_toc(pages, "page_id").groupBy("page_id").agg(F.count("*").alias("n"))


@query("c01_jats_sections")
def _(spark, d):
    s = F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("<sec><title>S</title><p>"), F.regexp_replace(x, "[<>&]", " "), F.lit("</p></sec>")))
    xml = F.concat(F.lit("<article><body>"), F.array_join(s, ""), F.lit("</body></article>"))
    return C.jats_sections(docs(spark, d).select(F.col("doc_id").cast("string").alias("pmcid"), xml.alias("xml")))


@query("c04_render_paper_html", LINES + """ SELECT doc_id, md5(string_agg('<section id="s-' || ord || '"><h2>T</h2>' || chunk || '</section>', chr(10) ORDER BY ord)) AS html FROM l GROUP BY doc_id""")
def _(spark, d):
    s = lines(spark, d).select("doc_id", "ord", F.lit("T").alias("title"), F.col("chunk").alias("html"))
    return C.render_paper_html(s, "doc_id").select("doc_id", F.md5("html").alias("html"))


# --- incremental corpus ---------------------------------------------------------------

CATALOG = """WITH files AS (SELECT 'f' || doc_id AS filename, sha256(text)[1:24] AS paper_id FROM documents WHERE doc_id % 10 <> 9),
catalog AS (SELECT CASE WHEN doc_id % 10 = 1 THEN 'stale' || doc_id ELSE sha256(text)[1:24] END AS paper_id, 'f' || doc_id AS filename, text[1:40] AS title,
  '10.1/' || (doc_id % 700) AS doi, CASE WHEN doc_id % 10 = 2 THEN 'error' ELSE 'indexed' END AS status, doc_id AS n, doc_id AS indexed_at FROM documents WHERE doc_id % 10 <> 3)
"""


def files(spark, d):
    x = table(spark, d, "documents").filter("doc_id % 10 <> 9")
    return x.select(F.concat(F.lit("f"), "doc_id").alias("filename"), corpus.content_id(F.col("text")).alias("paper_id"))


def catalog(spark, d):
    x = table(spark, d, "documents").filter("doc_id % 10 <> 3")
    k = F.col("doc_id") % 10
    return x.select(
        F.when(k == 1, F.concat(F.lit("stale"), "doc_id")).otherwise(corpus.content_id(F.col("text"))).alias("paper_id"),
        F.concat(F.lit("f"), "doc_id").alias("filename"), F.substring("text", 1, 40).alias("title"), F.concat(F.lit("10.1/"), (F.col("doc_id") % 700).cast("string")).alias("doi"),
        F.when(k == 2, "error").otherwise("indexed").alias("status"), F.col("doc_id").alias("n"), F.col("doc_id").alias("indexed_at"),
    )


@query("i01_content_id", "SELECT doc_id, sha256(text)[1:24] AS id FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", corpus.content_id(F.col("text")).alias("id"))


@query("i02_plan_increment", CATALOG + "SELECT coalesce(f.filename, c.filename) AS filename, f.paper_id, CASE WHEN f.paper_id <> c.paper_id THEN c.paper_id END AS stale_id, CASE WHEN f.paper_id IS NULL THEN 'missing' WHEN c.paper_id IS NULL THEN 'index' WHEN f.paper_id = c.paper_id AND status = 'indexed' THEN 'skip' WHEN f.paper_id = c.paper_id THEN 'index' ELSE 'replace' END AS action FROM files f FULL JOIN catalog c ON f.filename = c.filename")
def _(spark, d):
    return corpus.plan_increment(files(spark, d), catalog(spark, d))


@query("i03_apply_increment", CATALOG + "SELECT filename, CASE WHEN n % 2 = 0 THEN -1 ELSE n END AS n FROM catalog")
def _(spark, d):
    c = catalog(spark, d).select("filename", "n")
    return corpus.apply_increment(c, c.filter("n % 2 = 0").withColumn("n", F.lit(-1).cast("long")), "filename")


@query("i05_detect_doi_collisions", CATALOG + ", k AS (SELECT doi, paper_id, first_value(paper_id) OVER (PARTITION BY doi ORDER BY indexed_at, paper_id) AS f FROM catalog) SELECT doi, paper_id AS paper_new, f AS paper_existing FROM k WHERE paper_id <> f")
def _(spark, d):
    return corpus.detect_doi_collisions(catalog(spark, d))


@query("i06_delete_papers", CATALOG + "SELECT filename FROM catalog WHERE paper_id NOT IN (SELECT paper_id FROM catalog WHERE n % 5 = 0)")
def _(spark, d):
    c = catalog(spark, d)
    return corpus.delete_papers({"catalog": c}, c.filter("n % 5 = 0").select("paper_id"))["catalog"].select("filename")


@query("i07_find_papers", CATALOG + "SELECT filename FROM catalog WHERE filename LIKE '%12%' OR title LIKE '%12%'")
def _(spark, d):
    return corpus.find_papers(catalog(spark, d), "12").select("filename")


@query("i08_catalog_status", CATALOG + "SELECT status, count(*) AS n FROM catalog GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM catalog")
def _(spark, d):
    return corpus.catalog_status(catalog(spark, d))


@query("i09_replace_sources", "SELECT source, count(*) AS n, CAST(sum(CASE WHEN source IN ('src0', 'src1') THEN 0 ELSE 1 END) AS BIGINT) AS old FROM (SELECT source FROM documents WHERE source NOT IN ('src0', 'src1') UNION ALL SELECT DISTINCT source FROM documents WHERE source IN ('src0', 'src1')) GROUP BY 1")
def _(spark, d):
    x = docs(spark, d).select("source", F.lit(1).alias("old"))
    new = x.filter("source IN ('src0', 'src1')").distinct().withColumn("old", F.lit(0))
    return corpus.replace_sources(x, new).groupBy("source").agg(F.count("*").alias("n"), F.sum("old").alias("old"))


@query("i10_prune_orphan_parents", LINES + " SELECT DISTINCT doc_id FROM l WHERE ord = 3")
def _(spark, d):
    parents = docs(spark, d).select(F.col("doc_id").alias("parent_id"))
    kids = lines(spark, d).filter("ord = 3").select(F.col("doc_id").alias("parent_id"))
    return corpus.prune_orphan_parents(parents, kids).select(F.col("parent_id").alias("doc_id"))


@query("i11_list_indexed_files", "SELECT source, count(*) AS chunk_count, arg_min(lang, doc_id) AS parser FROM documents GROUP BY 1")
def _(spark, d):
    return corpus.list_indexed_files(docs(spark, d).select("source", F.col("doc_id").alias("ord"), F.col("lang").alias("parser")))


@query("i12_delete_source", "SELECT doc_id FROM documents WHERE source <> 'src0'")
def _(spark, d):
    return corpus.delete_source(docs(spark, d), "src0").select("doc_id")


@query("i13_get_parents", "SELECT doc_id AS parent_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def _(spark, d):
    ids = table(spark, d, "labels").filter("quality = 0").select(F.col("doc_id").alias("parent_id"))
    return corpus.get_parents(docs(spark, d).select(F.col("doc_id").alias("parent_id"), "lang"), ids)


@query("c02_jats_metadata", "SELECT CAST(doc_id AS VARCHAR) AS pmcid, 'T' || doc_id AS title, 'Ann ' || lang || ',Bo ' || coalesce(source, 'x') AS authors, 'Journal of ' || lang AS journal, CAST(1990 + doc_id % 30 AS VARCHAR) AS year, '10.1/' || doc_id AS doi FROM documents")
def _(spark, d):
    k, lang, source = F.col("doc_id").cast("string"), F.col("lang"), F.coalesce("source", F.lit("x"))
    person = lambda given, name: F.concat(F.lit('<contrib contrib-type="author"><name><surname>'), name, F.lit("</surname><given-names>"), F.lit(given), F.lit("</given-names></name></contrib>"))
    front = F.concat(F.lit("<journal-title>Journal of "), lang, F.lit('</journal-title><article-id pub-id-type="doi">10.1/'), k, F.lit("</article-id><article-title>T"), k, F.lit("</article-title>"), person("Ann", lang), person("Bo", source), F.lit("<pub-date><year>"), (1990 + F.col("doc_id") % 30).cast("string"), F.lit("</year></pub-date>"))
    body = F.concat(F.lit("<body><sec><p>"), F.regexp_replace("text", r"[<>&\x00-\x08\x0B\x0C\x0E-\x1F]", " "), F.lit("</p></sec></body>"))
    xml = F.concat(F.lit("<article><front>"), front, F.lit("</front>"), body, F.lit("</article>"))
    return C.jats_metadata(docs(spark, d).select(k.alias("pmcid"), xml.alias("xml"))).withColumn("authors", F.array_join("authors", ","))


@query("c14_semantic_split")
def _(spark, d):
    x = sentences(docs(spark, d), "text", "doc_id").select("doc_id", "ord", "sentence")
    return C.semantic_split(R.embed(x, R.hashing_embedder, "sentence"), shared_folder(spark))


def corpus_docs(spark, d):
    return docs(spark, d).select("doc_id", F.concat(F.lit("f"), "doc_id").alias("source"), "title", "lang", "text")


@query("c23_chunk_corpus")
def _(spark, d):
    return C.chunks_of(C.chunk_corpus(corpus_docs(spark, d)))


@query("c23_chunk_failures", r"SELECT doc_id, 'f' || doc_id AS source, 'no text' AS error FROM documents WHERE doc_id % 5 = 0 OR NOT regexp_matches(coalesce(text, ''), '\S')")
def _(spark, d):
    x = corpus_docs(spark, d).withColumn("text", F.when(F.col("doc_id") % 5 != 0, F.col("text")))
    return C.failures_of(C.chunk_corpus(x))


@query("c24_kb_chunk_corpus")
def _(spark, d):
    x = lines(spark, d).withColumn("headings", F.array(F.lit("Paper"), F.lit("Part")))
    x = x.withColumn("labels", F.when(F.col("ord") % 7 == 6, F.array(F.lit("footnote"))).otherwise(F.array(F.lit("text")))).withColumn("page", (F.col("ord") / 40).cast("int") + 1)
    return C.kb_chunk_corpus(x, docs(spark, d))[1]


@query("i04_record_failures", CATALOG + """, f AS (SELECT DISTINCT paper_id, filename FROM catalog WHERE n % 7 = 0)
SELECT filename, status FROM catalog WHERE paper_id NOT IN (SELECT paper_id FROM f) UNION ALL SELECT filename, 'error' FROM f""")
def _(spark, d):
    c = catalog(spark, d)
    return corpus.record_failures(c, c.filter("n % 7 = 0").select("paper_id", "filename", F.lit("boom").alias("error")), 5.0).select("filename", "status")


@query("i12_reset_corpus", "SELECT doc_id, lang FROM documents WHERE lang <> 'en' OR lang IS NULL")
def _(spark, d):
    x = docs(spark, d).select("doc_id", "lang", F.col("lang").alias("corpus_id"))
    return corpus.reset_corpus({"chunks": x}, "en")["chunks"].select("doc_id", "lang")


@query("a01_split_sentences")
def _(spark, d):
    return sentences(docs(spark, d), "text", "doc_id")
