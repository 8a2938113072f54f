"""Retrieval and citation queries: benchmark items as questions, documents as chunks, conversations as answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from litmine.functions import scalars as S
from litmine.operators import citations as A
from litmine.operators import retrieval as R
from litmine.operators import search_index as SI
from litmine.plans.registry import query, shared_folder, table

_TOKENS = "list_transform(list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: CASE WHEN length(w) > 4 THEN regexp_replace(w, '(?:ing|ed|es|s)$', '') ELSE w END)"


def questions(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def chunks(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source"), F.col("text"))


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def asked(spark, d):
    return table(spark, d, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("question_id"), "embedding")


DENSE = "WITH q AS (SELECT vec_id AS question_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT question_id, vec_id AS chunk_id, list_cosine_similarity(e, CAST(embedding AS DOUBLE[])) AS score FROM q, embeddings), k AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 12) DESC, chunk_id) AS rank FROM s)"
BM25 = f"""WITH q AS (SELECT item_id AS question_id, unnest(list_distinct({_TOKENS.format('text')})) AS term FROM benchmark),
w AS (SELECT doc_id AS chunk_id, {_TOKENS.format('text')} AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM w),
tf AS (SELECT chunk_id, term, dl, count(*) AS tf FROM (SELECT chunk_id, len(w) AS dl, unnest(w) AS term FROM w) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT question_id, chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN df USING (term) JOIN tf USING (term), st GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s)
"""


@query("r01_dense_topk", DENSE + " SELECT question_id, chunk_id, round(score, 6) AS score FROM k WHERE rank <= 60")
def _(spark, d):
    return R.dense_topk(asked(spark, d), vectors(spark, d)).select("question_id", "chunk_id", F.round("score", 6).alias("score"))


@query("r02_l2_normalize", "SELECT vec_id, 1.0::DOUBLE AS norm FROM embeddings")
def _(spark, d):
    u = S.l2_normalize(F.transform("embedding", lambda x: x * 3))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(u, F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm"))


@query("r03_truncate_dim", "SELECT vec_id, len(embedding[1:16]) AS n, round(list_sum(embedding[1:16]), 4) AS s FROM embeddings")
def _(spark, d):
    v = R.truncate_dim(F.col("embedding"), 16)
    return table(spark, d, "embeddings").select("vec_id", F.size(v).cast("long").alias("n"), F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 4).alias("s"))


@query("r04_bm25_index", BM25 + "SELECT term, df FROM df")
def _(spark, d):
    return R.bm25_index(chunks(spark, d), R.light_stem)[1]


@query("r05_bm25_topk", BM25 + "SELECT question_id, chunk_id, round(score, 6) AS score FROM k WHERE rank <= 60")
def _(spark, d):
    return R.bm25_topk(questions(spark, d), chunks(spark, d), stemmer=R.light_stem, shared=shared_folder(spark)).select("question_id", "chunk_id", F.round("score", 6).alias("score"))


def stored(spark, d, stemmer):
    """An index of all documents in three steps: as they are, those of two sources again as other texts, then as they are again but for one source."""
    index = SI.Bm25Index(spark, shared_folder(spark), stemmer, buckets=8, id_type="long")
    rows = chunks(spark, d).withColumn("source", F.coalesce("source", F.lit("")))
    index.add(rows, 0)
    some = rows.filter("source IN ('src1', 'src2')")
    index.add(some.withColumn("text", F.concat(F.lit("other words "), "text")), 1)
    index.add(some, 2)
    index.remove(rows.filter("source = 'src3'").select("source").distinct(), 3)
    return index


STORED = BM25.replace("FROM documents", "FROM documents WHERE source IS NULL OR source <> 'src3'")


@query("r04_stored_index", STORED + "SELECT term, df FROM df")
def _(spark, d):
    return stored(spark, d, R.light_stem).terms()


@query("r05_stored_topk", STORED + "SELECT question_id, chunk_id, round(score, 6) AS score FROM k WHERE rank <= 60")
def _(spark, d):
    """BM25 from the stored postings; the stems are the simple ones that SQL can say."""
    found = stored(spark, d, R.light_stem).topk(questions(spark, d))
    return found.select("question_id", "chunk_id", F.round("score", 6).alias("score"))


@query("r05_stemmed_topk")
def _(spark, d):
    return R.bm25_topk(questions(spark, d), chunks(spark, d), shared=shared_folder(spark))


@query("r06_rrf_fuse", BM25 + ", o AS (SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY chunk_id) AS rank FROM k WHERE rank <= 60), f AS (SELECT question_id, chunk_id, sum(1 / (60 + rank)) AS score FROM (SELECT question_id, chunk_id, rank FROM k WHERE rank <= 60 UNION ALL SELECT * FROM o) GROUP BY ALL) SELECT question_id, chunk_id, round(score, 9) AS score FROM f QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY round(score, 12) DESC, chunk_id) <= 60")
def _(spark, d):
    s = R.bm25_topk(questions(spark, d), chunks(spark, d), stemmer=R.light_stem, shared=shared_folder(spark)).select("question_id", "chunk_id", "rank")
    o = s.selectExpr("question_id", "chunk_id", "row_number() OVER (PARTITION BY question_id ORDER BY chunk_id) AS rank")
    return R.rrf_fuse(s, o).select("question_id", "chunk_id", F.round("score", 9).alias("score"))


@query("r07_source_filter", "SELECT doc_id AS chunk_id FROM documents WHERE source IN ('src1', 'src2')")
def _(spark, d):
    return R.source_filter(chunks(spark, d), ["src1", "src2"]).select("chunk_id")


@query("r08_display_score", BM25 + "SELECT question_id, chunk_id, CAST(round_even(score / max(score) OVER (PARTITION BY question_id) * 100, 0) AS INT) AS shown FROM k WHERE rank <= 60")
def _(spark, d):
    s = R.bm25_topk(questions(spark, d), chunks(spark, d), stemmer=R.light_stem, shared=shared_folder(spark))
    return s.select("question_id", "chunk_id", R.display_score(F.col("score")).alias("shown"))


RERANK = BM25 + f", c AS (SELECT question_id, chunk_id, rank, len(list_intersect(list_distinct({_TOKENS.format('b.text')}), {_TOKENS.format('d.text')})) / len(list_distinct({_TOKENS.format('b.text')})) AS raw FROM k JOIN benchmark b ON item_id = question_id JOIN documents d ON doc_id = chunk_id WHERE rank <= 40)"


def reranked(spark, d):
    s = R.bm25_topk(questions(spark, d), chunks(spark, d), stemmer=R.light_stem, shared=shared_folder(spark)).drop("score")
    return R.rerank(s.join(questions(spark, d), "question_id").join(chunks(spark, d).select("chunk_id", "text"), "chunk_id"))


@query("r09_rerank", RERANK + " SELECT question_id, chunk_id, round(raw, 6) AS raw FROM c")
def _(spark, d):
    return reranked(spark, d).select("question_id", "chunk_id", F.round("raw", 6).alias("raw"))


@query("r10_rerank_threshold", RERANK + ", m AS (SELECT *, CASE WHEN max(raw) OVER w - min(raw) OVER w < 1e-9 THEN 0.5 ELSE (raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w) END AS scaled FROM c WINDOW w AS (PARTITION BY question_id)) SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY raw DESC, rank) AS rank FROM m WHERE scaled >= 0.1")
def _(spark, d):
    return R.rerank_threshold(reranked(spark, d)).select("question_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


@query("r11_resolve_parents", BM25 + ", p AS (SELECT *, chunk_id % 100 AS parent, row_number() OVER (PARTITION BY question_id, chunk_id % 100 ORDER BY rank) AS n FROM k WHERE rank <= 60) SELECT question_id, chunk_id FROM p WHERE n = 1 QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY rank) <= 30")
def _(spark, d):
    hits = R.bm25_topk(questions(spark, d), chunks(spark, d), stemmer=R.light_stem, shared=shared_folder(spark)).withColumn("parent_id", (F.col("chunk_id") % 100).cast("string")).withColumn("text", F.lit("x"))
    parents = table(spark, d, "documents").filter("doc_id < 100").select(F.col("doc_id").cast("string").alias("parent_id"), F.col("text").alias("body"))
    return R.resolve_parents(hits, parents).select("question_id", "chunk_id")


def blocks(spark, d):
    s = R.bm25_topk(questions(spark, d), chunks(spark, d), k=20, stemmer=R.light_stem, shared=shared_folder(spark))
    return s.join(chunks(spark, d).select("chunk_id", "text"), "chunk_id").select("question_id", "chunk_id", "rank", "text")


@query("r12_diversify")
def _(spark, d):
    return R.diversify(blocks(spark, d)).select("question_id", "chunk_id", "rank")


@query("r13_context_budget", "WITH RECURSIVE " + BM25[5:] + """, b AS (SELECT question_id, chunk_id, rank, length(text) AS n FROM k JOIN documents ON doc_id = chunk_id WHERE rank <= 20),
g AS (SELECT question_id, chunk_id, rank, n AS used, true AS keep FROM b WHERE rank = 1 UNION ALL
SELECT b.question_id, b.chunk_id, b.rank, CASE WHEN g.used + b.n <= 24768 THEN g.used + b.n ELSE g.used END, g.used + b.n <= 24768 FROM g JOIN b ON b.question_id = g.question_id AND b.rank = g.rank + 1)
SELECT question_id, chunk_id, CASE WHEN keep THEN 'full' ELSE 'omitted_budget' END AS context_status FROM g""")
def _(spark, d):
    return R.context_budget(blocks(spark, d)).select("question_id", "chunk_id", "context_status")


@query("r14_positional_ids", BM25 + "SELECT question_id, chunk_id, 'c' || rank AS cid FROM k WHERE rank <= 20")
def _(spark, d):
    return R.positional_ids(blocks(spark, d)).select("question_id", "chunk_id", "cid")


@query("r15_context_block", "SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN 'TABLE ' ELSE '' END || 'c' || doc_id || ' | ' || source || ' | ' || lang || chr(10) || text) AS block FROM documents")
def _(spark, d):
    b = R.context_block(F.concat(F.lit("c"), "doc_id"), F.lit(""), F.col("source"), F.col("lang"), F.lit(None).cast("string"), F.col("text"), F.col("doc_id") % 2 == 0)
    return table(spark, d, "documents").select("doc_id", F.md5(b).alias("block"))


@query("r16_source_records", r"SELECT conv_id AS question_id, 'c' || turn AS chunk_id, md5(regexp_replace('Body.' || chr(10) || text, '\s+$', '')) AS chunk_text, turn AS page FROM conversations")
def _(spark, d):
    b = sources(spark, d).select("question_id", F.col("chunk_id").alias("cid"), "source", "section", F.lit(1.0).alias("score"), F.concat(F.lit("Name > Part\n## Part\nBody.\n"), "chunk_text").alias("text"), F.lit("Name").alias("title"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.col("page"), F.lit("full").alias("context_status"))
    return R.source_records(b).select("question_id", "record.chunk_id", F.md5("record.chunk_text").alias("chunk_text"), F.col("record.page").alias("page"))


@query("u03_embed")
def _(spark, d):
    e = R.embed(table(spark, d, "documents").select("doc_id", "text"), R.hashing_embedder)
    return e.select("doc_id", F.size("embedding").alias("n"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x), 4).alias("norm"))


@query(
    "r17_build_messages",
    r"""WITH h AS (SELECT *, CASE WHEN turn % 2 = 0 THEN 'assistant' ELSE 'user' END AS who, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations),
t AS (SELECT conv_id, who || ':' || CASE WHEN who = 'assistant' THEN regexp_replace(text || ' [c3]', '\[\s*[Cc]?\s*([0-9]+)\s*\]', '[†]', 'g') ELSE text || ' [c3]' END AS m, turn FROM h WHERE n <= 10),
p AS (SELECT conv_id, string_agg(m, '|' ORDER BY turn) AS m FROM t GROUP BY 1)
SELECT conv_id AS question_id, CASE WHEN c > 1 THEN md5('system:You answer.|' || m || '|user:Context:' || chr(10) || 'ctx' || conv_id || chr(10) || chr(10) || 'Question: why?') END AS messages, CASE WHEN c = 1 THEN 'No relevant passages were found for this question.' END AS answer
FROM p JOIN (SELECT conv_id, count(*) AS c FROM conversations GROUP BY 1) USING (conv_id)""",
)
def _(spark, d):
    """Conversations as histories, their even turns the assistant's; those of one turn have no context."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("question_id"), "turn", F.when(F.col("turn") % 2 == 0, "assistant").otherwise("user").alias("role"), F.concat("text", F.lit(" [c3]")).alias("text"))
    turns = c.groupBy("question_id").agg(F.count("*").alias("n"))
    q = turns.select("question_id", F.lit("why?").alias("question"))
    context = turns.filter("n > 1").select("question_id", F.concat(F.lit("ctx"), "question_id").alias("context"))
    m = R.build_messages(q, context, c, "You answer.")
    said = F.array_join(F.transform("messages", lambda x: F.concat_ws(":", x["role"], x["content"])), "|")
    return m.select("question_id", F.md5(said).alias("messages"), "answer")


@query("r18_truncate_tokens", "SELECT doc_id, md5(array_to_string(string_split(text, ' ')[1:50], ' ')) AS words, md5(text[1:200]) AS chars FROM documents")
def _(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.md5(R.truncate_tokens(t, 50)).alias("words"), F.md5(R.truncate_tokens(t, 50, 4)).alias("chars"))


@query("r19_hybrid_search")
def _(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    c = chunks(spark, d).join(e, "chunk_id").withColumn("parent_id", F.lit(None).cast("string"))
    q = questions(spark, d).join(e.withColumnRenamed("chunk_id", "question_id"), "question_id")
    parents = spark.createDataFrame([], "parent_id string, body string")
    return R.hybrid_search(q, c, parents, shared=shared_folder(spark)).select("question_id", "chunk_id", "cid", "context_status")


# --- citations -------------------------------------------------------------------------


def answers(spark, d):
    c = table(spark, d, "conversations").filter("role = 'assistant'")
    return c.groupBy(F.col("conv_id").alias("question_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("answer"))


def sources(spark, d):
    c = table(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("question_id"), F.concat(F.lit("c"), "turn").alias("chunk_id"), F.col("text").alias("chunk_text"), F.lit("Methods").alias("section"), F.col("role").alias("doc_title"), F.col("role").alias("source"), F.col("turn").cast("int").alias("page"))


@query("a05_verbatim_match")
def _(spark, d):
    return A.verbatim_match(A.sentences(answers(spark, d), "answer", "question_id"), sources(spark, d), shared=shared_folder(spark))


@query("a08_attribute_sentences")
def _(spark, d):
    return A.attribute_sentences(answers(spark, d), sources(spark, d), shared=shared_folder(spark)).select("question_id", "ord", "chunk_id", "score")


@query("a09_best_sentence")
def _(spark, d):
    claims = sources(spark, d).select("question_id", "chunk_id", F.substring("chunk_text", 1, 80).alias("claim"))
    return A.best_sentence(claims, sources(spark, d))


@query("a10_top_chunks_for_answer", "SELECT conv_id AS question_id, 'c' || turn AS chunk_id FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'assistant') QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY length('c' || turn), 'c' || turn) <= 2")
def _(spark, d):
    return A.top_chunks_for_answer(answers(spark, d), sources(spark, d), scorer=None).select("question_id", "chunk_id")


@query("a11_reattribute")
def _(spark, d):
    return A.reattribute(answers(spark, d), sources(spark, d), sources(spark, d).select("question_id", "chunk_id"))


@query("a12_inject_markers", "WITH a AS (SELECT conv_id AS question_id, string_agg(text, chr(10) ORDER BY turn) AS answer FROM conversations WHERE role = 'assistant' GROUP BY 1) SELECT question_id, md5(rtrim(answer[1:10], ' ' || chr(10)) || ' [c1][c2]' || answer[length(rtrim(answer[1:10], ' ' || chr(10))) + 1:] || ' [c10]') AS answer FROM a WHERE length(rtrim(answer, ' ' || chr(10))) = length(answer)")
def _(spark, d):
    a = answers(spark, d).filter(~F.col("answer").rlike(r"\s$"))
    ends = F.array(*[F.struct(F.lit(c).alias("chunk_id"), e.alias("end")) for c, e in (("c2", F.lit(10)), ("c1", F.lit(10)), ("c10", F.length("answer")))])
    marks = a.select("question_id", F.explode(ends).alias("m")).select("question_id", "m.*")
    return A.inject_markers(a, marks).select("question_id", F.md5("answer").alias("answer"))


def cited(spark, d):
    return answers(spark, d).withColumn("answer", F.concat("answer", F.lit(" [c2] [c1] [2]")))


@query("a13_references_block", "SELECT conv_id AS question_id, string_agg('[c' || turn || '] Methods — ' || role || ' (p. ' || turn || ')', chr(10) ORDER BY turn DESC) AS \"references\" FROM conversations WHERE turn IN (1, 2) AND conv_id IN (SELECT conv_id FROM conversations WHERE role = 'assistant') GROUP BY 1")
def _(spark, d):
    return A.references_block(cited(spark, d), sources(spark, d))


@query("a14_paper_references")
def _(spark, d):
    return A.paper_references(cited(spark, d), sources(spark, d).withColumn("doi", F.lit("10.1/x")))


@query("a15_collapse_references", r"SELECT conv_id, turn, CASE WHEN h <> '' THEN h || repeat(chr(10), 2) || '---' || repeat(chr(10), 2) ELSE '' END || '**References**' || chr(10) || 'References:' || chr(10) || 'second' AS answer FROM (SELECT conv_id, turn, regexp_replace(text, '\s+$', '') AS h FROM conversations)")
def _(spark, d):
    shown = F.concat("text", F.lit("\n---\n## References\nfirst\n**References**\n\nReferences:\nsecond"))
    return table(spark, d, "conversations").select("conv_id", "turn", A.collapse_references(shown).alias("answer"))


@query("a16_quote_matches_chunk", r"SELECT doc_id, doc_id % 2 = 0 AND regexp_matches(text[1:100], '\S') AS verified FROM documents")
def _(spark, d):
    quote = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" "), F.regexp_replace(F.substring("text", 1, 100), " ", "  "))).otherwise("0123456789 #### 0123456789 ####")
    return A.quote_matches_chunk(table(spark, d, "documents").select("doc_id", quote.alias("quote"), F.col("text").alias("chunk_text"))).select("doc_id", "verified")


@query("a17_verify_citations", "SELECT conv_id AS question_id, 'c' || turn AS chunk_id FROM conversations WHERE regexp_matches(text, '\\S')")
def _(spark, d):
    s = sources(spark, d)
    c = s.select("question_id", "chunk_id", F.substring("chunk_text", 1, 60).alias("quote"), F.lit(1).alias("ord"))
    return A.verify_citations(c.unionByName(c.withColumn("ord", F.lit(2))), s).select("question_id", "chunk_id")


@query("a18_citation_completeness", "SELECT conv_id, turn, 2 AS total, 1 AS verified, 0.5::DOUBLE AS rate FROM conversations")
def _(spark, d):
    r = A.citation_completeness(F.concat("text", F.lit(" [c1] [C 2] [1]")), F.array(F.lit("c2")))
    return table(spark, d, "conversations").select("conv_id", "turn", r.alias("r")).select("conv_id", "turn", "r.total", "r.verified", "r.rate")


@query("a19_validate_selected_ids", "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'c1,c2' ELSE '' END AS ids, CASE turn % 3 WHEN 1 THEN 'invalid_json' WHEN 2 THEN 'missing_chunk_ids' END AS error FROM conversations")
def _(spark, d):
    k = F.col("turn") % 3
    raw = F.when(k == 0, '{"chunk_ids": ["c1", "c9", "c2", "c1"]}').when(k == 1, "{chunk").otherwise('{"other": 1}')
    return table(spark, d, "conversations").select("conv_id", "turn", A.validate_selected_ids(raw, F.array(F.lit("c1"), F.lit("c2"))).alias("v")).select("conv_id", "turn", F.array_join("v.ids", ",").alias("ids"), "v.error")


@query("a20_locate_quotes")
def _(spark, d):
    quote = F.concat(F.upper(F.substring("text", 11, 100)), F.when(F.col("doc_id") % 3 == 0, " and more").otherwise(""))
    return A.locate_quotes(table(spark, d, "documents").select("doc_id", "text", quote.alias("quote"))).select("doc_id", "at.*")


@query("a21_sentence_start", r"SELECT doc_id, length(regexp_extract(text[1:200], '(?s)^(.*(?:[.!?][ \n]|\n\s*\n))', 1)) AS start FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", A.sentence_start(F.col("text"), F.lit(200)).alias("start"))
