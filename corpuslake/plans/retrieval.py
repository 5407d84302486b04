"""Queries over retrieval, grounding and evaluation. Questions are the table benchmark, texts the table documents, vectors the table embeddings; a
question's vector is that of its number."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as X
from ..operators import evaluation as E
from ..operators import lexical as L
from ..operators import retrieval as K
from ..operators import scorers as S
from ..operators import vectors as V
from ..sources.tables import read_table as T
from .registry import query
from .shared import fingerprint, stored

STOP = "(" + ", ".join(f"'{w}'" for w in rules.STOP_WORDS) + ")"
WORDS = lambda c: f"list_filter(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}\\p{{M}}_]{{2,}}'), lambda x: x not in {STOP})"
ALL_WORDS = lambda c: f"list_distinct(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+'))"
INDEX_SQL = f"idx as (select doc_id, term, count(*) as tf from (select doc_id, unnest({WORDS("concat_ws(' ', source, lang, text)")}) as term from documents) group by all), asked as (select item_id, term, count(*) as qtf from (select item_id, unnest({WORDS('text')}) as term from benchmark) group by all)"
BM25_SQL = f"""{INDEX_SQL},
dl as (select doc_id, sum(tf) as dl from idx group by 1), tot as (select count(*) as n, avg(dl) as avgdl from dl),
f as (select term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) as raw from idx, tot group by term, n),
idf as (select term, case when raw < 0 then 0.25 * (select avg(raw) from f) else raw end as idf from f),
scored as (select item_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score from asked join idf using (term) join idx using (term) join dl using (doc_id), tot group by all having round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) > 0),
lex as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored qualify rank <= 20)"""
DENSE_SQL = """cosines as (select item_id, e.vec_id as doc_id, round(list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 6) as score from benchmark join embeddings q on q.vec_id = item_id, embeddings e),
dense as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as rank from cosines where score >= 0.1 qualify rank <= 18)"""
FUSED_SQL = "fused as (select coalesce(d.item_id, l.item_id) as item_id, coalesce(d.doc_id, l.doc_id) as doc_id, d.rank as dense_rank, l.rank as lexical_rank, round(least(1.0, (coalesce(1.0 / (60 + d.rank), 0) + coalesce(1.0 / (60 + l.rank), 0)) / (2.0 / 61)), 6) as score from dense d full join lex l on d.item_id = l.item_id and d.doc_id = l.doc_id)"
TOP_SQL = "top as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as rank from fused qualify rank <= 3)"
ALL_SQL = f"with {BM25_SQL}, {DENSE_SQL}, {FUSED_SQL}, {TOP_SQL}"
#: The lowest cosine that counts here: the vectors are random, so few reach the threshold of production.
LEAST = 0.1


def questions(spark, sf):
    return T(spark, sf, "benchmark").select("item_id", "text")


_kept: dict[tuple, L.LexicalIndex] = {}


def kept_index(spark, sf, kind="all", rows=None, group=None):
    """The inverted index over source, language and text of documents (or of rows made of them), written once a session and state of the table's files."""
    state = (spark.sparkContext.applicationId, kind, fingerprint(spark, f"{sf}/documents.parquet"))
    if state not in _kept:
        _kept[state] = L.write_lexical_index(rows if rows is not None else T(spark, sf, "documents"), "doc_id", ["source", "lang", "text"], group)
    return _kept[state]


def lexical(spark, sf):
    return K.top(L.bm25_hits(questions(spark, sf), kept_index(spark, sf), "item_id", "text"), "item_id", "doc_id", K.LEXICAL_K)


def dense(spark, sf):
    vectors = T(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = questions(spark, sf).select("item_id").join(vectors.withColumnRenamed("doc_id", "item_id"), "item_id")
    return V.dense_topk(asked, vectors, "item_id", "doc_id", "embedding", threshold=LEAST)


def fused(spark, sf):
    return K.rrf_fuse(dense(spark, sf), lexical(spark, sf), "item_id", "doc_id")


def reranked(spark, sf):
    return K.top(fused(spark, sf), "item_id", "doc_id", K.RERANK_K)


def hits(spark, sf):
    """The hits with their texts: few, and used several times."""
    return stored(few_hits(spark, sf), "hits")


def few_hits(spark, sf):
    return reranked(spark, sf).select("item_id", "doc_id", "score", "rank").join(T(spark, sf, "documents").select("doc_id", "text", F.col("source").alias("source_name")), "doc_id")


def answers(spark, sf):
    """A question's answer: the first answer of the conversation of its number."""
    said = T(spark, sf, "conversations").where("role = 'assistant'").groupBy(F.col("conv_id").alias("item_id")).agg(F.min_by("text", "turn").alias("answer"))
    return questions(spark, sf).select("item_id").join(said, "item_id")


ANSWERS_SQL = "ans as (select item_id, arg_min(c.text, turn) as answer from benchmark join conversations c on conv_id = item_id where role = 'assistant' group by 1)"


@query("doc_frequency", f"with {INDEX_SQL} select term, count(*) as df, cast(sum(tf) as bigint) as cf from idx group by 1")
def _(spark, sf):
    return kept_index(spark, sf).terms(spark).where(F.col("grp") == L.ALL).select("term", "df", "cf")


@query("inverted_index", f"with {INDEX_SQL} select doc_id, term, tf, cast(sum(tf) over (partition by doc_id) as bigint) as dl from idx")
def _(spark, sf):
    return kept_index(spark, sf).postings(spark).select(F.col("key").alias("doc_id"), "term", "tf", "dl")


@query("bm25_topk", f"with {BM25_SQL} select item_id, doc_id, score, cast(rank as int) as rank from lex")
def _(spark, sf):
    return lexical(spark, sf)


def small_groups(doc_id):
    """Groups of one to three documents."""
    return doc_id - doc_id % (1 + doc_id % 3)


#: Each question looks at the group of the document of its number: in a group of one or two, no word has a BM25 above 0.
OVERLAP_SQL = f"""with {INDEX_SQL}, g as (select doc_id - doc_id % (1 + doc_id % 3) as grp, doc_id, term, tf from idx),
qs as (select item_id, item_id - item_id % (1 + item_id % 3) as grp from benchmark), dl as (select grp, doc_id, sum(tf) as dl from g group by all), tot as (select grp, count(*) as n, avg(dl) as avgdl from dl group by 1),
f as (select grp, term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) as raw from g join tot using (grp) group by grp, term, n), m as (select grp, avg(raw) as mean from f group by 1),
idf as (select grp, term, case when raw < 0 then 0.25 * mean else raw end as idf from f join m using (grp)),
found as (select item_id, doc_id from asked join qs using (item_id) join idf using (grp, term) join g using (grp, term) join dl using (grp, doc_id) join tot using (grp) group by all having round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) > 0),
n as (select item_id, count(*) as n from asked group by 1)
select item_id, doc_id, round(count(*) / any_value(n), 6) as score from asked join qs using (item_id) join g using (grp, term) join n using (item_id) where item_id not in (select item_id from found) group by all"""


@query("overlap_fallback", OVERLAP_SQL)
def _(spark, sf):
    rows = T(spark, sf, "documents").withColumn("grp", small_groups(F.col("doc_id")))
    asked = questions(spark, sf).withColumn("scope", F.array(small_groups(F.col("item_id"))))
    found = L.lexical_hits(asked, kept_index(spark, sf, "small groups", rows, "grp"), "item_id", "text", "scope")
    return found.where(F.col("by") == "overlap").select("item_id", "doc_id", "score")


def scopes(names):
    """Of every three questions, one looks at all groups, one at one group, one at two."""
    first, second = names(F.col("item_id")), names(F.col("item_id") + 1)
    return F.when(F.col("item_id") % 3 == 1, F.array(first)).when(F.col("item_id") % 3 == 2, F.array(first, second))


def status(key):
    return F.when(F.col(key) % 3 == 0, "active").when(F.col(key) % 3 == 1, "repealed")


FILTERED_SQL = DENSE_SQL.replace("embeddings e)", "embeddings e where e.vec_id % 3 <> 1 and (item_id % 3 = 0 or e.label = item_id % 10 or (item_id % 3 = 2 and e.label = (item_id + 1) % 10)))")


def filtered(spark, sf):
    """Questions with their vectors and scopes, and the vectors that are in force, with their label as procedure."""
    vectors = T(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", F.col("label").cast("string").alias("procedure")).withColumn("status", status("doc_id"))
    asked = questions(spark, sf).select("item_id", scopes(lambda i: (i % 10).cast("string")).alias("scope"))
    asked = asked.join(T(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding"), "item_id")
    return asked, V.payload_filter(vectors, status="status")


@query("dense_topk", f"with {FILTERED_SQL} select item_id, doc_id, score, cast(rank as int) as rank from dense")
def _(spark, sf):
    asked, vectors = filtered(spark, sf)
    return V.dense_topk(asked, vectors, "item_id", "doc_id", "embedding", threshold=LEAST, scope="scope", group="procedure")


@query("dense_topk_lsh", None)
def _(spark, sf):
    asked, vectors = filtered(spark, sf)
    files = V.write_vector_index(vectors, "doc_id", "embedding", "procedure")
    found = stored(V.dense_topk_index(spark, asked, files, vectors, "item_id", "doc_id", "embedding", threshold=LEAST, scope="scope"), "hits")
    V.drop_vector_index(spark, files)
    return found


@query("cross_score", "select a.item_id, e.vec_id, round(list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 6) as score from benchmark a join embeddings q on q.vec_id = a.item_id, embeddings e where round(list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 6) >= 0.3")
def _(spark, sf):
    vectors = T(spark, sf, "embeddings").select(F.col("vec_id"), "embedding")
    asked = questions(spark, sf).select("item_id").join(vectors.withColumnRenamed("vec_id", "item_id"), "item_id")
    return V.dense_hits(asked, vectors, "item_id", "vec_id", "embedding", threshold=0.3)


@query("fuse_outer", f"with {BM25_SQL}, {DENSE_SQL} select item_id, doc_id, cast(d.rank as int) as dense_rank, cast(l.rank as int) as lexical_rank from dense d full join lex l using (item_id, doc_id)")
def _(spark, sf):
    return fused(spark, sf).drop("score")


@query("rrf_fuse", f"with {BM25_SQL}, {DENSE_SQL}, {FUSED_SQL} select item_id, doc_id, score from fused")
def _(spark, sf):
    return fused(spark, sf).select("item_id", "doc_id", "score")


@query("weighted_fuse", f"with {BM25_SQL}, {DENSE_SQL}, d as (select *, case when max(score) over (partition by item_id) > 0 then score / max(score) over (partition by item_id) else 0 end as n from dense), l as (select *, case when max(score) over (partition by item_id) > 0 then score / max(score) over (partition by item_id) else 0 end as n from lex) select item_id, doc_id, round(0.65 * coalesce(d.n, 0) + 0.35 * coalesce(l.n, 0) + 1e-9, 6) as score from d full join l using (item_id, doc_id)".replace("0.35", "(1 - 0.65::double)").replace("0.65 *", "0.65::double *"))
def _(spark, sf):
    return K.weighted_fuse(dense(spark, sf), lexical(spark, sf), "item_id", "doc_id")


#: The six best of the fused list, with the share of the question's words that the text has as cross-encoder score, blended in as 0.8 to 0.2.
def blended_sql(fused, words="text"):
    return f"""six as (select item_id, doc_id, score from {fused} qualify row_number() over (partition by item_id order by score desc, doc_id) <= 6),
ce as (select s.*, d.source, d.lang, d.text, coalesce(len(list_intersect(list_distinct({WORDS('b.text')}), list_distinct({WORDS('d.text')}))) / nullif(len(list_distinct({WORDS('b.text')})), 0), 0) as ce from six s join documents d using (doc_id) join benchmark b using (item_id)),
span as (select *, min(ce) over (partition by item_id) as low, max(ce) over (partition by item_id) as high from ce),
best as (select item_id, doc_id, source, lang, text, round(0.8::double * (case when high > low then (ce - low) / (high - low) else 1.0 end) + (1 - 0.8::double) * score + 1e-9, 6) as blended from span),
three as (select *, row_number() over (partition by item_id order by blended desc, doc_id) as rank from best qualify rank <= 3)"""


@query("rerank", f"with {BM25_SQL}, {DENSE_SQL}, {FUSED_SQL}, {blended_sql('fused')} select item_id, doc_id, blended as score, cast(rank as int) as rank from three")
def _(spark, sf):
    six = K.top(fused(spark, sf), "item_id", "doc_id", K.TOP_K).select("item_id", "doc_id", "score")
    rows = six.join(T(spark, sf, "documents").select("doc_id", "text"), "doc_id").join(questions(spark, sf).withColumnRenamed("text", "question"), "item_id")
    scored = S.score_pairs(rows, "question", "text", S.shared_words)
    return S.rerank(scored, "item_id", "doc_id", K.RERANK_K, "ce_score").select("item_id", "doc_id", "score", "rank")


#: The whole chain: documents in force only, each question in the sources of its scope, expanded by its rewrite.
RETRIEVE_SQL = f"""with live as (select doc_id, source, lang, text, case when doc_id % 3 = 0 then 'active' end as status from documents where doc_id % 3 <> 1),
qs as (select item_id, b.text, case when length(d.text) <= 5 or d.text is null or contains(lower(b.text), 'nghị định') or contains(lower(b.text), 'thông tư') then b.text else b.text || ' ' || d.text end as query,
  case item_id % 3 when 0 then '*' when 1 then 'src' || (item_id % 20) else 'src' || (item_id % 20) || '+' end as s, case item_id % 3 when 0 then null when 1 then ['src' || (item_id % 20)] else ['src' || (item_id % 20), 'src' || ((item_id + 1) % 20)] end as scope
  from benchmark b left join (select doc_id, substring(text, 1, doc_id % 12 + 1) as text from documents) d on d.doc_id = item_id),
sc as (select distinct s, scope from qs), idx as (select doc_id, source, term, count(*) as tf from (select doc_id, source, unnest({WORDS("concat_ws(' ', source, lang, text)")}) as term from live) group by all),
asked as (select item_id, s, scope, term, count(*) as qtf from (select item_id, s, scope, unnest({WORDS('query')}) as term from qs) group by all),
dl as (select doc_id, source, sum(tf) as dl from idx group by all), tot as (select s, count(*) as n, avg(dl) as avgdl from sc join dl on scope is null or list_contains(scope, source) group by 1),
df as (select s, term, count(*) as df from sc join idx on scope is null or list_contains(scope, source) group by all), f as (select s, term, ln(n - df + 0.5) - ln(df + 0.5) as raw from df join tot using (s)),
m as (select s, avg(raw) as mean from f group by 1), idf as (select s, term, case when raw < 0 then 0.25 * mean else raw end as idf from f join m using (s)),
scored as (select item_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score from asked join idf using (s, term) join idx on idx.term = asked.term and (scope is null or list_contains(scope, idx.source)) join dl using (doc_id) join tot using (s) group by all having round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) > 0),
lap as (select item_id, doc_id, round(count(*) / any_value(w), 6) as score from asked join (select item_id, count(*) as w from asked group by 1) using (item_id) join idx on idx.term = asked.term and (scope is null or list_contains(scope, idx.source)) where item_id not in (select item_id from scored) group by all),
lex as (select item_id, doc_id, row_number() over (partition by item_id order by score desc, doc_id) as rank from (select * from scored union all select * from lap) qualify rank <= 20),
cosines as (select item_id, e.vec_id as doc_id, round(list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 6) as score from qs join embeddings q on q.vec_id = item_id, embeddings e join live on live.doc_id = e.vec_id where scope is null or list_contains(scope, source)),
dense as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as rank from cosines where score >= 0.1 qualify rank <= 18), {FUSED_SQL}, {blended_sql('fused')},
ctx as (select item_id, string_agg('--- Tài liệu ' || rank || ' [' || source || ', ' || lang || ' — Còn hiệu lực] ---' || chr(10) || text, chr(10) || chr(10) order by rank) as context from three group by 1)
select item_id, doc_id, blended as score, cast(rank as int) as rank, source as source_name, sha256(context) as context_sha256 from three join ctx using (item_id)"""


@query("retrieve", RETRIEVE_SQL)
def _(spark, sf):
    live = T(spark, sf, "documents").withColumn("status", status("doc_id")).where("status is null or status <> 'repealed'")
    chunks = live.select("doc_id", F.col("source").alias("source_name"), F.col("lang").alias("article"), F.lit("").alias("clause"), "status", "text")
    rewrites = T(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), F.expr("substring(text, 1, cast(doc_id % 12 as int) + 1)").alias("rewrite"))
    vectors = T(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = questions(spark, sf).join(rewrites, "item_id", "left").join(vectors.withColumnRenamed("doc_id", "item_id"), "item_id", "left")
    asked = asked.withColumn("scope", scopes(lambda i: F.concat(F.lit("src"), (i % 20).cast("string"))))
    held = vectors.join(live.select("doc_id", F.col("source").alias("grp")), "doc_id")
    found = stored(K.retrieve(asked, held, kept_index(spark, sf, "live", live, "source"), chunks, "item_id", "doc_id", threshold=LEAST), "hits")
    context = K.build_context(found, "item_id").select("item_id", F.sha2("context", 256).alias("context_sha256"))
    return found.select("item_id", "doc_id", "score", "rank", "source_name").join(context, "item_id")


@query("build_context", f"{ALL_SQL} select item_id, string_agg('--- Tài liệu ' || rank || ' [' || source || ', ' || lang || ' — ' || case doc_id % 3 when 0 then 'Còn hiệu lực' when 1 then 'Hết hiệu lực' else 'Còn hiệu lực' end || '] ---' || chr(10) || text, chr(10) || chr(10) order by rank) as context from top join documents using (doc_id) group by 1")
def _(spark, sf):
    rows = hits(spark, sf).join(T(spark, sf, "documents").select("doc_id", F.col("lang").alias("article")), "doc_id")
    return K.build_context(rows.withColumn("clause", F.lit("")).withColumn("status", status("doc_id")), "item_id")


CITED_SQL = f"""{ALL_SQL}, {ANSWERS_SQL},
s as (select t.*, d.text, list_distinct({WORDS('answer')}) as a, list_distinct({WORDS('d.text')}) as w from top t join ans using (item_id) join documents d using (doc_id)),
u as (select *, len(list_intersect(a, w)) / greatest(len(a), 1) as support from s),
v as (select *, max(support >= 0.08) over (partition by item_id) as any_ from u),
cited as (select item_id, doc_id, rank, score, text, a, w, case when any_ then support else 0 end as support from v where support >= 0.08 or (not any_ and rank = 1))"""


@query("citation_support", f"{CITED_SQL} select item_id, doc_id, round(support, 6) as support, round_even(0.7::double * score + 0.3::double * support, 3) as relevance from cited")
def _(spark, sf):
    return K.cite(answers(spark, sf), hits(spark, sf), "item_id").select("item_id", "doc_id", F.round("support", 6).alias("support"), "relevance")


@query("confidence", f"""{CITED_SQL}, best as (select item_id, arg_min(score, rank) as best, count(*) as n from top group by 1), g as (select item_id, list_distinct(flatten(list(w))) as w, count(*) as cited from cited group by 1)
select item_id, case when best is null then 0 when contains(lower(answer), 'chưa tìm thấy') or contains(lower(answer), 'không có thông tin') or contains(lower(answer), 'ngoài phạm vi') then least(best * 0.5, 0.4)
  else round_even(least(0.99, 0.55::double * best + 0.35::double * (coalesce(len(list_intersect(list_distinct({WORDS('answer')}), g.w)), 0) / greatest(len(list_distinct({WORDS('answer')})), 1)) + 0.10::double * coalesce(cited, 0) / n), 3) end as confidence
from ans left join best using (item_id) left join g using (item_id)""")
def _(spark, sf):
    h = hits(spark, sf)
    return K.confidence(answers(spark, sf), h, K.cite(answers(spark, sf), h, "item_id"), "item_id")


@query("fallback_answer", f"with {DENSE_SQL}, hit as (select item_id, text, row_number() over (partition by item_id order by score desc, dense.doc_id) as r from dense join documents using (doc_id) where score >= 0.3 and doc_id <> item_id) select item_id, 'no source found' as answer, true as is_fallback, 0.0::double as confidence from benchmark where item_id not in (select item_id from hit) union all select item_id, '{rules.EXCERPTS_BEFORE}' || coalesce(string_agg('• ' || substring(trim(text), 1, 900), chr(10) || chr(10) order by r) filter (trim(text) <> ''), '') || '{rules.EXCERPTS_AFTER}', true, 0.0 from hit where r <= 2 group by 1")
def _(spark, sf):
    held = dense(spark, sf).where("score >= 0.3 and doc_id <> item_id").select("item_id", "doc_id", "score").join(T(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    hits = K.top(held, "item_id", "doc_id", 2)
    nothing = K.fallback_answers(questions(spark, sf), hits, "item_id", "no source found")
    return nothing.unionByName(K.excerpt_answers(questions(spark, sf), hits, "item_id", "text"))


@query("intent_fast", "select conv_id, turn, case " + " ".join("when " + " or ".join(f"contains(lower(text), '{w}')" for w in ws) + f" then '{n}'" for n, ws in rules.INTENTS.items()) + " else 'general' end as intent from conversations")
def _(spark, sf):
    return T(spark, sf, "conversations").select("conv_id", "turn", K.detect_intent(F.col("text")).alias("intent"))


@query("expand_query", "select item_id, case when length(d.text) <= 5 or d.text is null or contains(lower(b.text), 'nghị định') or contains(lower(b.text), 'thông tư') then b.text else b.text || ' ' || d.text end as query from benchmark b left join (select doc_id, substring(text, 1, doc_id % 12 + 1) as text from documents) d on d.doc_id = item_id")
def _(spark, sf):
    rewrites = T(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), F.expr("substring(text, 1, cast(doc_id % 12 as int) + 1)").alias("rewrite"))
    return questions(spark, sf).join(rewrites, "item_id", "left").select("item_id", K.expand_query(F.col("text"), F.col("rewrite")).alias("query"))


#: Answers are stored once: the next is the first that comes after the time of the one before.
CACHE_SQL = """with recursive e as (select event_id, user_id, event_type, ts from events),
st as (select user_id, event_type, min(ts) as ts from e group by all
  union all select s.user_id, s.event_type, min(e.ts) from st s join e on e.user_id = s.user_id and e.event_type = s.event_type and e.ts > s.ts + interval 6 hour group by s.user_id, s.event_type, s.ts),
kept as (select e.user_id, e.event_type, min(e.event_id) as event_id from e join st on e.user_id = st.user_id and e.event_type = st.event_type and e.ts = st.ts group by e.user_id, e.event_type, e.ts)"""


@query("response_cache", f"{CACHE_SQL} select event_id, event_id not in (select event_id from kept) as reused from e")
def _(spark, sf):
    log = T(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("key"))
    return K.reuse_answers(log, "key", "ts", "event_id").select("event_id", "reused")


#: Every other supplier asks for a group that has no questions of its own.
@query("suggestions", """with log as (select c_nationkey as nation, o_orderpriority as question, count(*) as n from customer join orders on o_custkey = c_custkey group by all),
every as (select null as nation, question, sum(n) as n from log group by question),
lists as (select *, row_number() over (partition by nation order by n desc, question) as rank from (select * from log union all select * from every) qualify rank <= 3)
select s_suppkey, question, cast(l.n as bigint) as n, cast(rank as int) as rank from supplier left join (select distinct nation as known from log) on known = s_nationkey + s_suppkey % 2 * 100 join lists l on l.nation is not distinct from known""")
def _(spark, sf):
    log = T(spark, sf, "customer").join(T(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").cast("long").alias("group"), F.col("o_orderpriority").alias("question"))
    asked = T(spark, sf, "supplier").select("s_suppkey", (F.col("s_nationkey") + F.col("s_suppkey") % 2 * 100).cast("long").alias("group"))
    return K.suggest(log, asked, "group", "question", 3).drop("group")


PAIRS_SQL = f"""pairs as (select conv_id, a.turn, a.text as answer, u.text as expected, (select string_agg(text, ' ' order by turn) from conversations c where c.conv_id = a.conv_id and c.turn < a.turn) as context
  from conversations a join conversations u using (conv_id) where a.role = 'assistant' and u.turn = a.turn - 1),
tok as (select conv_id, turn, {ALL_WORDS('answer')} as a, {ALL_WORDS('expected')} as e, {ALL_WORDS('coalesce(context, chr(32))')} as c from pairs),
sc as (select conv_id, turn, case when len(a) > 0 and len(e) > 0 then round_even(len(list_intersect(a, e)) / len(list_distinct(list_concat(a, e))), 3) else 0 end as similarity,
  case when len(a) > 0 and len(c) > 0 then round_even(len(list_intersect(a, c)) / len(a), 3) else 0 end as grounding, case when len(e) > 0 and len(c) > 0 then round_even(len(list_intersect(e, c)) / len(e), 3) else 0 end as recall, len(a) as na, len(e) as ne, len(c) as nc from tok)"""


def samples(spark, sf):
    """Answers with the turn before as what was expected, and all turns before as context."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    said = T(spark, sf, "conversations").select("conv_id", "turn", "role", F.col("text").alias("answer"))
    before = F.array_join(F.collect_list("answer").over(w.rowsBetween(Window.unboundedPreceding, -1)), " ")
    rows = said.withColumn("expected", F.lag("answer").over(w)).withColumn("last_turn", F.lag("turn").over(w)).withColumn("context", before).withColumn("citations", F.when(F.col("turn") % 3 == 0, F.array("answer")))
    return rows.where("role = 'assistant' and last_turn = turn - 1")


@query("case_scores", f"with {PAIRS_SQL} select conv_id, turn, similarity, grounding, recall, turn % 3 = 0 as has_citation from sc")
def _(spark, sf):
    return E.case_scores(samples(spark, sf)).select("conv_id", "turn", "similarity", "grounding", "recall", "has_citation")


@query("case_verdict", f"with {PAIRS_SQL} select conv_id, turn, case when similarity >= 0.4 and turn % 5 <> 0 then 'pass' else 'review' end as verdict from sc")
def _(spark, sf):
    return E.case_scores(samples(spark, sf)).select("conv_id", "turn", E.case_verdict(F.col("similarity"), F.col("turn") % 5 == 0).alias("verdict"))


@query("token_jaccard", f"with {PAIRS_SQL} select conv_id, turn, similarity from sc")
def _(spark, sf):
    return samples(spark, sf).select("conv_id", "turn", X.token_jaccard(X.eval_tokens(F.col("answer")), X.eval_tokens(F.col("expected"))).alias("similarity"))


@query("token_coverage", f"with {PAIRS_SQL} select conv_id, turn, grounding from sc")
def _(spark, sf):
    return samples(spark, sf).select("conv_id", "turn", X.token_coverage(X.eval_tokens(F.col("answer")), X.eval_tokens(F.col("context"))).alias("grounding"))


METRICS_SQL = f"with {PAIRS_SQL}, m as (select conv_id, round_even(avg(case when na > 0 and nc > 0 then grounding end), 3) as faithfulness, round_even(avg(case when na > 0 and ne > 0 then similarity end), 3) as relevancy, round_even(avg(case when ne > 0 and nc > 0 then recall end), 3) as recall from sc group by 1)"


@query("heuristic_metrics", f"{METRICS_SQL}, p as (select conv_id, round_even(avg(case when turn % 2 = 0 then 0.5 else 1.0 end::double), 3) as precision from pairs group by 1) select conv_id, faithfulness, relevancy, recall, precision from m join p using (conv_id)")
def _(spark, sf):
    # of two contexts, the second is blank in even turns
    contexts = F.array(F.lit("x"), F.when(F.col("turn") % 2 == 0, " ").otherwise("x"))
    return E.heuristic_metrics(samples(spark, sf).withColumn("contexts", contexts), "conv_id", "contexts")


@query("avg_nonempty", f"{METRICS_SQL} select conv_id, relevancy from m")
def _(spark, sf):
    return E.heuristic_metrics(samples(spark, sf), "conv_id").select("conv_id", "relevancy")


@query("target_grade", f"{METRICS_SQL} select conv_id, case when faithfulness is null then 'N/A' when faithfulness >= 0.85 then 'pass' when faithfulness >= 0.85 * 0.85 then 'near' else 'fail' end as grade from m")
def _(spark, sf):
    return E.heuristic_metrics(samples(spark, sf), "conv_id").select("conv_id", E.target_grade(F.col("faithfulness"), F.lit(0.85)).alias("grade"))


@query("merge_metrics", f"{METRICS_SQL} select conv_id, coalesce(case when conv_id % 2 = 0 then 1.0::double end, relevancy) as relevancy, recall from m")
def _(spark, sf):
    base = E.heuristic_metrics(samples(spark, sf), "conv_id").select("conv_id", "relevancy", "recall")
    return E.merge_metrics(base, base.select("conv_id", F.when(F.col("conv_id") % 2 == 0, 1.0).alias("relevancy")), "conv_id")


@query("run_metrics", f"with {PAIRS_SQL} select conv_id % 7 as run_id, count(*) as total, count(*) filter (similarity >= 0.4) as passed, round(avg(similarity), 4) as mean_valid, round(avg(similarity), 4) as mean_all, round(avg(grounding), 4) as grounding, round(avg(recall), 4) as recall, round(avg(case when turn % 3 = 0 then 1.0::double else 0 end), 4) as citation_rate, round(avg(1 - grounding), 4) as ungrounded_rate, round(avg(case when turn % 5 = 0 then 1.0::double else 0 end), 4) as fallback_rate from sc group by 1")
def _(spark, sf):
    return E.run_metrics(E.case_scores(samples(spark, sf)).withColumn("run_id", F.col("conv_id") % 7), "run_id", F.lit(True), F.col("turn") % 5 == 0)


@query("eval_samples", "select conv_id, turn, list_filter([text, case when turn % 2 = 0 then '' else role end], lambda x: trim(x) <> '') as contexts from conversations")
def _(spark, sf):
    return E.eval_samples(T(spark, sf, "conversations"), [F.col("text"), F.when(F.col("turn") % 2 == 0, "").otherwise(F.col("role"))]).select("conv_id", "turn", "contexts")


@query("ablation", f"with {BM25_SQL}, {DENSE_SQL}, {FUSED_SQL}, d as (select *, score / max(score) over (partition by item_id) as n from dense), l as (select *, score / max(score) over (partition by item_id) as n from lex), w as (select item_id, doc_id, round(0.65::double * coalesce(d.n, 0) + (1 - 0.65::double) * coalesce(l.n, 0) + 1e-9, 6) as score from d full join l using (item_id, doc_id)), b as (select 'rrf' as method, item_id, count(*) as n, max(score) as s from fused group by 2 union all select 'weighted', item_id, count(*), max(score) from w group by 2) select method, count(*) as questions, cast(sum(n) as bigint) as hits, round(avg(s), 6) as mean_best from b group by 1")
def _(spark, sf):
    weighted = K.weighted_fuse(dense(spark, sf), lexical(spark, sf), "item_id", "doc_id")
    return E.ablation("item_id", "score", rrf=fused(spark, sf), weighted=weighted)
