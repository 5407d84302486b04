"""Queries over text functions, structure, metadata and validity. Structured documents are orders: an article per line item."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as X
from ..functions import values as Y
from ..operators import metadata as M
from ..operators import structure as C
from ..operators import validity as V
from ..operators.relational import flag_tables, infer_parents
from ..session import ship
from ..sources.tables import read_table as T
from ..sources import tables as S
from .registry import query
from .shared import scratch

LINE_SQL = "'Điều ' || l_linenumber || '. ' || p_name || chr(10) || '1. ' || p_brand || ' ' || p_type || chr(10) || '2. qty ' || cast(l_quantity as int) || chr(10) || '3. more of ' || p_name || ', ' || p_type || ' and ' || p_brand"
DOCS_SQL = f"sdocs as (select l_orderkey as doc_id, string_agg({LINE_SQL}, chr(10) order by l_linenumber, l_partkey, l_suppkey, l_quantity) as text, case when l_orderkey % 5 = 0 then 'Luật ' else 'doc ' end || (l_orderkey % 1000) as name from lineitem join part on l_partkey = p_partkey group by l_orderkey)"
BLOCKS_SQL = "blocks as (select doc_id, name, b.position, trim(b.part, ' ' || chr(10)) as block from (select doc_id, name, unnest(list_transform(list_zip(p, range(len(p))), lambda z: struct_pack(part := z[1], position := z[2]))) as b from (select doc_id, name, string_split(regexp_replace(text, '(?m)^(Điều \\d+)', chr(1) || '\\1', 'g'), chr(1)) as p from sdocs)) where length(trim(b.part, ' ' || chr(10))) >= 60)"


def line_items(spark, sf):
    return T(spark, sf, "lineitem").join(T(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))


def structured(spark, sf):
    """Lines are made where their document is put together, so that their parts alone are shuffled and sorted."""
    line = lambda x: F.concat(F.lit("Điều "), x["l_linenumber"].cast("string"), F.lit(". "), x["p_name"], F.lit("\n1. "), x["p_brand"], F.lit(" "), x["p_type"], F.lit("\n2. qty "), x["l_quantity"].cast("int").cast("string"), F.lit("\n3. more of "), x["p_name"], F.lit(", "), x["p_type"], F.lit(" and "), x["p_brand"])
    parts = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "p_name", "p_brand", "p_type")))
    docs = line_items(spark, sf).groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_join(F.transform(parts, line), "\n").alias("text"))
    return docs.withColumn("name", F.concat(F.when(F.col("doc_id") % 5 == 0, "Luật ").otherwise("doc "), (F.col("doc_id") % 1000).cast("string")))


def documents(spark, sf):
    return T(spark, sf, "documents").select("doc_id", "text", "lang", "source")


def column_query(name, sql, build, table="documents", key="doc_id"):
    """A query that applies a column function to the texts of a table."""

    @query(name, f"select {key}, {sql} from {table}")
    def _(spark, sf):
        ship(spark)
        out = T(spark, sf, table).select(key, build(F.col("text")))
        return out.select(key, "s.*") if "s" in out.columns else out


column_query("fix_artifacts", "replace(replace(replace(replace(replace(replace(replace(replace(replace(text, 'ﬁ', 'fi'), 'ﬀ', 'ff'), 'ﬂ', 'fl'), '–', '-'), '—', '-'), chr(160), ' '), chr(8203), ''), chr(65279), ''), '…', '...') as text", lambda t: X.fix_artifacts(t).alias("text"))
column_query("drop_garbage", "regexp_replace(text || ' 中文 x', '[^\\x{0000}-\\x{007F}\\x{00C0}-\\x{024F}\\x{0300}-\\x{036F}\\x{1E00}-\\x{1EFF}\\s]', ' ', 'g') as text", lambda t: X.drop_foreign(F.concat(t, F.lit(" 中文 x"))).alias("text"))
column_query("squeeze_ws", "regexp_replace(replace(text, chr(9), ' '), ' {2,}', ' ', 'g') as text", lambda t: X.squeeze_ws(t).alias("text"))
column_query("drop_page_numbers", "array_to_string(list_filter(string_split(text || chr(10) || '12' || chr(10) || '- 3 -' || chr(10) || 'Trang 1/2', chr(10)), lambda x: not regexp_full_match(trim(x), '(?i)(-\\s*\\d+\\s*-|Trang\\s+\\d+\\s*/\\s*\\d+|\\d+)')), chr(10)) as text", lambda t: X.drop_page_numbers(F.concat(t, F.lit("\n12\n- 3 -\nTrang 1/2"))).alias("text"))
column_query("drop_repeat_headers", "'Số: 12' || chr(10) || text as text", lambda t: X.drop_repeat_headers(F.concat(F.lit("Số: 12\n"), t, F.lit("\nSố: 12"))).alias("text"))
column_query("normalize_legal", "regexp_replace('Điều' || item_id || ' ' || text, '(Điều|Khoản|Điểm|Mục|Chương)(\\d+)', '\\1 \\2', 'g') as text", lambda t: X.normalize_legal(F.concat(F.lit("Điều"), F.col("item_id").cast("string"), F.lit(" "), t)).alias("text"), "benchmark", "item_id")
column_query("apply_corrections", "replace(replace(text, 'the ', 'THE '), 'THE and', 'x') as text", lambda t: X.apply_corrections(t, [("the ", "THE "), ("THE and", "x")]).alias("text"))
column_query("clean_page", "trim(regexp_replace(regexp_replace(translate(text, '“”‘’–—', '\"\"''''--'), '([A-Za-zÀ-ỹ])-\\n([A-Za-zÀ-ỹ])', '\\1\\2', 'g'), '[ \\t]{2,}', ' ', 'g')) as text", lambda t: X.clean_page(t).alias("text"))
column_query("ocr_post", "trim(regexp_replace(regexp_replace(replace(replace(replace(replace(text, ' ,', ','), ' .', '.'), ' ;', ';'), ' :', ':'), ' {2,}', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')) as text", lambda t: X.ocr_post(t).alias("text"))
column_query("nfc", "nfc_normalize(text) as text", lambda t: X.nfc(t).alias("text"))
column_query("strip_accents", "trim(regexp_replace(replace(strip_accents(lower(text)), 'đ', 'd'), '\\s+', ' ', 'g')) as text", lambda t: X.strip_accents(t).alias("text"))
column_query("norm_label", "trim(regexp_replace(lower(replace(text, '.', ' ')), '\\s+', ' ', 'g')) as label", lambda t: X.norm_label(t).alias("label"))
column_query("norm_question_key", "sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) || '|' || lang) as key", lambda t: X.norm_question_key(t, F.col("lang")).alias("key"))
column_query("tokens", "cast(len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}_]{2,}')) as int) as n, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}_]{2,}'))[1] is not null as some", lambda t: F.struct(F.size(X.tokens(t, [])).alias("n"), (F.size(X.tokens(t, [])) > 0).alias("some")).alias("s"))
column_query("eval_tokens", "cast(len(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}_]+'))) as int) as n", lambda t: F.size(X.eval_tokens(t)).alias("n"))
column_query("token_estimate", "cast(greatest(1, floor(length(text) / 1.5)) as int) as n", lambda t: X.token_estimate(t).alias("n"))
column_query("title_from_text", "case when length(text) > 50 then substring(text, 1, 50) || '...' else text end as title", lambda t: X.title_from_text(t).alias("title"))
def begins(line, heads):
    return f"regexp_matches({line}, '^(" + "|".join(f"\\{h}" if h in "[(-+" else h for h in heads) + ")')"


#: Only the rules on commas, bars and single letters can meet the table's texts; the fold over lines is whole.
POLISHED_SQL = r"""case when trim(coalesce(text, '')) = '' then '' else trim(regexp_replace(array_to_string(list_reduce(list_prepend(cast([] as varchar[]), list_transform(list_filter(list_transform(string_split(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[,;]?\s*\bm\s*[:;,]\s*', ', ', 'g'), '(?m)^[ \t]*[\\/][ \t]*', '', 'g'), '\s*\|\s*', ' - ', 'g'), '[,;][,\s;]+', ', ', 'g'),
    chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> ''), lambda x: [x])),
  lambda a, b: case when len(a) = 0 then case when len(string_split_regex(b[1], '\s+')) <= 2 and not HEADS then a else b end
    when (regexp_matches(a[-1], '(,|;| -| và| hoặc)$') or not regexp_matches(a[-1], '[.?!:]$')) and not ITEMS then list_concat(a[:-2], [a[-1] || ' ' || b[1]]) else list_concat(a, b) end), chr(10) || chr(10)), '[ \t]+', ' ', 'g')) end"""
POLISHED_SQL = POLISHED_SQL.replace("HEADS", begins("b[1]", rules.SNIPPET_HEADS)).replace("ITEMS", begins("b[1]", rules.SNIPPET_ITEMS))
column_query("polish_snippet", f"{POLISHED_SQL} as text", lambda t: X.polish_snippet(t).alias("text"))
column_query("clean_stats", "cast(length(text) as int) as before, cast(length(regexp_replace(text, '\\s+', ' ', 'g')) as int) as after, cast(length(text) - length(replace(text, chr(10), '')) + 1 as int) as lines, cast(1 as int) as lines_after, case when length(text) > 0 then round_even((1 - length(regexp_replace(text, '\\s+', ' ', 'g')) / length(text)) * 100, 1) else 0 end as reduction", lambda t: Y.clean_stats(t, F.regexp_replace(t, "\\s+", " ")).alias("s"))


@query("clean_text", None)
def _(spark, sf):
    ship(spark)
    return documents(spark, sf).select("doc_id", X.nfc("text").alias("text")).select("doc_id", X.clean_text(F.col("text")).alias("text"))


@query("parse_doc_date", "select o_orderkey, cast(o_orderdate as date) as d, cast(o_orderdate as date) + 9 as effective from orders")
def _(spark, sf):
    say = lambda d: F.concat(F.lit("ngày "), F.dayofmonth(d).cast("string"), F.lit(" tháng "), F.month(d).cast("string"), F.lit(" năm "), F.year(d).cast("string"))
    later = F.date_add(F.to_date("o_orderdate"), 9)
    force = F.when(F.col("o_orderkey") % 2 == 0, say(later)).otherwise(F.concat(F.lit("ngày "), F.date_format(later, "d/M/yyyy")))
    text = F.concat(F.lit("Vĩnh Long, "), say("o_orderdate"), F.lit(". Văn bản có hiệu lực thi hành kể từ "), force)
    return T(spark, sf, "orders").select("o_orderkey", X.parse_doc_date(text).alias("d"), X.parse_doc_date(text, "effective").alias("effective"))


@query("date_bucket", "select event_id, date_trunc('day', ts)::date as day, strftime(ts, '%H:%M') as minute, cast(floor((dayofyear(ts) + 6 - (dayofweek(ts) + 6) % 7) / 7) as int) as week from events")
def _(spark, sf):
    rows = T(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return rows.select("event_id", *(Y.date_bucket(F.col("ts"), u).alias(u) for u in ("day", "minute", "week")))


@query("parse_number", "select o_orderkey, round(case when o_orderkey % 3 = 0 then floor(o_totalprice) when o_orderkey % 3 = 1 then o_orderkey + 0.5 else null end, 4) as value from orders")
def _(spark, sf):
    whole = F.replace(F.format_number(F.floor("o_totalprice"), 0), F.lit(","), F.lit("."))
    text = F.when(F.col("o_orderkey") % 3 == 0, whole).when(F.col("o_orderkey") % 3 == 1, F.concat(F.col("o_orderkey").cast("string"), F.lit(",5"))).otherwise("12.34.5x")
    return T(spark, sf, "orders").select("o_orderkey", F.round(X.parse_number(text).cast("double"), 4).alias("value"))


@query("json_fields", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def _(spark, sf):
    return T(spark, sf, "events").select("event_id", Y.json_fields(F.col("props"), "k bigint")["k"].alias("k"))


@query("math_scores", "select o_orderkey, round(1.0 / (60 + o_orderkey % 20 + 1), 6) as rrf, round(least(0.99, 0.55 * (o_totalprice / 500000)), 6) as c from orders")
def _(spark, sf):
    return T(spark, sf, "orders").select("o_orderkey", F.round(Y.reciprocal_rank(F.col("o_orderkey") % 20 + 1), 6).alias("rrf"), F.round(Y.clamp(Y.weighted_sum([(0.55, F.col("o_totalprice") / 500000)]), high=0.99), 6).alias("c"))


@query("cosine", "select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as score from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def _(spark, sf):
    e = T(spark, sf, "embeddings").select("vec_id", "embedding")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(after, "vec_id").select("vec_id", F.round(X.cosine(F.col("embedding"), F.col("next")), 6).alias("score"))


@query("l2_normalize", "select vec_id, round(list_sum(list_transform(embedding::double[], lambda x: x / sqrt(list_inner_product(embedding::double[], embedding::double[])))), 4) as total from embeddings")
def _(spark, sf):
    return T(spark, sf, "embeddings").select("vec_id", F.round(F.aggregate(X.l2_normalize(F.col("embedding")), F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("markdown_table", "select p_brand, '| name | size |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || p_name || ' | ' || p_size || ' |', chr(10) order by p_partkey) as markdown from part group by 1")
def _(spark, sf):
    rows = F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "p_name", "p_size"))), lambda x: F.array(x["p_name"], x["p_size"].cast("string")))
    return T(spark, sf, "part").groupBy("p_brand").agg(X.markdown_table(F.array(F.lit("name"), F.lit("size")), rows).alias("markdown"))


@query("parse_markdown_row", "select p_partkey, [p_name, p_brand, cast(p_size as varchar)] as cells from part")
def _(spark, sf):
    row = F.concat(F.lit("| "), "p_name", F.lit(" |"), "p_brand", F.lit(" | "), F.col("p_size").cast("string"), F.lit(" |"))
    return T(spark, sf, "part").select("p_partkey", X.parse_markdown_row(row).alias("cells"))


@query("argmax_keywords", "select doc_id, case when n1 = 0 and n2 = 0 then 'none' when n1 >= n2 then 'a' else 'b' end as class from (select doc_id, contains(lower(text), ' the ')::int + contains(lower(text), ' and ')::int as n1, contains(lower(text), ' le ')::int + contains(lower(text), ' de ')::int + contains(lower(text), 'der ')::int as n2 from documents)")
def _(spark, sf):
    return documents(spark, sf).select("doc_id", X.argmax_keywords(F.col("text"), {"a": [" the ", " and "], "b": [" le ", " de ", "der "]}, "none").alias("class"))


@query("detect_doc_type", f"with {DOCS_SQL} select doc_id, case when contains(name, '1467') then 'quy_trinh_noi_bo' else 'luat_nghi_dinh' end as type from sdocs")
def _(spark, sf):
    return structured(spark, sf).select("doc_id", C.detect_doc_type(F.col("text"), F.col("name")).alias("type"))


@query("split_articles", f"with {DOCS_SQL}, {BLOCKS_SQL} select doc_id, regexp_extract(block, 'Điều \\d+') as article, block from blocks")
def _(spark, sf):
    return C.split_articles(structured(spark, sf), "text").select("doc_id", "article", "block")


FIELDS_SQL = "[" + ", ".join(f"'{f}'" for f, _ in C.SECTIONS) + "]"


@query("split_sections", f"with {DOCS_SQL}, parts as (select doc_id, unnest(string_split(regexp_replace(regexp_replace(text, '(?m)^Điều (\\d+)\\. ', '(\\1) ', 'g'), '(?m)^(\\(\\d+\\) )', chr(1) || '\\1', 'g'), chr(1))) as b from sdocs), kept as (select doc_id, trim(b, ' ' || chr(10)) as block, cast(regexp_extract(b, '^\\((\\d+)\\)', 1) as int) as section from parts where length(trim(b, ' ' || chr(10))) >= 60) select doc_id, section, {FIELDS_SQL}[section] as field_type, block from kept")
def _(spark, sf):
    docs = structured(spark, sf).withColumn("text", F.regexp_replace("text", "(?m)^Điều (\\d+)\\. ", "($1) "))
    return C.split_sections(docs, "text").select("doc_id", "section", "field_type", "block")


@query("split_steps", f"with {DOCS_SQL}, t as (select doc_id, 'Trình tự' || chr(10) || regexp_replace(text, '(?m)^Điều (\\d+)\\. ', 'Bước \\1: ', 'g') as text from sdocs), parts as (select doc_id, unnest(case when greatest(1, floor(length(text) / 1.5)) <= 300 then [text] else list_filter(list_transform(string_split(regexp_replace(text, '(?m)^(Bước \\d+:)', chr(1) || '\\1', 'g'), chr(1)), lambda x: trim(x, ' ' || chr(10))), lambda x: length(x) >= 60 or x = 'Trình tự') end) as block from t) select doc_id, try_cast(regexp_extract(block, '^Bước (\\d+)', 1) as int) as step, block from parts")
def _(spark, sf):
    docs = structured(spark, sf).withColumn("text", F.concat(F.lit("Trình tự\n"), F.regexp_replace("text", "(?m)^Điều (\\d+)\\. ", "Bước $1: ")))
    return C.split_steps(docs, "text", 300).select("doc_id", "step", "block")


@query("header_spans", f"with {DOCS_SQL}, p as (select doc_id, string_split(regexp_replace(text, '(?m)^(Điều \\d+)', chr(1) || '\\1', 'g'), chr(1)) as p from sdocs), u as (select doc_id, unnest(range(2, len(p) + 1)) as i, p from p) select doc_id, cast(list_sum(list_transform(p[:i - 1], lambda x: length(x))) + 1 as bigint) as \"start\", cast(list_sum(list_transform(p[:i], lambda x: length(x))) + 1 as bigint) as \"end\" from u")
def _(spark, sf):
    return C.header_spans(structured(spark, sf), "doc_id", "text", "(?m)^Điều \\d+").select("doc_id", "start", "end")


@query("fixed_windows", "select doc_id, cast(s as int) as \"start\", substring(text, cast(s as int) + 1, 900) as piece from (select doc_id, text, unnest(range(0, greatest(length(text) - 121, 0) + 1, 780)) as s from documents)")
def _(spark, sf):
    return C.fixed_windows(documents(spark, sf), "text").select("doc_id", "start", "piece")


@query("pack_paragraphs", None)
def _(spark, sf):
    return C.pack_paragraphs(documents(spark, sf).select("doc_id", "text"), "text").select("doc_id", "piece_index", "piece")


@query("pack_by_marker", f"with {DOCS_SQL}, parts as (select doc_id, list_filter(string_split(regexp_replace(text, '(?m)^Điều (\\d+)', chr(1) || '--- TRANG \\1 ---' || chr(1), 'g'), chr(1)), lambda x: x <> '') as p from sdocs), packed as (select doc_id, list_reduce(list_transform(p, lambda x: [x]), lambda a, x: case when length(a[-1]) + length(x[1]) > 300 then list_concat(a, x) else list_concat(a[:-2], [a[-1] || chr(10) || chr(10) || x[1]]) end) as b from parts) select doc_id, cast(i as int) as position, trim(b[i + 1], ' ' || chr(10)) as piece from (select doc_id, b, unnest(range(len(b))) as i from packed)")
def _(spark, sf):
    docs = structured(spark, sf).withColumn("text", F.regexp_replace("text", "(?m)^Điều (\\d+)", "--- TRANG $1 ---"))
    return C.pack_by_marker(docs, "text", most=300).select("doc_id", F.col("piece_index").alias("position"), "piece")


@query("context_prefix", f"with {DOCS_SQL}, {BLOCKS_SQL} select doc_id, '[Văn bản: ' || name || ']' || chr(10) || '[' || regexp_extract(block, 'Điều \\d+') || ']' || chr(10) || block as chunk from blocks")
def _(spark, sf):
    return C.split_articles(structured(spark, sf), "text").select("doc_id", C.with_prefix(F.col("block"), F.col("name"), F.col("article")).alias("chunk"))


#: Of every four documents one is a statute, one a procedure decision, one an internal workflow and one none of these.
KINDS_SQL = f"""{DOCS_SQL}, kinds as (select doc_id, name, case doc_id % 4 when 1 then regexp_replace(d, '(?m)^Điều (\\d+)\\. ', '(\\1) ', 'g') when 2 then regexp_replace(d, '(?m)^Điều (\\d+)\\. ', 'Bước \\1: ', 'g') when 3 then regexp_replace(d, '(?m)^Điều (\\d+)\\. ', 'Phần \\1 ', 'g') else text end as text,
  len(regexp_extract_all(text, '(?m)^Điều \\d+\\. ')) as n from (select *, regexp_replace(text, '(?m)^\\d+\\. ', '- ', 'g') as d from sdocs)),
typed as (select *, case when doc_id % 4 = 1 and n >= 4 then 'decision' when doc_id % 4 = 2 and n >= 3 then 'workflow' when doc_id % 4 = 0 then 'statute' else 'plain' end as kind from kinds),
parts as (select doc_id, name, kind, unnest(string_split(regexp_replace(text, '(?m)^(Điều \\d+|\\(\\d+\\) |Bước \\d+:)', chr(1) || '\\1', 'g'), chr(1))[2:]) as b, generate_subscripts(string_split(regexp_replace(text, '(?m)^(Điều \\d+|\\(\\d+\\) |Bước \\d+:)', chr(1) || '\\1', 'g'), chr(1))[2:], 1) as i from typed where kind <> 'plain'),
made as (select doc_id, i, case kind when 'statute' then '[Văn bản: ' || name || ']' || chr(10) || '[' || regexp_extract(b, 'Điều \\d+') || ']' || chr(10) when 'decision' then '[Thủ tục: Thủ tục đất đai]' || chr(10) || '[Mục: ' || [{", ".join(f"'{label}'" for _, label in C.SECTIONS)}][cast(regexp_extract(b, '^\\((\\d+)\\)', 1) as int)] || ']' || chr(10) else '[Thủ tục: Quy trình nội bộ đất đai]' || chr(10) || '[Bước ' || regexp_extract(b, '(\\d+)', 1) || ']' || chr(10) end || trim(b, ' ' || chr(10)) as chunk from parts where length(trim(b, ' ' || chr(10))) >= 60
  union all select doc_id, s, trim(substring(text, cast(s as int) + 1, 900)) from (select doc_id, text, unnest(range(0, greatest(length(text) - 121, 0) + 1, 780)) as s from typed where kind = 'plain' and length(trim(text)) >= 60))"""


@query("chunk_documents", f"with {KINDS_SQL} select doc_id, cast(row_number() over (partition by doc_id order by i) - 1 as int) as chunk_index, chunk from made where length(chunk) >= 60".replace("\\\\", "\\"))
def _(spark, sf):
    headed = lambda to: F.regexp_replace("text", "(?m)^Điều (\\d+)\\. ", to)
    docs = structured(spark, sf)
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 4 == 0, F.col("text")).otherwise(F.regexp_replace("text", "(?m)^\\d+\\. ", "- ")))
    kinds = F.when(F.col("doc_id") % 4 == 1, headed("($1) ")).when(F.col("doc_id") % 4 == 2, headed("Bước $1: ")).when(F.col("doc_id") % 4 == 3, headed("Phần $1 "))
    docs = docs.withColumn("text", F.coalesce(kinds, F.col("text")))
    return C.chunk_documents(docs, "doc_id", "text", "name", fallback="windows").select("doc_id", "chunk_index", "chunk")


@query("chunk_stats", "select doc_id, count(*) as n, count(*) filter (contains(p, '[Bảng') or (contains(p, '|') and contains(p, chr(10) || '| ---')) or contains(p, ' | ')) as tables, cast(floor(sum(greatest(1, floor(length(p) / 1.5))) / greatest(count(*), 1)) as bigint) as mean_tokens from (select doc_id, substring(text, cast(s as int) + 1, 900) as p from (select doc_id, text, unnest(range(0, greatest(length(text) - 121, 0) + 1, 780)) as s from documents)) group by 1")
def _(spark, sf):
    return C.chunk_stats(C.fixed_windows(documents(spark, sf), "text"), ["doc_id"], X.token_estimate(F.col("piece")), flag_tables(F.col("piece")))


@query("table_type", "select doc_id, case " + " ".join("when " + " or ".join(f"contains(lower(text), '{w}')" for w in ws) + f" then '{n}'" for n, ws in rules.TABLE_TYPES.items()) + " else 'general' end as type from documents")
def _(spark, sf):
    return documents(spark, sf).select("doc_id", C.classify_tables(F.col("text")).alias("type"))


#: Tables by supplier are long, those by part short.
TABLES_SQL = """r as (select case when l_suppkey % 2 = 0 then 's' || l_suppkey else 'p' || l_partkey end as k, '| ' || l_partkey || ' | ' || cast(l_quantity as int) || ' |' as line, l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem),
n as (select *, row_number() over (partition by k order by l_orderkey, l_linenumber, l_partkey, l_quantity) - 1 as i, sum(length(line) + 1) over (partition by k) as total, case when k[1] = 's' then '[Thủ tục: ' || k || ']' || chr(10) || '[Bảng: Lệ phí]' || chr(10) else '[Bảng]' || chr(10) || 'theo ' || k || chr(10) end as prefix, '| part | qty |' || chr(10) || '| --- | --- |' as head from r),
g as (select k, cast(case when floor((length(prefix) + length(head) + total) / 1.5) <= 700 then 0 else i // 20 end as int) as part, count(*) as n_rows, any_value(prefix) || any_value(head) || chr(10) || string_agg(line, chr(10) order by i) as chunk from n group by k, 2)"""


@query("table_chunks", f"with {TABLES_SQL} select k as table_key, part, n_rows, chunk from g where length(chunk) >= 60")
def _(spark, sf):
    cells = F.array(F.col("l_partkey").cast("string"), F.col("l_quantity").cast("int").cast("string"))
    by_supplier = F.col("l_suppkey") % 2 == 0
    rows = T(spark, sf, "lineitem").withColumn("table_key", F.when(by_supplier, F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))).otherwise(F.concat(F.lit("p"), F.col("l_partkey").cast("string"))))
    prefix = C.table_prefix(F.when(by_supplier, "le_phi"), F.when(~by_supplier, F.concat(F.lit(" theo "), "table_key")), F.when(by_supplier, F.col("table_key")))
    return C.chunk_tables(rows, "table_key", ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"], ["part", "qty"], cells, prefix)


@query("mixed_segments", "with s as (select l_orderkey, l_partkey, l_returnflag = 'R' as t, sum((l_returnflag = 'R')::int) over w as island, sum((l_returnflag = 'R')::int) over (partition by l_orderkey) as tables, row_number() over w as i from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity)) select l_orderkey, cast(island as bigint) as island, any_value(island) = any_value(tables) as last, string_agg(cast(l_partkey as varchar), chr(10) order by i) as block, count(*) as n from s where not t group by 1, 2")
def _(spark, sf):
    return C.mixed_segments(T(spark, sf, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], F.col("l_returnflag") == "R", F.col("l_partkey").cast("string"))


@query("detect_articles", f"with {DOCS_SQL} select doc_id, cast(len(list_distinct(regexp_extract_all(text, 'Điều \\d+'))) as int) as n from sdocs")
def _(spark, sf):
    return structured(spark, sf).select("doc_id", F.size(C.doc_outline(F.col("text"))["articles"]).alias("n"))


@query("classify_lines", f"""with {DOCS_SQL}, m as (select doc_id, '[Thủ tục: ' || name || ' ]' || chr(10) || '[Mục: a]' || chr(10) || replace(replace(replace(case when doc_id % 3 = 1 then replace(text, 'Điều ', 'Bước ') else text end, chr(10) || '1. ', chr(10) || case when doc_id % 2 = 0 then '- Thời hạn ' else '- Hồ sơ ' end), chr(10) || '2. ', chr(10) || case when doc_id % 2 = 0 then ' + ' else '- ' end), chr(10) || '3. ', chr(10) || case when doc_id % 5 = 0 then 'Lưu ý ' when doc_id % 5 = 1 then '3. ' else '' end) as text from sdocs),
l as (select doc_id, trim(unnest(string_split(text, chr(10)))) as t from m),
k as (select doc_id, case when starts_with(t, '[Th') then 'procedure' when starts_with(t, '[M') then 'section' when starts_with(t, 'Điều') or starts_with(t, '3. ') then 'heading' when starts_with(t, 'Bước') then 'step' when starts_with(t, '- Thời hạn') then 'agency_time' when starts_with(t, '- Hồ sơ') then 'subheading' when starts_with(t, '+') or starts_with(t, '- ') then 'item' when starts_with(t, 'Lưu ý') then 'case_note' else 'text' end as kind, t from l)
select doc_id, kind, count(*) as n, cast(sum(length(case when kind = 'procedure' then trim(t[11:-2]) when kind = 'section' then 'a' when kind in ('agency_time', 'subheading', 'item') then t[3:] else t end)) as bigint) as chars from k group by all""")
def _(spark, sf):
    k = F.col("doc_id")
    parts = {"\n1. ": F.when(k % 2 == 0, "\n- Thời hạn ").otherwise("\n- Hồ sơ "), "\n2. ": F.when(k % 2 == 0, "\n + ").otherwise("\n- "), "\n3. ": F.when(k % 5 == 0, "\nLưu ý ").when(k % 5 == 1, "\n3. ").otherwise("\n")}
    marked = F.when(k % 3 == 1, F.replace("text", F.lit("Điều "), F.lit("Bước "))).otherwise(F.col("text"))
    for old, new in parts.items():
        marked = F.replace(marked, F.lit(old), new)
    docs = structured(spark, sf).withColumn("text", F.concat(F.lit("[Thủ tục: "), "name", F.lit(" ]\n[Mục: a]\n"), marked))
    return C.classify_lines(docs, "doc_id", "text").groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))


@query("term_highlight", "select doc_id, t as term, count(*) as n from (select doc_id, unnest(regexp_extract_all(lower(text), '" + "|".join(sorted(["license", "apache", "password", "token", "the and", *rules.LEGAL_TERMS], key=lambda t: (-len(t), t))) + "')) as t from documents) group by all")
def _(spark, sf):
    terms = ["license", "apache", "password", "token", "the and", *rules.LEGAL_TERMS]
    return C.term_hits(documents(spark, sf), "doc_id", "text", terms)


@query("form_blanks", None)
def _(spark, sf):
    forms = T(spark, sf, "customer").select("c_custkey", F.concat(F.lit("Tên: ____ "), "c_name", F.lit(" số ......\n☐ "), "c_mktsegment").alias("text"))
    return C.find_blanks(forms, "c_custkey", "text")


FIRST = lambda label, pattern: f"'{label} ' || nullif(regexp_extract(block, '{pattern}', 1), '')"
REFS_SQL = f"""coalesce({FIRST('Điều', '(?i)Điều\\s+(\\d+[a-zA-Z]?)\\b')}, '') as article, coalesce({FIRST('Khoản', '(?i)khoản\\s+(\\d+)\\b')}, {FIRST('Khoản', '^\\s*(\\d+)\\.\\s+')}, '') as clause,
coalesce({FIRST('Điểm', '(?i)điểm\\s+([a-zA-Z])\\b')}, '') as point, regexp_extract(block, '(?i)(?:Mục|Chương)\\s+(?:[IVXLCDM]+|\\d+[a-zA-Z]?)\\b') as section"""


@query("extract_refs", f"with {DOCS_SQL}, {BLOCKS_SQL} select doc_id, position - 1 as position, {REFS_SQL} from blocks")
def _(spark, sf):
    blocks = C.split_articles(structured(spark, sf), "text")
    return blocks.select("doc_id", F.col("position").cast("long").alias("position"), M.extract_refs(F.col("block")).alias("r")).select("doc_id", "position", "r.*")


def keyword_sql(classes, default):
    scores = ", ".join("struct_pack(n := " + " + ".join(f"contains(lower(text), '{w}')::int" for w in ws) + f", i := {-i}, name := '{n}')" for i, (n, ws) in enumerate(classes.items()))
    return f"case when list_sort([{scores}])[-1].n > 0 then list_sort([{scores}])[-1].name else '{default}' end"


@query("classify_field_type", f"select doc_id, {keyword_sql(rules.FIELD_TYPES, 'general')} as field_type from documents")
def _(spark, sf):
    return documents(spark, sf).select("doc_id", X.argmax_keywords(F.col("text"), rules.FIELD_TYPES, "general").alias("field_type"))


@query("classify_procedure", f"select doc_id, {keyword_sql(rules.PROCEDURES, '')} as procedure from documents")
def _(spark, sf):
    return documents(spark, sf).select("doc_id", X.argmax_keywords(F.col("text"), rules.PROCEDURES, "").alias("procedure"))


@query("guess_procedure", "select n_nationkey, case n_nationkey % 4 when 0 then 'chuyen_nhuong' when 1 then 'tang_cho' when 2 then 'thua_ke' else 'all' end as procedure from nation")
def _(spark, sf):
    name = F.element_at(F.array(*map(F.lit, ["Chuyển nhượng đất", "Tặng cho", "thừa kế", "khác"])), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return T(spark, sf, "nation").select("n_nationkey", M.guess_procedure(name).alias("procedure"))


NAMES = ["{}_2026_NĐ-CP.pdf", "{}-NQ-HĐND.pdf", "{}/2024/TT-BTC.docx", "scan {}.pdf"]


def names(spark, sf):
    n = F.col("o_orderkey").cast("string")
    name = F.element_at(F.array(*(F.concat(F.lit(x.split("{}")[0]), n, F.lit(x.split("{}")[1])) for x in NAMES)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    text = F.when(F.col("o_orderkey") % 8 == 3, F.concat(F.lit("Số: "), n, F.lit("/QĐ-UBND ngày"))).otherwise(F.col("o_orderpriority"))
    return T(spark, sf, "orders").select("o_orderkey", name.alias("name"), text.alias("text"))


@query("doc_kind", "select o_orderkey, case o_orderkey % 4 when 0 then 'nghi_dinh' when 1 then 'nghi_quyet' when 2 then 'thong_tu' else 'quyet_dinh' end as kind, case o_orderkey % 4 when 3 then 'quyet_dinh' else 'luat' end as \"group\" from orders")
def _(spark, sf):
    return names(spark, sf).select("o_orderkey", M.doc_kind(F.col("name"), F.col("text")).alias("k")).select("o_orderkey", "k.kind", "k.group")


#: A number in a name has five digits at most: of a longer one the last five; one in the text is whole.
@query("doc_number", "select o_orderkey, case o_orderkey % 4 when 0 then right(cast(o_orderkey as varchar), 5) || '/2026/NĐ-CP' when 1 then right(cast(o_orderkey as varchar), 5) || '/NQ-HĐND' when 2 then right(cast(o_orderkey as varchar), 5) || '/2024/TT-BTC' else case when o_orderkey % 8 = 3 then o_orderkey || '/QĐ-UBND' else '' end end as number from orders")
def _(spark, sf):
    return names(spark, sf).select("o_orderkey", M.doc_number(F.col("name"), F.col("text")).alias("number"))


@query("doc_action", "select o_orderkey, case o_orderstatus when 'F' then 'replace' when 'O' then 'amend' else 'partial_repeal' end as action from orders")
def _(spark, sf):
    text = F.when(F.col("o_orderstatus") == "F", "Thay thế toàn bộ quyết định cũ").when(F.col("o_orderstatus") == "O", "Sửa đổi một số điều").otherwise("bãi bỏ điều 3 và sửa đổi khoản 2")
    return T(spark, sf, "orders").select("o_orderkey", M.doc_action(text).alias("action"))


@query("doc_source_name", "with n as (select *, trim(case o_orderkey % 4 when 0 then 'Nghị định' when 1 then 'Nghị quyết' when 2 then 'Thông tư' else 'Quyết định' end || ' ' || o_orderkey) as plain from orders) select o_orderkey, case when o_orderkey % 7 = 0 then 'Phụ lục II - Quy trình nội bộ 38 TTHC (kèm ' || o_orderkey || ')' when o_orderkey % 7 = 1 then 'Phụ lục I - 38 TTHC đặc thù (kèm ' || o_orderkey || ')' else plain end as name, case o_orderkey % 7 when 0 then '1467' when 1 then '1085' end as parent_hint from n")
def _(spark, sf):
    rows = names(spark, sf).withColumn("name", F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("Phụ lục II "), "name")).otherwise(F.col("name")))
    rows = rows.withColumn("text", F.when(F.col("o_orderkey") % 7 == 1, F.concat(F.lit("PHỤ LỤC I\n"), "text")).otherwise(F.col("text")))
    source = M.doc_source(F.col("name"), F.col("text"), M.doc_kind(F.col("name"), F.col("text"))["kind"], F.col("o_orderkey").cast("string"))
    return rows.select("o_orderkey", source["source_name"].alias("name"), source["parent_hint"].alias("parent_hint"))


@query("extract_changes", None)
def _(spark, sf):
    say = lambda x: F.concat(F.lit("Sửa đổi, bổ sung khoản "), x["k"].cast("string"), F.lit(" Điều "), x["a"].cast("string"), F.lit("; bãi bỏ điểm a khoản 2 Điều "), x["b"].cast("string"))
    parts = F.collect_list(F.struct(F.col("l_linenumber").alias("k"), (F.col("l_partkey") % 20 + 1).cast("int").alias("a"), (F.col("l_suppkey") % 9 + 1).cast("int").alias("b")))
    docs = T(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_join(F.sort_array(F.transform(parts, say)), ". ").alias("text"))
    return C.extract_changes(docs, "doc_id", "text")


CHUNKS_SQL = "c as (select distinct l_orderkey, l_linenumber, l_orderkey || '#' || l_linenumber as chunk_id from lineitem)"


def chunks(spark, sf):
    rows = T(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return rows.select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").cast("string").alias("article"), F.concat_ws("#", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("chunk_id"), F.lit("active").alias("status"))


#: Orders act on the order before them whose key is a multiple of three; provisions are named by partial repeals, and by some amendments.
ACTIONS_SQL = """acts as (select a.o_orderkey as source_id, a.o_orderkey - a.o_orderkey % 3 as document_id, case a.o_orderstatus when 'F' then 'replace' when 'P' then 'partial_repeal' else 'amend' end as action, cast(cast(a.o_orderdate as date) as varchar) as date,
  a.o_orderstatus = 'P' or a.o_orderkey % 10 = 1 as named, 'Điều ' || (a.o_orderkey % 4 + 1) as article, case when a.o_orderkey % 2 = 0 then '' else 'khoản 2' end as clause, case a.o_orderkey % 5 when 0 then 'amend' when 1 then 'add' else 'repeal' end as kind
  from orders a join orders p on p.o_orderkey = a.o_orderkey - a.o_orderkey % 3 where a.o_orderkey % 3 <> 0),
ch as (select distinct l_orderkey as document_id, l_orderkey || '#' || l_linenumber as chunk_id, 'Điều ' || l_linenumber as article, case when l_linenumber % 2 = 0 then 'Khoản 2' else '' end as clause, case when l_linenumber % 3 = 0 then 'theo khoản 2' else 'khác' end as text from lineitem),
hits as (select chunk_id, source_id, 'repealed' as status, date, 'Bị thay thế toàn bộ bởi doc ' || source_id as note from ch join acts using (document_id) where action = 'replace'
  union all select chunk_id, source_id, case kind when 'repeal' then 'repealed' else 'amended' end, date, case kind when 'repeal' then 'Bị bãi bỏ bởi doc ' else 'Bị sửa đổi bởi doc ' end || source_id || ' (' || acts.article || ' ' || acts.clause || ')' from ch join acts using (document_id) where action = 'partial_repeal' and kind <> 'add' and ch.article = acts.article and (acts.clause = '' or lower(ch.clause) = acts.clause or contains(text, acts.clause))),
last as (select chunk_id, arg_max(struct_pack(status, date, note), source_id) as e from hits group by 1)
select 'document' as kind, cast(o_orderkey as varchar) as id, case a when 'amend' then 'Đã sửa đổi bổ sung' when 'replace' then 'Hết hiệu lực' when 'partial_repeal' then 'Hết hiệu lực một phần' else 'Còn hiệu lực' end as status, null as date, null as note, null as other from orders left join (select document_id, arg_max(action, source_id) as a from acts group by 1) on document_id = o_orderkey
union all select 'chunk', chunk_id, coalesce(e.status, 'active'), e.date, e.note, null from ch left join last using (chunk_id)
union all select 'edge', cast(case when r = 0 then document_id else source_id end as varchar), case action when 'amend' then case r when 0 then 'amended_by' else 'amends' end when 'replace' then case r when 0 then 'replaced_by' else 'replaces' end else case r when 0 then 'partially_repealed_by' else 'partially_repeals' end end, date, case when named then 'partial' else 'full' end || case when named then ' ' || article else '' end, 'doc ' || case when r = 0 then source_id else document_id end from acts, range(2) x(r)"""


@query("apply_document_action", f"with {ACTIONS_SQL}")
def _(spark, sf):
    orders, key = T(spark, sf, "orders"), F.col("o_orderkey")
    action = F.when(F.col("o_orderstatus") == "F", "replace").when(F.col("o_orderstatus") == "P", "partial_repeal").otherwise("amend")
    provision = F.struct(F.concat(F.lit("Điều "), (key % 4 + 1).cast("string")).alias("article"), F.when(key % 2 == 0, "").otherwise("khoản 2").alias("clause"), F.when(key % 5 == 0, "amend").when(key % 5 == 1, "add").otherwise("repeal").alias("action"))
    named = F.when((F.col("o_orderstatus") == "P") | (key % 10 == 1), F.array(provision))
    name = F.concat(F.lit("doc "), key.cast("string"))
    actions = orders.where(key % 3 != 0).select(key.alias("position"), key.alias("source_id"), name.alias("source_name"), action.alias("action"), (key - key % 3).alias("document_id"), F.col("o_orderdate").cast("date").alias("effective_date"), F.lit(None).cast("string").alias("scope"), named.alias("provisions"))
    docs = orders.select(key.alias("document_id"), name.alias("source_name"), F.lit("Còn hiệu lực").alias("validity_status"))
    number = F.col("l_linenumber")
    parts = T(spark, sf, "lineitem").select("l_orderkey", number).distinct().select(
        F.col("l_orderkey").alias("document_id"), F.concat_ws("#", F.col("l_orderkey").cast("string"), number.cast("string")).alias("chunk_id"), F.concat(F.lit("Điều "), number.cast("string")).alias("article"), F.when(number % 2 == 0, "Khoản 2").otherwise("").alias("clause"),
        F.when(number % 3 == 0, "theo khoản 2").otherwise("khác").alias("text"), F.lit("active").alias("status"), F.lit(None).cast("date").alias("effective_to"), F.lit(None).cast("string").alias("validity_note"),
    )
    docs, parts, edges = V.apply_document_actions(actions, docs, parts)
    none = F.lit(None).cast("string")
    provisions = F.array_join(F.transform("affected_provisions", lambda p: p["article"]), ",")
    return (
        docs.select(F.lit("document").alias("kind"), F.col("document_id").cast("string").alias("id"), F.col("validity_status").alias("status"), none.alias("date"), none.alias("note"), none.alias("other"))
        .unionByName(parts.select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("id"), "status", F.col("effective_to").cast("string").alias("date"), F.col("validity_note").alias("note"), none.alias("other")))
        .unionByName(edges.select(F.lit("edge").alias("kind"), F.col("document_id").cast("string").alias("id"), F.col("relation").alias("status"), F.col("effective_date").cast("string").alias("date"), F.concat_ws(" ", "scope", provisions).alias("note"), F.col("other_name").alias("other")))
    )


CHANGES_SQL = f"{CHUNKS_SQL}, ch as (select l_orderkey || '#' || l_linenumber as chunk_id, l_partkey * 1000 + l_suppkey as position, case l_suppkey % 5 when 0 then 'repeal' when 1 then 'replace' when 2 then 'amend' when 3 then 'add' else 'other' end as action from lineitem where l_returnflag = 'R')"


def changes(spark, sf):
    action = F.element_at(F.array(*map(F.lit, ["repeal", "replace", "amend", "add", "other"])), (F.col("l_suppkey") % 5 + 1).cast("int"))
    return T(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.concat_ws("#", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("chunk_id"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("position"), action.alias("action"))


@query("confirm_changes", f"with {CHANGES_SQL}, last as (select chunk_id, arg_max(action, position) as a from ch where action <> 'add' and position % 3 <> 0 group by 1) select chunk_id, coalesce(case a when 'repeal' then 'repealed' when 'replace' then 'superseded' when 'amend' then 'amended' when 'other' then 'active' end, 'active') as status from c left join last using (chunk_id)")
def _(spark, sf):
    selected = changes(spark, sf).where("position % 3 <> 0").select("position").distinct()
    return V.confirm_changes(changes(spark, sf), chunks(spark, sf), selected)[0].select("chunk_id", "status")


@query("map_changes", f"with {CHANGES_SQL} select action, count(*) as detected, count(c.chunk_id) as mapped, count(distinct c.chunk_id) as targets from ch left join c on c.chunk_id = ch.chunk_id group by 1")
def _(spark, sf):
    return V.map_changes(changes(spark, sf), chunks(spark, sf), "chunk_id", ["action"])


@query("patch_status", f"with {CHUNKS_SQL} select chunk_id, case when l_linenumber = 2 then 'repealed' else 'active' end as status from c")
def _(spark, sf):
    patch = chunks(spark, sf).where("article = '2'").select("chunk_id", F.lit("repealed").alias("status"))
    return V.patch_status(chunks(spark, sf), patch, "chunk_id").select("chunk_id", "status")


@query("sync_index", "select vec_id, case when quality = 0 then 'repealed' else 'active' end as status from embeddings left join labels on doc_id = vec_id")
def _(spark, sf):
    changed = T(spark, sf, "labels").where("quality = 0").select(F.col("doc_id").alias("vec_id"), F.lit("repealed").alias("status"))
    return V.patch_status(T(spark, sf, "embeddings").select("vec_id", F.lit("active").alias("status")), changed, "vec_id")


@query("reindex", f"with {CHUNKS_SQL} select chunk_id, l_orderkey % 7 <> 0 as old from c")
def _(spark, sf):
    rows = chunks(spark, sf).select("document_id", "chunk_id", F.lit(True).alias("old"))
    return V.reindex(rows, rows.where("document_id % 7 = 0").withColumn("old", F.lit(False)), "document_id").select("chunk_id", "old")


@query("effective_as_of", "with e as (select l_orderkey, arg_max(l_returnflag, strftime(l_shipdate, '%Y%m%d') || lpad(cast(l_partkey * 1000 + l_suppkey as varchar), 12, '0') || l_returnflag) as s from lineitem where l_shipdate <= date '1996-06-30' group by 1) select o_orderkey as l_orderkey, coalesce(s, 'active') as status from orders left join e on l_orderkey = o_orderkey")
def _(spark, sf):
    effects = T(spark, sf, "lineitem").select("l_orderkey", F.to_date("l_shipdate").alias("effective_from"), F.struct(F.col("l_partkey") * 1000 + F.col("l_suppkey"), F.col("l_returnflag")).alias("position"), F.col("l_returnflag").alias("status"))
    return V.effective_as_of(T(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey")), effects, "1996-06-30", "l_orderkey")


@query("ingest_manifest", "select doc_id, case when sum((length(trim(p)) >= 60)::int) > 0 then 'indexed' else 'error' end as status, cast(sum((length(trim(p)) >= 60)::int) as bigint) as n_chunks from (select doc_id, substring(text, cast(s as int) + 1, 900) as p, length(trim(text)) as n from (select doc_id, text, unnest(range(0, greatest(length(text) - 121, 0) + 1, 780)) as s from documents)) group by doc_id")
def _(spark, sf):
    docs = documents(spark, sf).withColumn("name", F.lit("file"))
    return C.ingest_manifest(docs.select("doc_id", "lang"), docs, "doc_id", "text", "name", sink=scratch(spark, "ingested"), clean=False, fallback="windows")


@query("read_json_docs", "select count(*) as n_files, cast(sum(n) as bigint) as n_orders from (select o_custkey % 4 as part, count(*) as n from orders group by 1)")
def _(spark, sf):
    path = scratch(spark, "json")
    rows = T(spark, sf, "orders").groupBy((F.col("o_custkey") % 4).alias("part")).agg(F.count("*").alias("n"))
    rows.repartition(4, "part").select(F.to_json(F.struct("part", "n")).alias("value"), "part").write.partitionBy("part").text(path)
    docs = S.read_json_docs(spark, f"{path}/*/*.txt")
    return docs.select(F.from_json("text", "n bigint")["n"].alias("n")).agg(F.count("*").alias("n_files"), F.sum("n").alias("n_orders"))


@query("read_xml_docs", "select case when n_nationkey % 5 = 4 then '' else n_name || ' & <' || n_regionkey || '>' || chr(10) || 'é ' || n_nationkey end as text from nation")
def _(spark, sf):
    path = scratch(spark, "xml")
    name = F.concat(F.lit('<nation id="a>b"><!-- <name>no</name> --><name> '), "n_name", F.lit(" &amp; &lt;"), F.col("n_regionkey").cast("string"), F.lit("&gt;</name>"))
    rest = F.concat(F.lit("<empty/><key><![CDATA[é ]]>"), F.col("n_nationkey").cast("string"), F.when(F.col("n_nationkey") % 5 == 4, "</kay>").otherwise("</key>"), F.lit("</nation>"))
    T(spark, sf, "nation").select("n_nationkey", F.concat(name, rest).alias("value")).write.partitionBy("n_nationkey").text(path)
    return S.read_xml_docs(spark, f"{path}/*/*.txt").select("text")


@query("chunk_sink", "select label as procedure_type, count(*) as n from embeddings join documents on doc_id = vec_id group by 1")
def _(spark, sf):
    path = scratch(spark, "index")
    vectors = T(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", F.col("label").alias("procedure_type"))
    held = documents(spark, sf).select(F.col("doc_id").alias("chunk_id"), "text").join(vectors.select("chunk_id"), "chunk_id", "left_semi")
    S.write_index(held, vectors.join(held.select("chunk_id"), "chunk_id", "left_semi"), path)
    return spark.read.parquet(path).groupBy("procedure_type").agg(F.count("*").alias("n"))


DASHED_SQL = f"{DOCS_SQL}, dashed as (select doc_id, regexp_replace(text, '(?m)^\\d+\\. ', '- ', 'g') as text from sdocs)"
PROCEDURES_SQL = f"{DASHED_SQL}, procs as (select doc_id, case when doc_id % 6 = 0 then text else regexp_replace(text, '(?m)^Điều (\\d+)\\. (\\w+) (\\w+)', '\\1. Thủ tục cấp đổi \\2 \\3', 'g') end as text from dashed)"


def dashed(spark, sf):
    return structured(spark, sf).withColumn("text", F.regexp_replace("text", "(?m)^\\d+\\. ", "- "))


def procedures(spark, sf):
    titled = F.regexp_replace("text", "(?m)^Điều (\\d+)\\. (\\w+) (\\w+)", "$1. Thủ tục cấp đổi $2 $3")
    return dashed(spark, sf).withColumn("text", F.when(F.col("doc_id") % 6 == 0, F.col("text")).otherwise(titled))


@query("split_procedures", f"with {PROCEDURES_SQL}, p as (select doc_id, text, list_filter(list_transform(string_split(regexp_replace(text, '(?m)^((?:[1-9]|[12]\\d|30|0[1-9])\\.\\s+\\pL.{{15,199}}$)', chr(1) || '\\1', 'g'), chr(1)), lambda x: trim(x, ' ' || chr(10))), lambda x: length(x) > 100 and regexp_matches(x, '^\\d+\\. ')) as b from procs), u as (select doc_id, len(b) > 0 as headed, unnest(case when len(b) > 0 then b else [text] end) as block from p) select doc_id, case when headed then trim(regexp_extract(block, '^\\d+\\. ([^\\n]*)', 1)) else 'Thủ tục đất đai' end as name, case when headed then 'cap_doi_gcn' else 'all' end as procedure_type, block from u")
def _(spark, sf):
    return C.split_procedures(procedures(spark, sf), "text").select("doc_id", F.col("procedure_name").alias("name"), "procedure_type", "block")


@query("split_subprocedures", f"with {DASHED_SQL}, subs as (select doc_id, case when doc_id % 6 = 3 then text else case when doc_id % 2 = 0 then '8. Cấp đổi giấy chứng nhận đất' || chr(10) else '' end || regexp_replace(text, '(?m)^Điều (\\d+)\\. ', '8.\\1 ', 'g') end as text from dashed), p as (select doc_id, text, list_transform(string_split(regexp_replace(text, '(?m)^(\\d{{1,2}}\\.\\d\\s+.{{10,200}})', chr(1) || '\\1', 'g'), chr(1))[2:], lambda x: trim(x, ' ' || chr(10))) as b from subs), k as (select *, list_filter(b, lambda x: length(x) >= 60) as kept from p), u as (select doc_id, unnest(case when len(kept) > 0 then list_transform(kept, lambda x: struct_pack(number := regexp_extract(x, '^(\\d+\\.\\d)', 1), parent := case when doc_id % 2 = 0 then 'Cấp đổi giấy chứng nhận đất' else 'Thủ tục 8' end, sub_name := substring(trim(regexp_extract(x, '^\\d+\\.\\d\\s+([^\\n]*)', 1)), 1, 150), block := x)) when len(b) > 0 then [struct_pack(number := '', parent := 'Quy trình nội bộ', sub_name := '', block := text)] when doc_id % 2 = 0 then [struct_pack(number := '', parent := 'Cấp đổi giấy chứng nhận đất', sub_name := '', block := text)] else [struct_pack(number := '', parent := 'Quy trình nội bộ đất đai', sub_name := '', block := text)] end) as x from k) select doc_id, x.number as number, x.parent as parent, x.sub_name as sub_name, x.block as block from u")
def _(spark, sf):
    headed = F.concat(F.when(F.col("doc_id") % 2 == 0, "8. Cấp đổi giấy chứng nhận đất\n").otherwise(""), F.regexp_replace("text", "(?m)^Điều (\\d+)\\. ", "8.$1 "))
    docs = dashed(spark, sf).withColumn("text", F.when(F.col("doc_id") % 6 == 3, F.col("text")).otherwise(headed))
    return C.split_subprocedures(docs, "text").select("doc_id", "number", "parent", "sub_name", "block")


@query("total_time_chunk", "select o_orderkey, cast(o_orderkey % 30 + 1 as varchar) || ' ngày' as chunk from orders where o_orderkey % 2 = 0")
def _(spark, sf):
    head = F.when(F.col("o_orderkey") % 2 == 0, "Tổng thời gian giải quyết TTHC: \n").otherwise("không có \n")
    text = F.concat(head, (F.col("o_orderkey") % 30 + 1).cast("string"), F.lit(" ngày"))
    return T(spark, sf, "orders").select("o_orderkey", C.total_time(text).alias("chunk")).where("chunk <> ''")


@query("detect_procedure_name", f"with {PROCEDURES_SQL} select doc_id, nullif(trim(regexp_extract(text, 'Thủ tục [^\\n]*')), '') as name from procs")
def _(spark, sf):
    return procedures(spark, sf).select("doc_id", C.doc_outline(F.col("text"))["procedure"].alias("name"))


@query("infer_parents", "select o_orderkey, c_custkey from orders join customer on contains(c_name, lpad(cast(o_custkey as varchar), 9, '0'))")
def _(spark, sf):
    hints = T(spark, sf, "orders").select("o_orderkey", F.lpad(F.col("o_custkey").cast("string"), 9, "0").alias("hint"))
    return infer_parents(hints, T(spark, sf, "customer").select("c_custkey", "c_name"), "hint", "c_name").select("o_orderkey", "c_custkey")


@query("patch_by_source", "select doc_id, case when source in ('src1', 'src2') then 'repealed' else 'active' end as status from documents")
def _(spark, sf):
    patch = documents(spark, sf).where("source in ('src1', 'src2')").select("source").distinct().withColumn("status", F.lit("repealed"))
    return V.patch_status(documents(spark, sf).select("doc_id", "source", F.lit("active").alias("status")), patch, "source").select("doc_id", "status")


@query("patch_by_ids", "select doc_id, case when toxic = 1 then 'repealed' else 'active' end as status from documents left join labels using (doc_id)")
def _(spark, sf):
    patch = T(spark, sf, "labels").where("toxic = 1").select("doc_id", F.lit("repealed").alias("status"))
    return V.patch_status(documents(spark, sf).select("doc_id", F.lit("active").alias("status")), patch, "doc_id")
