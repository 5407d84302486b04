"""Queries over scans, filters, joins, aggregates, windows, sorts and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import relational as R
from ..sources import tables as S
from ..sources.tables import read_table as T
from .registry import query
from .shared import scratch

AS_OF = "2024-01-30"
#: An event log as messages: a conversation per user, views are questions, errors are fallback answers.
MESSAGES = "select event_id, cast(ts as timestamp) ts, user_id, event_type, value from events"


def events(spark, sf):
    return T(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


@query("scan_table", "select o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) as price from orders")
def _(spark, sf):
    return T(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.round("o_totalprice", 2).alias("price"))


@query("read_case_csv", """
with t as (select conv_id % 4 as part, row_number() over (partition by conv_id % 4 order by conv_id, turn) + 1 as line, trim(text) as question, case when turn % 3 = 0 then cast(turn as varchar) else 'x' end as level, trim(role) as answer from conversations),
v as (select *, coalesce(length(question) >= 5 and length(answer) >= 5, false) as valid from t)
select part, line, valid, case when valid then md5(question) end as question, case when valid and regexp_full_match(level, '\\d+') then cast(level as int) end as level from v""".replace("\\\\", "\\"))
def _(spark, sf):
    path = scratch(spark, "cases")
    rows = T(spark, sf, "conversations").select((F.col("conv_id") % 4).alias("part"), "conv_id", "turn", F.col("text").alias("question"), F.col("role").alias("expected_answer"), F.when(F.col("turn") % 3 == 0, F.col("turn").cast("string")).otherwise("x").alias("level"))
    for part in range(4):  # a file each, with a header
        rows.where(F.col("part") == part).coalesce(1).sortWithinPartitions("conv_id", "turn").select("question", "expected_answer", "level").write.csv(f"{path}/bank={part}", header=True, quoteAll=True, escape='"')
    valid, wrong = S.read_cases_csv(spark, f"{path}/*/*.csv")
    part = F.regexp_extract("path", "bank=(\\d)", 1).cast("long").alias("part")
    valid = valid.select(part, (F.col("position") + 1).cast("long").alias("line"), F.lit(True).alias("valid"), F.md5("question").alias("question"), "level")
    return valid.unionByName(wrong.select(part, F.col("line").cast("long").alias("line"), F.lit(False).alias("valid"), F.lit(None).cast("string").alias("question"), F.lit(None).cast("int").alias("level")))


@query("read_case_json", "select cast(min(item_id) as varchar) as id, text as question, case when min(item_id) % 2 = 0 then 'a' else 'b' end as source, 1 as level from benchmark b where item_id >= 10 and not exists (select 1 from benchmark e where e.item_id < 10 and e.text = b.text) group by text")
def _(spark, sf):
    path = scratch(spark, "cases")
    cases = T(spark, sf, "benchmark")
    key = F.col("item_id")
    one = F.struct(F.lpad(key.cast("string"), 9, "0").alias("id"), F.col("text").alias("question"), F.lit("answer").alias("expected_answer"), F.when(key % 2 == 0, "a").alias("source"), F.when(key % 2 == 1, "b").alias("source_doc"))
    cases.where("item_id >= 10").groupBy((key % 3).alias("bank")).agg(F.to_json(F.collect_list(one)).alias("value")).write.partitionBy("bank").text(path)
    found = S.load_cases(cases.where("item_id < 10").select(F.col("text").alias("question")), S.read_cases_json(spark, f"{path}/*/*.txt"))
    return found.select(F.col("id").cast("long").cast("string").alias("id"), "question", "source", "level")


@query("export_cases", "select item_id, text as question, cast(row_number() over (order by item_id) as int) as line from benchmark")
def _(spark, sf):
    path = scratch(spark, "cases")
    S.export_json(T(spark, sf, "benchmark").select("item_id", F.col("text").alias("question")), path, "item_id")
    # the files are in order: their names, then the rows in them
    rows = spark.read.schema("item_id long, question string").json(path).select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"))
    return rows.select("item_id", "question", F.row_number().over(Window.orderBy("file", "block", "i")).alias("line"))


@query("assemble_pages", """
select l_orderkey as doc_id, coalesce(string_agg(p_name || ' ' || p_type, chr(10) || chr(10) order by l_linenumber) filter (length(regexp_replace(p_name || ' ' || p_type, '\\s', '', 'g')) >= 20), '') as text,
  count(*) as n_pages, count(*) filter (length(regexp_replace(p_name || ' ' || p_type, '\\s', '', 'g')) < 20) as n_empty
from lineitem join part on l_partkey = p_partkey group by l_orderkey""".replace("\\\\", "\\"))
def _(spark, sf):
    pages = T(spark, sf, "lineitem").join(T(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return S.assemble_pages(pages.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_no"), F.concat_ws(" ", "p_name", "p_type").alias("text")))


@query("scan_flag", """
with p as (select l_orderkey as doc_id, l_linenumber, length(trim(repeat('word ', cast(l_quantity as int)))) as n, row_number() over (partition by l_orderkey order by l_linenumber, l_quantity) as i from lineitem)
select doc_id, avg(n) < 50 as scanned from p where i <= 3 group by doc_id""")
def _(spark, sf):
    pages = T(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.struct("l_linenumber", "l_quantity").alias("page_no"), F.expr("repeat('word ', cast(l_quantity as int))").alias("text"))
    return S.flag_scanned(pages)


@query("page_html_text", None)
def _(spark, sf):
    return S.html_segments(T(spark, sf, "pages"))


@query("match_cached_text", """
with f as (select p_partkey as file, unnest(list_distinct(regexp_extract_all(p_name || ' ' || p_partkey, '\\d{2,5}'))) as number from part),
c as (select 'doc ' || doc_id as name, unnest(list_distinct(regexp_extract_all('doc ' || doc_id, '\\d{2,5}'))) as number from documents where length(text) > 50)
select file, min(name) as name from f join c using (number) group by file""".replace("\\\\", "\\"))
def _(spark, sf):
    files = T(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("file"))
    cache = T(spark, sf, "documents").select(F.concat_ws(" ", F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), "text")
    return S.match_cached_text(files, cache).join(files, "file").select(F.col("id").alias("file"), "name")


@query("scroll_scan", "select doc_id, lang, source from documents where lang = 'en' order by doc_id limit 10000")
def _(spark, sf):
    return S.scroll(T(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id", lang="en")


@query("index_stats", "select (select count(*) from documents) as n_docs, (select count(*) from documents where length(text) > 0) as n_indexed, (select count(*) from pages) as n_chunks, (select count(*) from embeddings) as n_points, (select cast(max(len(embedding)) as int) from embeddings) as size")
def _(spark, sf):
    return R.index_stats(T(spark, sf, "documents"), T(spark, sf, "pages"), T(spark, sf, "embeddings"), F.length("text") > 0, "embedding")


@query("rebuild_index", """
select o_orderkey, l_linenumber, cast(row_number() over (partition by o_orderkey order by l_linenumber) - 1 as int) as chunk_index, cast(len(list_filter(string_split_regex(p_name, '\\s+'), lambda x: x <> '')) as int) as token_estimate
from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey""".replace("\\\\", "\\"))
def _(spark, sf):
    chunks = T(spark, sf, "lineitem").join(T(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "p_name")
    return S.rebuild_index(chunks, T(spark, sf, "orders").select("o_orderkey"), "o_orderkey", "o_orderkey", "l_linenumber", "p_name")


@query("migrate_index", """
select vec_id, coalesce(case label % 4 when 0 then 'active' when 1 then 'amended' when 2 then 'repealed' end, 'active') as status, cast(len(embedding) as int) as size
from embeddings join documents on vec_id = doc_id where length(trim(text)) > 0""")
def _(spark, sf):
    status = F.when(F.col("label") % 4 == 0, "active").when(F.col("label") % 4 == 1, "amended").when(F.col("label") % 4 == 2, "repealed")
    index = T(spark, sf, "embeddings").join(T(spark, sf, "documents"), F.col("vec_id") == F.col("doc_id")).select("vec_id", "embedding", "text", status.alias("status"))
    return S.migrate_index(index, "embedding", "text", {"status": "active"}).select("vec_id", "status", F.size("embedding").alias("size"))


@query("backfill_status", "select vec_id, case when label % 4 = 3 or label % 4 = 2 then 'active' else 'l' || (label % 4) end as status from embeddings")
def _(spark, sf):
    index = T(spark, sf, "embeddings").select("vec_id", F.when(F.col("label") % 4 == 3, None).when(F.col("label") % 4 == 2, "").otherwise(F.concat(F.lit("l"), (F.col("label") % 4).cast("string"))).alias("status"))
    return S.backfill(index, "status", "active")


@query("filter_optional", "select o_orderkey, o_orderpriority from orders where o_orderstatus = 'F'")
def _(spark, sf):
    return R.filter_eq(T(spark, sf, "orders"), o_orderstatus="F", o_custkey=None).select("o_orderkey", "o_orderpriority")


@query("filter_in", "select doc_id, lang from documents where lang in ('de', 'fr')")
def _(spark, sf):
    return R.match_any(T(spark, sf, "documents").select("doc_id", "lang"), "lang", ["de", "fr"])


@query("exclude_expired", "select vec_id, label from embeddings where coalesce(case when label % 4 = 3 then null else label % 4 end not in (1, 2), true)")
def _(spark, sf):
    index = T(spark, sf, "embeddings").select("vec_id", "label", F.when(F.col("label") % 4 != 3, F.col("label") % 4).alias("status"))
    return R.exclude_expired(index, "status", [1, 2]).select("vec_id", "label")


@query("widen_procedure", "select c.c_custkey, count(*) as n from customer c join customer d on c.c_nationkey = d.c_nationkey and (c.c_mktsegment = d.c_mktsegment or c.c_mktsegment in ('BUILDING', 'MACHINERY') and d.c_mktsegment = 'FURNITURE') group by 1")
def _(spark, sf):
    customers = T(spark, sf, "customer")
    asked = customers.select("c_custkey", "c_nationkey", F.explode(R.widen(F.col("c_mktsegment"), {"BUILDING": ["FURNITURE"], "MACHINERY": ["FURNITURE"]})).alias("c_mktsegment"))
    held = customers.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("held"))
    return asked.join(held, ["c_nationkey", "c_mktsegment"]).groupBy("c_custkey").agg(F.sum("held").alias("n"))


@query("payload_defaults", "select e.vec_id, coalesce(d.lang, '') as lang, coalesce(d.n_chars, 0) as n_chars, coalesce(l.quality, 1) as quality from embeddings e left join documents d on vec_id = d.doc_id and d.lang <> 'en' left join labels l on l.doc_id = vec_id")
def _(spark, sf):
    docs = T(spark, sf, "documents").where("lang <> 'en'").select(F.col("doc_id").alias("vec_id"), "lang", "n_chars")
    labels = T(spark, sf, "labels").select(F.col("doc_id").alias("vec_id"), "quality")
    return R.with_defaults(T(spark, sf, "embeddings").select("vec_id").join(docs, "vec_id", "left").join(labels, "vec_id", "left"), lang="", n_chars=0, quality=1)


@query("search_contains", "select c_custkey from customer where contains(lower(c_name || ' ' || c_mktsegment), 'er#00000001') and c_nationkey = 3")
def _(spark, sf):
    return R.search_contains(T(spark, sf, "customer"), "ER#00000001", ["c_name", "c_mktsegment"], c_nationkey=3).select("c_custkey")


ASOF = "last_value(case when event_type = 'view' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row)"


@query("needs_attention", f"with m as ({MESSAGES}), q as (select *, {ASOF} as question_id from m) select event_id, question_id from q where event_type = 'error' or (event_type = 'click' and value < 0.6) order by ts desc, event_id desc limit 10")
def _(spark, sf):
    unsure = (F.col("event_type") == "error") | ((F.col("event_type") == "click") & (F.col("value") < 0.6))
    return R.needs_attention(events(spark, sf), "user_id", ["ts", "event_id"], F.col("event_type") == "view", F.col("event_id"), unsure).select("event_id", "question_id")


@query("owner_scope", "select event_id, event_type from events where user_id = 7")
def _(spark, sf):
    return R.filter_eq(events(spark, sf), user_id=7).select("event_id", "event_type")


@query("resolve_user_ids", """
with u as (select c_custkey, 'User' || c_custkey || '@Example.com' as email from customer),
l as (select event_id, case when event_id % 2 = 0 then 'USER' || user_id else ' user' || user_id || '@example.com' end as login from events)
select event_id, c_custkey from l join u on lower(trim(login)) = lower(email) or lower(trim(login)) = split_part(lower(email), '@', 1)""")
def _(spark, sf):
    users = T(spark, sf, "customer").select("c_custkey", F.concat(F.lit("User"), F.col("c_custkey").cast("string"), F.lit("@Example.com")).alias("email"))
    user = F.col("user_id").cast("string")
    log = events(spark, sf).select("event_id", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("USER"), user)).otherwise(F.concat(F.lit(" user"), user, F.lit("@example.com"))).alias("login"))
    return R.resolve_user_ids(log, users, "login", "email").select("event_id", "c_custkey")


@query("table_chunk_flag", "select doc_id, contains(text, '[Bảng') or (contains(text, '|') and contains(text, chr(10) || '| ---')) or contains(text, ' | ') as has_table from documents")
def _(spark, sf):
    return T(spark, sf, "documents").select("doc_id", R.flag_tables(F.col("text")).alias("has_table"))


@query("validate_enums", """
select o_orderkey, list_filter([case when o_orderstatus not in ('O', 'F') then 'status' end, case when o_totalprice > 300000 then 'price' end, case when o_orderpriority not in ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW') then 'priority' end], lambda x: x is not null) as errors from orders""")
def _(spark, sf):
    found = R.errors_of(status=~F.col("o_orderstatus").isin("O", "F"), price=F.col("o_totalprice") > 300000, priority=~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"))
    return T(spark, sf, "orders").select("o_orderkey", found.alias("errors"))


@query("validate_provisions", """
with p as (select l_orderkey, l_linenumber, case when l_linenumber % 4 = 0 then null else l_linenumber end as article, case when l_returnflag = 'R' then 'other' when l_returnflag = 'A' then 'amend' end as action from lineitem)
select l_orderkey, l_linenumber, article is not null and coalesce(action, 'repeal') in ('amend', 'repeal', 'add') as valid, coalesce(action, 'repeal') as action from p""")
def _(spark, sf):
    item = F.struct(F.when(F.col("l_linenumber") % 4 != 0, F.col("l_linenumber")).alias("article"), F.when(F.col("l_returnflag") == "R", "other").when(F.col("l_returnflag") == "A", "amend").alias("action"))
    rows = T(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.to_json(F.array(item)).alias("json"))
    return R.validate_provisions(rows, "json", rules.ACTIONS).select("l_orderkey", "l_linenumber", "valid", "action")


@query("join_chunks_docs", "select l_orderkey, l_linenumber, o_orderstatus from lineitem join orders on l_orderkey = o_orderkey")
def _(spark, sf):
    docs = T(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return R.join_chunks_docs(T(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), docs, "l_orderkey").select("l_orderkey", "l_linenumber", "o_orderstatus")


@query("join_message_owner", "select event_id, c_custkey from events join customer on user_id = c_custkey where event_type = 'error' and c_custkey between 5 and 50")
def _(spark, sf):
    owners = T(spark, sf, "customer").select("c_custkey", F.col("c_custkey").alias("user_id"))
    return R.join_message_owner(events(spark, sf), owners, "user_id", F.col("c_custkey").between(5, 50), event_type="error").select("event_id", "c_custkey")


@query("count_children", "select c_custkey, count(o_orderkey) as n_children from customer left join orders on c_custkey = o_custkey group by 1")
def _(spark, sf):
    return R.count_children(T(spark, sf, "customer").select("c_custkey"), T(spark, sf, "orders"), "c_custkey", "o_custkey")


@query("asof_question", f"with m as ({MESSAGES}) select event_id, {ASOF} as question_id from m")
def _(spark, sf):
    return R.asof_question(events(spark, sf), "user_id", ["ts", "event_id"], F.col("event_type") == "view", F.col("event_id"), "question_id").select("event_id", "question_id")


THETA = "with c as (select o_orderkey, o_custkey, 'Điều ' || (o_orderkey % 7 + 1) || '.' as article, case when o_orderkey % 3 = 0 then '' else 'khoản ' || (o_custkey % 3 + 1) end as clause from orders where o_orderstatus = 'O'), t as (select l_orderkey, l_linenumber, 'điều ' || l_linenumber as chunk_article, 'Khoản ' || (l_partkey % 3 + 1) as chunk_clause from lineitem)"


def _changes(spark, sf):
    number = lambda c: c.cast("string")
    changes = T(spark, sf, "orders").where("o_orderstatus = 'O'").select("o_orderkey", F.concat(F.lit("Điều "), number(F.col("o_orderkey") % 7 + 1), F.lit(".")).alias("article"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit("khoản "), number(F.col("o_custkey") % 3 + 1))).alias("clause"))
    chunks = T(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws("#", "l_orderkey", "l_linenumber").alias("chunk_id"), F.lit("").alias("text"), F.concat(F.lit("điều "), number(F.col("l_linenumber"))).alias("chunk_article"), F.concat(F.lit("Khoản "), number(F.col("l_partkey") % 3 + 1)).alias("chunk_clause"))
    return changes, chunks


@query("amend_theta", THETA + " select c.o_orderkey, count(*) as n from c join t on lower(replace(article, '.', '')) = lower(chunk_article) and t.l_orderkey = c.o_orderkey and (clause = '' or lower(clause) = lower(chunk_clause)) group by 1")
def _(spark, sf):
    changes, chunks = _changes(spark, sf)
    keyed = lambda df, key: df.withColumn("_k", F.col(key).cast("string"))
    c = keyed(changes, "o_orderkey").withColumn("article", F.concat_ws("@", "article", "_k")).drop("_k")
    t = keyed(chunks, "l_orderkey").withColumn("chunk_article", F.concat_ws("@", F.concat(F.col("chunk_article"), F.lit(" ")), "_k"))
    return R.amend_theta(c.withColumn("article", F.regexp_replace("article", "\\.@", " @")), t.drop("_k")).groupBy("o_orderkey").agg(F.count("*").alias("n"))


@query("repeal_theta", "with p as (select distinct 'Điều ' || (n_nationkey % 3 + 1) as article, n_regionkey from nation), t as (select l_orderkey, 'điều ' || (l_partkey % 30 + 1) as chunk_article from lineitem) select n_regionkey, article, count(*) as n from p join t on contains(chunk_article, lower(article)) group by all")
def _(spark, sf):
    provisions = T(spark, sf, "nation").select(F.concat(F.lit("Điều "), (F.col("n_nationkey") % 3 + 1).cast("string")).alias("article"), "n_regionkey").distinct()
    chunks = T(spark, sf, "lineitem").select("l_orderkey", F.concat(F.lit("điều "), (F.col("l_partkey") % 30 + 1).cast("string")).alias("chunk_article"))
    return R.repeal_theta(provisions, chunks, exact=False).groupBy("n_regionkey", "article").agg(F.count("*").alias("n"))


@query("anti_new_cases", "select item_id from benchmark where item_id not in (select doc_id from labels where quality = 0)")
def _(spark, sf):
    held = T(spark, sf, "labels").where("quality = 0").select(F.col("doc_id").alias("item_id"))
    return R.anti_new(T(spark, sf, "benchmark").select("item_id"), held, ["item_id"])


@query("semi_selected", "select doc_id, true as kept from documents where doc_id in (select vec_id from embeddings where label = 3) union all select vec_id, false from embeddings where label = 3 and vec_id not in (select doc_id from documents)")
def _(spark, sf):
    kept, rejected = R.semi_selected(T(spark, sf, "documents").select("doc_id"), T(spark, sf, "embeddings").where("label = 3").select(F.col("vec_id").alias("doc_id")), "doc_id")
    return kept.withColumn("kept", F.lit(True)).unionByName(rejected.withColumn("kept", F.lit(False)))


@query("dim_labels", "select o_orderkey, case o_orderstatus when 'O' then 'open' when 'F' then 'filled' else o_orderstatus end as label from orders")
def _(spark, sf):
    return T(spark, sf, "orders").select("o_orderkey", R.dim_labels(None, "o_orderstatus", {"O": "open", "F": "filled"}).alias("label"))


@query("assign_projects", "select c_custkey, o.o_custkey is not null as assigned from customer left join (select distinct o_custkey from orders where o_orderstatus = 'P') o on c_custkey = o_custkey")
def _(spark, sf):
    projects = T(spark, sf, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_orderkey") % 10).agg(F.collect_set("o_custkey").alias("ids"))
    return R.assign_projects(T(spark, sf, "customer").select("c_custkey"), projects, "c_custkey", "ids")


@query("doc_relation_edges", """
with a as (select o_orderkey as s, o_custkey as t, case o_orderstatus when 'O' then 'amend' when 'F' then 'replace' else 'partial_repeal' end as a from orders)
select s as document_id, t as other_id, case a when 'amend' then 'amends' when 'replace' then 'replaces' else 'partially_repeals' end as relation from a
union all select t, s, case a when 'amend' then 'amended_by' when 'replace' then 'replaced_by' else 'partially_repealed_by' end from a""")
def _(spark, sf):
    action = F.when(F.col("o_orderstatus") == "O", "amend").when(F.col("o_orderstatus") == "F", "replace").otherwise("partial_repeal")
    return R.relation_edges(T(spark, sf, "orders").select(F.col("o_orderkey").alias("source"), F.col("o_custkey").alias("target"), action.alias("action")))


@query("template_match", """
with f as (select p_partkey as id, lower(p_name) as title, [p_brand, p_type, cast(p_size as varchar)] as keys from part),
t as (select p_partkey as id, lower(p_name) as title, [p_brand, p_type, cast(p_size as varchar)] as keys from part qualify row_number() over (partition by p_brand order by p_partkey) = 1),
k as (select f.id as form, t.id as template, count(*) as overlap from (select id, unnest(list_distinct(keys)) as x from f) f join (select id, unnest(list_distinct(keys)) as x from t) t using (x) group by 1, 2),
h as (select f.id as form, t.id as template, count(*) as hits from (select id, unnest(list_distinct(string_split_regex(title, '\\W+'))) as x from f) f join (select id, unnest(list_distinct(string_split_regex(title, '\\W+'))) as x from t) t using (x) where x <> '' group by 1, 2),
s as (select form, template, overlap, coalesce(hits, 0) as hits, 100 * overlap + 10 * coalesce(hits, 0) as score from k left join h using (form, template))
select form, template, overlap, hits, score from s where overlap >= 2 or (overlap >= 1 and hits >= 1) qualify row_number() over (partition by form order by score desc, template) = 1""".replace("\\\\", "\\"))
def _(spark, sf):
    parts = T(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.array("p_brand", "p_type", F.col("p_size").cast("string")).alias("keys"), "p_brand")
    templates = R.top_by(parts, ["p_brand"], ["id"], 1).select("id", "title", "keys")
    return R.template_match(parts.drop("p_brand"), templates)


@query("count_where", """
select lang, count(*) as n, count(*) filter (quality = 1) as up, count(*) filter (toxic = 1) as fallback, cast(case when count(quality) > 0 then round_even(count(*) filter (quality = 1) / count(quality) * 100, 0) else 0 end as int) as up_pct
from documents left join labels using (doc_id) group by lang""")
def _(spark, sf):
    rows = T(spark, sf, "documents").join(T(spark, sf, "labels"), "doc_id", "left")
    up, rated = F.col("quality") == 1, F.col("quality").isNotNull()
    return R.count_where(rows, ["lang"], {"up": up, "fallback": F.col("toxic") == 1}, {"up_pct": (up, rated)})


@query("topic_topk", f"with t as (select event_type, count(*) as n from events where ts > timestamp '{AS_OF}' - interval 30 day and event_type is not null group by 1 order by n desc, event_type limit 3) select event_type, n, round_even(n / sum(n) over () * 100, 1) as share from t")
def _(spark, sf):
    return R.topic_topk(events(spark, sf).where(F.col("ts") > F.expr(f"timestamp '{AS_OF}' - interval 30 day")), "event_type")


@query("daily_stats", "with d as (select event_type from events where cast(ts as date) = date '2024-01-15') select count(*) filter (event_type = 'view') as questions, count(*) filter (event_type = 'click') as up, count(*) filter (event_type = 'error') as down, cast(case when count(*) filter (event_type in ('click', 'error')) > 0 then round_even(count(*) filter (event_type = 'click') / count(*) filter (event_type in ('click', 'error')) * 100, 0) else 0 end as int) as pct from d")
def _(spark, sf):
    of = lambda *types: F.col("event_type").isin(*types)
    return R.daily_stats(events(spark, sf), "ts", "2024-01-15", {"questions": of("view"), "up": of("click"), "down": of("error")}, (of("click"), of("click", "error")))


@query("count_subquery", "select o_orderkey, (select count(*) from orders where o_orderstatus = 'O') as total from orders where o_orderstatus = 'O' order by o_orderkey limit 20 offset 20")
def _(spark, sf):
    rows = R.filter_eq(T(spark, sf, "orders"), o_orderstatus="O").select("o_orderkey")
    return R.count_subquery(rows, ["o_orderkey"], 2, 20)


@query("status_breakdown", "select o_orderpriority, count(*) filter (o_orderstatus = 'F') as \"F\", count(*) filter (o_orderstatus = 'O') as \"O\", count(*) filter (o_orderstatus = 'P') as \"P\" from orders group by 1")
def _(spark, sf):
    return R.status_breakdown(T(spark, sf, "orders"), ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"])


@query("majority_type", "with c as (select user_id, event_type, count(*) as n from events group by all) select user_id, event_type as majority from c qualify row_number() over (partition by user_id order by n desc, event_type) = 1")
def _(spark, sf):
    return R.majority(events(spark, sf), "user_id", "event_type", "unknown")


@query("run_summary", """
select month(o_orderdate) as run_id, count(*) as total, count(*) filter (o_orderstatus = 'F' and o_totalprice >= 150000) as passed, round(avg(case when o_orderstatus = 'F' then o_totalprice end), 4) as mean_valid, round(avg(o_totalprice), 4) as mean_all,
  round(avg(case when o_orderstatus = 'F' then case when o_orderpriority = '1-URGENT' then 1.0::double else 0 end end), 4) as citation_rate, round(avg(cast(o_orderkey % 1000 as double)), 4) as latency from orders group by 1""")
def _(spark, sf):
    from ..operators.evaluation import run_summary
    
    rows = T(spark, sf, "orders").withColumn("run_id", F.month("o_orderdate").cast("long"))
    return run_summary(rows, "run_id", F.col("o_orderstatus") == "F", F.col("o_totalprice"), 150000, {"citation_rate": F.col("o_orderpriority") == "1-URGENT"}, {"latency": F.col("o_orderkey") % 1000})


@query("group_min_order", "select 'nation' as \"group\", cast(s_nationkey as varchar) as name, min(s_suppkey) as first_order from supplier group by 2 union all select 'parent', cast(s_nationkey % 5 as varchar), min(s_suppkey) from supplier where s_acctbal > 0 group by 2")
def _(spark, sf):
    fields = T(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), F.when(F.col("s_acctbal") > 0, F.col("s_nationkey") % 5).alias("parent"))
    return R.group_min_order(fields, ["nation", "parent"], "s_suppkey")


@query("one_of_groups", "select l_orderkey, bool_or(l_returnflag = 'R') as fulfilled, count(*) >= 2 and not bool_or(l_linestatus = 'O') as valid from lineitem group by 1")
def _(spark, sf):
    return R.one_of_groups(T(spark, sf, "lineitem"), ["l_orderkey"], F.col("l_returnflag") == "R", F.col("l_linestatus") == "O")


@query("concat_group", "select l_orderkey, string_agg(cast(l_partkey as varchar), ',' order by l_linenumber, l_partkey) as parts from lineitem group by 1")
def _(spark, sf):
    return R.concat_group(T(spark, sf, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey"], "l_partkey", ",", "parts")


@query("ocr_confidence", "with p as (select l_orderkey, l_suppkey % 3 as page, avg(case when l_returnflag <> 'N' then l_discount end) as c from lineitem group by 1, 2) select l_orderkey, round(avg(coalesce(c, 0)), 6) as confidence from p group by 1")
def _(spark, sf):
    lines = T(spark, sf, "lineitem").withColumn("page", F.col("l_suppkey") % 3)
    return R.ocr_confidence(lines, "l_orderkey", "page", F.when(F.col("l_returnflag") != "N", F.col("l_discount")))


@query("checklist_progress", "select o_custkey, count(*) as n, count(*) filter (o_orderstatus = 'F') as done, cast(round(count(*) filter (o_orderstatus = 'F') / count(*) * 100) as int) as pct from orders group by 1")
def _(spark, sf):
    return R.checklist_progress(T(spark, sf, "orders"), ["o_custkey"], F.col("o_orderstatus") == "F")


@query("rank_per_query", "select l_suppkey, l_orderkey, l_linenumber, cast(row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber) as int) as rank from lineitem")
def _(spark, sf):
    return R.rank_per_query(T(spark, sf, "lineitem"), ["l_suppkey"], "l_extendedprice", ["l_orderkey", "l_linenumber"]).select("l_suppkey", "l_orderkey", "l_linenumber", "rank")


@query("minmax_norm", """
with s as (select o_orderkey, o_totalprice as s, min(o_totalprice) over (partition by o_custkey) as lo, max(o_totalprice) over (partition by o_custkey) as hi, o_shippriority as p from (select *, o_orderkey % 10 / 10.0 as o_shippriority from orders))
select o_orderkey, round(0.8 * case when hi > lo then (s - lo) / (hi - lo) else 1.0 end + 0.2 * p, 6) as score from s""")
def _(spark, sf):
    rows = T(spark, sf, "orders").withColumn("prior", F.col("o_orderkey") % 10 / 10.0)
    return rows.select("o_orderkey", F.round(R.minmax_norm(rows, "o_custkey", "o_totalprice", "prior"), 6).alias("score"))


@query("max_norm", "select o_orderkey, round(case when max(o_totalprice) over (partition by o_custkey) > 0 then o_totalprice / max(o_totalprice) over (partition by o_custkey) else 0 end, 6) as score from orders")
def _(spark, sf):
    return T(spark, sf, "orders").select("o_orderkey", F.round(R.max_norm("o_custkey", "o_totalprice"), 6).alias("score"))


@query("last_n_messages", "select conv_id, turn, role from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 3 order by conv_id, turn")
def _(spark, sf):
    return R.last_n(T(spark, sf, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", 3).orderBy("conv_id", "turn")


@query("run_diffs", """
with r as (select cast(month(o_orderdate) as bigint) as run_id, round(avg(o_totalprice) / 100000, 4) as metric from orders group by 1), t as (select * from r order by run_id desc limit 6)
select run_id, metric, round_even((metric - lag(metric) over (order by run_id)) * 100, 1) as diff from t""")
def _(spark, sf):
    runs = T(spark, sf, "orders").groupBy(F.month("o_orderdate").cast("long").alias("run_id")).agg(F.round(F.avg("o_totalprice") / 100000, 4).alias("metric"))
    return R.run_diffs(runs, ["run_id"], "metric")


@query("first_seen_dedupe", "select l_orderkey, l_suppkey, l_linenumber from lineitem qualify row_number() over (partition by l_orderkey, l_suppkey order by l_linenumber) = 1")
def _(spark, sf):
    return R.first_seen(T(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber"), ["l_orderkey"], "l_suppkey", "l_linenumber")


@query("enumerate_chunks", "select l_orderkey, l_linenumber, cast(row_number() over (partition by l_orderkey order by l_linenumber) - 1 as int) as chunk_index from lineitem")
def _(spark, sf):
    return R.enumerate_chunks(T(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey"], ["l_linenumber"])


@query("carry_parent", "select l_orderkey, l_linenumber, last_value(case when l_returnflag = 'R' then l_linenumber end ignore nulls) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity rows between unbounded preceding and current row) as parent from lineitem")
def _(spark, sf):
    rows = R.carry(T(spark, sf, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], F.when(F.col("l_returnflag") == "R", F.col("l_linenumber")), "parent")
    return rows.select("l_orderkey", "l_linenumber", "parent")


@query("reading_order", "select l_orderkey, l_linenumber, cast(row_number() over (partition by l_orderkey order by floor(l_extendedprice / 6000), l_quantity, l_linenumber) as int) as place from lineitem")
def _(spark, sf):
    rows = R.reading_order(T(spark, sf, "lineitem"), ["l_orderkey"], "l_extendedprice", ["l_quantity", "l_linenumber"], 6000)
    return rows.select("l_orderkey", "l_linenumber", "place")


@query("group_digits", "select l_orderkey, l_linenumber, cast(row_number() over (partition by l_orderkey, l_returnflag order by l_linenumber) - 1 as int) as digit_index from lineitem")
def _(spark, sf):
    return R.group_digits(T(spark, sf, "lineitem"), ["l_orderkey", "l_returnflag"], ["l_linenumber"]).select("l_orderkey", "l_linenumber", "digit_index")


@query("order_by_keys", "select o_orderkey, o_orderstatus from orders order by o_orderstatus desc, o_orderkey")
def _(spark, sf):
    return R.order_by_keys(T(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), [F.desc("o_orderstatus")], "o_orderkey")


@query("topk_per_query", "select l_suppkey, l_orderkey, l_linenumber, cast(row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber) as int) as rank from lineitem qualify rank <= 6")
def _(spark, sf):
    return R.top_by(T(spark, sf, "lineitem"), ["l_suppkey"], [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"], 6).select("l_suppkey", "l_orderkey", "l_linenumber", "rank")


@query("page_offset", "select c_custkey, c_name from customer order by c_name, c_custkey limit 100 offset 100")
def _(spark, sf):
    return R.page_offset(T(spark, sf, "customer").select("c_custkey", "c_name"), ["c_name", "c_custkey"], 2, 500)


@query("limit_cases", "select item_id from benchmark where length(text) > 100 order by item_id limit 50")
def _(spark, sf):
    return R.limit_cases(T(spark, sf, "benchmark").where(F.length("text") > 100).select("item_id"), "item_id", 50)


@query("order_fields", "select p_partkey, cast(row_number() over (partition by p_brand order by coalesce(case when p_partkey % 11 = 0 then 6 end, case when p_size % 5 > 0 then p_size end, p_partkey * 100), p_partkey) as int) as place from part")
def _(spark, sf):
    fields = T(spark, sf, "part").select("p_partkey", "p_brand", F.when(F.col("p_size") % 5 > 0, F.col("p_size").cast("long")).alias("display_order"), (F.col("p_partkey") - 1).alias("at"), F.when(F.col("p_partkey") % 11 == 0, 7).alias("members_first"))
    return R.order_fields(fields, ["p_brand"], "display_order", "at", "p_partkey", "members_first").select("p_partkey", "place")


@query("union_candidates", "select doc_id, 'dense' as origin, lang, null as label from documents union all select vec_id, 'lexical', null, label from embeddings")
def _(spark, sf):
    lexical = T(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return R.union_candidates(dense=T(spark, sf, "documents").select("doc_id", "lang"), lexical=lexical)


@query("ids_except", "select doc_id from documents except all select doc_id from labels")
def _(spark, sf):
    return R.ids_except(T(spark, sf, "documents"), T(spark, sf, "labels"), "doc_id")


@query("relations_union", "select c_custkey, list_sort(list_concat([0], coalesce((select list(o_orderkey) from orders where o_custkey = c_custkey), []))) as relations from customer")
def _(spark, sf):
    edges = T(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    rows = T(spark, sf, "customer").select("c_custkey", F.array(F.lit(0).cast("long")).alias("relations"))
    return R.relations_union(rows, edges, "c_custkey", "relations", "o_orderkey")


@query("upsert_by_key", "select coalesce(l.doc_id, d.doc_id) as doc_id, coalesce(case when l.quality = 1 then 'good' end, d.lang) as lang from documents d full join labels l on d.doc_id = l.doc_id")
def _(spark, sf):
    new = T(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").alias("lang"))
    return R.upsert_by_key(T(spark, sf, "documents").select("doc_id", "lang"), new, "doc_id")


@query("delete_cascade", "select l_orderkey, l_linenumber from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'P')")
def _(spark, sf):
    gone = T(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return R.delete_cascade(gone, "l_orderkey", T(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"))[0]


@query("retention_clear", "select event_id from events where user_id not in (select c_custkey from customer where c_nationkey < 5)")
def _(spark, sf):
    gone = T(spark, sf, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("user_id"))
    return R.retention_clear("user_id", events(spark, sf), ids=gone)[0].select("event_id")
