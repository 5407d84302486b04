"""Queries over conversations and form submissions. Submissions are customers."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import conversations as C
from ..operators import submissions as S
from ..operators.submissions import Field
from ..sources.tables import read_table as T
from .registry import query

ACCENTS_SQL = "trim(regexp_replace(replace(strip_accents(lower({})), 'đ', 'd'), '\\s+', ' ', 'g'))"
PHRASES = ["tiep tuc dien", "toi muon tra cuu", "ke khai thue dat", "nop thay giup toi", "huy don", "the and"]


def said(spark, sf):
    """Conversations with a phrase that routing knows, by turn."""
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("turn") % 6 + 1).cast("int"))
    return T(spark, sf, "conversations").select("conv_id", "turn", "role", F.when(F.col("conv_id") % 2 == 0, F.concat_ws(" ", "text", phrase)).otherwise(F.col("text")).alias("text"))


SAID_SQL = "said as (select conv_id, turn, role, case when conv_id % 2 = 0 then text || ' ' || [" + ", ".join(f"'{p}'" for p in PHRASES) + "][turn % 6 + 1] else text end as text from conversations)"
PLAIN_SQL = f"{SAID_SQL}, plain as (select *, {ACCENTS_SQL.format('text')} as p from said)"


def any_sql(column, words):
    return "(" + " or ".join(f"contains({column}, '{w}')" for w in words) + ")"


ROUTE_SQL = "case " + " ".join(f"when {any_sql('p', ws)} then '{n}'" for n, ws in rules.MODES.items()) + " else 'unknown' end"


@query("route_mode", f"with {PLAIN_SQL} select conv_id, turn, {ROUTE_SQL} as mode from plain")
def _(spark, sf):
    return said(spark, sf).select("conv_id", "turn", C.route_mode(F.col("text")).alias("mode"))


@query("out_of_scope", f"with {PLAIN_SQL} select conv_id, turn, {any_sql('p', rules.OUT_OF_SCOPE)} as out from plain")
def _(spark, sf):
    return said(spark, sf).select("conv_id", "turn", C.out_of_scope(F.col("text")).alias("out"))


@query("resolve_mode", f"with {PLAIN_SQL}, r as (select conv_id, turn, {ROUTE_SQL} as m from plain) select conv_id, turn, case when m in ('rag', 'exit_form') then 'rag' when m in ('form', 'resume_form') then 'form' when turn % 2 = 0 then 'rag' else 'form' end as mode from r")
def _(spark, sf):
    saved = F.when(F.col("turn") % 2 == 0, "rag").otherwise("form")
    return said(spark, sf).select("conv_id", "turn", C.resolve_mode(saved, C.route_mode(F.col("text"))).alias("mode"))


@query("match_form", f"with {PLAIN_SQL} select conv_id, turn, case when {any_sql('p', C.INFO)} then null when contains(p, 'thue dat') then 'tax' when contains(p, 'the and') then 'transfer' end as form from plain")
def _(spark, sf):
    forms = spark.createDataFrame([("tax", 1, "thue dat|khai thue"), ("transfer", 2, "the and|bien dong")], "form string, position int, family string")
    return C.match_form(said(spark, sf), forms, ["conv_id", "turn"], "text")


@query("digression", f"with {SAID_SQL} select conv_id, turn, case when contains(text, ';') then 'FILL' when contains(text, '?') then 'ASK_LEGAL' else 'FILL' end as intent from said")
def _(spark, sf):
    return said(spark, sf).select("conv_id", "turn", C.digression(F.col("text")).alias("intent"))


@query("skip_detect", f"with {PLAIN_SQL} select conv_id, turn, turn % 2 = 1 and len(string_split(p, ' ')) <= 6 and contains(p, 'the') as skipped from plain")
def _(spark, sf):
    return said(spark, sf).select("conv_id", "turn", C.skip_detect(F.col("text"), F.col("turn") % 2 == 1, ["the"]).alias("skipped"))


@query("turn_pairs", "with n as (select *, lead(role) over w as r, lead(text) over w as answer, lead(turn) over w as answer_turn from conversations window w as (partition by conv_id order by turn)) select conv_id, turn, answer_turn, answer from n where role = 'user' and r = 'assistant'")
def _(spark, sf):
    return C.turn_pairs(T(spark, sf, "conversations").select("conv_id", "turn", "role", "text"), "conv_id", "turn").select("conv_id", "turn", "answer_turn", "answer")


@query("conversation_detail", "select conv_id, cast(count(*) as int) as n, string_agg(role, ',' order by turn) as roles from conversations group by 1")
def _(spark, sf):
    rows = C.conversation_detail(T(spark, sf, "conversations"), "conv_id", "turn", ["role", "text"])
    return rows.select("conv_id", F.size("messages").alias("n"), F.array_join("messages.role", ",").alias("roles"))


@query("record_feedback", "with f as (select user_id as conv_id, arg_max(cast(value > 50 as int), event_id) as value from events where event_type = 'click' and event_id % 3 <> 0 group by 1) select conv_id, turn, case when role = 'assistant' then value end as feedback from conversations left join f using (conv_id)")
def _(spark, sf):
    # every third click comes from another user than the conversation's
    by = F.when(F.col("event_id") % 3 == 0, F.col("user_id") + 1).otherwise(F.col("user_id"))
    feedback = T(spark, sf, "events").where("event_type = 'click'").select(F.col("user_id").alias("conv_id"), (F.col("value") > 50).cast("int").alias("value"), "event_id", by.alias("given_by"))
    messages = T(spark, sf, "conversations").select("conv_id", "turn", "role", F.col("conv_id").alias("user_id"))
    return C.record_feedback(messages, feedback, ["conv_id"], "event_id", "user_id", "given_by").select("conv_id", "turn", "feedback")


FIELDS = [
    Field("name", "name", order=1),
    Field("segment", "choice", order=2, options=["BUILDING", "MACHINERY", "FURNITURE"]),
    Field("balance", "number", order=3),
    Field("nation", "digits", order=4),
    Field("builds", "boolean", derived_from=("segment", "BUILDING")),
    Field("permit", "digits", order=5, depends_on=("segment", "BUILDING")),
    Field("inspector", order=6, depends_on=("permit", "7")),
    Field("phone", "phone", order=7, group="contact"),
    Field("email", "email", order=8, group="contact"),
    Field("score", order=9, formula="([nation] * 2 + 1) / [permit]"),
]
SUBMITTED_SQL = "s as (select c_custkey as id, lower(c_name) as name, c_mktsegment as segment, case when c_custkey % 4 = 0 then null else replace(cast(c_nationkey as varchar), '.', '') end as nation, case when c_custkey % 3 = 0 then '7' when c_custkey % 3 = 1 then '0' end as permit, case when c_custkey % 5 = 0 then 'a@b.vn' end as email, case when c_custkey % 7 = 0 then '12' end as phone from customer)"


def submissions(spark, sf):
    k = F.col("c_custkey")
    values = {"name": F.lower("c_name"), "segment": F.col("c_mktsegment"), "nation": F.when(k % 4 != 0, F.col("c_nationkey").cast("string")), "permit": F.when(k % 3 == 0, "7").when(k % 3 == 1, "0"), "email": F.when(k % 5 == 0, "a@b.vn"), "phone": F.when(k % 7 == 0, "12")}
    answers = F.map_filter(F.create_map(*(x for n, v in values.items() for x in (F.lit(n), v))), lambda _, v: v.isNotNull())
    return T(spark, sf, "customer").select(k.alias("id"), answers.alias("answers"))


@query("normalize_values", "select c_custkey as id, upper(substring(c_name, 1, 1)) || lower(substring(c_name, 2)) as name from customer")
def _(spark, sf):
    return S.normalize_values(submissions(spark, sf), FIELDS).select("id", S.value("name").alias("name"))


@query("validate_values", f"with {SUBMITTED_SQL} select id, list_filter([case when segment not in ('BUILDING', 'MACHINERY', 'FURNITURE') then 'segment' end, case when phone is not null then 'phone' end], lambda x: x is not null) as invalid from s")
def _(spark, sf):
    return submissions(spark, sf).select("id", S.invalid_keys(FIELDS).alias("invalid"))


@query("auto_fill_flag", "select p_partkey, case when p_size % 5 = 0 then true when p_size % 5 = 1 then false else p_partkey % 7 = 0 or contains(p_name, 'steel') or p_partkey % 3 = 0 end as auto from part")
def _(spark, sf):
    source = F.when(F.col("p_size") % 5 == 0, "formula").when(F.col("p_size") % 5 == 1, "user_input")
    description = F.when(F.col("p_name").contains("steel"), S.AUTO_FILL_TAG)
    name = F.when(F.col("p_partkey") % 3 == 0, "Nơi nhận").otherwise(F.col("p_name"))
    return T(spark, sf, "part").select("p_partkey", S.auto_fill_flag(source, F.col("p_partkey") % 7 == 0, description, name).alias("auto"))


@query("derive_fields", f"with {SUBMITTED_SQL} select id, case when segment = 'BUILDING' then 'có' else 'không' end as builds from s")
def _(spark, sf):
    return S.derive_fields(submissions(spark, sf), FIELDS).select("id", S.value("builds").alias("builds"))


@query("apply_dependencies", f"with {SUBMITTED_SQL}, p as (select id, case when segment <> 'BUILDING' then '{S.SKIPPED}' else permit end as permit from s) select id, permit, case when permit = '{S.SKIPPED}' or permit <> '7' then '{S.SKIPPED}' end as inspector from p")
def _(spark, sf):
    rows = S.apply_dependencies(submissions(spark, sf), FIELDS)
    return rows.select("id", F.try_element_at("answers", F.lit("permit")).alias("permit"), F.try_element_at("answers", F.lit("inspector")).alias("inspector"))


@query("settle_one_of", f"with {SUBMITTED_SQL} select id, case when phone is not null then phone when email is not null then '{S.SKIPPED}' end as phone, case when email is not null then email when phone is not null then '{S.SKIPPED}' end as email from s")
def _(spark, sf):
    rows = S.settle_one_of(submissions(spark, sf), FIELDS)
    return rows.select("id", *(F.try_element_at("answers", F.lit(k)).alias(k) for k in ("phone", "email")))


@query("calc_fields", f"with {SUBMITTED_SQL} select id, case when nation is not null and permit = '7' then (cast(nation as double) * 2 + 1) / 7 end as score from s")
def _(spark, sf):
    return S.calc_fields(submissions(spark, sf), FIELDS).select("id", S.value("score").cast("double").alias("score"))


@query("missing_fields", f"""with {SUBMITTED_SQL} select id, 'balance' as field, 3 as place from s union all select id, 'nation', 4 from s where nation is null union all select id, 'permit', 5 from s where permit is null
union all select id, 'inspector', 6 from s where permit is not null union all select id, 'phone', 7 from s where phone is null and email is null""")
def _(spark, sf):
    return S.missing_fields(submissions(spark, sf), FIELDS)


@query("required_missing", f"with {SUBMITTED_SQL} select id, list_filter(['balance', case when nation is null then 'Quốc gia' end, 'builds', case when permit is null then 'permit' end, 'inspector', case when phone is null then 'phone' end, case when email is null then 'email' end, 'score', case when segment is null then 'Ngành' end], lambda x: x is not null) as missing from s")
def _(spark, sf):
    named = [replace(f, name="Quốc gia", box=("nation", 0)) if f.key == "nation" else f for f in FIELDS]
    more = [Field("nation_2", name="Quốc gia", box=("nation", 1)), Field("branch", name="Ngành")]
    rows = submissions(spark, sf).withColumn("answers", F.map_concat("answers", F.create_map(F.lit("Ngành"), F.try_element_at("answers", F.lit("segment")))))
    return S.required_missing(rows, [*named, *more])


TAX_SQL = ", ".join(f"trim(substring(rpad(c, 13, ' '), {place + 1}, 1)) as mst_1_{box}" for place, box in enumerate(S.TAX_BOXES))


@query("render_values", f"with {SUBMITTED_SQL} select s.id, coalesce(segment, '') as segment, case when segment = 'BUILDING' then 'X' else '' end as builds, coalesce(array_to_string(string_split(nation, ''), ' '), '') as nation, case when nation is null then '' else substring(nation, 1, 1) end as box0, case when nation is null then '' when length(nation) > 1 then substring(nation, 2, 1) else ' ' end as box1, {TAX_SQL} from s join (select c_custkey as id, regexp_replace(c_name, '\\D', '', 'g') as c from customer) using (id)".replace("\\\\", "\\"))
def _(spark, sf):
    boxes = [Field(f"box{i}", box=("nation", i)) for i in (0, 1)]
    rows = S.render_values(S.derive_fields(submissions(spark, sf), FIELDS), [*FIELDS, *boxes], tax={"name": [1]})
    return rows.drop("name", "balance", "permit", "inspector", "phone", "email", "score")


@query("co_owner_rows", """select o_custkey as id, cast(o_orderkey % 9 + 1 as int) as owner, max(o_orderstatus) as name, cast(max(o_orderkey) as varchar) as tax_id, max(case when o_orderkey % 2 = 0 then cast(cast(o_orderdate as date) as varchar) end) as identity, cast(max(o_orderkey % 100) as varchar) || '%' as share from orders group by 1, 2""")
def _(spark, sf):
    n = (F.col("o_orderkey") % 9 + 1).cast("string")
    attributes = {"tên đồng sở hữu": F.max("o_orderstatus"), "mst dsh": F.max("o_orderkey").cast("string"), "cccd của dsh": F.max(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate").cast("date").cast("string"))), "ty_le_": F.max(F.col("o_orderkey") % 100).cast("string")}
    one = T(spark, sf, "orders").groupBy("o_custkey", n.alias("n")).agg(*(v.alias(str(i)) for i, v in enumerate(attributes.values())))
    # the share's owner stands in its field's name
    entries = F.array(*(F.struct(F.concat(F.lit(a if a == "ty_le_" else f"{a} "), "n").alias("k"), F.col(str(i)).alias("v")) for i, a in enumerate(attributes)))
    answers = F.map_from_entries(F.filter(F.flatten(F.collect_list(entries)), lambda e: e["v"].isNotNull()))
    fields = [Field(f"ty_le_{i}", name=f"Tỷ lệ phần của người {i}") for i in range(1, 10)]
    return S.co_owners(one.groupBy(F.col("o_custkey").alias("id")).agg(answers.alias("answers")), fields)


@query("extract_declared", """select c_custkey, '0' || lpad(cast(c_custkey as varchar), 9, '1') as phone, case when c_custkey % 5 = 0 then '__skipped__' else 'u' || c_custkey || '@mail.vn' end as email, c_name as name, 'Cccd số ' || lpad(cast(c_custkey as varchar), 12, '0') as identity, c_custkey || ' ' || c_mktsegment as address, 'Vĩnh Long' as place from customer""")
def _(spark, sf):
    k = F.col("c_custkey").cast("string")
    email = F.when(F.col("c_custkey") % 5 == 0, "không có email").otherwise(F.concat(F.lit("email u"), k, F.lit("@mail.vn")))
    text = F.concat(F.lit("Tôi tên là "), "c_name", F.lit("; Cccd số "), F.lpad(k, 12, "0"), F.lit("; địa chỉ: "), k, F.lit(" "), "c_mktsegment", F.lit("; sđt 0"), F.lpad(k, 9, "1"), F.lit("; "), email, F.lit("; nơi viết đơn là Vĩnh Long."))
    found = T(spark, sf, "customer").select("c_custkey", S.extract_declared(text).alias("d"))
    return found.select("c_custkey", *(F.try_element_at("d", F.lit(x)).alias(x) for x in ("phone", "email", "name", "identity", "address", "place")))


@query("submission_history", "select o_custkey, o_orderpriority, count(*) as n, cast(max(o_orderdate) as date) as last from orders group by 1, 2")
def _(spark, sf):
    log = T(spark, sf, "orders").withColumn("day", F.to_date("o_orderdate"))
    return S.submission_history(log, ["o_custkey", "o_orderpriority"], "day")


@query("fallback_log", "with q as (select event_id, event_type, ts, last_value(case when event_type = 'view' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as question_id from events) select event_id, question_id, strftime(ts, '%H:%M') as \"at\" from q where event_type = 'error' order by ts desc, event_id desc limit 5")
def _(spark, sf):
    from ..operators.relational import fallback_log
    from .relational import events
    
    rows = fallback_log(events(spark, sf), "user_id", ["ts", "event_id"], F.col("event_type") == "view", F.col("event_id"), F.col("event_type") == "error")
    return rows.select("event_id", "question_id", "at")


@query("overview", """
with r as (select cast(month(o_orderdate) as bigint) as run_id, round(avg(o_totalprice) / 100000, 4) as price, round(avg(case when o_orderstatus = 'F' then 1.0::double else 0 end), 4) as filled from orders group by 1),
t as (select * from r order by run_id desc limit 6), l as (select run_id, 'price' as name, price as v from t union all select run_id, 'filled', filled from t)
select 'metric' as section, name, run_id as place, round_even(v * 100, 1) as value, round_even((v - lag(v) over (partition by name order by run_id)) * 100, 1) as diff from l
union all select 'data', 'n_docs', null, cast((select count(*) from documents) as double), null union all select 'data', 'n_questions', null, cast((select count(*) from conversations where role = 'user') as double), null
union all select 'data', 'up', null, cast((select count(*) from labels where quality = 1) as double), null union all select 'data', 'down', null, cast((select count(*) from labels where quality = 0) as double), null""")
def _(spark, sf):
    from ..operators.evaluation import overview
    
    filled = F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0))
    runs = T(spark, sf, "orders").groupBy(F.month("o_orderdate").cast("long").alias("run_id")).agg(F.round(F.avg("o_totalprice") / 100000, 4).alias("price"), F.round(filled, 4).alias("filled"))
    docs = T(spark, sf, "documents").agg(F.count("*").alias("n_docs"))
    asked = T(spark, sf, "conversations").agg(F.count_if(F.col("role") == "user").alias("n_questions"))
    rated = T(spark, sf, "labels").agg(F.count_if(F.col("quality") == 1).alias("up"), F.count_if(F.col("quality") == 0).alias("down"))
    return overview(runs, "run_id", ["price", "filled"], docs=docs, asked=asked, rated=rated)


@query("manual_review", "select doc_id, case when quality = 1 then 'approved' when quality = 0 then 'rejected' else 'review' end as verdict from documents left join labels using (doc_id)")
def _(spark, sf):
    from ..operators.validity import patch_status

    results = T(spark, sf, "documents").select("doc_id", F.lit("review").alias("status"))
    reviews = T(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "approved").when(F.col("quality") == 0, "rejected").alias("status"))
    return patch_status(results, reviews, "doc_id").select("doc_id", F.col("status").alias("verdict"))
