"""Rules and edge cases that the tables do not show."""

import datetime
import json
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from corpuslake.functions import rules, text
from corpuslake.operators import conversations, metadata, relational, retrieval, structure, submissions, validity
from corpuslake.plans import registry
from corpuslake.sources import tables


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], [f"{k}" for k in values]) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("function", "given", "wanted"),
    [
        (text.fix_artifacts, "ﬁn–e…​ x", "fin-e... x"),
        (text.drop_foreign, "ab中c", "ab c"),
        (text.squeeze_ws, "a\t  b", "a b"),
        (text.drop_page_numbers, "a\n- 3 -\n 12 \nTrang 1/10\nb 7", "a\nb 7"),
        (text.drop_repeat_headers, "Số: 12\na\nSố: 12\na", "Số: 12\na\na"),
        (text.normalize_legal, "Điều1. Khoản2\n• x", "Điều 1. Khoản 2\n- x"),
        (text.clean_page, "thu-\ntục  “x”", 'thutục "x"'),
        (text.ocr_post, "a , b .\n\n\n\nc", "a, b.\n\nc"),
        (text.strip_accents, "Đất  đai ở VĨNH Long", "dat dai o vinh long"),
        (text.norm_label, " Điều.  3 ", "điều 3"),
        (text.title_from_text, "x" * 60, "x" * 50 + "..."),
        (text.parse_doc_date, "Vĩnh Long, ngày 5 tháng 2 năm 2024", datetime.date(2024, 2, 5)),
        (text.parse_doc_date, "ngày 31 tháng 2 năm 2024", None),
        (conversations.route_mode, "Tôi muốn TRA CỨU", "rag"),
        (conversations.route_mode, "tiếp tục điền giúp", "resume_form"),
        (conversations.digression, "500 m2", "FILL"),
        (conversations.digression, "Lệ phí được tính như thế nào trong trường hợp này", "ASK_LEGAL"),
        (conversations.digression, "Vĩnh Long", "FILL"),
        (metadata.doc_action, "Sửa đổi khoản 1 và bãi bỏ điều 2", "partial_repeal"),
        (metadata.doc_action, "Thay thế toàn bộ", "replace"),
        (structure.total_time, "Tổng thời gian giải quyết TTHC:\n10 ngày", "10 ngày"),
    ],
)
def test_text(spark, function, given, wanted):
    assert one(spark, function(F.col("t")), t=given) == wanted


@pytest.mark.parametrize(("given", "wanted"), [("1.234,5", 1234.5), ("1.234", 1234), ("1,234", 1234), ("12,5", 12.5), ("12.5", 12.5), ("1.2.3", None), ("x", None), ("-7", -7)])
def test_numbers(spark, given, wanted):
    got = one(spark, text.parse_number(F.col("t")), t=given)
    assert (got is None) if wanted is None else float(got) == wanted


def test_nfc_and_tokens(spark):
    assert one(spark, text.nfc("t"), t="é") == "é"
    assert one(spark, text.tokens(F.col("t")), t="Tôi cần GIẤY tờ a giấy") == ["giấy", "tờ", "giấy"]
    assert one(spark, text.token_jaccard(text.eval_tokens(F.col("t")), text.eval_tokens(F.lit(""))), t="a b") == 0.0


def test_argmax_ties_go_first(spark):
    assert one(spark, text.argmax_keywords(F.col("t"), {"a": ["x"], "b": ["y"]}, "none"), t="y x") == "a"
    assert one(spark, text.argmax_keywords(F.col("t"), rules.FIELD_TYPES, "general"), t="") == "general"


def test_markdown(spark):
    rows = F.array(F.array(F.lit("a|b"), F.lit("c\nd")), F.array(F.lit("e")))
    assert one(spark, text.markdown_table(F.array(F.lit("h"), F.lit("i")), rows)) == "| h | i |\n| --- | --- |\n| a\\|b | c d |\n| e |  |"
    assert one(spark, text.parse_markdown_row(F.lit("|---|---|"))) == []


def test_references(spark):
    r = one(spark, metadata.extract_refs(F.col("t")), t="Chương II: điểm b khoản 3 Điều 12a của luật")
    assert (r.article, r.clause, r.point, r.section) == ("Điều 12a", "Khoản 3", "Điểm b", "Chương II")
    assert one(spark, metadata.extract_refs(F.col("t")), t="2. Hồ sơ gồm").clause == "Khoản 2"
    assert one(spark, metadata.doc_number(F.lit("12_2026_ND-CP.pdf"), F.lit(""))) == "12/2026/ND-CP"
    assert one(spark, metadata.doc_number(F.lit("x.pdf"), F.lit("không rõ"))) == ""


def test_references_in_full(spark, sf_dir):
    """The query has all references of a block; a context is read before the text."""
    assert registry.QUERIES["extract_refs"](spark, sf_dir).columns == ["doc_id", "position", "article", "clause", "point", "section"]
    df = spark.createDataFrame([(1, "Chương I", "2. theo điểm b Điều 3"), (2, None, "2. theo điểm b Điều 3"), (3, "", "MỤC 2\nKHOẢN 7"), (4, "Điều 9", "khoản 1 Điều 3"), (5, "Điều 9", None)], "id long, c string, t string")
    got = {r.id: tuple(r.x) for r in df.select("id", metadata.extract_refs(F.col("t"), F.col("c")).alias("x")).where("t is not null").collect()}
    assert got == {1: ("Điều 3", "", "Điểm b", "Chương I"), 2: ("Điều 3", "Khoản 2", "Điểm b", ""), 3: ("", "Khoản 7", "", "MỤC 2"), 4: ("Điều 9", "Khoản 1", "", "")}


def test_doc_types_and_chunks(spark):
    statute = "Điều 1. " + "Phạm vi điều chỉnh của luật này " * 3 + "\nĐiều 2. " + "Đối tượng áp dụng của luật này " * 3
    procedure = "\n".join(f"({i}) Trình tự thực hiện" for i in range(1, 6))
    df = spark.createDataFrame([(1, statute, "Luật A"), (2, procedure, "x"), (3, "ngắn", "y"), (4, "", "z"), (5, None, "z")], "id long, text string, name string")
    kinds = {r.id: r.k for r in df.select("id", structure.detect_doc_type(F.col("text"), F.col("name")).alias("k")).collect()}
    assert kinds[1] == "luat_nghi_dinh" and kinds[2] == "quyet_dinh_tthc" and kinds[3] == "unknown"
    chunks = structure.chunk_documents(df, "id", "text", "name").orderBy("id", "chunk_index").collect()
    assert [(c.id, c.chunk_index, c.article) for c in chunks] == [(1, 0, "Điều 1"), (1, 1, "Điều 2"), (2, 0, "")]


def test_long_article_is_cut_by_clause(spark):
    article = "Điều 1. Tên\n" + "\n".join(f"{i}. " + "nội dung khoản " * 50 for i in range(1, 4))
    df = spark.createDataFrame([(1, article)], "id long, text string")
    assert [r.clause for r in structure.split_articles(df, "text").orderBy("clause_position").collect()] == ["Khoản 1", "Khoản 2", "Khoản 3"]


def test_each_text_gives_chunks_of_its_kind(spark):
    words = "nội dung cần giữ lại trong văn bản này " * 4
    decision = "1. Đăng ký biến động quyền sử dụng đất\n" + "\n".join(f"({i}) Mục {words}" for i in range(1, 5))
    workflow = "8. Cấp đổi Giấy chứng nhận đã cấp\n8.1 Trường hợp bản đồ chính quy\n" + "\n".join(f"Bước {i} {words}" for i in range(1, 4)) + "\nTổng thời gian giải quyết TTHC\n10 ngày làm việc"
    bare, long_, short = words * 2, "Điều 1. Tên\n" + words * 20, "Điều 1. Tên\n" + "1. ngắn\n" * 300
    texts = [(1, decision, "x"), (2, workflow, "y"), (3, bare, "Luật B"), (4, long_, "Luật C"), (5, short, "Luật D")]
    df = spark.createDataFrame(texts, "id long, text string, name string")
    found = {}
    for r in structure.chunk_documents(df, "id", "text", "name").orderBy("id", "chunk_index").collect():
        found.setdefault(r.id, []).append((r.field_type, r.chunk))
    assert [f for f, _ in found[1]] == ["trinh_tu", "cach_thuc", "thanh_phan_ho_so", "thoi_han"]
    assert found[1][2][1].startswith("[Thủ tục: Đăng ký biến động quyền sử dụng đất]\n[Mục: (3) Thành phần, số lượng hồ sơ]\n(3) Mục ")
    assert [f for f, _ in found[2]] == ["trinh_tu"] * 3 + ["thoi_han"]
    assert found[2][1][1].startswith("[Thủ tục: Cấp đổi Giấy chứng nhận đã cấp — Trường hợp bản đồ chính quy]\n[Bước 2]\nBước 2 ")
    assert found[2][3][1].endswith("10 ngày làm việc")
    assert [c for _, c in found[3]] == [bare.strip()]
    assert len(found[4]) > 3 and len(found[5]) == 1 and found[5][0][1].endswith(short.strip())


def test_packing_is_greedy(spark):
    got = one(spark, structure.pack_parts(F.split(F.lit("aa,bb,cccc,d,e"), ","), 5, " "))
    assert got == ["aa bb", "cccc", "d e"]
    df = spark.createDataFrame([(1, "Một câu. " * 300), (2, "")], "id long, text string")
    pieces = structure.pack_paragraphs(df, "text").collect()
    assert pieces and all(len(p.piece) <= 900 + 120 for p in pieces)


def test_changes(spark):
    df = spark.createDataFrame([(1, "Bãi bỏ khoản 2 Điều 5; thay thế cụm từ “a” tại điều 7. Bãi bỏ khoản 2 Điều 5"), (2, "không có gì"), (3, None)], "id long, text string")
    got = {(r.action, r.article, r.clause, r.confidence) for r in structure.extract_changes(df, "id", "text").collect()}
    assert got == {("repeal", "điều 5", "khoản 2", 0.96), ("replace_text", "điều 7", "", 0.9)}


def test_blanks(spark):
    df = spark.createDataFrame([(1, "Tên: ____ Số ....\n☐ Nam")], "id long, text string")
    assert [(r.number, r.label) for r in structure.find_blanks(df, "id", "text").orderBy("number").collect()] == [(1, "Tên:"), (2, "Số"), (3, "")]


def test_last_confirmed_change_wins(spark):
    chunks = spark.createDataFrame([("a", "active"), ("b", "active"), ("c", "active")], "chunk_id string, status string")
    changes = spark.createDataFrame([("a", 1, "repeal"), ("a", 2, "amend"), ("b", 1, "add")], "chunk_id string, position int, action string")
    now, log = validity.confirm_changes(changes, chunks)
    assert {r.chunk_id: r.status for r in now.collect()} == {"a": "amended", "b": "active", "c": "active"} and log.count() == 3


def test_theta_labels(spark):
    p = spark.createDataFrame([("Điều 1",)], "article string")
    t = spark.createDataFrame([("điều 1",), ("Điều 10",), ("điều 2",)], "chunk_article string")
    assert relational.repeal_theta(p, t).count() == 1 and relational.repeal_theta(p, t, exact=False).count() == 2


def test_null_status_stays(spark):
    df = spark.createDataFrame([("repealed",), (None,), ("active",)], "s string")
    assert relational.exclude_expired(df, "s", rules.EXPIRED).count() == 2


def test_dependency_cycle_is_an_error():
    fields = [submissions.Field("a", depends_on=("b", "x")), submissions.Field("b", depends_on=("a", "x"))]
    with pytest.raises(ValueError, match="depend"):
        submissions.levels(fields)
    with pytest.raises(ValueError, match="formula"):
        submissions.calc_fields(None, [submissions.Field("a", formula="exec('x')")])


def test_dependencies_cascade_and_reopen(spark):
    fields = [submissions.Field("a"), submissions.Field("b", depends_on=("a", "1")), submissions.Field("c", depends_on=("b", "2"))]
    skipped = submissions.SKIPPED
    rows = [(1, {"a": "0", "b": "2", "c": "x"}, []), (2, {"a": "1", "b": skipped}, ["b"]), (3, {"a": "1", "b": skipped}, None), (4, {"a": "0", "b": skipped}, [])]
    df = spark.createDataFrame(rows, "id long, answers map<string,string>, auto_skipped array<string>")
    once = submissions.apply_dependencies(df, fields)
    got = {r.id: (r.answers, sorted(r.auto_skipped)) for r in once.collect()}
    assert got[1] == ({"a": "0", "b": skipped, "c": skipped}, ["b", "c"]) and got[2] == ({"a": "1"}, [])
    # what the user skipped stays so; its own child was skipped by the rules
    assert got[3] == ({"a": "1", "b": skipped, "c": skipped}, ["c"]) and got[4] == ({"a": "0", "b": skipped, "c": skipped}, ["c"])
    changed = once.withColumn("answers", submissions.put("a", F.lit("1")))
    again = {r.id: (r.answers, r.auto_skipped) for r in submissions.apply_dependencies(changed, fields).collect()}
    assert again[1] == ({"a": "1"}, []) and again[4][0]["b"] == skipped
    assert submissions.apply_dependencies(df.drop("auto_skipped"), fields).columns == ["id", "answers", "auto_skipped"]


def test_case_files(spark, tmp_path):
    (tmp_path / "cases.csv").write_text('﻿question,expected_answer,level\n"Câu hỏi, một",Trả lời dài,2\nx,y,3\nCâu hỏi hai,Trả lời hai,cao\n', encoding="utf-8")
    valid, wrong = tables.read_cases_csv(spark, str(tmp_path / "cases.csv"))
    assert {(r.question, r.level) for r in valid.collect()} == {("Câu hỏi, một", 2), ("Câu hỏi hai", None)} and wrong.count() == 1
    (tmp_path / "a.json").write_text(json.dumps({"a": 1}))
    (tmp_path / "b.json").write_text("no json")
    assert {r.text for r in tables.read_json_docs(spark, str(tmp_path / "*.json")).collect()} >= {"no json"}
    (tmp_path / "a.xml").write_text("<a><b> x </b><c/>y</a>")
    (tmp_path / "b.xml").write_text("plain")
    assert {r.text for r in tables.read_xml_docs(spark, str(tmp_path / "*.xml"), tails=True).collect()} == {"x\ny", ""}
    assert {r.text for r in tables.read_xml_docs(spark, str(tmp_path / "*.xml")).collect()} == {"x", ""}


def test_index_must_match(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "a"), (2, "b")], "chunk_id long, text string")
    vectors = spark.createDataFrame([(1, [1.0], "p")], "chunk_id long, embedding array<double>, procedure_type string")
    with pytest.raises(ValueError, match="one to one"):
        tables.write_index(chunks, vectors, str(tmp_path / "i"))


def test_cached_text_by_number_or_stem(spark):
    from corpuslake.sources.tables import match_cached_text

    files = spark.createDataFrame([("Cap doi.pdf",), ("law 1085.pdf",), ("other.pdf",)], "file string")
    cache = spark.createDataFrame([("b_cap doi_ocr.txt", "x" * 60), ("a_cap doi.txt", "x"), ("qd1085.txt", "x" * 60)], "name string, text string")
    assert {tuple(r) for r in match_cached_text(files, cache).collect()} == {("Cap doi.pdf", "b_cap doi_ocr.txt"), ("law 1085.pdf", "qd1085.txt")}


def test_html(spark):
    html = "<nav>x</nav><h1>T &amp; U</h1><p>a<br>b</p><ul><li>c</li></ul><script>1</script>"
    got = tables.html_segments(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("position").collect()
    assert [(r.kind, r.level, r.text) for r in got] == [("heading", 1, "T & U"), ("paragraph", None, "a"), ("paragraph", None, "b"), ("list", None, "c")]


def test_reused_answers_do_not_live_longer(spark):
    """Events at 0, 5 and 10 h: the second reuses the first, the third is answered anew."""
    df = spark.createDataFrame([(1, "a", 0), (2, "a", 5), (3, "a", 10), (4, "a", 16), (5, "b", 1), (6, "a", 17), (7, None, 3), (8, "b", None)], "id long, key string, h int")
    log = df.select("id", "key", F.expr("timestamp_seconds(h * 3600)").alias("ts"))
    got = {r.id: r.reused for r in retrieval.reuse_answers(log, "key", "ts", "id").collect()}
    assert got == {1: False, 2: True, 3: False, 4: True, 5: False, 6: False, 7: False, 8: False}


def test_formulas_guard_every_divisor(spark):
    fields = [submissions.Field("x", formula="1 / ([a] - [b])", order=1), submissions.Field("y", formula="-[a] * (2 + [b]) / 4 - 1.5", order=2)]
    df = spark.createDataFrame([(1, {"a": "2", "b": "2"}), (2, {"a": "3", "b": "1"}), (3, {"a": "3"})], "id long, answers map<string,string>")
    got = {r.id: (r.answers.get("x"), r.answers.get("y")) for r in submissions.calc_fields(df, fields).collect()}
    assert got == {1: (None, "-3.5"), 2: ("0.5", "-3.75"), 3: (None, None)}
    for bad in ("1 +", "(1", "1 2", "[a] % 2", ""):
        with pytest.raises(ValueError):
            submissions.formula_value(bad, lambda k: F.lit(1.0))


def test_all_digits_are_printed(spark):
    df = spark.createDataFrame([(1, {"tax": "0123456789012"})], "id long, answers map<string,string>")
    assert submissions.render_values(df, [submissions.Field("tax", "digits")]).first().tax == "0 1 2 3 4 5 6 7 8 9 0 1 2"


def test_declared_fields(spark):
    from corpuslake.operators.submissions import SKIPPED, extract_declared

    said = "Kính gửi: UBND xã A; họ và tên là Lê B, CCCD số 0123 địa chỉ ấp 1; điện thoại: 0901 234 567; không có email; nội dung biến động là đổi tên; giấy tờ thứ hai là sổ; giấy tờ liên quan thứ ba: đơn; nơi viết đơn là Vĩnh Long."
    edit = "sửa lại giấy tờ nhân thân thành căn cước 99"
    df = spark.createDataFrame([(1, said), (2, edit), (3, ""), (4, None)], "id int, text string")
    got = {r.id: r.d for r in df.select("id", extract_declared(F.col("text")).alias("d")).collect()}
    assert got[1] == {"receiver": "UBND xã A", "name": "Lê B", "identity": "CCCD số 0123", "address": "ấp 1", "phone": "0901234567", "email": SKIPPED, "change": "đổi tên", "second_paper": "sổ", "third_paper": "đơn", "place": "Vĩnh Long"}
    assert got[2] == {"identity": "căn cước 99"}
    assert not got[3] and not got[4]


def test_provisions_and_invalid_values(spark):
    from corpuslake.operators.relational import validate_provisions
    from corpuslake.operators.submissions import Field, invalid_keys

    rows = spark.createDataFrame([(1, '[{"article": "Điều 1"}, {"article": " ", "action": "add"}, {"article": "2", "action": "move"}]'), (2, "[]"), (3, "none"), (4, None)], "id int, json string")
    got = [(r.id, r.position, r.article, r.action, r.valid) for r in validate_provisions(rows, "json", ["amend", "repeal", "add"]).orderBy("id", "position").collect()]
    assert got[:3] == [(1, 0, "Điều 1", "repeal", True), (1, 1, None, "add", False), (1, 2, "2", "move", False)]
    assert [(g[0], g[4]) for g in got[3:]] == [(2, False), (3, False), (4, False)]
    fields = [Field("n", "name"), Field("a", "address"), Field("p", "phone"), Field("e", "email"), Field("d", "digits"), Field("c", "choice", options=["Có ", "Không"]), Field("b", "boolean")]
    good = {"n": "Lê B", "a": "ấp 1", "p": "+84 90-123-4567", "e": "a@b.vn", "d": "12.3-4", "c": "có", "b": "Đúng"}
    bad = {"n": "bản sao", "a": "Sổ đỏ số 1", "p": "12", "e": "a@b", "d": "1a", "c": "x", "b": "maybe"}
    df = spark.createDataFrame([(1, good), (2, bad), (3, {})], "id int, answers map<string,string>")
    assert {r.id: r.k for r in df.select("id", invalid_keys(fields).alias("k")).collect()} == {1: [], 2: list("napedcb"), 3: []}


def test_documents_are_cut_where_they_are_read(spark):
    """No shuffle, no union of branches, and no filter that Spark infers from a generator and that would split each text again."""
    docs = spark.createDataFrame([(1, "Điều 1. " + "nội dung " * 20, "Luật")], "id long, text string, name string")
    for cut in (structure.chunk_documents(docs, "id", "text", "name"), structure.split_articles(docs, "text")):
        plan = cut._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Union" not in plan and "Filter (size(" not in plan and len(cut.collect()) == 1


def test_procedures_sections_and_steps(spark):
    long_ = "nội dung của phần này " * 6
    text_ = f"lời mở đầu\n1. Thủ tục cấp đổi giấy\n(1) Trình tự thực hiện\n{long_}\n(12) không phải mục\n(2) ngắn\n(3) hồ sơ gồm\n{long_}\n2. Chuyển nhượng quyền sử dụng\n{long_}"
    df = spark.createDataFrame([(1, text_), (2, "không có tiêu đề"), (3, None)], "id int, text string")
    got = structure.split_procedures(df, "text").orderBy("id", "position").collect()
    assert [(r.id, r.procedure_name, r.procedure_type) for r in got] == [(1, "Thủ tục cấp đổi giấy", "cap_doi_gcn"), (1, "Chuyển nhượng quyền sử dụng", "chuyen_nhuong"), (2, "Thủ tục đất đai", "all")]
    assert "mở đầu" not in got[0].block and got[2].block == "không có tiêu đề"
    sections = structure.split_sections(df, "text").orderBy("position").collect()
    assert [(r.section, r.field_type) for r in sections] == [(1, "trinh_tu"), (3, "thanh_phan_ho_so")] and "(12)" in sections[0].block
    steps = spark.createDataFrame([(f"mở đầu\nBước 1: {long_}\nBước 2: ngắn\nBước 3: {long_}",)], "text string")
    assert [r.step for r in structure.split_steps(steps, "text", 50).orderBy("position").collect()] == [None, 1, 3]
    assert [r.step for r in structure.split_steps(steps, "text").collect()] == [None]
    assert [r.step for r in structure.split_steps(steps, "text", workflow=True).orderBy("position").collect()] == [1, 3]


def test_subprocedures_know_their_procedure(spark):
    body = "các bước xử lý hồ sơ tại cơ quan có thẩm quyền trong thời hạn"
    texts = [(1, f"8. Cấp đổi giấy chứng nhận\n8.1 trường hợp thứ nhất\n{body}\n8.2 trường hợp thứ hai\n{body}\n12.1 trường hợp khác nữa\n{body}"), (2, "8.1 trường hợp ngắn"), (3, f"8. Cấp đổi giấy chứng nhận\n{body}"), (4, "x")]
    df = spark.createDataFrame(texts, "id int, text string")
    got = [(r.id, r.number, r.parent, r.sub_name) for r in structure.split_subprocedures(df, "text").orderBy("id", "position").collect()]
    assert got == [(1, "8.1", "Cấp đổi giấy chứng nhận", "trường hợp thứ nhất"), (1, "8.2", "Cấp đổi giấy chứng nhận", "trường hợp thứ hai"), (1, "12.1", "Thủ tục 12", "trường hợp khác nữa"), (2, "", "Quy trình nội bộ", ""), (3, "", "Cấp đổi giấy chứng nhận", ""), (4, "", "Quy trình nội bộ đất đai", "")]


def test_marked_pages_are_packed(spark):
    df = spark.createDataFrame([("a--- TRANG 1 ---bb--- TRANG 2 ---cc",), ("",), ("x" * 50,)], "text string")
    got = structure.pack_by_marker(df, "text", most=20).collect()
    assert [r.piece for r in got] == ["a\n\n--- TRANG 1 ---\n\nbb", "--- TRANG 2 ---\n\ncc", "", "x" * 50]


def test_parents_by_hint(spark):
    docs = spark.createDataFrame([(1, "1467"), (2, "Quy trình"), (3, ""), (4, None), (5, "99")], "id int, hint string")
    catalog = spark.createDataFrame([(10, "QĐ 1467/2024"), (11, "QUY TRÌNH nội bộ 14671467"), (12, None), (13, "")], "parent int, name string")
    got = sorted((r.id, r.parent) for r in relational.infer_parents(docs, catalog, "hint", "name").collect())
    assert got == [(1, 10), (1, 11), (2, 11)]
    assert relational.infer_parents(docs.where("id = 3"), catalog, "hint", "name").count() == 0


def plain_snippet(snippet):
    """The rules of polish_snippet(), line by line."""
    for pattern, new, cased in rules.SNIPPET_FIXES:
        snippet = re.sub(pattern, new, snippet, flags=0 if cased else re.IGNORECASE)
    lines = []
    for line in filter(None, map(str.strip, snippet.split("\n"))):
        if not lines:
            if len(line.split()) > 2 or line.startswith(rules.SNIPPET_HEADS):
                lines.append(line)
        elif not line.startswith(rules.SNIPPET_ITEMS) and (lines[-1].endswith(rules.SNIPPET_OPEN_ENDS) or lines[-1][-1] not in ".?!:"):
            lines[-1] += " " + line
        else:
            lines.append(line)
    return re.sub("[ \t]+", " ", "\n\n".join(lines)).strip()


def test_polish_snippet(spark):
    hard = [
        "", "   \n ", "mồ côi\nĐiều 1. Nội dung\ntiếp theo,\nvà nữa.\nCâu mới\n- mục một\n- mục hai", "Bước 1 | nộp hồ sơ Bước 2: nhận kết quả", "chưa &Ễy đủ giãy tờ; ; , khác", "Xác nhận | ABC | ?\nxong. a/b\n / lề",
        "gắn liên với đất đi và tải  sản, m: 3", "Đăng Ối 0.5 ngà làm việc", "ffl1t đai và fflấy của o1 đình", "xiãy chứng nhận Iãy CHỨNG nhận", "một hai\nba bốn năm\n(a) sáu", "dất đai thửa đắt Cấp đồi Nghị định sô 5",
    ]
    df = spark.createDataFrame(list(enumerate(hard)), "id long, t string")
    for r in df.select("id", text.polish_snippet(F.col("t")).alias("x")).collect():
        assert r.x == plain_snippet(hard[r.id]), hard[r.id]
    assert one(spark, text.polish_snippet(F.lit(None).cast("string"))) == ""


def test_snippets_keep_numbers_whole(spark):
    """A code behind a bar goes; the first part of an address or of a number with points is none."""
    df = spark.createDataFrame([(1, "số liệu của máy | 161.17.88.162 | hết câu này"), (2, "số liệu của máy | QD12 hết câu này")], "id long, t string")
    got = {r.id: r.x for r in df.select("id", text.polish_snippet(F.col("t")).alias("x")).collect()}
    assert got == {1: "số liệu của máy - 161.17.88.162 - hết câu này", 2: "số liệu của máy hết câu này"}


def test_snippets_keep_cells(spark):
    """Behind a bar, words in capitals and numbers stay, and so does what follows a bar that ends a line or the text."""
    rows = [(1, "ab cd ef | +1 | (017) | 555-7713 | gh"), (2, "ab cd ef | the | GNU | General | CC | BY-NC | MIT | SS | 4002 | gh"), (3, "ab cd ef | gh |"), (4, "ab cd ef | gh | "), (5, "ab cd ef | gh. | \nIj kl | AB_12 | ; \nmn")]
    df = spark.createDataFrame(rows, "id long, t string")
    got = {r.id: r.x for r in df.select("id", text.polish_snippet(F.col("t")).alias("x")).collect()}
    want = ["ab cd ef - +1 - (017) - 555-7713 - gh", "ab cd ef - the - GNU - General - CC - BY-NC - MIT - SS - 4002 - gh", "ab cd ef - gh -", "ab cd ef - gh -", "ab cd ef - gh. - Ij kl mn"]
    assert got == dict(enumerate(want, 1))


def test_document_actions(spark):
    d = datetime.date
    provision = "array<struct<article: string, clause: string, action: string>>"
    docs = spark.createDataFrame([(1, "A", "x", 7), (2, "B", "x", 8), (3, "C", "x", 9)], "document_id long, source_name string, validity_status string, extra int")
    chunks = spark.createDataFrame(
        [(1, "1a", "Điều 1", "Khoản 1", "nói", "active"), (1, "1b", "Điều 2", None, "theo Khoản 1", "active"), (1, "1c", None, None, None, "active"), (2, "2a", "Điều 1", "", "x", "active"), (3, "3a", "Điều 5", "", "x", "amended")],
        "document_id long, chunk_id string, article string, clause string, text string, status string",
    ).selectExpr("*", "cast(null as date) as effective_to", "cast(null as string) as validity_note")
    log = [
        (1, 10, "N1", "partial_repeal", 1, d(2024, 1, 1), None, [("điều 1", "khoản 1", "repeal"), ("Điều 2", "khoản 1", "amend"), ("", "", "repeal"), ("Điều 1", "khoản 9", "amend"), ("Điều 2", "", "add")]),
        (2, 11, "N2", "replace", 2, d(2024, 2, 1), None, None),
        (3, 12, "N3", "amend", 2, None, "partial", None),
        (4, 13, "N4", "other", 3, None, None, None),
        (5, 14, "N5", "replace", 99, None, None, None),
        (6, 15, "N6", "partial_repeal", 3, d(2024, 3, 1), None, None),
    ]
    actions = spark.createDataFrame(log, f"position long, source_id long, source_name string, action string, document_id long, effective_date date, scope string, provisions {provision}")
    new_docs, new_chunks, edges = validity.apply_document_actions(actions, docs, chunks)
    assert {(r.document_id, r.validity_status, r.extra) for r in new_docs.collect()} == {(1, "Hết hiệu lực một phần", 7), (2, "Đã sửa đổi bổ sung", 8), (3, "Hết hiệu lực một phần", 9)}
    got = {r.chunk_id: (r.status, r.effective_to, r.validity_note) for r in new_chunks.collect()}
    assert got == {
        "1a": ("repealed", d(2024, 1, 1), "Bị bãi bỏ bởi N1 (điều 1 khoản 1)"),
        "1b": ("amended", d(2024, 1, 1), "Bị sửa đổi bởi N1 (Điều 2 khoản 1)"),
        "1c": ("active", None, None),
        "2a": ("repealed", d(2024, 2, 1), "Bị thay thế toàn bộ bởi N2"),
        "3a": ("amended", None, None),
    }
    assert new_chunks.columns == chunks.columns
    found = {(r.document_id, r.other_id, r.other_name, r.relation, r.scope, None if r.affected_provisions is None else len(r.affected_provisions)) for r in edges.collect()}
    assert found == {
        (1, 10, "N1", "partially_repealed_by", "partial", 5), (10, 1, "A", "partially_repeals", "partial", 5), (2, 11, "N2", "replaced_by", "full", None), (11, 2, "B", "replaces", "full", None),
        (2, 12, "N3", "amended_by", "partial", 0), (12, 2, "B", "amends", "partial", 0), (3, 15, "N6", "partially_repealed_by", "full", None), (15, 3, "C", "partially_repeals", "full", None),
    }
    assert validity.apply_document_actions(actions.limit(0), docs, chunks)[2].collect() == []


def test_selected_changes(spark):
    chunks = spark.createDataFrame([("a", "active"), ("b", "active")], "chunk_id string, status string")
    changes = spark.createDataFrame([("a", 1, "repeal"), ("a", 2, "amend"), ("b", 3, "repeal")], "chunk_id string, position long, action string")
    selected = spark.createDataFrame([(1,), (None,)], "position long")
    got, log = validity.confirm_changes(changes, chunks, selected)
    assert {tuple(r) for r in got.collect()} == {("a", "repealed"), ("b", "active")} and log.count() == 1


def test_formulas_are_decimal(spark):
    fields = [submissions.Field("s", formula="[a] + [Số hai]", order=1), submissions.Field("b", name="Số hai"), submissions.Field("t", formula="[s] / 3", order=2), submissions.Field("w", formula="[s] * 10", order=3)]
    df = spark.createDataFrame([(1, {"a": "0,1", "b": "2000000000000000,2", "t": "old"}), (2, {"a": "1.000.000", "b": "chữ", "s": "old"}), (3, None)], "id long, answers map<string,string>")
    got = {r.id: r.answers for r in submissions.calc_fields(df, fields).collect()}
    assert (got[1]["s"], got[1]["t"], got[1]["w"]) == ("2000000000000000.3", "666666666666666.7666666666667", "20000000000000003")
    assert got[2] == {"a": "1.000.000", "b": "chữ"} and got[3] is None
    for v in ("1.234.567,5", "1,234", "-12.5", " 7 ", "12,5", "1.2.3", "", "x", "1234,567"):
        want = spark.range(1).select(text.parse_number(F.lit(v)).alias("x")).first().x
        try:
            assert submissions.decimal_of(v) == want, v
        except ArithmeticError:
            assert want is None, v


def test_boxes_and_tax_number(spark):
    fields = [submissions.Field(f"d{i}", box=("mst", i)) for i in range(3)] + [submissions.Field("own", box=("none", 1))]
    df = spark.createDataFrame([(1, {"mst": "0-1", "own": "98", "tax": "1234567890-123"}), (2, {"mst": submissions.SKIPPED})], "id long, answers map<string,string>")
    first, second = submissions.render_values(df, fields, tax={"tax": [1, 3]}).orderBy("id").collect()
    assert (first.d0, first.d1, first.d2, first.own) == ("0", "1", " ", "8") and (second.d0, second.own, second.mst_1_0) == ("", "", "")
    for group in (1, 3):
        assert "".join(first[f"mst_{group}_{box}"] for box in [12, 11, 7, 8, 10, 9, 1, 0, 6, 5, 4, 3, 2]) == "1234567890123"


def test_co_owners(spark):
    fields = [submissions.Field("f1", name="Tên người đồng sở hữu 2"), submissions.Field("f2", name="CCCD đồng sở hữu 2"), submissions.Field("f3", name="Tỷ lệ của dsh 3"), submissions.Field("f4", name="Ghi chú")]
    rows = [(1, {"f1": " An ", "f2": "012", "f3": "30", "f4": "x", "mst dsh": "99"}), (2, {"f3": "40%", "f1": submissions.SKIPPED}), (3, {"f4": "y"})]
    df = spark.createDataFrame(rows, "id long, answers map<string,string>")
    got = {tuple(r) for r in submissions.co_owners(df, fields).select("id", "owner", "name", "tax_id", "identity", "share").collect()}
    assert got == {(1, 2, "An", None, "012", None), (1, 3, None, None, None, "30%"), (1, 1, None, "99", None, None), (2, 3, None, None, None, "40%")}
    assert submissions.co_owners(df, []).where("owner = 1").count() == 1


def test_required_by_name_or_box(spark):
    fields = [submissions.Field("a", name="Tên"), submissions.Field("b", name="Ô", box=("g", 0)), submissions.Field("c", name="Ô", box=("g", 1)), submissions.Field("d", required=False)]
    df = spark.createDataFrame([(1, {"Tên": "x"}), (2, {"a": "x", "g": "12"}), (3, {"b": "1"})], "id long, answers map<string,string>")
    assert {r.id: r.missing for r in submissions.required_missing(df, fields).collect()} == {1: ["Ô"], 2: [], 3: ["Tên"]}


def plain_clean(x, corrections):
    """All steps of clean_text(), one after the other."""
    x = unicodedata.normalize("NFC", x)
    for old, new in rules.ARTIFACTS.items():
        x = x.replace(old, new)
    x = re.sub(r"[^\x00-\x7FÀ-ɏ̀-ͯḀ-ỿ\s]", " ", x, flags=re.ASCII)
    x = re.sub(r"[<>'\"`~^\\|{}\[\]]{1,3}[A-Za-z0-9]{0,4}[,;:!?]{0,2}(?=\s|[À-ɏḀ-ỿ])", " ", x, flags=re.ASCII)
    x = re.sub(" {2,}", " ", x.replace("\t", " "))
    lines = [line for line in x.split("\n") if not re.search(rules.PAGE_NUMBER_LINES, line.strip(" "))]
    kept, seen = [], set()
    for line in lines:
        bare = line.strip(" ")
        if not re.search(rules.HEADER_LINES.replace("(?iu)", "(?i)"), bare) or bare not in seen:
            kept.append(line)
        seen.add(bare)
    x = re.sub(r"(Điều|Khoản|Điểm|Mục|Chương)(\d+)", r"\1 \2", "\n".join(kept))
    x = re.sub(r"(?m)^[•●▪▸►]\s*", "- ", x)
    for old, new in corrections:
        x = x.replace(old, new)
    return re.sub("\n{3,}", "\n\n", x).strip(" ")


def test_clean_text(spark, sf_dir):
    hard = ["", "  a\t\tb  ", "Số: 12\nĐiều1. Khoản2\nSố: 12\n- 3 -\nTrang 1/2\n12\nhết", "cá ﬁn – … ​x", "x |AB, y [Z9;Đ 'q\" é", "中文 và\n\n\n\nđất", "CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM\nx\nCỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM", "sai lỗi"]
    rows = [(i, x) for i, x in enumerate(hard)]
    rows += [(1000 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").limit(120).collect()]
    corrections = [("lỗi", "đúng"), ("sai đúng", "ổn")]
    df = spark.createDataFrame(rows, "id long, t string").withColumn("t", text.nfc(F.col("t")))
    got = {r.id: r.x for r in df.select("id", text.clean_text(F.col("t"), corrections=corrections).alias("x")).collect()}
    for i, x in rows:
        assert got[i] == plain_clean(x, corrections), (i, x[:200])
    assert got[7] == "ổn"


def test_rebuild_counts_words_before_the_join(spark):
    """No text is shuffled or sorted: the words are counted below the join."""
    chunks = spark.createDataFrame([(1, 2, "two words"), (1, 1, "one"), (9, 1, "no such document")], "doc long, n long, t string")
    docs = spark.createDataFrame([(1,)], "doc long")
    out = tables.rebuild_index(chunks, docs, "doc", "doc", "n", "t")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.rindex("AS token_estimate")
    assert {tuple(r) for r in out.collect()} == {(1, 1, 0, 1), (1, 2, 1, 2)}
