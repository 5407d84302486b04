"""Structure of documents: types, sections, articles, windows, tables and chunks."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import clean_text, markdown_table, nfc, token_estimate
from ..session import ship
from .metadata import guess_procedure
from .splitter import OVERLAP_CHARS, PIECE_CHARS, with_pieces

#: The header patterns of sections, steps, sub-procedures and articles.
SECTION = "(?m)^\\s*\\((\\d{1,2})\\)\\s+.{3,}"
STEP = "(?i)B\\s*(?:ư|u|ướ|ươ)\\s*[oơớó]?\\s*c\\s+\\d+"
SUB_PROCEDURE = "(?m)^\\s*\\d{1,2}\\.\\d\\s+.{10,200}"
ARTICLE = "(?imu)^Đi[eề]u\\s+\\d+[a-zđ]?\\.?\\s+"
CLAUSE = "(?m)^\\s*\\d+\\.\\s"
PROCEDURE = "(?mu)^\\s*(?:[1-9]|[12]\\d|30|0[1-9])\\.\\s+\\p{L}.{15,199}$"
SECTION_HEAD = "(?m)^\\s*\\((?:[1-9]|0[1-9]|1[01])\\)\\s+.{3,}"
STEP_HEAD = "(?iu)B\\s*(?:ư|u|ướ|ươ)\\s*[oơớó]?\\s*c\\s+\\d+"
SECTIONS = [
    ("trinh_tu", "(1) Trình tự thực hiện"),
    ("cach_thuc", "(2) Cách thức thực hiện"),
    ("thanh_phan_ho_so", "(3) Thành phần, số lượng hồ sơ"),
    ("thoi_han", "(4) Thời hạn giải quyết"),
    ("doi_tuong", "(5) Đối tượng thực hiện"),
    ("co_quan", "(6) Cơ quan thực hiện"),
    ("ket_qua", "(7) Kết quả thực hiện"),
    ("le_phi", "(8) Lệ phí"),
    ("mau_don", "(9) Tên mẫu đơn, mẫu tờ khai"),
    ("dieu_kien", "(10) Yêu cầu, điều kiện"),
    ("can_cu_phap_ly", "(11) Căn cứ pháp lý"),
]
LEAST_CHARS, CHUNK_TOKENS, TABLE_TOKENS, TABLE_ROWS = 60, 600, 700, 20


def detect_doc_type(text: Column, name: Column) -> Column:
    """procedure, internal workflow, statute or unknown, by counts of section, step and article headers and words of the name."""
    low = F.lower(name)
    sections = F.size(F.filter(F.regexp_extract_all(text, F.lit(SECTION), F.lit(1)), lambda x: x.cast("int").between(1, 11)))
    named = reduce(lambda a, b: a | b, [low.contains(w) for w in ("luật", "luat", "nghị định", "nghi dinh", "thông tư")])
    return (
        F.when(sections >= 4, "quyet_dinh_tthc")
        .when((F.regexp_count(text, F.lit(STEP)) >= 3) | (F.regexp_count(text, F.lit(SUB_PROCEDURE)) >= 2) | low.contains("1467"), "quy_trinh_noi_bo")
        .when(text.rlike(ARTICLE) | named, "luat_nghi_dinh")
        .otherwise("unknown")
    )


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once, however often use() names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _strip(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, "^\\s+|\\s+$", ""))


def _split(text: Column, header: str) -> Column:
    return F.split(text, header.replace("(?m)^", "(?m)(?=^").replace("(?imu)^", "(?imu)(?=^") + ")")


def _at_start(header: str) -> str:
    return header.replace("(?m)^", "(?m)\\A").replace("(?imu)^", "(?imu)\\A")


def split_blocks(df: DataFrame, text: str, header: str, least: int = LEAST_CHARS, keep_preamble: bool = False) -> DataFrame:
    """A row (position, block) for each stretch from one header to the next; text before the first header goes unless kept; short ones go."""
    parts = F.transform(_split(F.col(text), header), lambda x, i: F.struct(i.alias("position"), _strip(x).alias("block")))
    kept = F.filter(parts, lambda p: (F.length(p["block"]) >= least) & (F.lit(keep_preamble) | p["block"].rlike(_at_start(header))))
    # the outer form: from the inner one Spark infers filters that would split each text several times
    return df.select("*", F.explode_outer(kept).alias("_b")).where("_b is not null").select(*df.columns, "_b.position", "_b.block")


def article_parts(block: Column, least: int = LEAST_CHARS) -> Column:
    """An article as an array: whole, or, over twice CHUNK_TOKENS, its clauses; one without clauses is cut into windows, and one with short clauses only
    stays whole."""
    windows = F.filter(F.transform(windows_of(block), lambda x: F.trim(x)), lambda x: F.length(x) >= least)
    cut = once(F.filter(stretches(block, CLAUSE), lambda x: F.length(x) >= least), lambda headed: F.when(F.size(headed) > 0, headed).when(block.rlike(CLAUSE), F.array(block)).otherwise(windows))
    return F.when(token_estimate(block) > 2 * CHUNK_TOKENS, cut).otherwise(F.array(block))


def _article(block: Column) -> Column:
    return F.regexp_extract(block, "(?iu)Đi[eề]u\\s+\\d+", 0)


def _clause(block: Column) -> Column:
    label = F.regexp_extract(block, "(?iu)^\\s*(\\d+[a-zđ]?)\\.\\s", 1)
    return F.when(label != "", F.concat(F.lit("Khoản "), label)).otherwise("")


def split_articles(df: DataFrame, text: str, least: int = LEAST_CHARS) -> DataFrame:
    """Articles with their label; those of over twice CHUNK_TOKENS in clauses, whose number is the clause's label: see article_parts()."""
    rows = split_blocks(df, text, ARTICLE, least).withColumnRenamed("block", "_block").withColumn("article", _article(F.col("_block")))
    cut = rows.select("*", F.posexplode_outer(article_parts(F.col("_block"), least)).alias("clause_position", "block")).drop("_block")
    return cut.where("clause_position is not null").withColumn("clause", _clause(F.col("block")))


def article_pieces(text: Column, name: Column) -> Column:
    """Structs (field_type, article, clause, chunk) of a statute's articles, with their prefix; none if no article has LEAST_CHARS."""

    def of_article(block):
        piece = lambda x, label: F.struct(F.lit("can_cu_phap_ly").alias("field_type"), label.alias("article"), _clause(x).alias("clause"), with_prefix(x, name, label).alias("chunk"))
        return once(_article(block), lambda label: F.transform(article_parts(block), lambda x: piece(x, label)))

    def of_parts(parts):
        headed = F.exists(parts, lambda x: x.rlike(_at_start(ARTICLE)) & (F.length(F.regexp_replace(x, "^\\s+|\\s+$", "")) >= LEAST_CHARS))
        blocks = F.filter(F.transform(parts, _strip), lambda x: (F.length(x) >= LEAST_CHARS) & x.rlike(_at_start(ARTICLE)))
        return F.when(headed, F.flatten(F.transform(blocks, of_article)))

    return once(_split(text, ARTICLE), of_parts)


def stretches(text: Column, header: str) -> Column:
    """The stretches from one header to the next, trimmed; without the text before the first."""
    flags, rest = header.split(")", 1)
    parts = F.split(text, f"{flags})(?={rest})")
    return F.transform(F.filter(parts, lambda x: x.rlike(f"{flags})\\A(?:{rest.lstrip('^')})")), lambda x: F.regexp_replace(x, "^\\s+|\\s+$", ""))


def windows_of(text: Column, size: int = 900, overlap: int = 120) -> Column:
    """The pieces of fixed_windows() as an array."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - overlap - 1, F.lit(0)), F.lit(size - overlap))
    return F.transform(starts, lambda i: F.substr(text, i + 1, F.lit(size)))


def pieces(parts: Column, field: Column, prefix: Column) -> Column:
    """Structs (field_type, chunk) of the parts of LEAST_CHARS and more."""
    kept = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: F.length(x) >= LEAST_CHARS)
    return F.transform(kept, lambda x: F.struct(field.alias("field_type"), F.concat(prefix, x).alias("chunk")))


def procedure_name(block: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(block, "(?u)^\\s*\\d{1,2}(?:\\.\\d)?\\.?\\s+(.{0,200})", 1), "\\s+", " "))


def procedure_blocks(text: Column) -> Column:
    """Structs (procedure_name, procedure_type, block) of the procedures of over 100 characters, from one numbered title to the next; a text without
    any is one block."""
    of = lambda name, p: F.struct(name.alias("procedure_name"), guess_procedure(name).alias("procedure_type"), p.alias("block"))
    named = lambda p: once(procedure_name(p), lambda name: of(name, p))
    found = F.filter(stretches(text, PROCEDURE), lambda p: F.length(p) > 100)
    return once(found, lambda ps: F.when(F.size(ps) > 0, F.transform(ps, named)).otherwise(F.array(of(F.lit("Thủ tục đất đai"), text))))


def section_blocks(text: Column) -> Column:
    """Structs (section, field_type, label, block) of the sections (1) to (11) of LEAST_CHARS and more; none without headers."""

    def of(s):
        number = F.regexp_extract(s, "^\\((\\d{1,2})\\)", 1).cast("int")
        field, label = (F.element_at(F.array(*(F.lit(x[i]) for x in SECTIONS)), number) for i in (0, 1))
        return F.struct(number.alias("section"), field.alias("field_type"), label.alias("label"), s.alias("block"))

    return F.transform(F.filter(stretches(text, SECTION_HEAD), lambda s: F.length(s) >= LEAST_CHARS), of)


def section_steps(text: Column, most: int = 2 * CHUNK_TOKENS) -> Column:
    """A section of over `most` tokens in its steps of LEAST_CHARS and more, with what stands before the first; windows if it has no steps. Shorter ones
    are whole."""
    flags, head = STEP_HEAD.split(")", 1)
    steps = F.transform(F.split(text, f"{flags})(?={head}\\s*:)"), lambda x: F.regexp_replace(x, "^\\s+|\\s+$", ""))
    kept = lambda xs: F.filter(xs, lambda x: (F.length(x) >= LEAST_CHARS) | ((x != "") & ~x.rlike(f"{flags})\\A{head}\\s*:")))
    cut = once(steps, lambda xs: F.when((F.size(xs) > 1) & (F.size(kept(xs)) > 0), kept(xs)).otherwise(windows_of(text)))
    return F.when(token_estimate(text) <= most, F.array(text)).otherwise(cut)


def workflow_steps(text: Column) -> Column:
    """The stretches of LEAST_CHARS and more from one step, as scans may spell it, to the next; none without steps."""
    return F.filter(stretches(text, STEP_HEAD), lambda x: F.length(x) >= LEAST_CHARS)


def subprocedure_blocks(text: Column) -> Column:
    """Structs (number, parent, sub_name, block) of the sub-procedures (8.1, 8.2, ...), each with the title of its procedure; those of under LEAST_CHARS
    go. A text without sub-procedures gives its procedures, or is one block without them."""
    of = lambda number, parent, name, p: F.struct(number.alias("number"), parent.alias("parent"), name.alias("sub_name"), p.alias("block"))
    none = F.lit("")

    def names(parents):
        return F.transform(F.reverse(parents), lambda p: F.struct(F.regexp_extract(p, "^(\\d{1,2})", 1).cast("int").alias("k"), procedure_name(p).alias("v")))

    def of_sub(p, names):
        number = F.regexp_extract(p, "^(\\d{1,2})", 1)
        parent = F.coalesce(F.get(F.filter(names, lambda e: e["k"] == number.cast("int")), F.lit(0))["v"], F.concat(F.lit("Thủ tục "), number))
        return of(F.regexp_extract(p, "^(\\d{1,2}\\.\\d)", 1), parent, F.left(procedure_name(p), F.lit(150)), p)

    def of_text(parents, found):
        kept = F.filter(found, lambda p: F.length(p) >= LEAST_CHARS)
        return (
            F.when(F.exists(found, lambda p: F.length(p) >= LEAST_CHARS), once(names(parents), lambda ns: F.transform(kept, lambda p: of_sub(p, ns))))
            .when(F.size(found) > 0, F.array(of(none, F.lit("Quy trình nội bộ"), none, text)))
            .when(F.size(parents) > 0, F.transform(parents, lambda p: of(none, procedure_name(p), none, p)))
            .otherwise(F.array(of(none, F.lit("Quy trình nội bộ đất đai"), none, text)))
        )

    return once(stretches(text, PROCEDURE), lambda parents: once(stretches(text, SUB_PROCEDURE), lambda found: of_text(parents, found)))


def split_procedures(df: DataFrame, text: str) -> DataFrame:
    """A row (position, procedure_name, procedure_type, block) for each of procedure_blocks(); null texts have none."""
    return _exploded(df, procedure_blocks(F.col(text)), "procedure_name", "procedure_type", "block")


def split_sections(df: DataFrame, text: str) -> DataFrame:
    """A row (position, section, field_type, label, block) for each of section_blocks()."""
    return _exploded(df, section_blocks(F.col(text)), "section", "field_type", "label", "block")


def split_steps(df: DataFrame, text: str, most: int = 2 * CHUNK_TOKENS, workflow: bool = False) -> DataFrame:
    """A row (position, step, block) for each of section_steps(), or of workflow_steps(); step is the number, null before the first."""
    parts = workflow_steps(F.col(text)) if workflow else section_steps(F.col(text), most)
    number = lambda x: F.regexp_extract(x, STEP_HEAD.replace("(?iu)", "(?iu)^").replace("\\d+", "(\\d+)"), 1)
    return _exploded(df, F.transform(parts, lambda x: F.struct(F.when(number(x) != "", number(x).cast("int")).alias("step"), x.alias("block"))), "step", "block")


def split_subprocedures(df: DataFrame, text: str) -> DataFrame:
    """A row (position, number, parent, sub_name, block) for each of subprocedure_blocks()."""
    return _exploded(df, subprocedure_blocks(F.col(text)), "number", "parent", "sub_name", "block")


def _exploded(df: DataFrame, blocks: Column, *fields: str) -> DataFrame:
    """df's rows with each struct of the blocks; fields replace columns of their names. Null texts have no row."""
    rows = df.select(*(c for c in df.columns if c not in ("position", *fields)), F.posexplode(blocks).alias("position", "_b"))
    return rows.where("_b.block is not null").select(*rows.columns[:-1], *(F.col("_b")[f].alias(f) for f in fields))


def procedure_pieces(text: Column) -> Column:
    """Pieces of a procedure decision: its sections with procedure and section named before; long ones by steps, or windows without steps. A
    procedure without sections gives windows."""

    def of_section(s, name):
        return pieces(section_steps(s["block"]), s["field_type"], F.concat(F.lit("[Thủ tục: "), name, F.lit("]\n[Mục: "), s["label"], F.lit("]\n")))

    def of_procedure(p):
        plain = pieces(windows_of(p["block"]), F.lit("general"), F.lit(""))
        return once(section_blocks(p["block"]), lambda ss: F.when(F.size(ss) > 0, F.flatten(F.transform(ss, lambda s: of_section(s, p["procedure_name"])))).otherwise(plain))

    return F.flatten(F.transform(procedure_blocks(text), of_procedure))


def workflow_pieces(text: Column) -> Column:
    """Pieces of an internal workflow: the steps of its sub-procedures (or procedures, or of the whole) and their total times; one without steps is
    whole."""

    def of_block(b):
        name = F.when(b["sub_name"] == "", b["parent"]).otherwise(F.concat(b["parent"], F.lit(" — "), b["sub_name"]))
        head = F.concat(F.lit("[Thủ tục: "), name, F.lit("]\n"))
        return once(workflow_steps(b["block"]), lambda steps: of_steps(b, head, steps))

    def of_steps(b, head, steps):
        stepped = F.flatten(F.transform(steps, lambda x: pieces(F.array(x), F.lit("trinh_tu"), F.concat(head, F.lit("[Bước "), F.regexp_extract(x, "(\\d+)", 1), F.lit("]\n")))))
        time = total_time(b["block"])
        timed = F.when(time == "", F.array().cast("array<struct<field_type:string,chunk:string>>")).otherwise(F.array(F.struct(F.lit("thoi_han").alias("field_type"), F.concat(head, F.lit("[Mục: (4) Thời hạn giải quyết]\nTổng thời gian giải quyết TTHC: "), time).alias("chunk"))))
        return F.when(F.size(steps) > 0, F.concat(stepped, timed)).otherwise(pieces(F.array(b["block"]), F.lit("trinh_tu"), head))

    return F.flatten(F.transform(subprocedure_blocks(text), of_block))


def header_spans(df: DataFrame, key: str, text: str, header: str) -> DataFrame:
    """start and end of each headed stretch: from its header to the next, or to the end of the text (1-based, end exclusive)."""
    parts = F.split(F.col(text), header.replace("(?m)^", "(?m)(?=^") + ")")
    rows = df.select(key, F.posexplode(parts).alias("position", "part"))
    w = Window.partitionBy(key).orderBy("position")
    end = F.sum(F.length("part")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("part"))
    return rows.where(F.col("part").rlike(header.replace("(?m)^", "\\A"))).select(key, "position", "start", "end")


def fixed_windows(df: DataFrame, text: str, size: int = 900, overlap: int = 120) -> DataFrame:
    """Windows of `size` characters, each `overlap` before the end of the one before."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - overlap - 1, F.lit(0)), F.lit(size - overlap))
    return df.select("*", F.posexplode(starts).alias("window", "start")).withColumn("piece", F.substr(F.col(text), F.col("start") + 1, F.lit(size)))


def pack_parts(parts: Column, most: int, sep: str) -> Column:
    """Parts joined in order, greedily, into pieces of at most `most` characters (a longer part is a piece of its own)."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("now"))
    fits = lambda s, p: F.length(s["now"]) + len(sep) + F.length(p) <= most
    step = lambda s, p: F.when(s["now"].isNull(), F.struct(s["done"].alias("done"), p.alias("now"))).when(fits(s, p), F.struct(s["done"].alias("done"), F.concat_ws(sep, s["now"], p).alias("now"))).otherwise(F.struct(F.array_append(s["done"], s["now"]).alias("done"), p.alias("now")))
    return F.aggregate(parts, start, step, lambda s: F.when(s["now"].isNull(), s["done"]).otherwise(F.array_append(s["done"], s["now"])))


def pack_by_marker(df: DataFrame, text: str, marker: str = "--- TRANG \\d{1,9} ---", most: int = 6000) -> DataFrame:
    """piece_index, piece: the marked pages of a text, markers included, joined greedily by blank lines while their characters stay within `most`; a
    longer page is a piece of its own. Blank texts are one piece. The marker must be a pattern of bounded length."""
    parts = F.filter(F.split(F.col(text), f"(?={marker})|(?<={marker})"), lambda x: x != "")
    strip = lambda x: F.regexp_replace(x, "^\\s+|\\s+$", "")
    state = lambda done, now: F.struct(done.alias("done"), now.alias("now"))

    def step(s, p):
        full = F.length(s["now"]) + F.length(p) > most
        return F.when(s["now"] == "", state(s["done"], p)).when(full, state(F.array_append(s["done"], strip(s["now"])), p)).otherwise(state(s["done"], F.concat(s["now"], F.lit("\n\n"), p)))

    packed = F.aggregate(parts, state(F.array().cast("array<string>"), F.lit("")), step, lambda s: F.when(strip(s["now"]) == "", s["done"]).otherwise(F.array_append(s["done"], strip(s["now"]))))
    return df.select("*", F.posexplode(F.when(F.size(packed) > 0, packed).otherwise(F.array(F.col(text)))).alias("piece_index", "piece"))


def pack_paragraphs(df: DataFrame, text: str, most: int = PIECE_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """A row (piece_index, piece) for each piece of splitter.split_text(): cut at blank lines, lines, sentences, then words, each with at most `overlap` characters of the one before; none is longer than
    `most`."""
    return with_pieces(df, text, most, overlap).select(*df.columns, F.posexplode("_pieces").alias("piece_index", "piece"))


def classify_tables(context: Column) -> Column:
    from ..functions.text import first_match

    return first_match(F.lower(context), rules.TABLE_TYPES, "general")


#: How a table of each type is announced; others are just "Bảng".
TABLE_LABELS = {"ho_so": "Bảng: Thành phần hồ sơ", "trinh_tu": "Bảng: Trình tự thực hiện", "le_phi": "Bảng: Lệ phí", "dieu_kien": "Bảng: Điều kiện", "thoi_han": "Bảng: Thời hạn", "can_cu_phap_ly": "Bảng: Căn cứ pháp lý"}


def table_prefix(table_type: Column, context: Column, procedure: Column) -> Column:
    """The lines before a table's Markdown: its procedure if there is one, its label, and the text before it if there is any."""
    label = reduce(lambda c, kv: c.when(table_type == kv[0], kv[1]), TABLE_LABELS.items(), F.when(F.lit(False), "")).otherwise("Bảng")
    named = F.when(F.coalesce(procedure, F.lit("")) != "", F.concat(F.lit("[Thủ tục: "), procedure, F.lit("]\n"))).otherwise("")
    before = F.when(F.trim(F.coalesce(context, F.lit(""))) != "", F.concat(F.trim(context), F.lit("\n"))).otherwise("")
    return F.concat(named, F.lit("["), label, F.lit("]\n"), before)


def chunk_tables(rows: DataFrame, key: str, order: list[str], headers: list[str], cells: Column, prefix: Column | None = None, size: int = TABLE_ROWS, most: int = TABLE_TOKENS, least: int = LEAST_CHARS) -> DataFrame:
    """key, part, n_rows, chunk: tables as Markdown behind their prefix (table_prefix(); the same in all rows of a table). A table of `most` tokens at most is one chunk; a larger one is cut
    into groups of `size` rows, each with prefix and header. Chunks under `least` characters go."""
    head = F.array(*map(F.lit, headers))
    own = Window.partitionBy(key)
    bare = F.length(markdown_table(head, F.array().cast("array<array<string>>")))
    numbered = rows.select(key, F.row_number().over(own.orderBy(*order)).alias("_i"), cells.alias("_c"), (prefix if prefix is not None else F.lit("")).alias("_p"))
    numbered = numbered.withColumn("_n", F.length(markdown_table(head, F.array("_c"))) - bare)
    tokens = F.floor((F.length("_p") + bare + F.sum("_n").over(own)) / 1.5)
    part = F.when(tokens <= most, 0).otherwise(F.floor((F.col("_i") - 1) / size)).cast("int")
    groups = numbered.withColumn("part", part).groupBy(key, "part").agg(F.sort_array(F.collect_list(F.struct("_i", "_c"))).alias("_r"), F.count("*").alias("n_rows"), F.min("_p").alias("_p"))
    chunk = F.trim(F.concat("_p", markdown_table(head, F.transform("_r", lambda x: x["_c"]))))
    return groups.select(key, "part", "n_rows", chunk.alias("chunk")).where(F.length("chunk") >= least)


def mixed_segments(segments: DataFrame, key: str, order: list[str], is_table: Column, text: Column) -> DataFrame:
    """key, island, last, block, n: runs of text between tables as one block each, in order (gaps and islands). island: how many tables stand before; last: none stands
    behind."""
    w = Window.partitionBy(key).orderBy(*order)
    islands = segments.withColumn("_t", is_table).withColumn("island", F.sum(F.col("_t").cast("int")).over(w)).withColumn("_i", F.row_number().over(w)).withColumn("_x", text)
    islands = islands.withColumn("_all", F.max("island").over(Window.partitionBy(key)))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_x"))), lambda x: x["_x"]), "\n")
    return islands.where(~F.col("_t")).groupBy(key, "island").agg((F.max("island") == F.max("_all")).alias("last"), joined.alias("block"), F.count("*").alias("n"))


def chunk_segments(segments: DataFrame, key: str, order: list[str], is_table: Column, text: Column, name: Column) -> DataFrame:
    """key, island, chunk_index, field_type, article, clause, chunk of the text in documents of segments with tables between: blocks before a table are cleaned and cut by the recursive
    splitter; the last block of a document is chunked by its type, procedure decision or statute (see chunk_documents()). Segments that are blank or null are left out; chunk_index counts
    within a block. Tables are chunked by chunk_tables()."""
    ship(segments.sparkSession)
    kept = segments.withColumn("_name", name).where(is_table | (F.trim(F.coalesce(text, F.lit(""))) != ""))
    blocks = mixed_segments(kept, key, order, is_table, F.trim(text))
    names = kept.groupBy(key).agg(F.min("_name").alias("_name"))
    last = blocks.where("last").join(names, key)
    typed = chunk_documents(last.select(key, "block", "_name"), key, "block", "_name", types=("quyet_dinh_tthc", "luat_nghi_dinh")).join(last.select(key, "island"), key)
    earlier = blocks.where("not last").select(key, "island", nfc(F.col("block")).alias("_text")).withColumn("_text", clean_text(F.col("_text")))
    cut = with_pieces(earlier, "_text").select(key, "island", F.posexplode(F.filter("_pieces", lambda x: F.length(x) >= LEAST_CHARS)).alias("chunk_index", "chunk"))
    none = F.lit("")
    cut = cut.select(key, "island", "chunk_index", F.lit("general").alias("field_type"), none.alias("article"), none.alias("clause"), "chunk")
    return typed.select(*cut.columns).unionByName(cut)


def with_prefix(text: Column, source: Column, article: Column) -> Column:
    return F.concat(F.lit("[Văn bản: "), source, F.lit("]\n["), article, F.lit("]\n"), text)


def chunk_documents(df: DataFrame, key: str, text: str, name: str, clean: bool = True, fallback: str = "recursive", types: tuple[str, ...] = ("quyet_dinh_tthc", "quy_trinh_noi_bo", "luat_nghi_dinh")) -> DataFrame:
    """key, chunk_index, field_type, article, clause, chunk: articles of statutes, sections of procedure decisions and steps of internal workflows with
    their prefix, and the pieces of all other documents and of those without such parts: pack_paragraphs(), or fixed windows if fallback is "windows".

    types: the types that are told; documents of others are none of these. Texts under LEAST_CHARS go, before and after they are cleaned (clean_text(), unless clean is False); so do chunks. Null texts give nothing. Each
    document is typed and cut where it is read: nothing is shuffled, and no text is written in between."""
    ship(df.sparkSession)
    long_ = lambda x: F.when(F.length(F.trim(x)) >= LEAST_CHARS, x)
    held = df.select(key, long_(F.col(text)).alias("_text"), F.coalesce(F.col(name), F.lit("")).alias("_name"))
    if clean:
        held = held.withColumn("_text", nfc(F.col("_text"))).withColumn("_text", clean_text(F.col("_text"))).withColumn("_text", long_(F.col("_text")))
    typed = held.withColumn("_type", F.when(F.col("_text").isNotNull(), detect_doc_type(F.col("_text"), F.col("_name"))))
    t, none = F.col("_text"), F.lit("")
    piece = lambda kind, chunk: F.struct(kind.alias("field_type"), none.alias("article"), none.alias("clause"), chunk.alias("chunk"))
    unnamed = lambda xs: F.transform(xs, lambda x: piece(x["field_type"], x["chunk"]))
    parts = {"quyet_dinh_tthc": unnamed(procedure_pieces(t)), "quy_trinh_noi_bo": unnamed(workflow_pieces(t)), "luat_nghi_dinh": article_pieces(t, F.col("_name"))}
    found = reduce(lambda c, kind: c.when(F.col("_type") == kind, parts[kind]), types, F.when(F.lit(False), unnamed(procedure_pieces(t))))
    rows = typed.select(key, "_text", found.alias("_found"))
    bare = F.coalesce(F.size("_found"), F.lit(0)) <= 0
    if fallback == "recursive":
        rows = with_pieces(rows.withColumn("_text", F.when(bare, t)), "_text")
    else:
        rows = rows.withColumn("_pieces", F.when(bare & t.isNotNull(), F.transform(windows_of(t), lambda x: F.trim(x))))
    plain = F.transform(F.filter("_pieces", lambda x: F.length(x) >= LEAST_CHARS), lambda x: piece(F.lit("general"), x))
    cut = rows.select(key, F.posexplode_outer(F.when(bare, plain).otherwise(F.col("_found"))).alias("chunk_index", "_x")).where("chunk_index is not null")
    return cut.select(key, "_x.field_type", "_x.article", "_x.clause", "_x.chunk", "chunk_index")


def find_blanks(df: DataFrame, key: str, text: str) -> DataFrame:
    """Blanks to fill in (runs of dots or underscores, boxes), numbered, with the label to their left."""
    lines = df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line", "t"))
    found = lines.select(key, "line", F.posexplode(F.regexp_extract_all("t", F.lit("([^_.…☐□]*)(_{3,}|\\.{3,}|…+|☐|□)"), F.lit(0))).alias("position", "x"))
    return found.select(key, "line", "position", F.trim(F.regexp_extract("x", "^([^_.…☐□]*)", 1)).alias("label"), (F.row_number().over(Window.partitionBy(key).orderBy("line", "position"))).alias("number"))


def total_time(text: Column) -> Column:
    """What stands under the line on the total processing time; empty without one."""
    return F.trim(F.regexp_extract(text, "(?iu)T[oổ]ng\\s+th[oờ]i\\s+gian\\s+gi[aả]i\\s+quy[eế]t\\s+TTHC[^\\n]*\\n(.{3,80})", 1))


#: What each kind of line matches, in this order, and what of it is no content.
LINE_KINDS = [
    ("procedure", "(?iu)^\\[Thủ tục:\\s*(.*?)\\]$", ""),
    ("section", "(?iu)^\\[Mục:\\s*(.*?)\\]$", ""),
    ("heading", "(?iu)^(?:\\([0-9]+\\)\\s+|Điều\\s+[0-9]+|[0-9]+\\.\\s+[A-ZĐ])", ""),
    ("step", "(?iu)^Bước\\s+[0-9]+", ""),
    ("agency_time", "(?iu)^-\\s*(?:Cơ quan thực hiện|Thời hạn|Địa điểm tiếp nhận)", "^-\\s*"),
    ("subheading", "(?iu)^-\\s*(?:Thành phần|Số lượng|Trình tự|Cách thức|Cơ quan|Yêu cầu|Điều kiện|Hồ sơ)", "^-\\s*"),
    ("item", "^(?:\\+|•|- )", "^[+•\\-]\\s*"),
    ("case_note", "(?iu)^(?:Trường hợp|Lưu ý|Đối với|Người sử dụng đất|Cơ quan tiếp nhận)(?!\\w)", ""),
]


def classify_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line, kind, content of the lines that are not blank: the first of LINE_KINDS that a line matches, else text; titles without their brackets, items and the like without
    their mark."""
    lines = df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line", "t")).withColumn("t", F.regexp_replace("t", "^\\s+|\\s+$", "")).where("t <> ''")
    kind, content = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for name, pattern, mark in LINE_KINDS:
        matches = F.col("t").rlike(pattern)
        kind = kind.when(matches, name)
        content = content.when(matches, F.trim(F.regexp_extract("t", pattern, 1)) if name in ("procedure", "section") else F.regexp_replace("t", mark, "") if mark else F.col("t"))
    return lines.select(key, "line", kind.otherwise("text").alias("kind"), content.otherwise(F.col("t")).alias("content"))


def extract_changes(df: DataFrame, key: str, text: str) -> DataFrame:
    """Changes that a text orders: verb, then article with an optional clause and point within 240 characters; each once."""
    whole = "(?iu)(bãi\\s+bỏ|sửa\\s+đổi(?:\\s*,?\\s*bổ\\s+sung)?|bổ\\s+sung|thay\\s+thế)(?s:(.{0,240}?))(?:(điểm\\s+[a-zđ])\\s+(?:tại\\s+)?)?(?:(khoản\\s+\\d+[a-zđ]?)\\s+(?:tại\\s+)?)?(điều\\s+\\d+[a-zđ]?)"
    rows = df.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(whole), F.lit(0))).alias("position", "m"))
    part = lambda i: F.lower(F.trim(F.regexp_replace(F.regexp_extract("m", whole, i), "\\s+", " ")))
    verb = part(1)
    action = F.when(verb.contains("bãi bỏ"), "repeal").when(verb.contains("thay thế"), F.when(part(2).contains("cụm từ"), "replace_text").otherwise("replace")).when(verb.startswith("bổ sung"), "add").otherwise("amend")
    rows = rows.select(key, "position", action.alias("action"), part(5).alias("article"), part(4).alias("clause"), part(3).alias("point"), F.substring(F.regexp_replace("m", "\\s+", " "), 1, 500).alias("evidence"))
    rows = rows.withColumn("confidence", F.when((F.col("clause") != "") | (F.col("point") != ""), 0.96).otherwise(0.90))
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key, "action", "article", "clause", "point").orderBy("position"))).where("_r = 1").drop("_r")


def chunk_stats(chunks: DataFrame, by: list[str], tokens: Column, is_table: Column) -> DataFrame:
    """n, tables and mean_tokens (whole number) of chunks."""
    mean = F.floor(F.sum(tokens) / F.greatest(F.count("*"), F.lit(1)))
    return chunks.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.coalesce(is_table, F.lit(False))).alias("tables"), mean.alias("mean_tokens"))


def doc_outline(text: Column) -> Column:
    """articles: the distinct article headings of a text in order; procedure: its first line from "Thủ tục", else null."""
    articles = F.array_distinct(F.regexp_extract_all(text, F.lit("Điều \\d+[a-zđ]?"), F.lit(0)))
    procedure = F.nullif(F.trim(F.regexp_extract(text, "Thủ tục [^\\n]*", 0)), F.lit(""))
    return F.struct(articles.alias("articles"), procedure.alias("procedure"))


def term_hits(df: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """key, term, n: how often each term stands in a text, in any case; of terms that begin at one place the longest counts."""
    longest = sorted(terms, key=lambda t: (-len(t), t))
    pattern = "|".join(re.sub(r"([^\w\s])", r"\\\1", t.lower()) for t in longest)
    found = df.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))).alias("term"))
    return found.groupBy(key, "term").agg(F.count("*").alias("n"))


def ingest_manifest(manifest: DataFrame, docs: DataFrame, key: str, text: str, name: str, dry_run: bool = False, sink: str | None = None, **how) -> DataFrame:
    """key, status, n_chunks for each file of the manifest: indexed if its document gives a chunk, else error (a document that is not there too).
    The chunks of the files are written to sink as Parquet, with the manifest's columns, unless dry_run is set. how: as for chunk_documents()."""
    chunks = chunk_documents(docs.join(manifest.select(key), key, "left_semi"), key, text, name, **how)
    if sink and not dry_run:
        chunks.join(manifest.drop(*(c for c in chunks.columns if c != key)), key).write.mode("overwrite").parquet(sink)
        chunks = manifest.sparkSession.read.parquet(sink)
    made = chunks.groupBy(key).agg(F.count("*").alias("_n"))
    n = F.coalesce("_n", F.lit(0)).cast("long")
    return manifest.select(key).join(made, key, "left").select(key, F.when(n > 0, "indexed").otherwise("error").alias("status"), n.alias("n_chunks"))
