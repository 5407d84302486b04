"""Form submissions: one schema, compiled into expressions, over a table of answers (id, answers map<string, string>)."""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterator
from contextlib import suppress
from dataclasses import dataclass, field
from decimal import Decimal, InvalidOperation
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import parse_number, strip_accents
from ..session import ship

YES, NO = ["có", "co", "yes", "true", "1", "x"], ["không", "khong", "no", "false", "0"]
SKIPPED = "__skipped__"
#: Answers that a boolean may have.
BOOLEANS = ["có", "co", "yes", "true", "1", "x", "☑", "đúng", "rồi", "được", "không", "khong", "no", "false", "0", "☐", "sai", "chưa", "ko"]
#: Words for papers, which are no name or address.
PAPERS = "(?iu)\\b(bản\\s*sao|cccd|cmnd|sổ\\s*đỏ|giấy\\s*chứng\\s*nhận|hộ\\s*khẩu|hợp\\s*đồng|biên\\s*lai|chứng\\s*từ|tờ\\s*khai)\\b"
#: Sources that fill a field, the tag of filled fields and the names (without accents) that tell one.
FILLED_SOURCES = ["ai_document", "current_date", "formula"]
AUTO_FILL_TAG = "[TU_DONG_DIEN]"
AUTO_FILL = ["noi\\s*nhan", "tinh.*noi\\s*viet", "noi\\s*viet", "^ngay$", "^thang$", "^nam$", "thoi\\s*han", "le\\s*phi", "co\\s*quan\\s*tiep\\s*nhan", "co\\s*quan\\s*co\\s*tham\\s*quyen", "can\\s*cu\\s*phap\\s*ly"]
#: How a message declares each field, and how it says that there is none.
DECLARED = {
    "receiver": "(?iu)(?:nơi\\s*tiếp\\s*nhận(?:\\s*là)?|kính\\s*gửi)\\s*[:=]?\\s*([^;,\\.]+)",
    "name": "(?iu)(?:tôi\\s*tên(?:\\s*là)?|họ\\s*và\\s*tên(?:\\s*là)?|tên\\s*tôi\\s*là)\\s*[:=]?\\s*([^;,\\.]+)",
    "identity_edit": "(?iu)sửa\\s*lại\\s*(?:giấy\\s*tờ\\s*nhân\\s*thân\\s*(?:thành)?)\\s*[:=]?\\s*([^;\\.]+)",
    "identity": "(?iu)(?:giấy\\s*tờ\\s*nhân\\s*thân(?:\\s*là)?\\s*[:=]?\\s*|(?<!\\w)(?:cccd|cmnd|căn\\s*cước\\s*công\\s*dân)\\s*(?:số)?\\s*[:=]?\\s*)([a-zA-Z0-9\\s]+?)(?=[;,\\.]|(?:\\s+địa\\s*chỉ|\\s+điện\\s*thoại|$))",
    "address": "(?iu)(?:địa\\s*chỉ(?:\\s*là)?)\\s*[:=]?\\s*([^;]+?)(?=[;]|(?:\\s+điện\\s*thoại|\\s+sđt|$))",
    "phone": "(?iu)(?:số\\s*điện\\s*thoại(?:\\s*đúng)?(?:\\s*là)?|điện\\s*thoại(?:\\s*là)?|sđt(?:\\s*là)?)\\s*[:=]?\\s*([0-9\\s\\.\\-\\+]{9,15})",
    "email": "(?iu)(?:email(?:\\s*là)?|hộp\\s*thư(?:\\s*điện\\s*tử)?(?:\\s*là)?)\\s*[:=]?\\s*([^\\s;,]+@[^\\s;,]+)",
    "change": "(?iu)(?:nội\\s*dung\\s*biến\\s*động(?:\\s*là)?)\\s*[:=]?\\s*([^;]+?)(?=[;]|$)",
    "second_paper": "(?iu)(?:giấy\\s*tờ(?:\\s*liên\\s*quan)?\\s*thứ\\s*hai(?:\\s*là)?)\\s*[:=]?\\s*([^;]+?)(?=[;]|$)",
    "third_paper": "(?iu)(?:giấy\\s*tờ(?:\\s*liên\\s*quan)?\\s*thứ\\s*ba(?:\\s*là)?)\\s*[:=]?\\s*([^;]+?)(?=[;]|$)",
    "place": "(?iu)(?:nơi\\s*viết\\s*đơn(?:\\s*là)?)\\s*[:=]?\\s*([^;\\.]+)",
}
NONE_OF = {
    "phone": "(?iu)(?:không\\s*có\\s*(?:số\\s*)?điện\\s*thoại|bỏ\\s*qua\\s*(?:trường\\s*)?(?:số\\s*)?điện\\s*thoại)",
    "email": "(?iu)(?:không\\s*có\\s*email|bỏ\\s*qua\\s*(?:trường\\s*)?email|không\\s*có\\s*hộp\\s*thư)",
}
ENDS = "^[ .;,]+|[ .;,]+$"


@dataclass
class Field:
    key: str
    type: str = "text"
    required: bool = True
    order: int | None = None
    options: list[str] = field(default_factory=list)
    depends_on: tuple[str, str] | None = None  # parent, value
    derived_from: tuple[str, str] | None = None  # parent, value
    group: str | None = None  # one of the group is enough
    formula: str | None = None
    name: str | None = None  # answers may be given under it
    box: tuple[str, int] | None = None  # a group of digit boxes, and which of them this is (from 0)


def value(key: str) -> Column:
    """An answer; null if missing, blank or skipped."""
    v = F.try_element_at("answers", F.lit(key))
    return F.when((F.trim(v) != "") & (v != SKIPPED), v)


def put(key: str, v: Column) -> Column:
    """answers with a key set, or removed where v is null."""
    rest = F.map_filter("answers", lambda k, _: k != key)
    return F.when(v.isNull(), rest).otherwise(F.map_concat(rest, F.create_map(F.lit(key), v)))


def normalize_values(rows: DataFrame, fields: list[Field]) -> DataFrame:
    """Booleans as có or không, digit groups as digits, names in title case."""
    for f in fields:
        v = value(f.key)
        if f.type == "boolean":
            rows = rows.withColumn("answers", put(f.key, F.when(F.lower(F.trim(v)).isin(YES), "có").when(F.lower(F.trim(v)).isin(NO), "không").otherwise(v)))
        elif f.type == "digits":
            rows = rows.withColumn("answers", put(f.key, F.regexp_replace(v, "\\D", "")))
        elif f.type == "name":
            rows = rows.withColumn("answers", put(f.key, F.initcap(F.trim(v))))
    return rows


def invalid_keys(fields: list[Field]) -> Column:
    """Keys whose answers do not fit their type, in the fields' order; missing answers are not invalid. Names and addresses must not be words for
    papers; options are compared without case and outer blanks."""
    low = lambda v: F.lower(F.trim(v))
    checks = {
        "phone": lambda v: F.regexp_replace(v, "[ -]", "").rlike("^(0|\\+84)[0-9]{8,10}$"),
        "email": lambda v: ~v.contains("@") | v.rlike("^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$"),
        "boolean": lambda v: low(v).isin(BOOLEANS),
        "digits": lambda v: F.regexp_replace(v, "[\\s.\\-/]", "").rlike("^\\d*$"),
        "number": lambda v: parse_number(v).isNotNull(),
        "name": lambda v: ~v.rlike(PAPERS),
        "address": lambda v: ~v.rlike(PAPERS),
    }
    found = []
    for f in fields:
        ok = checks.get(f.type, lambda v: F.lit(True))(value(f.key))
        ok = low(value(f.key)).isin([o.strip().lower() for o in f.options]) if f.type == "choice" and f.options else ok
        found.append(F.when(value(f.key).isNotNull() & ~F.coalesce(ok, F.lit(False)), f.key))
    return F.array_compact(F.array(*found))


def auto_fill_flag(source: Column, flag: Column, description: Column, name: Column) -> Column:
    """Whether a field is filled without asking: by its source if that is given, else by its flag, the tag in its description or its name."""
    by_name = strip_accents(name).rlike("|".join(f"(?:{p})" for p in AUTO_FILL))
    marked = F.coalesce(flag, F.lit(False)) | F.coalesce(description.contains(AUTO_FILL_TAG), F.lit(False)) | F.coalesce(by_name, F.lit(False))
    return F.when(source.isin(FILLED_SOURCES), True).when(source == "user_input", False).otherwise(marked)


def record_submissions(submissions: DataFrame, path: str) -> None:
    """Appends exports to the log."""
    submissions.write.mode("append").parquet(path)


def submission_history(log: DataFrame, by: list[str], at: str) -> DataFrame:
    """n and last of the exports of each form and user."""
    return log.groupBy(*by).agg(F.count("*").alias("n"), F.max(at).alias("last"))


def derive_fields(rows: DataFrame, fields: list[Field]) -> DataFrame:
    """Derived answers: có or không by their parent's answer; none where the parent has none."""
    for f in fields:
        if f.derived_from:
            parent, wanted = f.derived_from
            rows = rows.withColumn("answers", put(f.key, F.when(value(parent).isNotNull(), F.when(value(parent) == wanted, "có").otherwise("không"))))
    return rows


def levels(fields: list[Field]) -> list[Field]:
    """Dependent fields, parents first; a cycle is an error of the schema."""
    by_key, out = {f.key: f for f in fields}, []

    def visit(f: Field, path: tuple[str, ...]) -> None:
        if f.key in path:
            raise ValueError(f"fields depend on each other: {path}")
        if f in out or not f.depends_on:
            return
        if f.depends_on[0] in by_key:
            visit(by_key[f.depends_on[0]], (*path, f.key))
        out.append(f)

    for f in fields:
        visit(f, ())
    return out


def apply_dependencies(rows: DataFrame, fields: list[Field]) -> DataFrame:
    """A child is skipped where its parent is answered otherwise or skipped, and open again where the answer fits; parents first, so it cascades.

    The column auto_skipped (array of keys; made where it is missing) tells the children that these rules skipped: only they open again, and what a user skipped stays so."""
    if "auto_skipped" not in rows.columns:
        rows = rows.withColumn("auto_skipped", F.array().cast("array<string>"))
    for f in levels(fields):
        parent, wanted = f.depends_on
        raw = F.try_element_at("answers", F.lit(parent))
        now = F.try_element_at("answers", F.lit(f.key))
        skip = F.coalesce((raw == SKIPPED) | (value(parent).isNotNull() & (value(parent) != wanted)), F.lit(False))
        automatic = F.coalesce(F.array_contains("auto_skipped", f.key), F.lit(False))
        by_user = F.coalesce(now == SKIPPED, F.lit(False)) & ~automatic
        answer = F.when(by_user, SKIPPED).when(skip, SKIPPED).when(F.coalesce(now == SKIPPED, F.lit(False)), None).otherwise(now)
        others = F.filter(F.coalesce("auto_skipped", F.array().cast("array<string>")), lambda k: k != f.key)
        rows = rows.withColumns({"answers": put(f.key, answer), "auto_skipped": F.when(skip & ~by_user, F.array_append(others, F.lit(f.key))).otherwise(others)})
    return rows


def settle_one_of(rows: DataFrame, fields: list[Field]) -> DataFrame:
    """Of a group with an answer, the empty members are skipped; of one without, skipped members are open again."""
    groups: dict[str, list[str]] = {}
    for f in fields:
        if f.group:
            groups.setdefault(f.group, []).append(f.key)
    for keys in groups.values():
        rows = rows.withColumn("_done", F.coalesce(*(value(k) for k in keys)).isNotNull())
        for k in keys:
            rows = rows.withColumn("answers", put(k, F.when(value(k).isNotNull(), value(k)).when(F.col("_done"), SKIPPED)))
        rows = rows.drop("_done")
    return rows


def formula_value(formula: str, of: Callable[[str], Any], number: Callable[[str], Any] = lambda t: F.lit(float(t)), divide: Callable[[Any, Any], Any] = F.try_divide) -> Any:
    """A formula of [references], numbers, + - * / and brackets as an expression, by default a column: null where a divisor is 0 or an input is missing. of, number and
    divide make the operands of another kind, which + - * must join."""
    parts = re.findall(r"\[[^\]]+\]|\d+(?:\.\d+)?|[-+*/()]|\S", formula)

    def take(*wanted: str) -> str | None:
        return parts.pop(0) if parts and parts[0] in wanted else None

    def factor() -> Any:
        if sign := take("-", "+"):
            return -factor() if sign == "-" else factor()
        if take("("):
            inner = total()
            if not take(")"):
                raise ValueError(f"not a formula: {formula}")
            return inner
        part = parts.pop(0) if parts else ""
        if part.startswith("["):
            return of(part[1:-1])
        if not re.fullmatch(r"\d+(?:\.\d+)?", part):
            raise ValueError(f"not a formula: {formula}")
        return number(part)

    def product() -> Any:
        out = factor()
        while sign := take("*", "/"):
            out = out * factor() if sign == "*" else divide(out, factor())
        return out

    def total() -> Any:
        out = product()
        while sign := take("+", "-"):
            out = out + product() if sign == "+" else out - product()
        return out

    result = total()
    if parts:
        raise ValueError(f"not a formula: {formula}")
    return result


class Later:
    """A number that is known when the answers are."""

    def __init__(self, get: Callable[[dict], Decimal]):
        self.get = get

    def _with(self, other: Later, op: Callable[[Decimal, Decimal], Decimal]) -> Later:
        return Later(lambda answers: op(self.get(answers), other.get(answers)))

    def __add__(self, other: Later) -> Later:
        return self._with(other, operator.add)

    def __sub__(self, other: Later) -> Later:
        return self._with(other, operator.sub)

    def __mul__(self, other: Later) -> Later:
        return self._with(other, operator.mul)

    def __truediv__(self, other: Later) -> Later:
        return self._with(other, operator.truediv)

    def __neg__(self) -> Later:
        return Later(lambda answers: -self.get(answers))


def decimal_of(v: str | None) -> Decimal:
    """parse_number() for one answer, exactly; an InvalidOperation where there is no number."""
    t = re.sub(r"\s", "", "" if v is None or v == SKIPPED else v)
    if re.fullmatch(r"-?\d{1,3}(\.\d{3})+,\d+", t):
        t = t.replace(".", "").replace(",", ".")
    elif re.fullmatch(r"-?\d{1,3}([.,]\d{3})+", t):
        t = re.sub("[.,]", "", t)
    elif not re.fullmatch(r"-?\d+([.,]\d+)?", t):
        raise InvalidOperation
    return Decimal(t.replace(",", "."))


def _printed(x: Decimal) -> str:
    if not x.is_finite():
        raise InvalidOperation
    return str(x.quantize(Decimal(1))) if x == x.to_integral_value() else format(x.normalize(), "f")


def _calculated(formulas: list[tuple[str, Later]], at: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for pairs in batch.column(at).to_pylist():
                answers = None if pairs is None else dict(pairs)
                for key, number in formulas if answers is not None else ():
                    answers.pop(key, None)
                    with suppress(ArithmeticError):  # also of decimals: a divisor of 0, an input that is no number
                        answers[key] = _printed(number.get(answers))
                out.append(None if answers is None else list(answers.items()))
            columns = list(batch.columns)
            columns[at] = pa.array(out, pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return run


def calc_fields(rows: DataFrame, fields: list[Field]) -> DataFrame:
    """Formulas in display order, over decimals of 28 digits: whole results without decimals, others without trailing zeros; no answer where an
    input is missing or no number, or a divisor is 0. References are keys, or names where no key is called so."""
    keys = {f.name: f.key for f in fields if f.name} | {f.key: f.key for f in fields}
    of = lambda ref: Later(lambda answers, k=keys.get(ref.strip(), ref.strip()): decimal_of(answers.get(k)))
    ordered = sorted((f for f in fields if f.formula), key=lambda f: f.order or 0)
    formulas = [(f.key, formula_value(f.formula, of, lambda t: Later(lambda _, d=Decimal(t): d), operator.truediv)) for f in ordered]
    if not formulas:
        return rows
    ship(rows.sparkSession)
    return rows.mapInArrow(_calculated(formulas, rows.columns.index("answers")), rows.schema)


def missing_fields(rows: DataFrame, fields: list[Field], key: str = "id") -> DataFrame:
    """key, field, place: what to ask next, in order: open required fields, one for each group without an answer; a child waits for its parent."""
    spark = rows.sparkSession
    schema = spark.createDataFrame([(f.key, f.order if f.order is not None else (i + 1) * 100, f.group, f.depends_on[0] if f.depends_on else None) for i, f in enumerate(fields) if f.required and not f.formula and not f.derived_from], "field string, place int, group string, parent string")
    named = F.array(*(F.struct(F.lit(f.key).alias("field"), F.try_element_at("answers", F.lit(f.key)).alias("v")) for f in fields))
    long_ = rows.select(key, F.explode(named).alias("x")).select(key, "x.field", F.when(F.trim("x.v") != "", F.col("x.v")).alias("v"))
    asked = long_.join(F.broadcast(schema), "field")
    w = Window.partitionBy(key, F.coalesce("group", "field"))
    rows_ = asked.withColumn("_met", F.max(F.col("v").isNotNull()).over(w)).withColumn("_r", F.row_number().over(w.orderBy("place"))).where("not _met and _r = 1")
    parents = long_.select(F.col(key).alias("_k"), F.col("field").alias("_f"), F.col("v").alias("_pv"))
    waits = rows_.join(parents, (F.col(key) == F.col("_k")) & (F.col("parent") == F.col("_f")), "left").where("parent is null or _pv is not null")
    return waits.select(key, "field", "place")


def given(f: Field) -> Column:
    """A field's answer under its key, or else under its name."""
    return F.coalesce(value(f.key), value(f.name)) if f.name else value(f.key)


def required_missing(rows: DataFrame, fields: list[Field], key: str = "id") -> DataFrame:
    """key, missing: required fields without an answer under their key or name, by name where they have one. A group of digit boxes is missing once: if neither the group nor its first box has an
    answer."""
    out, seen = [], set()
    for f in (f for f in fields if f.required):
        group = f.box and f.box[0]
        if group in seen:
            continue
        if group:
            seen.add(group)
        answer = F.coalesce(value(group), given(f)) if group else given(f)
        out.append(F.when(answer.isNull(), f.name or f.key))
    return rows.select(key, F.array_compact(F.array(*out)).alias("missing"))


#: Digits of a tax number, and the box of a template that each of them is printed in, from the left.
TAX_DIGITS = 13
TAX_BOXES = [12, 11, 7, 8, 10, 9, 1, 0, 6, 5, 4, 3, 2]


def render_values(rows: DataFrame, fields: list[Field], key: str = "id", tax: dict[str, list[int]] | None = None) -> DataFrame:
    """A column for each field as printed: skipped and missing ones empty, booleans as X or empty, digits one a box, all of them; a field that is a
    box of a group has the digit at its place (a blank beyond the last) of the group's answer, or of its own.

    tax: for keys with a tax number, the numbers of the box groups of a template that show it. The number, padded to TAX_DIGITS, fills a column mst_group_box
    for each box, in the order that the template has them."""
    out = []
    digits = lambda v: F.regexp_replace(F.coalesce(v, F.lit("")), "\\D", "")
    for f in fields:
        v = F.coalesce(given(f), F.lit(""))
        if f.box:
            whole = digits(F.coalesce(value(f.box[0]), given(f)))
            v = F.when(whole == "", "").when(F.length(whole) > f.box[1], F.substring(whole, f.box[1] + 1, 1)).otherwise(" ")
        elif f.type == "boolean":
            v = F.when(v == "có", "X").otherwise("")
        elif f.type == "digits":
            v = F.trim(F.regexp_replace(v, "(.)", "$1 "))
        out.append(v.alias(f.key))
    for k, groups in (tax or {}).items():
        padded = F.rpad(digits(value(k)), TAX_DIGITS, " ")
        out += [F.trim(F.substring(padded, place + 1, 1)).alias(f"mst_{g}_{box}") for g in groups for place, box in enumerate(TAX_BOXES)]
    return rows.select(key, *out)


#: The words by which a co-owner's answer is told, in this order; the first needs one of both kinds.
OWNER_NAME, OWNER_OF = "tên|người|tổ chức|chu_so_huu", "đồng sở hữu|dsh|đồng"
OWNER_TAX, OWNER_ID, OWNER_SHARE = "mst|mã số thuế|ma_so_thue", "cmnd|cccd|hộ chiếu|hc", "tỷ lệ|ty le|ty_le|phần trăm|%"
OWNER_NUMBER, OWNER_FIRST = "(?:đồng sở hữu|dsh|sh|người)\\s*(\\d+)", "đồng sở hữu|dsh|tỷ lệ sh|ty le sh"


def co_owners(rows: DataFrame, fields: list[Field], key: str = "id") -> DataFrame:
    """key, owner (1 to 9), name, tax_id, identity, share of the co-owners that answers name: an answer's key and its field's name and group tell whose it is (the number
    after a word for owner, else the first number in the name, else 1 if it speaks of co-owners) and what it is. Shares end in %. Of several answers of one kind, the last by key counts."""
    known = [F.struct(F.lit(f.key.lower().strip()).alias("k"), F.lit((f.name or "").lower()).alias("name"), F.lit((f.group or "").lower()).alias("grp")) for f in fields]
    schema = F.array(*known) if known else F.array().cast("array<struct<k: string, name: string, grp: string>>")
    long_ = rows.select(key, F.explode("answers").alias("k", "v")).where((F.trim("v") != "") & (F.col("v") != SKIPPED))
    long_ = long_.withColumn("k", F.lower(F.trim("k"))).withColumn("_f", F.get(F.filter(schema, lambda f: f["k"] == F.col("k")), F.lit(0)))
    name = F.coalesce("_f.name", F.lit(""))
    said = F.trim(F.concat_ws(" ", "k", name, F.coalesce("_f.grp", F.lit(""))))
    number = F.coalesce(F.nullif(F.regexp_extract(said, OWNER_NUMBER, 1), F.lit("")), F.nullif(F.regexp_extract(name, "(\\d+)", 1), F.lit("")), F.when(said.rlike(OWNER_FIRST), "1"))
    kind = F.when(said.rlike(OWNER_NAME) & said.rlike(OWNER_OF), "name").when(said.rlike(OWNER_TAX), "tax_id").when(said.rlike(OWNER_ID), "identity").when(said.rlike(OWNER_SHARE), "share")
    v = F.trim("v")
    found = long_.select(key, number.try_cast("int").alias("owner"), kind.alias("a"), F.when((kind == "share") & ~v.contains("%"), F.concat(v, F.lit("%"))).otherwise(v).alias("v"), "k")
    found = found.where(F.col("owner").between(1, 9) & F.col("a").isNotNull())
    return found.groupBy(key, "owner").pivot("a", ["name", "tax_id", "identity", "share"]).agg(F.max_by("v", "k"))


def co_owner_rows(rows: DataFrame, attributes: list[str], key: str = "id") -> DataFrame:
    """key, owner and a column for each attribute, from keys such as name_1, share_2; a share ends in %."""
    long_ = rows.select(key, F.explode("answers").alias("k", "v")).where(F.col("k").rlike("^(" + "|".join(attributes) + ")_[1-9]$"))
    long_ = long_.select(key, F.regexp_extract("k", "_(\\d)$", 1).cast("int").alias("owner"), F.regexp_replace("k", "_\\d$", "").alias("a"), "v")
    v = F.when((F.col("a") == "share") & ~F.col("v").contains("%"), F.concat("v", F.lit("%"))).otherwise(F.col("v"))
    return long_.withColumn("v", v).groupBy(key, "owner").pivot("a", attributes).agg(F.first("v"))


def extract_declared(text: Column) -> Column:
    """The fields that a message declares, as a map; a phone or email that it says there is none of is skipped."""
    found = {}
    for key, pattern in DECLARED.items():
        found[key] = F.nullif(F.regexp_replace(F.regexp_extract(text, pattern, 1), ENDS, ""), F.lit(""))
    found["phone"] = F.nullif(F.regexp_replace(found["phone"], "[^\\d+]", ""), F.lit(""))
    edited = F.when(found["identity_edit"].rlike("(?iu)căn cước|cccd|cmnd"), found["identity_edit"])
    whole = F.regexp_replace(F.regexp_replace(F.regexp_extract(text, DECLARED["identity"], 0), ENDS, ""), "(?iu)^giấy\\s*tờ\\s*nhân\\s*thân(?:\\s*là)?\\s*[:=]?\\s*", "")
    found["identity"] = F.coalesce(edited, F.nullif(F.regexp_replace(whole, ENDS, ""), F.lit("")))
    del found["identity_edit"]
    for key, pattern in NONE_OF.items():
        found[key] = F.when(text.rlike(pattern), SKIPPED).otherwise(found[key])
    return F.map_filter(F.create_map(*(x for k, v in found.items() for x in (F.lit(k), v))), lambda _, v: v.isNotNull())
