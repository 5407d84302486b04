"""Conversation routing and analysis."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import first_match, strip_accents

#: Words of questions about law, of form answers and of declared fields, and what asks.
LEGAL = r"(?iu)\b(quy\s*định|quy\s*trình|thủ\s*tục|điều\s*khoản|luật|nghị\s*định|thông\s*tư|hạn\s*mức|lệ\s*phí|phí|thời\s*hạn|bao\s*lâu|mất\s*bao\s*lâu|cần\s*giấy\s*tờ|cần\s*chuẩn\s*bị|hồ\s*sơ\s*gồm|nộp\s*ở\s*đâu|gửi\s*ở\s*đâu|nộp\s*tại\s*đâu|tại\s*sao|vì\s*sao|mục\s*đích|giải\s*thích|cho\s*tôi\s*biết\s*về|tư\s*vấn|được\s*không|có\s*được\s*không)\b"
FILL = r"(?iu)^(\s*[\d,.]+\s*(m2|mét|ha|đồng|vnd|ngày|tháng|năm|%)?\s*|\s*\d{1,2}/\d{1,2}/\d{4}\s*|\s*\d{9,12}\s*)$"
DECLARED = r"(?iu)\b(tôi\s*tên|họ\s*tên|cccd|cmnd|căn\s*cước|địa\s*chỉ|điện\s*thoại|sđt|email|nơi\s*tiếp\s*nhận|nơi\s*viết\s*đơn|nội\s*dung\s*biến\s*động\s*là|giấy\s*tờ\s*thứ|giấy\s*tờ\s*liên\s*quan|hợp\s*đồng\s*chuyển\s*nhượng|tờ\s*khai\s*lệ\s*phí|bỏ\s*qua\s*trường|sửa\s*lại\s*giấy\s*tờ)\b"
ASKS = r"(?iu)(\?|\b(như\s*thế\s*nào|ra\s*sao|ở\s*đâu|mất\s*bao\s*lâu|bao\s*nhiêu|khi\s*nào|ai\s*có\s*thẩm\s*quyền|được\s*không)\b)"
INFO = ["nhung gi", "can nhung giay to gi", "bao nhieu tien", "thue suat", "nop o dau", "o dau", "bao lau", "mat bao lau", "thoi han", "quy dinh", "co duoc khong", "la gi", "the nao", "huong dan thu tuc"]


def route_mode(text: Column) -> Column:
    """The first explicit mode that a message asks for, else unknown."""
    return first_match(strip_accents(text), rules.MODES, "unknown")


def out_of_scope(text: Column) -> Column:
    plain = strip_accents(text)
    return reduce(lambda a, b: a | b, [plain.contains(p) for p in rules.OUT_OF_SCOPE])


def resolve_mode(saved: Column, explicit: Column) -> Column:
    return F.when(explicit.isin("rag", "exit_form"), "rag").when(explicit.isin("form", "resume_form"), "form").when(saved == "rag", "rag").otherwise("form")


def match_form(messages: DataFrame, forms: DataFrame, key: list[str], text: str) -> DataFrame:
    """messages with the first form (position, family as regular expression) whose family's words they have; none for questions. Forms are few and broadcast."""
    plain = messages.withColumn("_p", strip_accents(F.col(text)))
    asks = reduce(lambda a, b: a | b, [F.col("_p").contains(m) for m in INFO])
    hits = plain.where(~asks).join(F.broadcast(forms), F.expr("_p rlike family")).groupBy(*key).agg(F.min_by("form", "position").alias("form"))
    return messages.select(*key).join(hits, key, "left")


def digression(text: Column) -> Column:
    """FILL for an answer to a form, ASK_LEGAL for a question."""
    t = F.trim(text)
    words = F.size(F.filter(F.split(t, "\\s+"), lambda x: x != ""))
    short = (words <= 6) & ~t.contains("?") & ~t.rlike(LEGAL)
    return F.when(t.rlike(FILL) | t.contains(";") | t.rlike(DECLARED) | short, "FILL").when(t.rlike(ASKS) | t.rlike(LEGAL), "ASK_LEGAL").otherwise("FILL")


def skip_detect(text: Column, skippable: Column, phrases: list[str]) -> Column:
    """Whether a short message asks to skip a field that may be skipped."""
    plain = strip_accents(text)
    return skippable & (F.size(F.split(plain, " ")) <= 6) & reduce(lambda a, b: a | b, [plain.contains(p) for p in phrases])


def turn_pairs(messages: DataFrame, by: str, order: str) -> DataFrame:
    """Each user turn with the turn after it, where that is an answer."""
    w = Window.partitionBy(by).orderBy(order)
    rows = messages.withColumn("next_role", F.lead("role").over(w)).withColumn("answer", F.lead("text").over(w)).withColumn("answer_turn", F.lead(order).over(w))
    return rows.where("role = 'user' and next_role = 'assistant'").drop("next_role")


def conversation_detail(messages: DataFrame, by: str, order: str, fields: list[str]) -> DataFrame:
    """A row for each conversation with its messages nested, in order (a conversation's length bounds the array)."""
    return messages.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(order, *fields))).alias("messages"))


def record_feedback(messages: DataFrame, feedback: DataFrame, key: list[str], order: str, owner: str | None = None, by: str | None = None) -> DataFrame:
    """messages with the latest feedback on answers; others have none. owner and by: the columns of messages and of feedback with the conversation's user and
    the one who gives it; feedback of others than the owner is not recorded."""
    last = feedback.groupBy(*key, *([by] if by else [])).agg(F.max_by("value", order).alias("feedback"))
    if by:
        rows = messages.join(last.withColumnRenamed(by, "_by").withColumnsRenamed({k: f"_{k}" for k in key}), [*(F.col(k) == F.col(f"_{k}") for k in key), F.col(owner) == F.col("_by")], "left").drop("_by", *(f"_{k}" for k in key))
    else:
        rows = messages.join(last, key, "left")
    return rows.withColumn("feedback", F.when(F.col("role") == "assistant", F.col("feedback")))