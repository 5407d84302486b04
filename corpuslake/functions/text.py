"""Column functions over text: cleaning, normalising, tokens, labels. All but nfc() stay in the JVM."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import rules


@F.pandas_udf(StringType())
def nfc(c: pd.Series) -> pd.Series:
    """Unicode NFC; null stays null."""
    return c.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def fix_artifacts(c: Column) -> Column:
    """OCR artifacts: ligatures, dashes, invisible spaces, the ellipsis."""
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), rules.ARTIFACTS.items(), c)


def drop_foreign(c: Column) -> Column:
    """Characters outside ASCII, Latin letters and combining marks become spaces."""
    return F.regexp_replace(c, "[^\\u0000-\\u007F](?<![\\u00C0-\\u024F\\u0300-\\u036F\\u1E00-\\u1EFF])", " ")  # one test for ASCII characters


def drop_garbage(c: Column) -> Column:
    """drop_foreign(), then short runs of ASCII junk before a space or a Latin letter become spaces."""
    return F.regexp_replace(drop_foreign(c), "[<>'\"`~^\\\\|{}\\[\\]]{1,3}[A-Za-z0-9]{0,4}[,;:!?]{0,2}(?=\\s|[\\u00C0-\\u024F\\u1E00-\\u1EFF])", " ")


def squeeze_ws(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, "\t", " "), " {2,}", " ")


def _lines(c: Column, keep) -> Column:
    return F.array_join(F.filter(F.split(c, "\n"), keep), "\n")


def drop_page_numbers(c: Column) -> Column:
    """Lines that hold only a page number go."""
    return _lines(c, lambda x: ~F.trim(x).rlike(rules.PAGE_NUMBER_LINES))


def drop_repeat_headers(c: Column, pattern: str = rules.HEADER_LINES) -> Column:
    """Header lines stay only where they stand first."""
    trimmed = F.transform(F.split(c, "\n"), lambda x: F.trim(x))
    return _lines(c, lambda x, i: ~F.trim(x).rlike(pattern) | (F.array_position(trimmed, F.trim(x)) == i + 1))


def normalize_legal(c: Column) -> Column:
    """A space between a label and its number; bullets become dashes."""
    return F.regexp_replace(F.regexp_replace(c, "(Điều|Khoản|Điểm|Mục|Chương)(\\d+)", "$1 $2"), "(?m)^[•●▪▸►]\\s*", "- ")


def apply_corrections(c: Column, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements, in order."""
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def clean_text(c: Column, remove_headers: bool = True, corrections: list[tuple[str, str]] | None = None) -> Column:
    """All cleaning steps in order, for a column in NFC (see nfc(): a UDF can't stand inside the lambdas here)."""
    c = squeeze_ws(drop_garbage(fix_artifacts(c)))
    c = drop_page_numbers(c)
    c = drop_repeat_headers(c) if remove_headers else c
    c = apply_corrections(normalize_legal(c), corrections or [])
    return F.trim(F.regexp_replace(c, "\n{3,}", "\n\n"))


def clean_page(c: Column) -> Column:
    """Straight quotes and dashes; words broken at a line end are joined."""
    c = F.translate(c, "“”‘’–—", "\"\"''--")
    return F.trim(F.regexp_replace(F.regexp_replace(c, "([A-Za-zÀ-ỹ])-\n([A-Za-zÀ-ỹ])", "$1$2"), "[ \t]{2,}", " "))


def ocr_post(c: Column) -> Column:
    """No space before punctuation; runs of spaces and blank lines shortened."""
    c = reduce(lambda x, p: F.replace(x, F.lit(f" {p}"), F.lit(p)), [",", ".", ";", ":"], c)
    return F.trim(F.regexp_replace(F.regexp_replace(c, " {2,}", " "), "\n{3,}", "\n\n"))


def accent_table() -> tuple[str, str]:
    """Letters of Latin blocks that decompose, and their base letters; đ counts as d."""
    table = {"đ": "d", "Đ": "D"}
    for i in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(i))
        if len(base) > 1 and all(unicodedata.category(x) == "Mn" for x in base[1:]):
            table[chr(i)] = base[0]
    return "".join(table), "".join(table.values())


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def polish_snippet(c: Column) -> Column:
    """A snippet made readable: rules.SNIPPET_FIXES in order; lines of two words or fewer before the first real one go; a line that goes on (it ends
    in no sentence's end, or in a comma or the like) is joined with the next, unless that begins an item or step. Lines are parted by a blank one; null is empty."""
    c = F.coalesce(c, F.lit(""))
    for pattern, new, cased in rules.SNIPPET_FIXES:
        c = F.regexp_replace(c, f"(?dU{'' if cased else 'iu'}){pattern}", new.replace("\\1", "$1"))
    starts = lambda x, heads: reduce(lambda a, b: a | b, [x.startswith(h) for h in heads])
    ends = lambda x, tails: reduce(lambda a, b: a | b, [x.endswith(t) for t in tails])
    state = lambda done, now: F.struct(done.alias("done"), now.alias("now"))

    def step(s, line):
        orphan = (F.size(F.split(line, "(?U)\\s+")) <= 2) & ~starts(line, rules.SNIPPET_HEADS)
        goes_on = ends(s["now"], rules.SNIPPET_OPEN_ENDS) | ~s["now"].rlike("[.?!:]$")
        joined = goes_on & ~starts(line, (*rules.SNIPPET_ITEMS, "Bước "))
        return (
            F.when(s["now"].isNull(), state(s["done"], F.when(~orphan, line)))
            .when(joined, state(s["done"], F.concat(s["now"], F.lit(" "), line)))
            .otherwise(state(F.array_append(s["done"], s["now"]), line))
        )

    lines = F.filter(F.transform(F.split(c, "\n"), _strip), lambda x: x != "")
    start = state(F.array().cast("array<string>"), F.lit(None).cast("string"))
    merged = F.aggregate(lines, start, step, lambda s: F.when(s["now"].isNull(), s["done"]).otherwise(F.array_append(s["done"], s["now"])))
    return _strip(F.regexp_replace(F.array_join(merged, "\n\n"), "[ \t]+", " "))


def strip_accents(c: Column, slug: bool = False) -> Column:
    """Lower case without accents, white space squeezed; slug: letters and digits parted by single dashes."""
    c = F.translate(F.lower(c), *accent_table())
    return F.trim(F.regexp_replace(c, "[^a-z0-9]+", "-"), F.lit("-")) if slug else F.trim(F.regexp_replace(c, "\\s+", " "))


def norm_label(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.replace(F.coalesce(c, F.lit("")), F.lit("."), F.lit(" "))), "\\s+", " "))


def norm_question_key(question: Column, flt: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.trim(F.regexp_replace(F.lower(question), "\\s+", " ")), F.coalesce(flt, F.lit(""))), 256)


def tokens(c: Column, stop: list[str] | None = None) -> Column:
    """Words of two characters or more, lower case, without stop words; repeats stay."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[\\p{L}\\p{N}\\p{M}_]{2,}"), F.lit(0))
    stop = rules.STOP_WORDS if stop is None else stop
    return F.filter(found, lambda x: ~x.isin(stop)) if stop else found


def eval_tokens(c: Column) -> Column:
    """Distinct words, lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[\\p{L}\\p{N}\\p{M}_]+"), F.lit(0)))


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words of two token sets; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.bround(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)), 3)).otherwise(F.lit(0.0))


def token_coverage(target: Column, source: Column) -> Column:
    """The part of target's words that source has; 0 if either is empty."""
    return F.when((F.size(target) > 0) & (F.size(source) > 0), F.bround(F.size(F.array_intersect(target, source)) / F.size(target), 3)).otherwise(F.lit(0.0))


def token_estimate(c: Column, words: bool = False) -> Column:
    return F.size(F.filter(F.split(c, "\\s+"), lambda x: x != "")) if words else F.greatest(F.lit(1), F.floor(F.length(c) / 1.5)).cast("int")


def title_from_text(c: Column, n: int = 50) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def parse_doc_date(c: Column, kind: str = "issued") -> Column:
    """The first date written as day, month and year in words; kind="effective": the one from which the text says that it is in force, in words or
    with slashes. Null for days that no calendar has."""
    issued, effective = "(?iu)ngày\\s+(\\d{1,2})\\s*tháng\\s+(\\d{1,2})\\s*năm\\s+(\\d{4})", "(?iu)có hiệu lực (?:thi hành )?(?:kể )?từ ngày\\s+(\\d{1,2})(?:\\s*/\\s*|\\s*tháng\\s+)(\\d{1,2})(?:\\s*/\\s*|\\s*năm\\s+)(\\d{4})"
    part = lambda i: F.regexp_extract(c, {"issued": issued, "effective": effective}[kind], i)
    return F.try_to_date(F.concat_ws("-", part(3), F.lpad(part(2), 2, "0"), F.lpad(part(1), 2, "0")), "yyyy-MM-dd")


def parse_number(c: Column) -> Column:
    """Numbers with . for thousands and , for decimals; one separator before three last digits is for thousands; null if neither reading fits."""
    t = F.regexp_replace(c, "\\s", "")
    both, one = t.rlike("^-?\\d{1,3}(\\.\\d{3})+,\\d+$"), t.rlike("^-?\\d{1,3}([.,]\\d{3})+$")
    text = F.when(both, F.translate(F.replace(t, F.lit("."), F.lit("")), ",", ".")).when(one, F.regexp_replace(t, "[.,]", "")).when(t.rlike("^-?\\d+([.,]\\d+)?$"), F.translate(t, ",", "."))
    return text.try_cast("decimal(38,10)")


def markdown_table(headers: Column, rows: Column) -> Column:
    """A Markdown table; cells are padded to the header's width, bars and line ends escaped."""
    cell = lambda x: F.regexp_replace(F.replace(F.coalesce(x, F.lit("")), F.lit("|"), F.lit("\\|")), "\n", " ")
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    width = F.size(headers)
    body = F.transform(rows, lambda r: line(F.transform(F.concat(r, F.array_repeat(F.lit(""), F.greatest(width - F.size(r), F.lit(0)))), cell)))
    return F.array_join(F.concat(F.array(line(F.transform(headers, cell)), line(F.array_repeat(F.lit("---"), width))), body), "\n")


def parse_markdown_row(c: Column) -> Column:
    """Cells of a Markdown table row; none for a separator row."""
    cells = F.transform(F.split(F.regexp_replace(F.trim(c), "^\\||\\|$", ""), "\\|"), lambda x: F.trim(x))
    return F.when(c.rlike("^\\s*\\|?[\\s:|-]+\\|?\\s*$"), F.array().cast("array<string>")).otherwise(cells)


def first_match(c: Column, classes: dict[str, list[str]], default: str | None) -> Column:
    """The first class, in their order, that has a keyword in c."""
    out = None
    for name, words in classes.items():
        hit = reduce(lambda a, b: a | b, [c.contains(w) for w in words])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(F.lit(default))


def argmax_keywords(c: Column, classes: dict[str, list[str]], default: str) -> Column:
    """The class with the most keywords in c; ties go to the first; default if none has any."""
    low = F.lower(F.coalesce(c, F.lit("")))
    scored = [F.struct(sum((low.contains(w).cast("int") for w in words), F.lit(0)).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, words) in enumerate(classes.items())]
    best = F.array_max(F.array(*scored))
    return F.when(best["n"] > 0, best["name"]).otherwise(default)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays, in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def l2_normalize(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / norm)
