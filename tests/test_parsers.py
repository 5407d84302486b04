"""XML, HTML and the recursive splitter against plain versions."""

import random
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from corpuslake.operators import splitter, structure
from corpuslake.sources import parsers, tables


@pytest.mark.parametrize(
    ("xml", "leading", "tails"),
    [
        ("<a><!-- <b>no</b> --><b>yes</b></a>", "yes", "yes"),
        ("<a x='>'>1 &lt; 2 &amp; &#233;<b/>tail<c> <![CDATA[<raw>&amp;]]> </c></a>", "1 < 2 & é\n<raw>&amp;", "1 < 2 & é\ntail\n<raw>&amp;"),
        ("<a>one<!-- c -->two<?pi x?></a>", "onetwo", "onetwo"),
        ("<a><b> </b></a>", "<a><b> </b></a>", "<a><b> </b></a>"),
        ("<a><b></a>", "", ""),
        ("<a>&unknown;</a>", "", ""),
        ("", "", ""),
        ("<a>x</a><b/>", "", ""),
        ("<a>" + "<b>" * 3000 + "deep" + "</b>" * 3000 + "</a>", "deep", "deep"),
    ],
)
def test_xml(xml, leading, tails):
    assert parsers.xml_text(xml.encode()) == leading and parsers.xml_text(xml.encode(), tails=True) == tails


def test_xml_files(spark, tmp_path):
    (tmp_path / "a.xml").write_bytes('<?xml version="1.0" encoding="utf-16"?><a>é</a>'.encode("utf-16"))
    (tmp_path / "b.xml").write_bytes(b'<?xml version="1.0" encoding="iso-8859-1"?><a>\xe9 2</a>')
    (tmp_path / "c.xml").write_bytes(b"<a>\xff</a>")
    (tmp_path / "d.xml").write_bytes(b"")
    got = {r.path.rsplit("/", 1)[1]: r.text for r in tables.read_xml_docs(spark, str(tmp_path / "*.xml")).collect()}
    assert got == {"a.xml": "é", "b.xml": "é 2", "c.xml": ""}  # Spark skips empty files


class Plain(HTMLParser):
    """The same rules on the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.text, self.kinds, self.skip = [], "", [], []

    def flush(self):
        text = re.sub(r"\s+", " ", self.text).strip()
        self.text = ""
        if text:
            kind = self.kinds[-1] if self.kinds else "p"
            self.out.append(("heading", int(kind[1]), text) if kind[0] == "h" else ("list" if kind == "li" else "paragraph", None, text))

    def handle_starttag(self, tag, attrs):
        if tag in parsers.BLOCKS and not self.skip:
            self.flush()
        if tag in ("script", "style"):
            self.skip.append(tag)
        elif tag in ("nav", "footer"):
            self.skip.append(tag)
        elif re.fullmatch("h[1-6]|li", tag):
            self.kinds.append(tag)
        elif tag == "p" and self.kinds and self.kinds[-1][0] == "h":
            self.kinds.pop()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in parsers.BLOCKS and not self.skip:
            self.flush()
        if tag in self.skip:
            while self.skip.pop() != tag:
                pass
        elif tag in self.kinds and not self.skip:
            while self.kinds.pop() != tag:
                pass
        elif tag in ("ul", "ol", "menu") and "li" in self.kinds and not self.skip:
            del self.kinds[self.kinds.index("li") :]

    def handle_data(self, data):
        if not self.skip:
            self.text += data


def plain(page):
    p = Plain()
    p.feed(page)
    p.close()
    p.flush()
    return p.out


HARD = [
    "", "text", "<p>a<p>b", "<h1>T &amp; U</h1><p>a<br>b</p><ul><li>c</li></ul>", "<ul><li>a<li>b</ul>after", "<h2>x<p>y</h2>z",
    '<script>var t="</style>";</script>x', "<style>p{}</style >y", "<nav>a<nav>b</nav>c</nav>d", "<footer>x</footer><p>y", '<p title="a>b">c', "<p title='a>b' class=x>c", "<a href=x/y>z</a>",
    "1 < 2 &lt; 3 &#233; &eacute;&nbsp;&copy; &unknown; &amp;amp;", "<!-- a > b --><p>c", "<!doctype html><p>x", "<?php echo 1 ?>x", "<P>UP</P><LI>q</LI>", "<td>a</td><td>b</td>", "a<b>b</b>c", "<br/>x<br />y", "<p>a</nav>b", "<div><li>a</div>b", "<h1>a<h2>b</h1>c",
]


def test_html_rows():
    for page in HARD:
        assert parsers.html_blocks(page) == plain(page), page
    assert parsers.html_blocks("<title>a <b> &amp; c</title><textarea><p>x</p></textarea>") == [("paragraph", None, "a <b> & c"), ("paragraph", None, "<p>x</p>")]
    assert parsers.html_blocks("<p>a<!-- never closed <p>b") == [("paragraph", None, "a")] and parsers.html_blocks("<p>a<script>b") == [("paragraph", None, "a")]
    assert parsers.html_blocks("a<p title='never closed>b") == [("paragraph", None, "a")]
    pick = random.Random(6)
    bits = ["<p>", "</p>", "<li>", "</li>", "<ul>", "</ul>", "<h1>", "</h1>", "<h3 a='>'>", "</h3>", "<nav>", "</nav>", "<footer>", "</footer>", "x", " y ", "&amp;", "<b>", "</b>", "<br>", "<!-- z -->", "<div>", "</div>", "<script>s<p></script>"]
    for _ in range(3000):
        page = "".join(pick.choices(bits, k=pick.randint(1, 14)))
        assert parsers.html_blocks(page) == plain(page), page


def test_html_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").unionByName(spark.createDataFrame([(10**6, "u", None)], "page_id long, url string, html string"))
    got = {}
    for r in tables.html_segments(pages).orderBy("page_id", "position").collect():
        got.setdefault(r.page_id, []).append((r.kind, r.level, r.text))
    want = {r.page_id: plain(r.html) for r in pages.collect() if r.html}
    # the standard parser may read tags within a title
    assert {i: x for i, x in got.items()} == {i: x for i, x in want.items() if x}


def plain_split(text, most, overlap, separators):
    """The splitter's rule, step by step."""
    s = next(x for x in separators if not x or x in text)
    finer = separators[separators.index(s) + 1 :]
    parts = [p for i, p in enumerate(text.split(s)) for p in [s + p if i else p] if p] if s else list(text)
    out, run = [], []

    def pack():
        now = []
        for p in run:
            if now and len("".join(now) + p) > most:
                out.append("".join(now))
                while now and (len("".join(now)) > overlap or len("".join(now) + p) > most):
                    now = now[1:]
            now = [*now, p]
        if now:
            out.append("".join(now))
        run.clear()

    for p in parts:
        if len(p) <= most:
            run.append(p)
        else:
            pack()
            out.extend(plain_split(p, most, overlap, finer))
    pack()
    return [p.strip() for p in out if p.strip()]


def test_split_text():
    pick = random.Random(9)
    for _ in range(600):
        text = "".join(pick.choices(["a", "bc", "defg", " ", " ", "\n", "\n\n", ". ", "hijklmnopqrstuvw", "é"], k=pick.randint(0, 80)))
        most = pick.randint(5, 40)
        overlap = pick.randint(0, most - 1)
        got = splitter.split_text(text, most, overlap)
        assert got == (plain_split(text, most, overlap, list(splitter.SEPARATORS)) if text else [])
        assert all(0 < len(p) <= most for p in got)
        assert sorted(set("".join(text.split()))) == sorted(set("".join("".join(got).split())))
        words = {w for w in text.replace(". ", " ").split() if len(w) < most - 1}
        if not overlap:
            assert "".join("".join(got).split()) == "".join(text.split())
            pieces = [w for p in got for w in p.split()]
            assert words <= set(pieces) | {w.strip(".") for w in pieces} | {w + "." for w in pieces} | {p for w in pieces for p in [w.rstrip(".")]}
    with pytest.raises(ValueError, match="overlap"):
        splitter.split_text("a", 5, 5)


def test_pack_paragraphs(spark):
    df = spark.createDataFrame([(1, "one two\n\nthree four five. six"), (2, None), (3, "")], "id long, text string")
    got = [(r.id, r.piece_index, r.piece) for r in structure.pack_paragraphs(df, "text", 12, 3).orderBy("id", "piece_index").collect()]
    assert got == [(1, i, p) for i, p in enumerate(splitter.split_text("one two\n\nthree four five. six", 12, 3))]


def test_dispatcher_cleans_and_falls_back(spark):
    long_ = "Câu này nói về đất đai và nhà ở. " * 80
    df = spark.createDataFrame([(1, long_, None), (2, "•" * 80 + "\n- 1 -", "x"), (3, None, "x"), (4, "ngắn", "x"), (5, "Luật không có điều nào. " * 10, "Luật A")], "id long, text string, name string")
    got = {}
    for r in structure.chunk_documents(df, "id", "text", "name").orderBy("id", "chunk_index").collect():
        got.setdefault(r.id, []).append(r.chunk)
        assert r.field_type == "general" and r.chunk_index == len(got[r.id]) - 1
    assert got[1] == [p for p in splitter.split_text(long_.strip()) if len(p) >= 60] and max(map(len, got[1])) <= 900
    assert set(got) == {1, 5}
    assert structure.chunk_documents(df.where(F.lit(False)), "id", "text", "name").collect() == []


def test_segments_between_tables(spark):
    long_ = "Câu này nói về đất đai và nhà ở. " * 60
    law = "Điều 1. " + "Phạm vi điều chỉnh của luật này là đất đai. " * 3 + "\nĐiều 2. " + "Đối tượng áp dụng của luật này là mọi người. " * 3
    rows = [
        (1, 1, False, long_), (1, 2, False, "  "), (1, 3, False, "và thêm một đoạn nữa"), (1, 4, True, None), (1, 5, False, law),
        (2, 1, False, "đoạn đầu quá ngắn"), (2, 2, True, "bảng"), (2, 3, True, "bảng"), (2, 4, False, None), (3, 1, False, long_),
    ]
    df = spark.createDataFrame(rows, "id long, i int, t boolean, x string")
    got = {}
    for r in structure.chunk_segments(df, "id", ["i"], F.col("t"), F.col("x"), F.lit("Luật A")).orderBy("id", "island", "chunk_index").collect():
        got.setdefault((r.id, r.island), []).append((r.field_type, r.article, r.chunk))
    whole = long_.strip() + "\nvà thêm một đoạn nữa"
    assert [c for _, _, c in got[1, 0]] == [p for p in splitter.split_text(whole) if len(p) >= 60]
    assert [(f, a) for f, a, _ in got[1, 1]] == [("can_cu_phap_ly", "Điều 1"), ("can_cu_phap_ly", "Điều 2")]
    assert set(got) == {(1, 0), (1, 1), (3, 0)} and {f for f, _, _ in got[3, 0]} == {"general"}
