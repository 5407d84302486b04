"""License scans: Aho-Corasick over words finds notices and identifier tags; a shunting-yard parser evaluates licence expressions."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text

#: The phrases of the contract and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices that the method adds, by their words.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "isc license": "isc",
    "boost software license": "bsl",
    "creative commons attribution": "cc-by",
    "cc0": "cc0",
    "public domain": "public-domain",
    "the unlicense": "unlicense",
    "all rights reserved": "all-rights-reserved",
}
TAGS = ("spdx license identifier", "license expression")
#: Families of licence identifiers, by the start of the identifier.
FAMILIES = {"agpl": "agpl", "lgpl": "lgpl", "gpl": "gpl", "apache": "apache", "mit": "mit", "bsd": "bsd", "mpl": "mpl", "epl": "epl", "isc": "isc", "bsl": "bsl", "cc0": "cc0", "cc-by": "cc-by", "unlicense": "unlicense"}
KNOWN = frozenset(FAMILIES.values())
#: Identifiers of the public list of licences that are letters only and of no family above. Those with a digit, point or hyphen are told by it.
LETTERS = frozenset("aal abstyles afmparse aml ampas antlr apafml app artistic bahyph barr beerware bittorrent blessing borceux caldera catosl cecill checkmk clartistic condor cpal cpol crossword crystalstacker cube curl diffmark doc dotseqn dsdp dvipdfm entessa eudatagrid fair freeimage ftl gd giftware glide glulxe gnuplot hpnd ibm icu ijg imagemagick imatix imlib2 info intel interbase ipa ipl jasper jpnic json latex leptonica libpng libtiff linuxman lpl magaz makeindex miros motosoto mpich mtll multics mup naist naumen ncsa netcdf newsletr ngpl nist nlpl noweb nokia nosl nposl npl nrl ntp oclc oml openssl opl osl parity php plexus postgresql psfrag psutils python qhull qpl rdisc rhecos rpl rpsl rscpl ruby sax scea sendmail sgi simpl sissl sleepycat smlnj smppl snia spencer ssh sunpro swl tcl tmate torque tosl ucl upl vim vostrom vsl w3c watcom wsuipa wtfpl x11 xerox xinetd xnet xpp xskat ypl zed zend zimbra zlib".split())
PERMISSIVE = frozenset({"apache", "mit", "bsd", "isc", "bsl", "cc0", "cc-by", "unlicense", "public-domain"})
PRECEDENCE = {"or": 1, "and": 2, "with": 3}

NOT_WORD = bytes(i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
TAG = re.compile(rb"(?:spdx[^a-z0-9]{0,3}license[^a-z0-9]{0,3}identifier|license[^a-z0-9]{0,3}expression)[\x20\t]*[:=]?[\x20\t]*")
LINE_END = re.compile(rb"[\r\n]|\Z")
TOKEN = re.compile(r"\(|\)|[a-z0-9][a-z0-9.+-]*")


def to_postfix(expression: str) -> list[str] | None:
    """Shunting-yard: a lower-case licence expression in postfix order. It ends where the next token cannot continue it, and brackets that are open
    there end with it; None if nothing can be read."""
    out: list[str] = []
    stack: list[str] = []
    operand = True  # one is expected next
    at = 0
    for token in TOKEN.finditer(expression):
        if expression[at : token.start()].strip("\x20\t"):
            break
        word = token[0].rstrip(".-") if token[0] not in "()" else token[0]
        if word in PRECEDENCE:
            if operand:
                break
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[word]:
                out.append(stack.pop())
            stack.append(word)
            operand = True
        elif word == "(":
            if not operand:
                break
            stack.append(word)
        elif word == ")":
            if operand or "(" not in stack:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif not operand:
            break
        else:
            out.append(word)
            operand = False
        at = token.end()
    while operand and stack:  # words after the licence, as in "mit and that" or "mit and (see below"
        operand = stack.pop() not in PRECEDENCE
    return out + [x for x in stack[::-1] if x != "("] if out else None


def family(identifier: str) -> str:
    """The label of an identifier: its family, or itself."""
    return next((label for start, label in FAMILIES.items() if re.match(rf"{re.escape(start)}(?![a-z])", identifier)), identifier)


def is_licence(label: str) -> bool:
    """Whether the label of an identifier is that of a family, one of the list's, or has a digit, point or hyphen, as all others of the list and licenseref- have."""
    return label in KNOWN or label in LETTERS or any(c in "-.0123456789" for c in label)


def evaluate(postfix: list[str], allowed: frozenset[str] = PERMISSIVE) -> tuple[set[str], bool]:
    """Labels of all licences in the expression, and whether it can be met with allowed ones: `or` needs one side, `and` both; an exception
    (after `with`) adds no licence."""
    stack: list[tuple[set[str], bool]] = []
    for token in postfix:
        if token in PRECEDENCE:
            b, a = stack.pop(), stack.pop()
            stack.append({"or": (a[0] | b[0], a[1] or b[1]), "and": (a[0] | b[0], a[1] and b[1]), "with": a}[token])
        else:
            label = family(token)
            stack.append(({label}, label in allowed))
    return stack[0]


def automaton() -> ahocorasick.Automaton:
    """All phrases and tags, between spaces."""
    a = ahocorasick.Automaton()
    for kind, words in (("base", BASE), ("notice", NOTICES), ("tag", dict.fromkeys(TAGS, ""))):
        for phrase, label in words.items():
            a.add_word(f" {phrase} ", (kind, phrase, label))
    a.make_automaton()
    return a


ANCHORS = (b"licen", b"cc by", b"cc0", b"rights", b"public domain", b"redistribution", b"creative", b"permission", b"unlicense")


def scan(text: bytes, machine: ahocorasick.Automaton) -> tuple:
    """The columns of scan_licenses() after doc_id."""
    low = text.lower()
    words = low.translate(NOT_WORD).split()
    joined = b" ".join(words)
    if not any(map(joined.__contains__, ANCHORS)):
        return len(words), 0, None, None, "", "", 0.0, None, None
    line = f" {joined.decode()} "
    found: list[int] = []  # the phrases' first characters
    base, labels, tagged = set(), set(), False
    for end, (kind, phrase, label) in machine.iter(line):
        if kind == "base":
            found.append(end - len(phrase))
            base.add(label)
        elif kind == "notice":
            labels.add(label)
        else:
            tagged = True
    starts = []
    if found:
        places = [0, *accumulate(len(w) + 1 for w in line[1:-1].split(" "))]
        starts = [bisect_left(places, at - 1) for at in found]
    expressions, allowed = [], None
    heads = list(TAG.finditer(low)) if tagged else []
    for head, then in zip(heads, [h.start() for h in heads[1:]] + [len(low)], strict=False):
        if postfix := to_postfix(low[head.end() : LINE_END.search(low, head.end(), then).start()].decode(errors="ignore")):
            named, met = evaluate(postfix)
            if not (named := {x for x in named if is_licence(x)}):
                continue  # a word that names no licence
            labels |= named
            allowed = met if allowed is None else allowed and met
            expressions.append(" ".join(postfix))
    score = 1.0 if expressions or base else 0.8 if labels else 0.0
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score, "; ".join(expressions) or None, allowed


COLUMNS = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("expressions", pa.string()), ("permissive", pa.bool_())]


def _scanned() -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in batches:
            rows = [scan(t.as_py() or b"", machine) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(COLUMNS))], names=["doc_id", *(n for n, _ in COLUMNS)])

    return run


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, permissive for each row of docs.

    Words are runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII. n_base counts the places of the contract's
    phrases, overlapping ones too; first_word and last_word are their smallest and largest start. labels adds other notices and the
    licences of SPDX tags: known families, identifiers of the public list, and other words with a digit, point or hyphen; of an expression that breaks off, what came before. expressions holds the tags' expressions in postfix order, permissive whether all can be met with permissive
    licences (null without a tag). score: 1 with a phrase or a tag, 0.8 with other notices only, else 0.
    Null text is empty: no words, score 0. Repeated rows are scanned each; a null doc_id is carried; an empty table gives no rows. Each row
    is read whole and alone: no shuffle.
    """
    return id_and_text(docs).mapInArrow(_scanned(), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions string, permissive boolean")


def license_scan_query(docs: DataFrame) -> DataFrame:
    return scan_licenses(docs).drop("expressions", "permissive")
