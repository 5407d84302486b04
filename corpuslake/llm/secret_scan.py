"""Secret scans: probabilistic automata, inferred from labelled credentials by state merging, score every candidate."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, starts_of, text_blocks

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(rb"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
WORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
LEAST = {"assign": 6, "access": 20, "hex": 24}
EXAMPLES, LONGEST_EXAMPLE, CANDIDATE = 200, 64, 16
HEX, TOKEN, DIGIT, LETTER = (np.zeros(256, bool) for _ in range(4))
HEX[[*range(48, 58), *range(97, 103)]] = True
DIGIT[48:58] = True
LETTER[[*range(65, 91), *range(97, 123)]] = True
TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_=-"]] = True
#: The classes of characters that the automata read.
CLASS = "".join("d" if 48 <= i <= 57 else "h" if 97 <= i <= 102 else "l" if 97 <= i <= 122 else "U" if 65 <= i <= 90 else chr(i) if chr(i) in "+/_=.-" else "?" for i in range(256))


def shape(value: bytes) -> str:
    return "".join(CLASS[b] for b in value)


class Automaton:
    """States with counts of passes, ends and moves; built as a prefix tree, then merged."""

    def __init__(self) -> None:
        self.passes, self.ends, self.moves = [0], [0], [{}]

    def add(self, word: str) -> None:
        state = 0
        self.passes[0] += 1
        for symbol in word:
            if symbol not in self.moves[state]:
                self.moves[state][symbol] = len(self.moves)
                self.passes.append(0)
                self.ends.append(0)
                self.moves.append({})
            state = self.moves[state][symbol]
            self.passes[state] += 1
        self.ends[state] += 1

    def _differ(self, f1: int, n1: int, f2: int, n2: int, alpha: float) -> bool:
        """Hoeffding's bound: whether two frequencies differ by more than chance allows."""
        return abs(f1 / n1 - f2 / n2) > math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int, alpha: float) -> bool:
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            na, nb = self.passes[a], self.passes[b]
            if self._differ(self.ends[a], na, self.ends[b], nb, alpha):
                return False
            for symbol in self.moves[a].keys() | self.moves[b].keys():
                x, y = self.moves[a].get(symbol), self.moves[b].get(symbol)
                if self._differ(self.flow(a, symbol), na, self.flow(b, symbol), nb, alpha):
                    return False
                if x is not None and y is not None and x != y:
                    pairs.append((x, y))
        return True

    def flow(self, state: int, symbol: str) -> int:
        return self.counts[state].get(symbol, 0)

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below b to a."""
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            self.passes[a] += self.passes[b]
            self.ends[a] += self.ends[b]
            for symbol, y in self.moves[b].items():
                self.counts[a][symbol] = self.flow(a, symbol) + self.flow(b, symbol)
                x = self.moves[a].get(symbol)
                if x is None:
                    self.moves[a][symbol] = y
                elif x != y:
                    pairs.append((x, y))

    def merge(self, alpha: float = 0.05) -> Automaton:
        """Fold each state at the border of those that stay into the first of them that it is compatible with, or let it stay."""
        self.counts = [{s: self.passes[t] for s, t in m.items()} for m in self.moves]
        stay = [0]
        while True:
            border = sorted((t, a, s) for a in stay for s, t in self.moves[a].items() if t not in stay)
            if not border:
                break
            b, parent, symbol = border[0]
            for a in stay:
                if self._compatible(a, b, alpha):
                    self.moves[parent][symbol] = a
                    self._fold(a, b)
                    break
            else:
                stay.append(b)
        return self

    def score(self, word: str) -> float:
        """Mean log likelihood of the symbols and the end; -inf if the automaton can't read the word."""
        state, total = 0, 0.0
        for symbol in word:
            if symbol not in self.moves[state]:
                return -math.inf
            total += math.log(self.flow(state, symbol) / self.passes[state])
            state = self.moves[state][symbol]
        return (total + math.log((self.ends[state] + 0.5) / (self.passes[state] + 1))) / (len(word) + 1)


def infer(examples: dict[str, list[bytes]]) -> dict[str, tuple[Automaton, float]]:
    """An automaton for each kind that has examples, and the likelihood that all but the least likely twentieth of them reach."""
    out = {}
    for kind, values in sorted(examples.items()):
        automaton = Automaton()
        for value in sorted(values):
            automaton.add(shape(value))
        automaton.merge()
        scores = sorted(automaton.score(shape(v)) for v in values)
        out[kind] = automaton, scores[len(scores) // 20]
    return out


def long_runs(mask: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, within rows, of at least so many bytes."""
    starts = starts_of(mask, offsets)
    if not len(starts):
        return starts, starts
    lengths = np.add.reduceat(mask.astype(np.int64), starts)
    return starts[lengths >= least], (starts + lengths)[lengths >= least]


def base_spans(text: bytes, low: bytes) -> list[tuple[int, int, int, int, int]]:
    """(start, end, kind, start and end of the value) in bytes, of the kinds assign and access."""
    out = []
    if any(w in low for w in WORDS):
        out += [(m.start(), m.end(), 0, m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if b"AKIA" in text:
        out += [(m.start(), m.end(), 1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    return out


def _found(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, bytes, list, list]]:
    """Row, bytes as an array and as bytes, base spans and candidates (start, end) of each row that has any, and of all others none."""
    for first, data, offsets in text_blocks(batch):
        raw = data.tobytes()
        hs, he = long_runs(HEX[data], offsets, LEAST["hex"])
        ts, te = long_runs(TOKEN[data], offsets, CANDIDATE)
        if len(ts):
            digits, letters = (np.r_[0, np.cumsum(x[data])] for x in (DIGIT, LETTER))
            both = (digits[te] > digits[ts]) & (letters[te] > letters[ts])
            ts, te = ts[both], te[both]
        h_at, t_at = np.searchsorted(hs, offsets), np.searchsorted(ts, offsets)
        for i in range(len(offsets) - 1):
            a, b = int(offsets[i]), int(offsets[i + 1])
            text = raw[a:b]
            spans = base_spans(text, text.lower()) + [(int(s) - a, int(e) - a, 2, int(s) - a, int(e) - a) for s, e in zip(hs[h_at[i] : h_at[i + 1]], he[h_at[i] : h_at[i + 1]], strict=True)]
            yield first + i, data[a:b], text, spans, [(int(s) - a, int(e) - a) for s, e in zip(ts[t_at[i] : t_at[i + 1]], te[t_at[i] : t_at[i + 1]], strict=True)]


def _values() -> Callable:
    """(kind, value) of all base matches that may serve as examples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(KINDS[k], text[a:b]) for _, _, text, spans, _ in _found(batch) for _, _, k, a, b in spans if b - a <= LONGEST_EXAMPLE]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["kind", "value"])

    return run


def _scanned(automata: dict[str, tuple[Automaton, float]]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            rows = []
            for _, data, text, spans, candidates in _found(batch):
                found = [(s, e, k) for s, e, k, _, _ in spans]
                best = None
                for s, e in candidates:
                    word = shape(text[s:e])
                    margin = max((a.score(word) - level for a, level in automata.values()), default=-math.inf)
                    if margin > -math.inf:
                        best = max(-1e9 if best is None else best, margin)
                    if margin >= 0 and not any(x < e and s < y for x, y, _, _, _ in spans):
                        found.append((s, e, 3))
                if not found:
                    rows.append((0, 0, 0, nothing, "", best))
                    continue
                ahead = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]  # code points before a byte
                found.sort(key=lambda x: (x[0], x[2]))
                named = [(k, f"{(*KINDS, 'format')[k]}:{ahead[s]}:{ahead[e]}") for s, e, k in found]
                base = ",".join(t for k, t in named if k < 3)
                rows.append((*(sum(k == i for k, _ in named) for i in range(3)), hashlib.sha256(base.encode()).hexdigest(), ",".join(t for _, t in named), best))
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "margin"])

    return run


def fit_automata(docs: DataFrame, examples: int = EXAMPLES) -> dict[str, tuple[Automaton, float]]:
    """Automata from the credentials that the base patterns label in docs: of each kind a bounded sample, the `examples` distinct values of at
    most LONGEST_EXAMPLE bytes that come first by hash."""
    values = id_and_text(docs).mapInArrow(_values(), "kind string, value binary").distinct()
    order = Window.partitionBy("kind").orderBy(F.xxhash64("value"), "value")
    sample = values.withColumn("i", F.row_number().over(order)).where(F.col("i") <= examples).select("kind", "value").collect()
    by_kind: dict[str, list[bytes]] = {}
    for r in sample:
        by_kind.setdefault(r.kind, []).append(bytes(r.value))
    return infer(by_kind)


def scan_secrets(docs: DataFrame, automata: dict[str, tuple[Automaton, float]]) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, margin for each row of docs.

    Base matches are leftmost and do not overlap within their kind; spans are kind:start:end in code points. Every other run of 16 or more
    token characters with a letter and a digit is a candidate: its likelihood under the automata, above the level that their examples reach,
    is its margin, and candidates of margin 0 or more that touch no base match are spans of the kind format. margin: the largest of the row, null if no
    automaton can read a candidate.
    Null text is empty and has no spans. Repeated rows are scanned each; a null doc_id is carried; an empty table gives no rows. Each row
    is read whole and alone: no shuffle.
    """
    return id_and_text(docs).mapInArrow(_scanned(automata), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, margin double")


def secret_scan_query(docs: DataFrame) -> DataFrame:
    return scan_secrets(docs, fit_automata(docs)).drop("margin")
