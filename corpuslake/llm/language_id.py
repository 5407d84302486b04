"""Language identification: a bidirectional gated recurrent network over bytes, trained in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, ship, tidy, utf8

HIDDEN, EMBEDDING = 8, 8
TRAINING_DOCUMENTS, TRAINING_WINDOWS, WINDOW_BYTES = 2000, 9000, 64
PARTS = 32
STRETCH, CONTEXT, ROWS, STEPS = 1024, 64, 2048, 32
LETTER = r"\p{L}"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class Gru:
    """One direction: gates r and z and the candidate state, each from the embedded byte and the state before."""

    w: np.ndarray  # (EMBEDDING, 3 * HIDDEN)
    u: np.ndarray  # (HIDDEN, 3 * HIDDEN)
    b: np.ndarray  # (3 * HIDDEN,)

    def run(self, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States at each position of x (batch, time, 3 * HIDDEN: the bytes' part of the gates). The state stays 0 where mask is 0."""
        h = np.zeros((len(x), HIDDEN), np.float32)
        out = np.empty((x.shape[1], len(x), HIDDEN), np.float32)
        for t in range(x.shape[1]):
            hu = h @ self.u
            gates = _sigmoid(x[:, t, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            r, z = gates[:, :HIDDEN], gates[:, HIDDEN:]
            c = np.tanh(x[:, t, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            new = (z * h + (1 - z) * c) * mask[:, t, None]
            if keep is not None:
                keep.append((h, hu, r, z, c))
            h = out[t] = new
        return out.transpose(1, 0, 2)

    def back(self, dh_out: np.ndarray, mask: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
        """Backpropagation through time: gradients of the bytes' part of the gates, and of u."""
        n, steps, _ = dh_out.shape
        dx, du, carry = np.zeros((n, steps, 3 * HIDDEN), np.float32), np.zeros_like(self.u), np.zeros((n, HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1):
            h, hu, r, z, c = kept[t]
            d = (dh_out[:, t] + carry) * mask[:, t, None]
            dc = d * (1 - z) * (1 - c * c)
            dz = d * (h - c) * z * (1 - z)
            dr = dc * hu[:, 2 * HIDDEN :] * r * (1 - r)
            dhu = np.concatenate([dr, dz, dc * r], 1)
            dx[:, t] = np.concatenate([dr, dz, dc], 1)
            du += h.T @ dhu
            carry = d * z + dhu @ self.u.T
        return dx, du


@dataclass
class LanguageModel:
    """Byte embeddings, a network for each direction, and a softmax layer over both states at every position."""

    langs: list[str]
    embedding: np.ndarray
    forward: Gru
    backward: Gru
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def new(cls, langs: list[str], seed: int = 7) -> LanguageModel:
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        gru = lambda: Gru(draw(EMBEDDING, 3 * HIDDEN), draw(HIDDEN, 3 * HIDDEN), np.zeros(3 * HIDDEN, np.float32))
        return cls(langs, draw(256, EMBEDDING) * 4, gru(), gru(), draw(2 * HIDDEN, len(langs)), np.zeros(len(langs), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, self.forward.w, self.forward.u, self.forward.b, self.backward.w, self.backward.u, self.backward.b, self.out, self.bias]

    def positions(self, words: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Probabilities of each language at each position of padded words (batch, time)."""
        kept_f, kept_b = ([], []) if keep is not None else (None, None)
        f = self.forward.run((self.embedding @ self.forward.w + self.forward.b)[words], mask, kept_f)
        b = self.backward.run((self.embedding @ self.backward.w + self.backward.b)[words[:, ::-1]], mask[:, ::-1], kept_b)[:, ::-1]
        h = np.concatenate([f, b], 2)
        score = h @ self.out + self.bias
        score = np.exp(score - score.max(2, keepdims=True))
        p = score / score.sum(2, keepdims=True)
        if keep is not None:
            keep |= {"h": h, "f": kept_f, "b": kept_b}
        return p

    def gradients(self, words: np.ndarray, mask: np.ndarray, lang: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy over the positions, and its gradients."""
        keep: dict = {}
        p = self.positions(words, mask, keep)
        n = mask.sum()
        loss = float(-(np.log(p[np.arange(len(words)), :, lang] + 1e-9) * mask).sum() / n)
        d = p.copy()
        d[np.arange(len(words)), :, lang] -= 1
        d *= (mask / n)[:, :, None]
        h = keep["h"]
        grads_out = [np.einsum("nth,ntl->hl", h, d), d.sum((0, 1))]
        dh = d @ self.out.T
        de = np.zeros_like(self.embedding)
        grads = []
        for gru, dh_, w, m, kept in ((self.forward, dh[:, :, :HIDDEN], words, mask, keep["f"]), (self.backward, dh[:, ::-1, HIDDEN:], words[:, ::-1], mask[:, ::-1], keep["b"])):
            dx, du = gru.back(dh_, m, kept)
            flat, bytes_ = dx.reshape(-1, 3 * HIDDEN), w.reshape(-1)
            by_byte = np.zeros((256, 3 * HIDDEN), np.float32)
            np.add.at(by_byte, bytes_, flat)
            grads += [self.embedding.T @ by_byte, du, by_byte.sum(0)]
            de += by_byte @ gru.w.T
        return loss, [de, *grads, *grads_out]


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte matrix and mask of some short texts."""
    width = max(map(len, texts))
    flat = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), np.uint8).reshape(len(texts), width)
    return flat, (np.arange(width) < np.array([len(t) for t in texts])[:, None]).astype(np.float32)


def train(windows: list[tuple[bytes, str]], most: int = TRAINING_WINDOWS, epochs: int = 3, batch: int = 128, rate: float = 0.01, seed: int = 7) -> LanguageModel:
    """Fit the network with Adam on windows of labelled texts, every position of which has the text's label; each language has about as many."""
    langs = sorted({lang for _, lang in windows})
    model = LanguageModel.new(langs, seed)
    rng = np.random.default_rng(seed)
    rows: list[tuple[bytes, int]] = []
    for i, lang in enumerate(langs):
        own = sorted(w for w, of in windows if of == lang and w)
        if own:
            rows += [(own[j], i) for j in rng.integers(0, len(own), max(batch, most // len(langs)))]
    if not rows or len(langs) < 2:
        return model
    params = model.parameters()
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), batch):
            some = order[k : k + batch]
            text, mask = padded([rows[i][0] for i in some])
            _, grads = model.gradients(text, mask, np.array([rows[i][1] for i in some]))
            step += 1
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            scale = min(1.0, 1.0 / (norm + 1e-9))
            for p, g, a, b in zip(params, grads, first, second, strict=True):
                g = g * scale
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (0.5**epoch) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return model


def stretches(offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """How texts are read: row, first and last byte read, first and last byte labelled of each stretch. Up to STRETCH + CONTEXT bytes a text is read in
    one go; a longer one in stretches of STRETCH bytes, with CONTEXT more on both sides for the states to settle."""
    n = np.diff(offsets)
    parts = np.maximum(1, -(-(n - CONTEXT) // STRETCH)) * (n > 0)
    row = np.repeat(np.arange(len(n)), parts)
    k = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = k * STRETCH
    end = np.where(k == parts[row] - 1, n[row], start + STRETCH)
    return row, offsets[row] + np.maximum(0, start - CONTEXT), offsets[row] + np.minimum(n[row], end + CONTEXT), offsets[row] + start, offsets[row] + end


def _step(table: np.ndarray, u: np.ndarray, codes: np.ndarray, h: np.ndarray) -> None:
    """One byte further, in place; the gates' parts of table and u are halved, as sigmoid(x) = (tanh(x / 2) + 1) / 2."""
    x = table.take(codes, 0)
    hu = h @ u
    gates = x[:, : 2 * HIDDEN]
    gates += hu[:, : 2 * HIDDEN]
    np.tanh(gates, out=gates)
    gates *= 0.5
    gates += 0.5
    c = gates[:, :HIDDEN] * hu[:, 2 * HIDDEN :]
    c += x[:, 2 * HIDDEN :]
    np.tanh(c, out=c)
    h -= c
    h *= gates[:, HIDDEN:]
    h += c


def _halved(model: LanguageModel, gru: Gru) -> tuple[np.ndarray, np.ndarray]:
    table, u = (model.embedding @ gru.w + gru.b).astype(np.float32), gru.u.astype(np.float32)
    half = np.where(np.arange(3 * HIDDEN) < 2 * HIDDEN, np.float32(0.5), np.float32(1))
    return table * half, u * half


def label_texts(model: LanguageModel, data: np.ndarray, offsets: np.ndarray, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """For each text (data from offset to offset): the sums of its positions' probabilities, and how many positions are labelled with each language.

    All bytes are read, lower-cased (A-Z). Stretches of about one length go together, so that a step of the network serves up to `rows` of them."""
    low = LOWER[data]
    sums, tops = np.zeros((len(offsets) - 1, len(model.langs))), np.zeros((len(offsets) - 1, len(model.langs)), np.int64)
    row, first, last, begin, end = stretches(offsets)
    order = np.argsort(first - last, kind="stable")  # longest first
    (ft, fu), (bt, bu) = _halved(model, model.forward), _halved(model, model.backward)
    out_f, out_b, bias = (x.astype(np.float32) for x in (model.out[:HIDDEN], model.out[HIDDEN:], model.bias))
    for at in range(0, len(order), rows):
        some = order[at : at + rows]
        lengths = last[some] - first[some]
        codes = np.zeros((len(some), int(lengths[0])), np.uint8)
        for i, j in enumerate(some):
            codes[i, : lengths[i]] = low[first[j] : last[j]]
        codes = np.ascontiguousarray(codes.T)
        active = np.searchsorted(-lengths, -np.arange(len(codes)), "left")  # rows longer than t
        states, h = np.zeros((len(codes), len(some), HIDDEN), np.float32), np.zeros((len(some), HIDDEN), np.float32)
        for t, n in enumerate(active):
            _step(ft, fu, codes[t, :n], h[:n])
            states[t, :n] = h[:n]
        h[:] = 0
        total, top = np.zeros((len(some), len(model.langs))), np.zeros((len(some), len(model.langs)), np.int64)
        own_first, own_end = begin[some] - first[some], end[some] - first[some]
        for stop in range(len(codes), 0, -STEPS):
            start = max(0, stop - STEPS)
            width = active[start]
            back = np.zeros((stop - start, width, HIDDEN), np.float32)
            for t in range(stop - 1, start - 1, -1):
                n = active[t]
                _step(bt, bu, codes[t, :n], h[:n])
                back[t - start, :n] = h[:n]
            time = np.arange(start, stop)[:, None]
            own = (own_first[:width] <= time) & (time < own_end[:width])
            score = (states[start:stop, :width].reshape(-1, HIDDEN) @ out_f + back.reshape(-1, HIDDEN) @ out_b + bias).T.copy()
            best, most = np.zeros(score.shape[1], np.int64), score[0].copy()
            for k in range(1, len(score)):
                best[score[k] > most] = k
                np.maximum(most, score[k], out=most)
            np.exp(score, out=score)
            score *= own.ravel() / score.sum(0)
            total[:width] += score.reshape(len(score), -1, width).sum(1).T
            at_row = np.broadcast_to(np.arange(width), own.shape)[own]
            top[:width] += np.bincount(at_row * len(score) + best[own.ravel()], minlength=width * len(score)).reshape(width, -1)
        np.add.at(sums, row[some], total)
        np.add.at(tops, row[some], top)
    return sums, tops


def _predicted(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = np.array([*model.value.langs, "und"], object)
        for batch in batches:
            letter = batch.column(3).to_numpy(zero_copy_only=False).astype(bool) & (len(langs) > 1)
            data, offsets = utf8(batch.column(1))
            sizes = np.diff(offsets)
            data = data[np.repeat(letter, sizes)]
            sums, tops = label_texts(model.value, data, np.r_[0, np.cumsum(sizes * letter)])
            whole = sums.sum(1)
            best = sums.argmax(1) if len(langs) > 1 else np.zeros(len(sums), np.int64)
            score = np.where(whole > 0, np.take_along_axis(sums, best[:, None], 1)[:, 0] / np.maximum(whole, 1e-30), 0.0) if len(langs) > 1 else np.zeros(len(sums))
            preds = langs[np.where(letter, best, len(langs) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(preds.tolist(), pa.string()), pa.array(np.clip(score, 0.0, 1.0)), pa.array(tops.tolist(), pa.list_(pa.int64()))], names=["doc_id", "held_out", "lang_pred", "score", "positions"])

    return tidy(run)


def held_out(doc_id):
    return (F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2) & doc_id.isNotNull()


def fit(docs: DataFrame, documents: int = TRAINING_DOCUMENTS) -> LanguageModel:
    """The network, trained on a bounded sample: of the rows with a language that are not held out, documents / languages of each language (20 at
    least), first by a hash of doc_id; first of PARTS parts of a language, then of all, so that no task sorts a whole language. Of their whole texts windows of WINDOW_BYTES bytes are taken evenly, and TRAINING_WINDOWS of all are drawn. The
    driver holds a row for each language and the sample."""
    ship(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("wanted"), F.col("lang").cast("string").alias("of"))
    langs = known.select("of").distinct().count()
    each = max(20, documents // max(1, langs))
    nth = lambda *by: F.row_number().over(Window.partitionBy("of", *by).orderBy(F.xxhash64("wanted"), "wanted"))
    parted = known.where("wanted is not null").distinct().withColumn("part", F.pmod(F.hash("wanted"), F.lit(PARTS)))
    first = parted.withColumn("nth", nth("part")).where(F.col("nth") <= each)
    chosen = first.withColumn("nth", nth()).where(F.col("nth") <= each).select("wanted", "of")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.col("lang").cast("string").alias("lang"))
    texts = texts.join(F.broadcast(chosen), (F.col("doc_id") == F.col("wanted")) & (F.col("lang") == F.col("of")), "left_semi")
    per_text = 4 * TRAINING_WINDOWS // max(1, each * max(1, langs)) + 1
    return train([(w, lang) for w, lang in texts.select("text", "lang").mapInArrow(_windows_of(per_text), "text binary, lang string").toLocalIterator()])


def _windows_of(most: int) -> Callable:
    """Of each text at most so many windows, evenly over the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, of = [], []
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                low = (text.as_py() or b"").lower()
                for start in np.unique(np.linspace(0, max(0, len(low) - WINDOW_BYTES), min(most, len(low) // WINDOW_BYTES + 1)).astype(int)):
                    out.append(low[start : start + WINDOW_BYTES])
                    of.append(lang)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(of, pa.string())], names=["text", "lang"])

    return run


def identify_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score, positions for each row of docs.

    The network runs both ways over all bytes of a text and labels every position; a document's probabilities are the mean of its positions',
    lang_pred is the largest, score its probability. States are carried through a text; one of more than STRETCH + CONTEXT bytes is read in
    stretches of STRETCH, each with CONTEXT bytes more on both sides, whose labels are not counted. positions maps each language to the
    number of positions labelled so. Only the text is an input.
    `und`, score 0: a model without languages, null text, and text without a letter. Equal texts are predicted alike; a null doc_id is not held out;
    an empty table gives no rows. Other columns are not read.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"), F.col("text").rlike(LETTER).alias("letter"))
    found = source.mapInArrow(_predicted(shared), "doc_id long, held_out boolean, lang_pred string, score double, positions array<long>")
    names = F.array(*map(F.lit, model.langs)) if model.langs else F.array().cast("array<string>")
    return found.withColumn("positions", F.map_from_arrays(names, "positions"))


def language_id_query(docs: DataFrame) -> DataFrame:
    return identify_languages(docs, fit(docs)).drop("positions")
