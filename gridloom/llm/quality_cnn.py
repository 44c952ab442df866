"""Quality classifier: a convolutional network over bytes, trained in numpy.

Learned filters of 8 bytes move over the whole text, byte by byte. Each filter's highest answer is
kept in every chunk of 512 bytes; chunks begin every 256 bytes, so they overlap, and cover the text to its end.
A text's chunks are combined by mean, highest and lowest, and a small dense layer makes one probability of
these. Filters are tables of a value for every byte at every place, which is an embedding and a filter folded together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import training_rows
from .shared import held_out_mod, released, text_slices

WIDTH, STRIDE, HALF, FILTERS, DENSE = 8, 1, 256, 16, 16
#: Training: steps of BATCH texts, as many whatever the sample's size.
STEPS, BATCH = 800, 32
ROW = HALF + WIDTH
LOW = np.float32(-1e30)


def _laid(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts in half-chunks of HALF bytes: (a row a half and the WIDTH bytes behind it, zeros behind the text; bytes of text in each half, each text's first half)."""
    sizes = np.diff(offsets)
    halves = np.maximum(1, -(-sizes // HALF))
    first = np.concatenate([[0], np.cumsum(halves)])
    out = np.zeros(int(first[-1]) * HALF, np.uint8)
    at = np.repeat(first[:-1] * HALF - offsets[:-1], sizes) + np.arange(len(data))
    out[at] = data
    within = np.arange(first[-1]) - np.repeat(first[:-1], halves)
    rows = np.zeros((int(first[-1]), ROW), np.uint8)
    rows[:, :HALF] = out.reshape(-1, HALF)
    rows[:-1, HALF:] = rows[1:, :WIDTH]
    rows[first[1:] - 1, HALF:] = 0
    return rows, np.clip(np.repeat(sizes, halves) - within * HALF, 0, HALF), first


class Filters:
    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        self.p = {"t": r.normal(0, 0.4, (WIDTH, 256, FILTERS)), "a": r.normal(0, 0.2, (3 * FILTERS + 1, DENSE)), "b": np.zeros(DENSE), "o": r.normal(0, 0.2, DENSE + 1)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.mean, self.scale = np.zeros(3 * FILTERS + 1, np.float32), np.ones(3 * FILTERS + 1, np.float32)

    def halves(self, laid: np.ndarray, filled: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """The highest answer of each filter in every half-chunk, and where it was."""
        n, per = len(filled), HALF // STRIDE
        best = np.empty((n, FILTERS), np.float32)
        place = np.empty((n, FILTERS), np.int64) if where else None
        some = 1024
        answer, part = np.empty((some * per, FILTERS), np.float32), np.empty((some * per, FILTERS), np.float32)
        for k in range(0, n, some):
            m = min(some, n - k)
            a, b = answer[: m * per], part[: m * per]
            for j in range(WIDTH):
                at = laid[k : k + m, j : j + HALF : STRIDE].ravel()
                np.take(self.p["t"][j], at, 0, out=b if j else a, mode="clip")
                if j:
                    a += b
            short = np.flatnonzero(filled[k : k + m] < HALF)
            cube = a.reshape(m, per, FILTERS)
            for i in short.tolist():
                cube[i, max(1, -(-int(filled[k + i]) // STRIDE)) :] = LOW
            if where:
                j = cube.argmax(1)
                place[k : k + m] = (np.arange(k, k + m)[:, None] * ROW) + j * STRIDE
                best[k : k + m] = np.take_along_axis(cube, j[:, None, :], 1)[:, 0]
            else:
                best[k : k + m] = cube.max(1)
        return best, place

    @staticmethod
    def chunks(best: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(highest answers of each chunk of two halves, which half had them, each text's first chunk). The last half
        of a text is in the chunk before it; a text of one half is one chunk."""
        n = len(best)
        last = np.zeros(n, bool)
        last[first[1:] - 1] = True
        begin = ~last
        begin[first[:-1][np.diff(first) == 1]] = True
        at = np.flatnonzero(begin)
        second = np.where(last[at], at, np.minimum(at + 1, n - 1))
        higher = best[second] > best[at]
        return np.where(higher, best[second], best[at]), np.where(higher, second[:, None], at[:, None]), np.searchsorted(at, first)

    def _combine(self, z: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Mean, highest and lowest of the chunks' answers, and how full a text's first chunk is."""
        n = np.diff(first)[:, None]
        full = np.log2(1 + np.minimum(sizes, 2 * HALF)).astype(np.float32)[:, None]
        return np.concatenate([np.add.reduceat(z, first[:-1]) / n, np.maximum.reduceat(z, first[:-1]), np.minimum.reduceat(z, first[:-1]), full], 1)

    def logits(self, combined: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = (combined - self.mean) / self.scale
        h = np.tanh(x @ self.p["a"] + self.p["b"])
        return h @ self.p["o"][:-1] + self.p["o"][-1], h, x

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        laid, filled, first = _laid(data, offsets)
        z, _, at = self.chunks(self.halves(laid, filled)[0], first)
        return 1 / (1 + np.exp(-self.logits(self._combine(z, at, np.diff(offsets)))[0].astype(float)))

    def gradients(self, laid: np.ndarray, filled: np.ndarray, first: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        best, place = self.halves(laid, filled, True)
        z, half, at = self.chunks(best, first)
        logit, h, x = self.logits(self._combine(z, at, sizes))
        d = ((1 / (1 + np.exp(-logit))) - y).astype(np.float32) / len(y)
        g = {"o": np.append(d @ h, d.sum())}
        dh = d[:, None] * self.p["o"][None, :-1] * (1 - h * h)
        g["a"], g["b"] = x.T @ dh, dh.sum(0)
        dx = (dh @ self.p["a"].T) / self.scale
        n = np.diff(at)
        dz = np.repeat(dx[:, :FILTERS] / n[:, None], n, 0)
        column = np.arange(FILTERS)
        for i in range(len(y)):
            part = z[at[i] : at[i + 1]]
            dz[at[i] + part.argmax(0), column] += dx[i, FILTERS : 2 * FILTERS]
            dz[at[i] + part.argmin(0), column] += dx[i, 2 * FILTERS : 3 * FILTERS]
        where = place[half, column[None, :]]
        g["t"] = np.empty_like(self.p["t"])
        for j in range(WIDTH):
            index = laid.ravel()[where + j].astype(np.int64) * FILTERS + column
            g["t"][j] = np.bincount(index.ravel(), dz.ravel(), 256 * FILTERS).reshape(256, FILTERS)
        return g


def learn(rows: list[tuple[str, int]], steps: int = STEPS, seed: int = 11) -> Filters | None:
    """None without examples of both classes."""
    labels = np.array([y for _, y in rows], np.float32)
    if len(set(labels.tolist())) < 2:
        return None
    raw = [np.frombuffer(t.encode(), np.uint8) for t, _ in rows]
    net, r = Filters(seed), np.random.default_rng(seed)

    def laid(some: np.ndarray) -> tuple[np.ndarray, ...]:
        sizes = np.array([len(raw[i]) for i in some])
        return *_laid(np.concatenate([raw[i] for i in some]), np.concatenate([[0], np.cumsum(sizes)])), sizes

    c = []
    for k in range(0, len(rows), 500):
        bytes_, filled, first, sizes = laid(np.arange(k, min(k + 500, len(rows))))
        z, _, at = net.chunks(net.halves(bytes_, filled)[0], first)
        c.append(net._combine(z, at, sizes))
    c = np.concatenate(c)
    net.mean, net.scale = c.mean(0), c.std(0) + 0.1
    net.p["o"][-1] = np.log(labels.mean() / (1 - labels.mean()))
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    order = np.zeros(0, np.int64)
    for step in range(steps):
        if len(order) < BATCH:
            order = np.concatenate([order, *[r.permutation(len(rows)) for _ in range(-(-BATCH // len(rows)))]])
        some, order = order[:BATCH], order[BATCH:]
        grads = net.gradients(*laid(some), labels[some])
        rate = 0.01 * 0.1 ** (step / steps)
        for name, value in grads.items():
            m, v = moment[name]
            m += 0.1 * (value - m)
            v += 0.01 * (value * value - v)
            net.p[name] -= (rate * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(v / (1 - 0.99 ** (step + 1))) + 1e-7)).astype(np.float32)
    return net


def score_texts(net: Filters | None, texts: pa.Array) -> np.ndarray:
    """The probability of every text; 1 for all without a model, so that nothing is rejected unlearned."""
    out = np.ones(len(texts))
    if net is not None:
        for lo, hi, data, offsets in text_slices(texts, texts):
            out[lo:hi] = net.score(data, offsets)
    return out


def _scores(net: Filters | None, threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = score_texts(net, batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return released(run)


def _kept(net: Filters | None, at: int, threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(score_texts(net, batch.column(at)) >= threshold))

    return released(run)


def score_quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", threshold: float = 0.3) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted (1 if score >= threshold).

    Null and empty texts are scored as one chunk of nothing. A null id is scored and never held out.
    Repeated rows are scored alike. Without labelled rows of both classes every score is 1. Only the id and
    the text are read from docs, so other columns may have any names.
    """
    net = learn(training_rows(docs, labels, label_column, id_column, text_column))
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(held_out_mod(5, id_column) == 0, F.lit(False)).alias("held_out"), F.col(text_column).cast("string").alias("text_"))
    return texts.mapInArrow(_scores(net, threshold), "doc_id long, held_out boolean, score double, predicted int")


def keep_quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches the threshold. Nulls, empty and long texts, repeats, ids and absent
    labels are as for score_quality, so without labels of both classes all rows stay. Columns may have any names."""
    net = learn(training_rows(docs, labels, label_column, id_column, text_column))
    return docs.mapInArrow(_kept(net, docs.columns.index(text_column), threshold), docs.schema)
