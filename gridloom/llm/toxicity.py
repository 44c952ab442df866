"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Every text is read as words (runs of ASCII letters, digits and bytes of other scripts, lower case) and their characters. A
word's inputs are a learned vector of its hashed self, the mean of the learned vectors of its hashed character 3-, 4- and
5-grams, and log-odds of both. The vectors are trained with the network, from its own gradients. Log-odds that a text is
trained with come from the other half of the texts, so that a word seen once does not give its own label away. Windows of
32 words, one every 16, cover the whole text; each is read in both directions, pooled by attention and scored; the
text's score is that of its highest window. Training is multiple-instance: a text's highest window carries
the text's label.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import training_rows
from .shared import LOWER, U64, held_out_mod, mix, release, released, span_hashes, text_slices, word_bounds

WINDOW, HOP, HIDDEN, BITS = 32, 16, 8, 17
#: Log-odds of a word (and a constant), numbers in a vector, and a word's inputs: log-odds, its vector, its characters' vector.
ODDS, WIDE, VECTOR_BITS = 6, 6, 14
INPUTS = ODDS + 2 * WIDE
SHIFT = BITS - VECTOR_BITS
#: Steps of training, texts in one, and steps after which the highest windows are looked for again. The same for every sample.
STEPS, BATCH, REFRESH = 300, 64, 75
#: Vectors shrink by this at each step, so that words without news go to nothing.
DECAY = 1e-3
#: The share of training windows that are read without log-odds, so that the vectors learn to do without.
BLIND = 0.5
GAP = np.ones(256, bool)
GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


# ---------------------------------------------------------------- words and characters


class Words:
    """The distinct words of a buffer with the buckets of their characters, and each token's word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = LOWER[data]
        starts, ends, self.offsets = word_bounds(data, offsets, GAP)
        self.hashes, where, self.word = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True) if len(starts) else (np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64))
        self.bucket = (self.hashes >> U64(64 - BITS)).astype(np.int64)
        starts, sizes = starts[where], (ends - starts)[where]
        self.count = len(sizes)
        # Each word between two marks, in a row.
        wide = sizes + 2
        first = np.concatenate([[0], np.cumsum(wide)])[:-1]
        letters = np.full(int(wide.sum()), 1, np.uint8)
        inside = np.repeat(first + 1 - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()) if len(sizes) else np.empty(0, np.int64)
        letters[inside] = data[np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())] if len(sizes) else 0
        letters[first + wide - 1] = 2
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        h = letters.astype(U64) + U64(1)
        for n in (2, 3, 4, 5):
            if len(letters) >= n:
                h = h[: len(letters) - n + 1] * U64(0x100000001B3) + letters[n - 1 :]
            else:
                h = h[:0]
            if n > 2:
                # The grams of a word of fewer signs reach into the next word: those are left out.
                per = np.maximum(wide - n + 1, 0)
                runs = np.concatenate([[0], np.cumsum(per)])
                at = np.repeat(first - runs[:-1], per) + np.arange(runs[-1])
                self.grams.append(((mix(h[at]) >> U64(64 - BITS)).astype(np.int64), runs))

    def odds(self, tables: list[np.ndarray]) -> np.ndarray:
        """For each distinct word: its own log-odds, the highest of its 3-, 4- and 5-grams, their mean, and 1."""
        out = np.zeros((self.count, ODDS), np.float32)
        if not self.count:
            return out
        out[:, 0] = tables[0][self.bucket]
        total, number = np.zeros(self.count), np.zeros(self.count)
        for k, (bucket, runs) in enumerate(self.grams):
            some = np.flatnonzero(np.diff(runs))
            if len(some):
                value = tables[k + 1][bucket]
                out[some, k + 1] = np.maximum.reduceat(value, runs[some])
                total[some] += np.add.reduceat(value, runs[some])
                number += np.diff(runs)
        out[:, 4] = total / np.maximum(number, 1)
        out[:, 5] = 1
        return out / np.array([3, 3, 3, 3, 3, 1], np.float32)

    def letters(self) -> tuple[np.ndarray, np.ndarray]:
        """(buckets of the 3-, 4- and 5-grams of all distinct words in a row, each word's offset into them)."""
        if not self.count or not self.grams:
            return np.empty(0, np.int64), np.zeros(self.count + 1, np.int64)
        word = np.concatenate([np.repeat(np.arange(self.count), np.diff(runs)) for _, runs in self.grams])
        bucket = np.concatenate([x for x, _ in self.grams])
        order = np.argsort(word, kind="stable")
        return bucket[order], np.searchsorted(word[order], np.arange(self.count + 1))


def _log_odds(seen: np.ndarray, texts: np.ndarray) -> list[np.ndarray]:
    """seen: (tables, 2, buckets) texts of each class that hold a bucket; texts: how many there are of each class."""
    tables = []
    for own in seen:
        odds = np.log((own[1] + 0.5) / (texts[1] + 1)) - np.log((own[0] + 0.5) / (texts[0] + 1))
        total = own.sum(0)
        tables.append(np.clip(odds * total / (total + 3), -2, 6).astype(np.float32))
    return tables


def windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first token, tokens, text) of every window; a text without words has one window of no tokens."""
    sizes = np.diff(offsets)
    n = np.maximum(1, -(-(sizes - WINDOW) // HOP) + 1)
    text = np.repeat(np.arange(len(sizes)), n)
    k = np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    first = offsets[text] + k * HOP
    return first, np.minimum(WINDOW, offsets[text + 1] - first), text


# ---------------------------------------------------------------- the network


class Network:
    """Parameters: e (buckets, wide) vectors of words, c those of characters, w (2, inputs, 3h), u (2, h, 3h) for both directions, v (2h) attention, o (2h + 1) output."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {"w": r.normal(0, 0.4, (2, INPUTS, 3 * HIDDEN)), "u": r.normal(0, 0.3, (2, HIDDEN, 3 * HIDDEN)), "v": r.normal(0, 0.3, 2 * HIDDEN), "o": np.append(r.normal(0, 0.3, 2 * HIDDEN), -1.0)}
        self.p |= {k: r.normal(0, 0.1, (1 << VECTOR_BITS, WIDE)) for k in "ec"}
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}

    def inputs(self, odds: np.ndarray, bucket: np.ndarray, letters: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """What is read of each distinct word."""
        grams, runs = letters
        n = np.diff(runs)
        out = np.zeros((len(bucket), INPUTS), np.float32)
        out[:, :ODDS] = odds
        out[:, ODDS : ODDS + WIDE] = self.p["e"][bucket >> SHIFT]
        some = np.flatnonzero(n)
        if len(some):
            out[some, ODDS + WIDE :] = np.add.reduceat(self.p["c"][grams >> SHIFT], runs[some], 0) / n[some, None]
        return out

    def vector_gradients(self, dx: np.ndarray, word: np.ndarray, bucket: np.ndarray, letters: tuple[np.ndarray, np.ndarray]) -> dict[str, np.ndarray]:
        """Gradients of e and c from those of the inputs of tokens, whose distinct words are given."""
        order = np.argsort(word, kind="stable")
        begin = np.flatnonzero(np.concatenate([[True], np.diff(word[order]) != 0]))
        own, total = word[order][begin], np.add.reduceat(dx[order], begin, 0)
        grams, runs = letters
        n = (runs[1:] - runs[:-1])[own]
        at = np.repeat(runs[own] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        spread = np.repeat(total[:, WIDE:] / np.maximum(n, 1)[:, None], n, 0)
        return {"e": _by_bucket(bucket[own], total[:, :WIDE]), "c": _by_bucket(grams[at], spread)}

    def _read(self, inputs: np.ndarray, token: np.ndarray, inside: np.ndarray, keep: list | None) -> np.ndarray:
        """inputs: (2, words, 3h), the projected features. States (2, length, windows, h), each direction at its own steps' places."""
        b, length = token.shape
        h = np.zeros((2, b, HIDDEN), np.float32)
        states = np.empty((2, length, b, HIDDEN), np.float32)
        a = np.empty((2, b, 3 * HIDDEN), np.float32)
        half = np.float32(0.5)
        for t in range(length):
            s = length - 1 - t
            np.take(inputs[0], token[:, t], 0, out=a[0], mode="clip")
            np.take(inputs[1], token[:, s], 0, out=a[1], mode="clip")
            live = np.stack([inside[:, t], inside[:, s]])[:, :, None]
            u = h @ self.p["u"]
            gates = np.tanh((a[..., : 2 * HIDDEN] + u[..., : 2 * HIDDEN]) * half) * half + half
            z, r = gates[..., :HIDDEN], gates[..., HIDDEN:]
            c = np.tanh(a[..., 2 * HIDDEN :] + r * u[..., 2 * HIDDEN :])
            new = c + z * (h - c)
            if keep is not None:
                keep.append((h, z, r, c, u[..., 2 * HIDDEN :], live))
            h = np.where(live, new, h)
            states[0, t], states[1, s] = h[0], h[1]
        return states

    def _pool(self, states: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, ...]:
        score = states[0] @ self.p["v"][:HIDDEN] + states[1] @ self.p["v"][HIDDEN:]
        weight = np.exp(score) * inside.T
        weight /= np.maximum(weight.sum(0), 1e-20)
        pooled = np.concatenate([np.einsum("lb,lbh->bh", weight, states[0]), np.einsum("lb,lbh->bh", weight, states[1])], 1)
        return pooled @ self.p["o"][:-1] + self.p["o"][-1], weight, pooled

    def logits(self, features: np.ndarray, word: np.ndarray, first: np.ndarray, size: np.ndarray, at_once: int = 4096) -> np.ndarray:
        """A logit for each window of tokens, whose words' features are given by distinct word."""
        out = np.empty(len(first), np.float32)
        inputs = np.concatenate([features @ self.p["w"], np.zeros((2, 1, 3 * HIDDEN), np.float32)], 1)
        word = np.append(word, len(features))
        for k in range(0, len(first), at_once):
            step = np.arange(WINDOW)[None, :]
            inside = step < size[k : k + at_once, None]
            token = word[np.where(inside, first[k : k + at_once, None] + step, len(word) - 1)]
            out[k : k + at_once] = self._pool(self._read(inputs, token, inside, None), inside)[0]
        return out

    def gradients(self, x: np.ndarray, inside: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """(gradients of w, u, v and o, those of the inputs that are vectors). x: (windows, length, inputs)."""
        b, length, _ = x.shape
        flat = np.concatenate([x.reshape(-1, INPUTS), np.zeros((1, INPUTS), np.float32)])
        token = np.arange(b * length).reshape(b, length)
        keep: list = []
        states = self._read(flat @ self.p["w"], token, inside, keep)
        logit, weight, pooled = self._pool(states, inside)
        d = ((1 / (1 + np.exp(-logit))) - y).astype(np.float32) / b
        g = {k: np.zeros_like(self.p[k]) for k in "wuvo"}
        dx = np.zeros((b, length, 2 * WIDE), np.float32)
        wt = np.swapaxes(self.p["w"][:, ODDS:], 1, 2)
        g["o"][:-1], g["o"][-1] = d @ pooled, d.sum()
        d_pooled = d[:, None] * self.p["o"][None, :-1]
        d_states = np.empty_like(states)
        for k in range(2):
            half = slice(k * HIDDEN, (k + 1) * HIDDEN)
            d_weight = np.einsum("bh,lbh->lb", d_pooled[:, half], states[k])
            total = d_weight if k == 0 else total + d_weight
        d_score = weight * (total - (weight * total).sum(0))
        for k in range(2):
            half = slice(k * HIDDEN, (k + 1) * HIDDEN)
            d_states[k] = weight[:, :, None] * d_pooled[None, :, half] + d_score[:, :, None] * self.p["v"][half]
            g["v"][half] = np.einsum("lb,lbh->h", d_score, states[k])
        back = np.zeros((2, b, HIDDEN), np.float32)
        ut = np.swapaxes(self.p["u"], 1, 2)
        for t in range(length - 1, -1, -1):
            s = length - 1 - t
            h, z, r, c, uc, live = keep[t]
            back = back + np.stack([d_states[0, t], d_states[1, s]])
            own = np.where(live, back, 0)
            dz, dc = own * (h - c), own * (1 - z)
            dac = dc * (1 - c * c)
            da = np.concatenate([dz * z * (1 - z), dac * uc * r * (1 - r), dac], 2)
            du = np.concatenate([da[..., : 2 * HIDDEN], dac * r], 2)
            xs = np.stack([x[:, t], x[:, s]])
            back_x = da @ wt
            dx[:, t] += back_x[0]
            dx[:, s] += back_x[1]
            g["w"] += np.swapaxes(xs, 1, 2) @ da
            g["u"] += np.swapaxes(h, 1, 2) @ du
            back = np.where(live, own * z, back) + du @ ut
        return g, dx


def _by_bucket(bucket: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of the rows of each bucket of vectors."""
    return np.stack([np.bincount(bucket >> SHIFT, column, 1 << VECTOR_BITS) for column in rows.T], 1).astype(np.float32)


def learn(rows: list[tuple[str, int]], seed: int = 7) -> tuple[Network, list[np.ndarray]] | None:
    """The network and the log-odds it reads; None without examples of both classes."""
    labels = np.array([y for _, y in rows], np.int64)
    if len(set(labels.tolist())) < 2:
        return None
    r = np.random.default_rng(seed)
    fold = np.empty(len(rows), np.int64)
    for y in (0, 1):
        own = np.flatnonzero(labels == y)
        fold[own] = r.permutation(len(own)) % 2

    def read(i: int) -> Words:
        raw = np.frombuffer(rows[i][0].encode(), np.uint8)
        return Words(raw, np.array([0, len(raw)]))

    # Of the texts only their words' numbers are held, of each distinct word its buckets and its log-odds in either half.
    seen = np.zeros((2, 4, 2, 1 << BITS), np.float32)
    number_of: dict[int, int] = {}
    buckets, gram_parts, gram_counts, tokens = [], [], [], []
    for i, y in enumerate(labels):
        w = read(i)
        for k, own in enumerate([w.bucket, *(g for g, _ in w.grams)]):
            seen[fold[i], k, y, np.unique(own)] += 1
        grams, runs = w.letters()
        local = np.empty(w.count, np.int64)
        known = len(number_of)
        for j, h in enumerate(w.hashes.tolist()):
            local[j] = number_of.setdefault(h, len(number_of))
        fresh = np.flatnonzero(local >= known)
        fresh = fresh[np.argsort(local[fresh], kind="stable")]
        buckets.append(w.bucket[fresh].astype(np.int32))
        own, ends = _some((grams, runs), fresh)
        gram_parts.append(own.astype(np.int32))
        gram_counts.append(np.diff(ends))
        tokens.append(local[w.word].astype(np.int32))
    number = np.array([[((labels == y) & (fold == k)).sum() for y in (0, 1)] for k in (0, 1)], float)
    known = len(number_of)
    bucket = np.concatenate(buckets)
    letters = (np.concatenate(gram_parts), np.concatenate([[0], np.cumsum(np.concatenate(gram_counts))]).astype(np.int64))
    del buckets, gram_parts, gram_counts
    tables = [_log_odds(seen[1 - k], number[1 - k]) for k in (0, 1)]
    odds = np.zeros((2 * known, ODDS), np.float32)
    for i in range(len(rows)):
        w = read(i)
        odds[np.array([number_of[h] for h in w.hashes.tolist()], np.int64) + known * fold[i]] = w.odds(tables[fold[i]])
    sizes = np.array([len(x) for x in tokens], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    # A word of the second half of the texts is another row of odds; the last row is no word.
    word = np.concatenate([*(x.astype(np.int64) + known * fold[i] for i, x in enumerate(tokens)), [2 * known]])
    first, size, text = windows(offsets)
    net = Network(seed)
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    ends = np.flatnonzero(np.append(text[1:] != text[:-1], True))
    begins = np.concatenate([[0], ends[:-1] + 1])
    step = np.arange(WINDOW)[None, :]
    net.p["o"][-1] = np.log((labels == 1).sum() / (labels == 0).sum())
    negative = np.flatnonzero(labels == 0)
    wait: list[int] = []
    for tick in range(1, STEPS + 1):
        if (tick - 1) % REFRESH == 0:
            if tick == 1:
                # The window whose inputs are highest, before anything is learned.
                peak = np.append(odds[:, :4].max(1), 0)[word] if known else np.zeros(len(word))
                score = np.array([peak[a : a + n].max() if n else 0 for a, n in zip(first, size, strict=True)], np.float32)
            else:
                score = _window_scores(net, odds, bucket, letters, word, first, size)
            top = np.array([a + int(score[a : b + 1].argmax()) for a, b in zip(begins, ends, strict=True)])
            others = begins[negative] + (r.random(len(negative)) * (ends - begins + 1)[negative]).astype(int)
            use, target = np.concatenate([top, others]), np.concatenate([labels, np.zeros(len(negative), np.int64)]).astype(np.float32)
            wait = []
        if len(wait) < BATCH:
            wait = [*wait, *r.permutation(len(use)).tolist()]
        some, wait = np.array(wait[:BATCH]), wait[BATCH:]
        inside = step < size[use[some], None]
        token = word[np.where(inside, first[use[some], None] + step, len(word) - 1)]
        near, place = np.unique(token, return_inverse=True)
        place = place.reshape(token.shape)
        real = near[near < 2 * known]
        x = np.zeros((len(near), INPUTS), np.float32)
        x[: len(real)] = net.inputs(odds[real], bucket[real % known], _some(letters, real % known)) if len(real) else 0
        x = x[place]
        x[r.random(len(some)) < BLIND, :, : ODDS - 1] = 0
        grads, dx = net.gradients(x, inside, target[some])
        told = token < 2 * known
        if told.any():
            grads |= net.vector_gradients(dx[told], token[told] % known, bucket, letters)
        rate = 0.02 * 0.1 ** (tick / STEPS)
        for name, value in grads.items():
            m, v = moment[name]
            m += 0.1 * (value - m)
            v += 0.01 * (value * value - v)
            net.p[name] -= (rate * (m / (1 - 0.9**tick)) / (np.sqrt(v / (1 - 0.99**tick)) + 1e-7)).astype(np.float32)
            if name in "ec":
                net.p[name] *= np.float32(1 - DECAY)
    out = net, _log_odds(seen.sum(0), number.sum(0))
    del number_of, odds, letters, bucket, word, moment, seen
    release()
    return out


def _some(letters: tuple[np.ndarray, np.ndarray], words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The character n-grams of some of the words."""
    grams, runs = letters
    n = (runs[1:] - runs[:-1])[words]
    ends = np.cumsum(n)
    return grams[np.repeat(runs[words] - ends + n, n) + np.arange(n.sum())], np.concatenate([[0], ends])


def _window_scores(net: Network, odds: np.ndarray, bucket: np.ndarray, letters: tuple[np.ndarray, np.ndarray], word: np.ndarray, first: np.ndarray, size: np.ndarray, at_once: int = 2048) -> np.ndarray:
    """Logits of the training windows, some at a time, each time with the inputs of the words that these hold."""
    out = np.zeros(len(first), np.float32)
    known = len(bucket)
    for k in range(0, len(first), at_once):
        lo, hi = int(first[k]), int((first + size)[k : k + at_once].max())
        near, place = np.unique(word[lo:hi], return_inverse=True)
        inputs = net.inputs(odds[near], bucket[near % known], _some(letters, near % known)) if len(near) else np.zeros((0, INPUTS), np.float32)
        out[k : k + at_once] = net.logits(inputs, place, first[k : k + at_once] - lo, size[k : k + at_once])
    return out


def score_texts(model: tuple[Network, list[np.ndarray]] | None, texts: pa.Array) -> np.ndarray:
    """The score of every text, by the highest of its overlapping windows; 0 for all without a model."""
    out = np.zeros(len(texts))
    if model is None:
        return out
    net, tables = model
    for lo, hi, data, offsets in text_slices(texts, texts):
        words = Words(data, offsets)
        first, size, text = windows(words.offsets)
        logit = net.logits(net.inputs(words.odds(tables), words.bucket, words.letters()), words.word, first, size)
        best = np.maximum.reduceat(logit, np.searchsorted(text, np.arange(hi - lo)))
        out[lo:hi] = 1 / (1 + np.exp(-best.astype(float)))
    return out


def _scores(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = score_texts(model, batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return released(run)


def _kept(model, at: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(score_texts(model, batch.column(at)) < 0.5))

    return released(run)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Null and empty texts are scored like a text without words. A null id is scored and never held out.
    Repeated rows are scored alike. Without labelled rows of both classes every score is 0. Only the id and
    the text are read from docs, so other columns may have any names.
    """
    model = training_model(docs, labels, id_column, text_column, label_column)
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(held_out_mod(5, id_column) == 0, F.lit(False)).alias("held_out"), F.col(text_column).cast("string").alias("text_"))
    return texts.mapInArrow(_scores(model), "doc_id long, held_out boolean, score double, predicted int")


def training_model(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic"):
    return learn(training_rows(docs, labels, label_column, id_column, text_column))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> DataFrame:
    """The rows of docs, with all their columns, that are not predicted toxic: score below 0.5. Nulls, empty and long texts, repeats,
    ids and absent labels are as for score_toxicity, so without labels of both classes all rows stay. Columns may have any names."""
    model = training_model(docs, labels, id_column, text_column, label_column)
    return docs.mapInArrow(_kept(model, docs.columns.index(text_column)), docs.schema)
