"""Language-model scoring with a weighted backoff automaton.

Symbols are whole words, all of them. N-grams of words up to three are counted over all training texts; bigrams and
trigrams that occur at least LEAST times are kept, however many there are. Interpolated absolute discounting makes them
probabilities. Every history with continuations is a state, every continuation an arc with its log-probability, and a
failure arc leads to the history without its oldest symbol at the cost of the backoff weight.

The table of states and arcs is spread over shards by a hash of the n-gram, so a frequent word or history is no larger
than any other, and it never comes to the driver. Texts are coded in blocks. A block sends each shard its distinct
n-grams once, with their counts, and gets back what the whole corpus has of them: trigrams first, then bigrams with what
was kept behind them, then words. One block reports each kept n-gram to its history. From the answers a block builds the
part of the automaton that its own texts pass.

A state depends on the last two symbols only, so the left-to-right traversal of all texts of a block is evaluated at once:
the state before every token is looked up, then arcs are taken and failures followed until every token is placed.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, U64, cut, held_out_mod, mix, release, released, span_hashes, text_slices, word_bounds

BLOCK_BYTES = 8 << 20
#: How often a bigram or trigram occurs at least to be kept.
LEAST = 2
#: Shards of an order: as many as keep one at about SHARD_KEYS n-grams, and LEAST_SHARDS at least (powers of two).
SHARD_KEYS, LEAST_SHARDS = 4 << 20, 256
#: Tokens of a block that are walked at once.
STEP = 1 << 18
DISCOUNT = 0.75
OTHER, END, BEGIN, FIRST = 0, 1, 2, 3
#: Hashes of the symbols before FIRST.
MARKS = mix(np.array([3, 5, 7], U64))
_TWO, _THREE = U64(0x9FB21C651E98DF25), U64(0xD6E8FEB86659FD93)


# ---------------------------------------------------------------- blocks

BLOCKS = "block long, doc_ids array<long>, held array<boolean>, sizes array<int>, tokens binary, words array<long>"


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for lo, hi, data, offsets in text_slices(batch.column(0), batch.column(2), BLOCK_BYTES):
            low = LOWER[data]
            starts, ends, at = word_bounds(low, offsets)
            words, tokens = np.unique(span_hashes(low, starts, ends), return_inverse=True)
            sizes = np.diff(at)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int.from_bytes(os.urandom(8), "little", signed=True)], pa.int64()),
                    _one(pa.array(batch.column(0).slice(lo, hi - lo)), pa.int64()),
                    _one(pa.array(held[lo:hi]), pa.bool_()),
                    _one(pa.array(sizes.astype(np.int32)), pa.int32()),
                    pa.array([_squeeze(tokens)], pa.binary()),
                    _one(pa.array(words.view(np.int64)), pa.int64()),
                ],
                ["block", "doc_ids", "held", "sizes", "tokens", "words"],
            )


def _one(values: pa.Array, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(kind))


_packer = cache(lambda: zstandard.ZstdCompressor(level=1))
_unpacker = cache(zstandard.ZstdDecompressor)


def _squeeze(tokens: np.ndarray) -> bytes:
    """The bytes of equal weight together: those of high weight are mostly zero."""
    return _packer().compress(np.ascontiguousarray(tokens.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unsqueeze(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(_unpacker().decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _list(column: pa.Array, i: int) -> np.ndarray:
    value = column[i].values
    return value.to_numpy(zero_copy_only=False) if value is not None else np.empty(0, np.int64)


def _padded(tokens: np.ndarray, sizes: np.ndarray, use: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every token of the texts and the end behind each: (symbol two before, symbol before, symbol)."""
    n = len(sizes)
    wide = sizes.astype(np.int64) + 1
    out = np.full(int(wide.sum()), END, np.int64)
    doc = np.repeat(np.arange(n), sizes)
    out[np.arange(len(tokens)) + doc] = tokens
    first = np.concatenate([[0], np.cumsum(wide)])[:-1]
    one = np.concatenate([[BEGIN], out[:-1]]) if len(out) else out
    one[first] = BEGIN
    two = np.concatenate([[BEGIN], one[:-1]]) if len(out) else out
    two[first] = BEGIN
    if use is not None:
        keep = np.repeat(use, wide)
        return two[keep], one[keep], out[keep]
    return two, one, out


# ---------------------------------------------------------------- n-grams of a block


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending distinct values, a place of each, and which of them stands at every place, in half the memory of np.unique."""
    order = np.argsort(hashes).astype(np.int32)
    ascending = hashes[order]
    fresh = np.ones(len(order), bool)
    np.not_equal(ascending[1:], ascending[:-1], out=fresh[1:])
    inverse = np.empty(len(order), np.int32)
    inverse[order] = np.cumsum(fresh, dtype=np.int32) - 1
    return ascending[fresh], order[fresh], inverse


class Grams:
    """The distinct n-grams of a block, each order sorted by hash, and where they stand; trigrams only where asked for."""

    def __init__(self, row: dict, trigrams: bool = True):
        self.sizes, held = np.asarray(row["sizes"], np.int64), np.asarray(row["held"], bool)
        hashes = np.concatenate([MARKS, np.asarray(row["words"], np.int64).view(U64)])
        self.k = len(hashes)
        self.two, self.one, self.last = (x.astype(np.int32) for x in _padded(_unsqueeze(row["tokens"]) + FIRST, self.sizes))
        wide = self.sizes + 1
        first = np.cumsum(wide) - wide
        train = np.repeat(~held, wide)
        texts = int((~held).sum())
        # Words, END, and BEGIN as often as texts begin.
        self.names = np.argsort(hashes[1:], kind="stable") + 1
        self.keys1 = hashes[self.names]
        n1 = np.bincount(self.last[train], minlength=self.k)
        n1[BEGIN] = texts
        self.n1 = n1[self.names]
        # Bigrams, and the history (BEGIN, BEGIN) as often as texts begin.
        begin = mix(MARKS[BEGIN : BEGIN + 1] * _TWO + MARKS[BEGIN])
        h2 = np.concatenate([mix(hashes[self.one] * _TWO + hashes[self.last]), begin])
        self.keys2, at, inv2 = _distinct(h2)
        del h2
        begins = at == len(self.one)
        at[begins] = 0
        self.a, self.b = np.where(begins, np.int32(BEGIN), self.one[at]), np.where(begins, np.int32(BEGIN), self.last[at])
        inv2, start = inv2[:-1], inv2[-1]
        if not trigrams:
            return
        self.n2 = np.bincount(inv2[train], minlength=len(self.keys2))
        self.n2[start] += texts
        before = np.concatenate([inv2[-1:], inv2[:-1]])
        before[first] = start
        # Trigrams: the history's number among the bigrams, and the bigram of the last two symbols.
        self.keys3, at, inv3 = _distinct(mix(self.keys2[before] * _THREE + hashes[self.last]))
        self.n3 = np.bincount(inv3[train], minlength=len(self.keys3))
        self.history, self.tail, self.c = before[at], inv2[at], self.last[at]


# ---------------------------------------------------------------- shards

SENT = "shard int, block long, keys binary, numbers binary"
ANSWERS = "order int, shard int, block long, numbers binary, tokens long, distinct long"


def _pack(keys: np.ndarray) -> bytes:
    """Ascending 64-bit numbers: the first, then the differences in as many bytes as the largest needs."""
    steps = np.diff(keys)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([width]) + keys[:1].astype("<u8").tobytes() + np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    width = raw[0]
    steps = np.zeros(((len(raw) - 9) // width, 8), np.uint8)
    steps[:, :width] = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, width)
    return np.cumsum(np.concatenate([np.frombuffer(raw[1:9], "<u8"), steps.view("<u8").ravel()]), dtype=U64)


def _numbers(columns: list[np.ndarray]) -> bytes:
    """Columns of numbers from 0, mostly small, of one length."""
    table = np.stack(columns).astype("<u8")
    width = max(1, (int(table.max()).bit_length() + 7) // 8)
    return bytes([width, len(columns)]) + _packer().compress(np.ascontiguousarray(table.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())


def _columns(raw: bytes) -> np.ndarray:
    width, columns = raw[0], raw[1]
    planes = np.frombuffer(_unpacker().decompress(raw[2:]), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel().astype(np.int64).reshape(columns, -1)


def _dealt(block: int, keys: np.ndarray, columns: list[np.ndarray], shards: int) -> pa.Table:
    """A block's ascending keys and their numbers by shard: the leading bits of the key."""
    edges = np.searchsorted(keys, np.arange(1, shards, dtype=U64) << U64(64 - shards.bit_length() + 1))
    edges = np.concatenate([[0], edges, [len(keys)]])
    used = np.flatnonzero(np.diff(edges)).tolist()
    parts = [slice(int(edges[s]), int(edges[s + 1])) for s in used]
    return pa.table(
        {
            "shard": pa.array(used, pa.int32()),
            "block": pa.array([block] * len(used), pa.int64()),
            "keys": pa.array([_pack(keys[p]) for p in parts], pa.binary()),
            "numbers": pa.array([_numbers([c[p] for c in columns]) for p in parts], pa.binary()),
        }
    )


def _summed(order: int) -> Callable:
    """Each block's numbers of a shard as those of all blocks, with a last column that is 1 for one block of each key.
    tokens and distinct: the sum and number of keys that training texts have, once a shard."""

    def run(sent: pa.Table) -> pa.Table:
        blocks = sent.column("block").to_pylist()
        keys = [_unpack(x) for x in sent.column("keys").to_pylist()]
        numbers = np.concatenate([_columns(x) for x in sent.column("numbers").to_pylist()], 1)
        found, at, inverse = _distinct(np.concatenate(keys))
        total = [np.bincount(inverse, x, len(found)).astype(np.int64) for x in numbers]
        tokens, distinct = int(total[0].sum()), int((total[0] > 0).sum())
        if order > 1:
            total[0][total[0] < LEAST] = 0
        owner = np.zeros(len(inverse), np.int64)
        owner[at] = 1
        answers = [*(x[inverse] for x in total), owner]
        ends = np.cumsum([len(x) for x in keys]).tolist()
        return pa.table(
            {
                "order": pa.array([order] * len(blocks), pa.int32()),
                "shard": sent.column("shard").combine_chunks().cast(pa.int32()),
                "block": pa.array(blocks, pa.int64()),
                "numbers": pa.array([_numbers([x[e - len(k) : e] for x in answers]) for k, e in zip(keys, ends, strict=True)], pa.binary()),
                "tokens": pa.array([tokens] + [0] * (len(blocks) - 1), pa.int64()),
                "distinct": pa.array([distinct] + [0] * (len(blocks) - 1), pa.int64()),
            }
        )

    return run


def _of_order(answers: pa.Table, order: int) -> np.ndarray:
    """A block's answers of an order, in the order of its keys."""
    rows = [(s, x) for o, s, x in zip(*(answers.column(c).to_pylist() for c in ("order", "shard", "numbers")), strict=True) if o == order]
    return np.concatenate([_columns(x) for _, x in sorted(rows)], 1)


def _kept_behind(history: np.ndarray, answers: np.ndarray, size: int) -> list[np.ndarray]:
    """Of each history, the occurrences and the number of the kept n-grams that this block reports."""
    own = (answers[-1] > 0) & (answers[0] >= LEAST)
    return [np.bincount(history[own], answers[0][own], size).astype(np.int64), np.bincount(history[own], minlength=size)]


def _send_trigrams(shards: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                g = Grams(row)
                yield from _dealt(row["block"], g.keys3, [g.n3], shards).to_batches()

    return run


def _send_bigrams(shards: int) -> Callable:
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        row = next(_rows(block))
        g = Grams(row)
        return _dealt(row["block"], g.keys2, [g.n2, *_kept_behind(g.history, _of_order(answers, 3), len(g.keys2))], shards)

    return run


def _send_words(shards: int) -> Callable:
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        row = next(_rows(block))
        g = Grams(row, trigrams=False)
        two = _of_order(answers, 2)
        two[0][g.b == BEGIN] = 0  # a history only
        behind = _kept_behind(g.a, two, g.k)
        return _dealt(row["block"], g.keys1, [g.n1, *(x[g.names] for x in behind)], shards)

    return run


def _rows(batch: pa.RecordBatch | pa.Table) -> Iterator[dict]:
    """Rows with their lists as arrays."""
    columns = {name: batch.column(name) for name in batch.schema.names}
    for i in range(batch.num_rows):
        yield {name: _list(x, i) if pa.types.is_list(x.type) else x[i].as_py() for name, x in columns.items()}


# ---------------------------------------------------------------- the automaton


@dataclass
class Automaton:
    """States are numbers, 0 the empty history. arcs: sorted state * k + symbol, with the log10 of their probability."""

    k: int
    pair_keys: np.ndarray  # histories of two symbols, sorted, and their states
    pair_states: np.ndarray
    single_states: np.ndarray  # the state of a history of one symbol, 0 if it has none
    arcs: np.ndarray
    weights: np.ndarray
    failure: np.ndarray
    backoff: np.ndarray

    def states(self, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The longest history that is a state."""
        out = self.single_states[last]
        if len(self.pair_keys):
            key = before * self.k + last
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            out = np.where(self.pair_keys[at] == key, self.pair_states[at], out)
        return out

    def walk(self, before: np.ndarray, last: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The log10 probability of each symbol after its history."""
        state = self.states(before, last)
        out = np.zeros(len(symbol))
        todo = np.arange(len(symbol))
        while len(todo):
            key = state[todo] * self.k + symbol[todo]
            at = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            there = self.arcs[at] == key
            out[todo[there]] += self.weights[at[there]]
            todo = todo[~there]
            out[todo] += self.backoff[state[todo]]
            state[todo] = self.failure[state[todo]]
        return out


def assemble(p1: np.ndarray, followed1: np.ndarray, behind1: np.ndarray, pairs: tuple[np.ndarray, ...], trigrams: tuple[np.ndarray, ...]) -> Automaton:
    """p1: the probability of every symbol (BEGIN has none). followed1 and behind1: how often a symbol was followed, and
    the discounted occurrences of its kept continuations. pairs: (first symbol, second, occurrences or 0 if not kept, how
    often followed, discounted occurrences of kept continuations). trigrams that are kept: (number of the history among the
    pairs, number of the pair of the last two symbols, last symbol, occurrences). Every symbol but BEGIN has an arc from 0."""
    k = len(p1)
    real = np.flatnonzero(np.arange(k) != BEGIN)
    a, b, n2, followed2, behind2 = pairs
    history, tail, c, n3 = trigrams
    gamma1 = 1 - behind1 / np.maximum(followed1, 1)
    gamma2 = 1 - behind2 / np.maximum(followed2, 1)
    single = np.zeros(k, np.int64)
    ones = np.flatnonzero(behind1 > 0)
    single[ones] = 1 + np.arange(len(ones))
    twos = np.flatnonzero(behind2 > 0)
    state2 = np.zeros(len(a), np.int64)
    state2[twos] = 1 + len(ones) + np.arange(len(twos))
    kept = (n2 > 0) & (b != BEGIN)
    p2 = np.where(kept, (n2 - DISCOUNT) / np.maximum(followed1[a], 1), 0.0) + gamma1[a] * p1[b]
    p3 = (n3 - DISCOUNT) / followed2[history] + gamma2[history] * p2[tail]
    arcs = np.concatenate([real, single[a[kept]] * k + b[kept], state2[history] * k + c])
    weights = np.log10(np.concatenate([p1[real], p2[kept], p3]))
    order = np.argsort(arcs, kind="stable")
    keys = a[twos].astype(np.int64) * k + b[twos]
    by_key = np.argsort(keys, kind="stable")
    failure = np.concatenate([[0], np.zeros(len(ones), np.int64), single[b[twos]]])
    backoff = np.concatenate([[0.0], np.log10(gamma1[ones]), np.log10(gamma2[twos])])
    return Automaton(k, keys[by_key], state2[twos][by_key], single, arcs[order], weights[order], failure, backoff)


def build(grams: list[tuple[int, int, int]], k: int, single_totals: np.ndarray) -> Automaton:
    """The automaton of a whole table. grams: (order, key, n) of the n-grams kept, of orders 2 and 3; single_totals: exact
    counts of the k symbols as tokens (0 for BEGIN)."""
    two = {key: n for order, key, n in grams if order == 2}
    three = {key: n for order, key, n in grams if order == 3}
    p1 = single_totals + 1.0
    p1[BEGIN] = 0
    p1 /= p1.sum()
    names = sorted({*two, *(key // k for key in three), *(key // (k * k) * k + key // k % k for key in three), *(key % (k * k) for key in three)})
    number = {key: i for i, key in enumerate(names)}
    keys, n2 = np.array(names, np.int64), np.array([two.get(key, 0) for key in names], np.int64)
    tri, n3 = np.array(list(three), np.int64), np.array(list(three.values()), np.int64)
    history = np.array([number[key // k] for key in three], np.int64)
    tail = np.array([number[key % (k * k)] for key in three], np.int64)
    # How often each history was followed by anything; texts begin as often as they end.
    followed1 = single_totals.astype(float)
    followed1[BEGIN], followed1[END] = single_totals[END], 0
    followed2 = np.where(keys == BEGIN * k + BEGIN, single_totals[END], n2).astype(float)
    followed1 = np.maximum(followed1, np.bincount(keys // k, n2, k))
    followed2 = np.maximum(followed2, np.bincount(history, n3, len(keys)))
    behind1 = np.bincount(keys // k, np.where(n2 > 0, n2 - DISCOUNT, 0), k)
    behind2 = np.bincount(history, n3 - DISCOUNT, len(keys))
    return assemble(p1, followed1, behind1, (keys // k, keys % k, n2, followed2, behind2), (history, tail, tri % k, n3))


# ---------------------------------------------------------------- scoring

SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(tokens: int, distinct: int) -> Callable:
    """tokens, distinct: of the training texts, ends included."""

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        row = next(_rows(block))
        g = Grams(row)
        one, two, three = (_of_order(answers, order) for order in (1, 2, 3))
        count, followed, behind = np.zeros(g.k, np.int64), np.zeros(g.k), np.zeros(g.k)
        count[g.names] = followed[g.names] = one[0]
        behind[g.names] = one[1] - DISCOUNT * one[2]
        count[BEGIN] = followed[END] = 0
        p1 = (count + 1.0) / (tokens + distinct + 1.0)
        kept = np.flatnonzero(three[0])
        pairs = (g.a, g.b, two[0], two[0].astype(float), two[1] - DISCOUNT * two[2])
        automaton = assemble(p1, followed, behind, pairs, (g.history[kept], g.tail[kept], g.c[kept], three[0][kept]))
        n = len(g.sizes)
        doc = np.repeat(np.arange(n), g.sizes + 1)
        base = np.bincount(doc, np.log10(p1)[g.last], n)
        known = np.bincount(doc, (count > 0)[g.last], n).astype(np.int64)
        walked = np.empty(len(doc))
        for i in range(0, len(doc), STEP):
            walked[i : i + STEP] = automaton.walk(*(x[i : i + STEP].astype(np.int64) for x in (g.two, g.one, g.last)))
        score = np.bincount(doc, walked, n)
        return pa.table(
            [pa.array(block.column("doc_ids").combine_chunks()[0].values), pa.array(block.column("held").combine_chunks()[0].values), pa.array(g.sizes + 1), pa.array(known), pa.array(np.full(n, tokens, np.int64)), pa.array(base.astype(float)), pa.array(score.astype(float))],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return run


def _shed(df: DataFrame, name: str) -> DataFrame:
    """cut, after which the shuffle files that made df are not kept."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        return cut(df, name)
    finally:
        spark.conf.set(key, was)


def score_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", modulus: int = 7, held: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows whose crc32(id as text) mod modulus is not held; rows with a null id are learned from. Null and
    empty texts are an end alone. Repeated rows count and are scored each. An empty table gives no rows; without
    training rows every word is unseen. Other columns are not read.
    """
    out_of = F.coalesce(held_out_mod(modulus, id_column) == held, F.lit(False))
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), out_of.alias("held"), F.col(text_column).cast("string").alias("text_"))
    blocks = cut(texts.mapInArrow(released(_coded), BLOCKS), "lm-blocks")
    in_block = F.aggregate("sizes", F.lit(0).cast("long"), lambda n, x: n + x) + F.size("sizes")
    ends, size = blocks.agg(F.coalesce(F.sum(F.size(F.filter("held", lambda x: ~x))), F.lit(0)), F.coalesce(F.sum(in_block), F.lit(0))).first()
    shards = max(LEAST_SHARDS, 1 << (int(size) // SHARD_KEYS).bit_length())

    def answered(sent: DataFrame, order: int) -> DataFrame:
        return _shed(sent.groupBy("shard").applyInArrow(_summed(order), ANSWERS), f"lm-answers-{order}")

    def with_answers(answers: DataFrame, run: Callable, schema: str) -> DataFrame:
        return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)

    three = answered(blocks.mapInArrow(released(_send_trigrams(shards)), SENT), 3)
    two = answered(with_answers(three, _send_bigrams(shards), SENT), 2)
    one = answered(with_answers(two, _send_words(shards), SENT), 1)
    total, distinct = one.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    # Texts begin as often as they end; BEGIN is no token.
    return with_answers(one.union(two).union(three), _scored(int(total) - int(ends), int(distinct) - (ends > 0)), SCORES)
