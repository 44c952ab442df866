"""Exact Jaccard join of documents by their word n-grams, with set-relation skipping.

A document is the set of hashes of its n-grams. Equal sets are one class. The rest:

1. Hashed counts of all n-grams give one order of n-grams, rare ones first. Every set is filed under its
   prefix in that order: two sets that link share an n-gram of their prefixes.
2. An n-gram's list is sorted by set size and cut into blocks by position. Index-level skipping: a block is
   passed over when its sizes are out of range or its positions leave too few n-grams behind them.
3. Answer-level skipping. Of every list, a leader takes the sets that follow it within its range of sizes; each set keeps
   the smallest and the largest of its leaders. These few pairs are verified first, and their exact difference is the
   answer that is kept: a linked set stands in its leader's group, at that distance. From here on lists hold a
   group once, with its widest distance. Groups of different components are compared by their leaders alone: what the
   leaders' computed difference, less both distances, already puts beyond the threshold is settled for all
   members without their sets. Before that, parities (at least 512 bits a set, about a bit an n-gram) bound the
   difference of two leaders from below in the same way.
4. Groups whose leaders' difference leaves it open are opened: their members stand in the lists themselves, are compared
   across components in the same way, and verified with the whole sets. Components of the links are the answer.

Every skip follows from the triangle inequality of set differences, so the result is exact. Links inside a component that
follow from others are not listed: no pair within a group of copies is expanded. A leader of many sets is sent to as many
tasks as its sets need.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import LOWER, U64, chained, cut, mix, released, span_hashes, text_slices, word_bounds

BUCKET_BITS = 20
CHUNK = 1 << 16
PARITY = 512
ID_BITS = 23
#: Rows of a list that are compared with each other at once; longer lists go block against block.
BLOCK = 2048
#: Sets that one task verifies against a leader; a leader of more goes to several tasks.
FOLLOWERS = 512
PAIR = "a long, a_fp long, b long, b_fp long"


# ---------------------------------------------------------------- sets


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct n-gram hashes of each document, ascending, documents in a row; offsets). A document of fewer words
    has its whole sequence as its only n-gram."""
    low = LOWER[data]
    starts, ends, words = word_bounds(low, offsets)
    hashes = span_hashes(low, starts, ends)
    grams, at = chained(hashes, words, width)
    counts = np.diff(words)
    doc = np.repeat(np.arange(len(counts)), np.diff(at))
    few = np.flatnonzero((counts > 0) & (counts < width))
    if len(few):
        short = np.array([_whole(hashes[words[i] : words[i + 1]]) for i in few.tolist()], U64)
        grams, doc = np.concatenate([grams, short]), np.concatenate([doc, few])
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams, doc = grams[new], doc[new]
    return grams, np.searchsorted(doc, np.arange(len(counts) + 1))


def _whole(words: np.ndarray) -> int:
    h = U64(0xA5A5A5A5A5A5A5A5 + len(words))
    with np.errstate(over="ignore"):
        for w in words:
            h = mix(np.array([h * U64(0x9FB21C651E98DF25) + w], U64))[0]
    return h


def fingerprints(sets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set that name it."""
    a = np.concatenate([np.zeros(1, U64), np.cumsum(mix(sets ^ U64(0x5851F42D4C957F2D)))])
    b = np.concatenate([np.zeros(1, U64), np.cumsum(mix(sets + U64(0x14057B7EF767814F)))])
    return (a[at[1:]] - a[at[:-1]]).view(np.int64), (b[at[1:]] - b[at[:-1]]).view(np.int64)


def _sets_and_counts(width: int) -> Callable:
    schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("bits", pa.binary()), ("short", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        total = np.zeros(1 << BUCKET_BITS, np.int32)
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(0), batch.column(1)):
                sets, at = shingle_sets(data, offsets, width)
                fp1, fp2 = fingerprints(sets, at)
                n = np.diff(at)
                # Copies within a slice are counted once.
                _, first = np.unique(np.stack([fp1, fp2]), axis=1, return_index=True)
                once = np.zeros(hi - lo, bool)
                once[first] = True
                total += np.bincount((sets[np.repeat(once, n)] >> U64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(total)).astype(np.int32)
                m = hi - lo
                bits = parities(sets, at)
                short = [folded(x, PARITY // 8).tobytes() for x in bits]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, -1, np.int32)), batch.column(0).slice(lo, m), pa.array(n), pa.array(fp1), pa.array(fp2), pa.array(bits, pa.binary()), pa.array(short, pa.binary()), pa.nulls(m, pa.binary())], schema=schema)
        kinds = [k for k in range(len(total) // CHUNK) if total[k * CHUNK : (k + 1) * CHUNK].any()]
        if kinds:
            m = len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), *[pa.nulls(m, pa.int64())] * 4, pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()), pa.array([zlib.compress(total[k * CHUNK : (k + 1) * CHUNK].tobytes(), 1) for k in kinds], pa.binary())], schema=schema)

    return released(run)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zlib

    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = np.frombuffer(zlib.decompress(raw), np.int32)
            total[k] = total[k] + own if k in total else own.astype(np.int64)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["kind", "counts"])


# ---------------------------------------------------------------- prefixes


def overlap_needed(n: np.ndarray, m: np.ndarray, threshold: int) -> np.ndarray:
    """The least intersection of sets of n and m for 100 * intersection >= threshold * union."""
    return -(-threshold * (n + m) // (100 + threshold))


def _postings(width: int, threshold: int, ordering: bytes) -> Callable:
    """An n-gram of a set's prefix (key) with the set's size and the place (pos). ordering: what packed_order gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        counts = np.frombuffer(zlib.decompress(ordering), np.int32)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in text_slices(batch.column(0), batch.column(1)):
                sets, at = shingle_sets(data, offsets, width)
                fp1, fp2 = fingerprints(sets, at)
                n = np.diff(at)
                # Of copies within a slice the smallest id stands for all.
                order = np.lexsort((ids[lo:hi], fp2, fp1))
                first = np.ones(len(order), bool)
                first[1:] = (fp1[order][1:] != fp1[order][:-1]) | (fp2[order][1:] != fp2[order][:-1])
                once = np.zeros(hi - lo, bool)
                once[order[first]] = True
                once &= n > 0
                doc = np.repeat(np.arange(hi - lo), n)
                use = once[doc]
                grams, doc = sets[use], doc[use]
                rank = np.lexsort((grams, counts[(grams >> U64(64 - BUCKET_BITS)).astype(np.int64)], doc))
                grams, doc = grams[rank], doc[rank]
                begin = np.concatenate([[0], np.cumsum(np.where(once, n, 0))])
                place = np.arange(len(grams)) - begin[doc]
                short = n - -(-threshold * n // 100) + 1
                inside = place < short[doc]
                d = doc[inside]
                yield pa.RecordBatch.from_arrays([pa.array(grams[inside].view(np.int64)), pa.array(n[d].astype(np.int32)), pa.array(place[inside].astype(np.int32)), pa.array(fp1[d]), pa.array(ids[lo + d])], ["key", "n", "pos", "fp", "doc_id"])

    return released(run)


def packed_order(counts: np.ndarray) -> bytes:
    """The order of the counts, equal ones alike, in as few bytes as go with the code to the tasks."""
    import zlib

    return zlib.compress(np.unique(counts, return_inverse=True)[1].astype(np.int32).tobytes(), 6)


def parities(sets: np.ndarray, at: np.ndarray) -> list[bytes]:
    """For each set the parities of its n-grams on PARITY bits, or on as many as it has n-grams (the next power of two):
    each bit in which two sets differ stands for at least one n-gram that only one of them has. Folding the
    halves of a row of bits onto each other gives the row of half the size."""
    spread = mix(sets * U64(0x2545F4914F6CDD1D)).view(np.int64)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        size = max(PARITY, 1 << max(0, b - a - 1).bit_length())
        odd = np.bincount(spread[a:b] & (size - 1), minlength=size) & 1
        out.append(np.packbits(odd.astype(np.uint8)).tobytes())
    return out


def folded(bits: bytes, size: int) -> np.ndarray:
    """A row of parities on so many bytes."""
    row = np.frombuffer(bits, np.uint8)
    while len(row) > size:
        row = row[: len(row) // 2] ^ row[len(row) // 2 :]
    return row


def _id_bits(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(U64)) >> U64(64 - ID_BITS)).astype(np.int64)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's ids as a bitmap of 2**ID_BITS bits, in parts."""
    import zlib

    seen = np.zeros(1 << ID_BITS, bool)
    for batch in batches:
        seen[_id_bits(batch.column(0).to_numpy())] = True
    parts = np.packbits(seen).reshape(16, -1)
    kinds = np.flatnonzero(parts.any(1))
    if len(kinds):
        yield pa.RecordBatch.from_arrays([pa.array(kinds.astype(np.int32)), pa.array([zlib.compress(parts[k].tobytes(), 1) for k in kinds], pa.binary())], ["kind", "bits"])


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zlib

    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = np.frombuffer(zlib.decompress(raw), np.uint8)
            total[k] = total[k] | own if k in total else own
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["kind", "bits"])


def _whole_sets(width: int, bitmap: bytes) -> Callable:
    """(doc_id, fp, grams) of the documents whose id is marked in the bitmap (compressed, for it goes with the code to the tasks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        marked = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8)).astype(bool)
        for batch in batches:
            batch = batch.filter(pa.array(marked[_id_bits(batch.column(0).to_numpy(zero_copy_only=False))]))
            for lo, hi, data, offsets in text_slices(batch.column(0), batch.column(1)):
                sets, at = shingle_sets(data, offsets, width)
                raw = [sets[at[i] : at[i + 1]].tobytes() for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(fingerprints(sets, at)[0]), pa.array(raw, pa.binary())], ["doc_id", "fp", "grams"])

    return released(run)


def _sets_of(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """The sets of the documents in pairs, from a bitmap of their ids (of fixed size) held against all documents:
    texts are not shuffled. What the bitmap lets pass by chance finds no partner in the exact joins that follow."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    import zlib

    parts = ids.mapInArrow(_marked, "kind int, bits binary").repartition(16, "kind").mapInArrow(_united, "kind int, bits binary").collect()
    marked = np.zeros((16, 1 << ID_BITS >> 7), np.uint8)
    for k, raw in parts:
        marked[k] |= np.frombuffer(raw, np.uint8)
    return texts.where("doc_id is not null").mapInArrow(_whole_sets(width, zlib.compress(marked.tobytes(), 1)), "doc_id long, fp long, grams binary")


# ---------------------------------------------------------------- lists


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Runs of equal `key` of a sorted stream, many whole runs at a time."""
    rest: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        rest = now if rest is None else pa.concat_tables([rest, now])
        if len(rest) < 50_000:
            continue
        key = rest.column("key").to_numpy()
        cutoff = int(np.searchsorted(key, key[-1]))
        if cutoff:
            part = rest.slice(0, cutoff).combine_chunks()
            yield {c: (part.column(c).to_numpy() if part.schema.field(c).type != pa.binary() else part.column(c).combine_chunks()) for c in names}
            rest = rest.slice(cutoff)
    if rest is not None and len(rest):
        part = rest.combine_chunks()
        yield {c: (part.column(c).to_numpy() if part.schema.field(c).type != pa.binary() else part.column(c).combine_chunks()) for c in names}


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a stream sorted by key, size, fp, id: the rows of n-grams that two different sets share, one for each set."""
    last: pa.RecordBatch | None = None
    told = False  # the row held back was told already
    for batch in batches:
        t = pa.Table.from_batches([x for x in (last, batch) if x is not None]).combine_chunks()
        key, n, fp = (t.column(c).to_numpy() for c in ("key", "n", "fp"))
        new_key = np.ones(len(t), bool)
        new_key[1:] = key[1:] != key[:-1]
        new_set = new_key.copy()
        new_set[1:] |= (n[1:] != n[:-1]) | (fp[1:] != fp[:-1])
        # Sets that repeat the row before them go; of the others those stay whose list has another set.
        keep_at = np.flatnonzero(new_set)
        k = key[keep_at]
        lone_before = np.ones(len(k), bool)
        lone_before[1:] = k[1:] != k[:-1]
        lone_after = np.ones(len(k), bool)
        lone_after[:-1] = k[:-1] != k[1:]
        good = ~(lone_before & lone_after)
        if told:
            good[0] = False
        # The last set is held back until its followers are known.
        hold = keep_at[-1]
        held_told = bool((told and len(k) == 1) or (not lone_before[-1]))
        if not held_told:
            good[-1] = False
        out = keep_at[good]
        if len(out):
            yield from t.take(pa.array(out)).to_batches()
        last = t.slice(hold, 1).combine_chunks().to_batches()[0]
        told = held_told


def _stars(threshold: int) -> Callable:
    """(leader, follower) of every list, with the leader's size and whether the list has these two alone: a leader takes the rows
    behind it that its size allows."""
    names = ["key", "n", "doc_id", "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead: tuple[int, int, int, int] | None = None
        held: pa.Table | None = None  # one or two rows that may be a whole list
        for batch in _and_none(batches):
            now = [x for x in (held, None if batch is None else pa.Table.from_batches([batch]).select(names)) if x is not None]
            if not now:
                continue
            rows = pa.concat_tables(now)
            key = rows.column("key").to_numpy()
            last = int(np.searchsorted(key, key[-1]))
            held = None
            if batch is not None and len(key) - last <= 2 and (lead is None or lead[0] != key[-1]):
                held = rows.slice(last)
                rows = rows.slice(0, last)
                key = key[:last]
            if not len(key):
                continue
            n, ids, fps = (rows.column(c).to_numpy() for c in ("n", "doc_id", "fp"))
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            count = np.diff(np.append(begin, len(key)))
            if lead is not None and lead[0] == key[0]:
                count[0] += 3  # goes on from rows before
            two = np.repeat(count == 2, np.diff(np.append(begin, len(key))))
            a, a_fp, a_n = (np.empty(len(key), np.int64) for _ in range(3))
            limit = n * threshold
            i = 0
            while i < len(key):
                if lead is None or lead[0] != key[i] or lead[1] * 100 < limit[i]:
                    lead = (int(key[i]), int(n[i]), int(ids[i]), int(fps[i]))
                end = int(np.searchsorted(key, lead[0], side="right"))
                stop = i + int(np.searchsorted(limit[i:end], lead[1] * 100, side="right"))
                a[i:stop], a_fp[i:stop], a_n[i:stop] = lead[2], lead[3], lead[1]
                i = stop
            pair = np.flatnonzero((a != ids) | (a_fp != fps))
            if len(pair):
                out = np.unique(np.stack([a[pair], a_fp[pair], ids[pair], fps[pair], a_n[pair], n[pair], two[pair]]), axis=1)
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in out[:6]), pa.array(out[6].astype(bool))], ["a", "a_fp", "b", "b_fp", "a_n", "n", "two"])

    return released(run)


def _and_none(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def most_apart(n, m, threshold: int):
    """The largest difference of linked sets of n and m (any array or column)."""
    return (n + m) * (100 - threshold) // (100 + threshold)


def most_apart_column(n: str, m: str, threshold: int):
    return F.floor((F.col(n) + F.col(m)) * F.lit(100 - threshold) / F.lit(100 + threshold)).cast("long")


def _across(threshold: int) -> Callable:
    """Pairs of groups of different components in a list that sizes, positions and the leaders' parities do not rule out, with
    the difference of the leaders up to which members may link."""
    names = ["key", "lo", "hi", "reach", "wide", "fp", "doc_id", "component", "short"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(batches, names):
            key = part["key"]
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            end = np.append(begin[1:], len(key))
            bits = np.frombuffer(b"".join(part["short"].to_pylist()), np.uint64).reshape(len(key), -1)
            found: list[np.ndarray] = []
            held = 0
            for s, e in zip(begin.tolist(), end.tolist(), strict=True):
                component = part["component"][s:e]
                if (component == component[0]).all():
                    continue
                lo, hi, reach, wide = (part[x][s:e].astype(np.int64) for x in ("lo", "hi", "reach", "wide"))
                for i0 in range(0, e - s, BLOCK):
                    i1 = min(e - s, i0 + BLOCK)
                    for j0 in range(i0, e - s, BLOCK):
                        j1 = min(e - s, j0 + BLOCK)
                        if hi[i0:i1].max() * 100 < lo[j0] * threshold:
                            break  # least sizes ascend: no later block can match
                        if min(reach[i0:i1].max(), reach[j0:j1].max()) < overlap_needed(lo[i0], lo[j0], threshold):
                            continue  # the block's positions leave too few n-grams
                        ok = component[i0:i1, None] != component[None, j0:j1]
                        ok &= (hi[i0:i1, None] * 100 >= lo[None, j0:j1] * threshold) & (hi[None, j0:j1] * 100 >= lo[i0:i1, None] * threshold)
                        ok &= np.minimum(reach[i0:i1, None], reach[None, j0:j1]) >= overlap_needed(lo[i0:i1, None], lo[None, j0:j1], threshold)
                        x, y = np.nonzero(ok)
                        late = x + i0 < y + j0
                        x, y = x[late] + i0, y[late] + j0
                        for q in range(0, len(x), 1 << 18):
                            u, v = x[q : q + (1 << 18)], y[q : q + (1 << 18)]
                            bound = most_apart(hi[u], hi[v], threshold) + wide[u] + wide[v]
                            near = _differ(bits[s + u], bits[s + v]) <= bound
                            if near.any():
                                u, v, bound = u[near] + s, v[near] + s, bound[near]
                                # One order of each pair, so that it is told once.
                                swap = part["doc_id"][u] > part["doc_id"][v]
                                u, v = np.where(swap, v, u), np.where(swap, u, v)
                                found.append(np.stack([part["doc_id"][u], part["fp"][u], part["doc_id"][v], part["fp"][v], bound]))
                                held += len(u)
                                if held > 200_000:
                                    yield _pairs(found)
                                    found, held = [], 0
            if found:
                yield _pairs(found)

    return released(run)


def _pairs(found: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(np.concatenate(found, 1), axis=1)], ["a", "a_fp", "b", "b_fp", "bound"])


def _differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(-1, dtype=np.int64)


def _verify(threshold: int) -> Callable:
    """Of a stream sorted by (a, a_fp, part), each leader's own row (b null) first: the pairs within their bound, with the
    exact difference of the sets and whether they link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: tuple[int, int, int] | None = None
        base = np.empty(0, np.uint64)
        for batch in batches:
            a, a_fp, part = (batch.column(c).to_numpy() for c in ("a", "a_fp", "part"))
            b, grams, bound = batch.column("b"), batch.column("grams"), batch.column("bound").to_numpy(zero_copy_only=False)
            at, apart, linked = [], [], []
            for i in range(len(batch)):
                other = np.frombuffer(grams[i].as_buffer(), np.uint64)
                now = (int(a[i]), int(a_fp[i]), int(part[i]))
                if not b[i].is_valid:
                    own, base = now, other
                    continue
                if own != now:
                    raise RuntimeError("a leader's set is missing")
                # Both sets are ascending: places of one in the other.
                small, large = (base, other) if len(base) <= len(other) else (other, base)
                place = np.searchsorted(large, small)
                both = int((large[np.minimum(place, len(large) - 1)] == small).sum()) if len(large) else 0
                d = len(base) + len(other) - 2 * both
                if d <= bound[i]:
                    at.append(i)
                    apart.append(d)
                    linked.append(100 * both >= threshold * (len(base) + len(other) - both))
            if at:
                kept = batch.select(["a", "a_fp", "b", "b_fp"]).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(apart, pa.int64()), pa.array(linked)], ["a", "a_fp", "b", "b_fp", "apart", "linked"])

    return released(run)


def _verified(pairs: DataFrame, texts: DataFrame, width: int, threshold: int, name: str) -> DataFrame:
    """(a, a_fp, b, b_fp, apart, linked) of the pairs (with bound) whose sets differ in at most bound n-grams. A follower's set moves
    once for each of its pairs; a leader's goes once to each task that has followers of it, of FOLLOWERS at most. Should
    sets hold a document twice (repeated rows), its pairs are looked at twice to the same end."""
    sets = _sets_of(pairs, texts, width)
    # How many tasks a leader's followers need, of those that need more than one.
    many = pairs.groupBy("a", "a_fp").agg(F.count(F.lit(1)).alias("k_")).where(F.col("k_") > FOLLOWERS).select("a", "a_fp", F.ceil(F.col("k_") / FOLLOWERS).cast("int").alias("parts_"))
    dealt = pairs.join(many, ["a", "a_fp"], "left").withColumn("part", F.coalesce(F.pmod(F.hash("b", "b_fp"), F.col("parts_")), F.lit(0))).drop("parts_")
    follower = dealt.select(F.col("b").alias("doc_id"), F.col("b_fp").alias("fp"), "a", "a_fp", "part", "b", "b_fp", "bound")
    leader = dealt.select("a", "a_fp", "part").distinct().select(F.col("a").alias("doc_id"), F.col("a_fp").alias("fp"), "a", "a_fp", "part", F.lit(None).cast("long").alias("b"), F.lit(None).cast("long").alias("b_fp"), F.lit(0).cast("long").alias("bound"))
    # Leaders and followers ask for their sets in one join, so that the sets move once and are not written.
    stream = follower.unionByName(leader).join(sets, ["doc_id", "fp"]).drop("doc_id", "fp")
    stream = stream.repartition("a", "a_fp", "part").sortWithinPartitions("a", "a_fp", "part", F.col("b").asc_nulls_first())
    return cut(stream.mapInArrow(_verify(threshold), PAIR + ", apart long, linked boolean"), name)


def _near_only(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """Pairs whose parities do not put them beyond their bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            apart = np.empty(len(batch), np.int64)
            for i, (x, y) in enumerate(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)):
                size = min(len(x), len(y))
                apart[i] = np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()
            yield batch.select(["a", "a_fp", "b", "b_fp", "bound"]).filter(pa.array(apart <= batch.column("bound").to_numpy(zero_copy_only=False)))

    one = pairs.join(bits.select(F.col("doc_id").alias("a"), F.col("fp").alias("a_fp"), F.col("bits").alias("x")), ["a", "a_fp"])
    two = one.join(bits.select(F.col("doc_id").alias("b"), F.col("fp").alias("b_fp"), F.col("bits").alias("y")), ["b", "b_fp"])
    return cut(two.mapInArrow(released(run), PAIR + ", bound long"), "jaccard-near")


# ---------------------------------------------------------------- the operator


def jaccard_components(docs: DataFrame, width: int = 3, threshold: int = 90, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    Two documents link when 100 * |A n B| >= threshold * |A u B| for their sets of `width`-word n-grams of
    ASCII-lower-cased words. component_id is the smallest doc_id reachable over links, the document's own
    included. Null and empty texts have the empty set (n_shingles 0) and link with nothing; a null id links
    with nothing and has a null component. Rows with equal ids are one document to the links: each gets the
    component of the id. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text_"))
    first = cut(texts.mapInArrow(_sets_and_counts(width), "kind int, doc_id long, n long, fp1 long, fp2 long, bits binary, short binary, counts binary"), "jaccard-sets")
    rows = first.where("kind = -1").select("doc_id", "n", "fp1", "fp2")
    parts = first.where("kind >= 0").select("kind", "counts").repartition(1 << BUCKET_BITS >> 16, "kind").mapInArrow(_summed, "kind int, counts binary").collect()  # 2**20 counts in all
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    for k, raw in parts:
        counts[k * CHUNK : (k + 1) * CHUNK] += np.frombuffer(raw, np.int64)

    lists = texts.where("doc_id is not null").mapInArrow(_postings(width, threshold, packed_order(counts)), "key long, n int, pos int, fp long, doc_id long")
    lists = lists.repartition("key").sortWithinPartitions("key", "n", "fp", "doc_id")
    shared = cut(lists.mapInArrow(released(_shared), "key long, n int, pos int, fp long, doc_id long"), "jaccard-lists")
    bits = first.where("kind = -1 and doc_id is not null").select("doc_id", F.col("fp1").alias("fp"), "bits", "short").dropDuplicates(["doc_id", "fp"])

    ordered = shared.repartition("key").sortWithinPartitions("key", "n", "fp", "doc_id")
    stars = ordered.mapInArrow(_stars(threshold), PAIR + ", a_n long, n long, two boolean")
    # Of the leaders in longer lists a set keeps the smallest and the largest; what these do not settle the second pass does.
    lead = F.when(~F.col("two"), F.struct("a_n", "a_fp", "a"))
    most = stars.groupBy("b", "b_fp").agg(F.array_compact(F.array_union(F.array(F.min(lead), F.max(lead)), F.collect_set(F.when(F.col("two"), F.struct("a_n", "a_fp", "a"))))).alias("leads"), F.first("n").alias("n"))
    kept = most.select("b", "b_fp", "n", F.explode("leads").alias("l"))
    kept = kept.select("l.a", "l.a_fp", "b", "b_fp", most_apart_column("l.a_n", "n", threshold).alias("bound"))
    links = _verified(_near_only(kept, bits), texts, width, threshold, "jaccard-links").where("linked")
    known = connected_components(links.select("a", "b"), "jaccard-components")

    # The answers so far: each linked set's nearest leader and their difference. Other sets lead themselves.
    own = links.groupBy("b", "b_fp").agg(F.min(F.struct("apart", "a", "a_fp")).alias("l")).select(F.col("b").alias("doc_id"), F.col("b_fp").alias("fp"), F.col("l.a").alias("leader"), F.col("l.a_fp").alias("leader_fp"), "l.apart")
    listed = shared.join(own, ["doc_id", "fp"], "left").select("key", "n", "pos", "doc_id", "fp", F.coalesce("leader", "doc_id").alias("leader"), F.coalesce("leader_fp", "fp").alias("leader_fp"), F.coalesce("apart", F.lit(0)).cast("long").alias("apart"))
    short = bits.select("doc_id", "fp", "short")

    def compared(groups: DataFrame, name: str) -> DataFrame:
        """The pairs of groups of different components whose leaders are within their bound."""
        sorted_ = groups.join(short, ["doc_id", "fp"]).repartition("key").sortWithinPartitions("key", "lo", "fp", "doc_id")
        across = sorted_.mapInArrow(_across(threshold), PAIR + ", bound long").groupBy("a", "a_fp", "b", "b_fp").agg(F.max("bound").alias("bound"))
        return _verified(_near_only(across, bits), texts, width, threshold, name)

    def with_component(rows: DataFrame, known: DataFrame) -> DataFrame:
        # By the set itself, for a leader may stand for any share of all rows; a set without links leads itself.
        return rows.join(known, rows["doc_id"] == known["node"], "left").withColumn("component", F.coalesce("component", "doc_id")).drop("node")

    # Lists whose sets are all of one component have nothing left to ask, nor have lists of two: those were leader and follower.
    listed_now = with_component(listed, known)
    mixed = listed_now.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("k")).where("lo <> hi and k > 2").select("key")
    listed_now = cut(listed_now.join(mixed, "key", "left_semi"), "jaccard-listed")
    groups = listed_now.groupBy("key", "leader", "leader_fp", "component").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("pos")).alias("reach"), F.max("apart").alias("wide"))
    met = compared(groups.withColumnsRenamed({"leader": "doc_id", "leader_fp": "fp"}), "jaccard-met")

    # Components so far stand for the links that made them: stars, which need fewer rounds than the links.
    def joined(known: DataFrame, links: DataFrame) -> DataFrame:
        return known.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links.select("a", "b"))

    # Groups that are open still: their members lead themselves. Mostly there are none.
    answers = met.agg(F.count_if("linked").alias("linked"), F.count_if(~F.col("linked")).alias("open")).first()
    if answers["linked"]:
        known = connected_components(joined(known, met.where("linked")), "jaccard-components")
    pairs = known.select(F.col("node").alias("a"), F.col("component").alias("b"))
    if answers["open"]:
        open_ = met.where("not linked")
        leaders = open_.select(F.col("a").alias("leader"), F.col("a_fp").alias("leader_fp")).union(open_.select("b", "b_fp")).distinct()
        sets = own.join(leaders, ["leader", "leader_fp"], "left_semi").select("doc_id", "fp").union(leaders).distinct()
        members = with_component(listed_now.drop("component").join(sets, ["doc_id", "fp"], "left_semi"), known)
        more = compared(members.select("key", F.col("n").alias("lo"), F.col("n").alias("hi"), (F.col("n") - F.col("pos")).alias("reach"), F.lit(0).cast("long").alias("wide"), "doc_id", "fp", "component"), "jaccard-members").where("linked")
        pairs = joined(known, more)

    # Equal sets: each row with the smallest id of its class.
    classes = rows.where("n > 0 and doc_id is not null")
    least = classes.groupBy("fp1", "fp2", "n").agg(F.min("doc_id").alias("least_"))
    same = classes.join(least, ["fp1", "fp2", "n"]).where("doc_id <> least_").select(F.col("doc_id").alias("a"), F.col("least_").alias("b"))
    final = connected_components(pairs.union(same), "jaccard-components")
    out = rows.join(final, rows["doc_id"] == final["node"], "left")
    return out.select(rows["doc_id"], F.col("n").alias("n_shingles"), F.coalesce("component", rows["doc_id"]).alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, threshold: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, but those whose component has a smaller id.

    Of rows with equal ids one stays: that of the first text (null before all), then of the first hash of the row. Rows with a
    null id stay, as do null and empty texts, which link with nothing. Texts of any length are taken whole. An empty table gives
    no rows. Other columns may have any names.
    """
    found = jaccard_components(docs, width, threshold, id_column, text_column).where("doc_id is not null")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone_")).distinct()
    twice = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k_")).where("k_ > 1").select(F.col("doc_id").alias("twice_"))
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row_"), F.col(id_column).cast("long").alias("id_"))
    kept = packed.where("id_ is not null").join(gone, F.col("id_") == F.col("gone_"), "left_anti")
    marked = kept.join(twice, F.col("id_") == F.col("twice_"), "left")
    first = F.min_by("row_", F.struct(F.col("row_")[text_column].cast("string"), F.xxhash64("row_")))
    again = marked.where("twice_ is not null").groupBy("id_").agg(first.alias("row_")).select("row_")
    out = marked.where("twice_ is null").select("row_").union(again).union(packed.where("id_ is null").select("row_"))
    return out.select(*[F.col("row_")[c].alias(c) for c in docs.columns])
