"""What the operators of this subpackage share: cutting lineage, Arrow text buffers, hashed words."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut  # noqa: F401  the operators take it from here


U64 = np.uint64
#: Whole documents are gathered up to this many bytes of text and then handled by numpy at once.
SLICE_BYTES = 1 << 20


# ---------------------------------------------------------------- Arrow text


def text_slices(ids: pa.Array, texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets into them) for runs of whole texts of about limit bytes; null is empty."""
    data, offsets = text_buffer(texts)
    n, row = len(texts), 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(n, max(end, row + 1))
        lo, hi = int(offsets[row]), int(offsets[end])
        yield row, end, data[lo:hi], (offsets[row : end + 1] - lo).astype(np.int64)
        row = end


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offs, data = texts.buffers()
    if len(texts) == 0 or offs is None:
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(offs, np.int64, len(texts) + 1 + texts.offset)[texts.offset :]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), offsets


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, offsets of each document's words) of the runs of bytes that are not gaps; runs end with their document."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~gap[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    inner = offsets[(offsets < n)]
    before[inner] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    inner = inner[inner > 0]
    after[inner - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets).astype(np.int64)


# ---------------------------------------------------------------- hashing

_RADIX = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_RADIX, -1, 1 << 64)
_BYTE = np.random.default_rng(20240521).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
#: Bytes that are hashed at once, and the powers kept for them.
_WINDOW = 1 << 17
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ...: kept for windows, made anew for the few longer spans."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, 2 * _WINDOW), U64(base), U64)
        step[0] = U64(1)
        have = np.multiply.accumulate(step)
        if len(have) == 2 * _WINDOW:
            _powers[base] = have
    return have[:n]


def release() -> None:
    """Give the memory that a task used back to the system; Python workers are used again for other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # other systems free by themselves


def released(run: Callable) -> Callable:
    """run over a task's batches, after which its memory goes back to the system."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers with well spread bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, from running sums over windows of the buffer. Spans ascend and do not overlap."""
    out = np.empty(len(starts), U64)
    at = 0
    while at < len(starts):
        lo = int(starts[at])
        stop = max(at + 1, int(np.searchsorted(ends, lo + _WINDOW, side="right")))
        hi = int(ends[stop - 1])
        run = np.empty(hi - lo + 1, U64)
        run[0] = 0
        np.cumsum(_BYTE[data[lo:hi]] * _power(_RADIX, hi - lo), out=run[1:])
        first, last = starts[at:stop] - lo, ends[at:stop] - lo
        h = (run[last] - run[first]) * _power(_INVERSE, hi - lo + 1)[first]
        out[at:stop] = mix(h + (last - first).astype(U64) * U64(0xD6E8FEB86659FD93))
        at = stop
    return out


def chained(hashes: np.ndarray, word_offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of width words in a row within each document, and each document's offsets into them."""
    n = len(hashes)
    counts = np.diff(word_offsets)
    if n < width:
        return np.empty(0, U64), np.zeros(len(word_offsets), np.int64)
    h = hashes[: n - width + 1].copy()
    for k in range(1, width):
        h = mix(h * U64(0x9FB21C651E98DF25) + hashes[k : n - width + 1 + k])
    doc = np.repeat(np.arange(len(counts)), counts)
    ok = doc[: n - width + 1] == doc[width - 1 :]
    per = np.maximum(counts - width + 1, 0)
    return h[ok], np.concatenate([[0], np.cumsum(per)]).astype(np.int64)


def held_out_mod(modulus: int, column: str = "doc_id"):
    """crc32 of the id as text, modulo modulus."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def rank_within(df: DataFrame, key: str, order: list[str], rows_per_group: int = 100_000, group: str | None = None) -> DataFrame:
    """df with rank_: 0-based place of each row among those of its key, by md5 of the order columns and then them; with
    `group`, a column that deals all rows to groups of bounded size, by that and then the order columns.

    A key may hold any share of the rows: each key is dealt to as many groups as its largest key needs, ranked
    inside its group, and moved on by the sum of the groups before it. Only counts by (key, group) are
    summed, never the rows of a key in one task."""
    if group is not None:
        return _ranked(df.withColumn("tag_", F.lit("")).withColumn("group_", F.col(group)), key, order)
    tag = F.md5(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in order]))
    top = df.groupBy(key).count().agg(F.max("count")).first()[0] or 1
    groups = max(256, -(-top // rows_per_group))
    tagged = df.withColumn("tag_", tag).withColumn("group_", F.floor(F.conv(F.substring("tag_", 1, 8), 16, 10).cast("double") * F.lit(groups / 2.0**32)).cast("int"))
    return _ranked(tagged, key, order)


def _ranked(tagged: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rank_ by group_, tag_ and the order columns."""
    from pyspark.sql import Window

    sizes = tagged.groupBy(key, "group_").agg(F.count(F.lit(1)).alias("size_"))
    # Sums over at most `groups` rows a key.
    before = sizes.withColumn("before_", F.sum("size_").over(Window.partitionBy(key).orderBy("group_").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select(F.col(key).alias("key_"), F.col("group_").alias("g_"), F.coalesce("before_", F.lit(0)).alias("before_"))
    inner = tagged.withColumn("within_", F.row_number().over(Window.partitionBy(key, "group_").orderBy("tag_", *order)) - 1)
    out = inner.join(before, inner[key].eqNullSafe(before["key_"]) & (inner["group_"] == before["g_"]))
    return out.withColumn("rank_", F.col("within_") + F.col("before_")).drop("tag_", "group_", "within_", "before_", "key_", "g_")
