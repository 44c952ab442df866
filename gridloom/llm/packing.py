"""Best-fit packing of tokenised documents into sequences of bounded length.

A configuration is a multiset of piece lengths that fit one sequence. The configuration linear program
asks for the fewest sequences whose configurations cover the length histogram. It is solved approximately
by multiplicative weights: every length class has a price that falls as it is covered, a knapsack dynamic
program, bounded by what is left of each class, finds the configuration of the highest price, and that configuration is used a little. The
solution is rounded to whole sequences of real lengths, the program is solved again for what rounding left, and the last tenth of the
pieces at most goes best-fit-decreasing into the room that is left and into new sequences. All this works on runs (length, count), whose number is bounded by
the capacity and not by the corpus. Each piece then gets its place from its rank within its length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, rank_within, released, text_slices
from .wordpiece import word_pieces

#: Classes of lengths by their share of the tokens, the ratio of sizes within one, rounds of multiplicative weights, and how fast a price falls.
CLASSES, WIDTH, ROUNDS, EAGER = 128, 1.05, 600, 3.0
#: How often the program is solved for what rounding left, the share of the pieces at which that ends, and of the room that a sequence may keep.
PASSES, LEFT_OVER, LOOSE = 3, 0.1, 1 / 128
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


# ---------------------------------------------------------------- tokens


def _pieces(path: str, capacity: int, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_pieces(path)
        for batch in batches:
            doc_ids = batch.column(0)
            for lo, hi, data, offsets in text_slices(doc_ids, batch.column(1)):
                ids, at = tokens.documents(data, offsets)
                rows: list[tuple] = []
                for i in range(hi - lo):
                    own = np.append(ids[at[i] : at[i + 1]], np.uint32(end_id)).astype("<u4")
                    rows += [(lo + i, k, s, min(capacity, len(own) - s), zlib.crc32(own[s : s + capacity])) for k, s in enumerate(range(0, len(own), capacity))]
                row, piece, start, length, crc = zip(*rows, strict=True)
                further = [c for c in batch.schema.names if c not in ("doc_id", "text_")]
                yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), *(batch.column(c).take(pa.array(row)) for c in further)], ["doc_id", "piece", "start", "length", "ids_crc32", *further])

    return released(run)


# ---------------------------------------------------------------- the linear program


def _classes(sizes: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The class of each length: neighbouring lengths, of at most 1/most of all tokens and sizes within WIDTH of each other."""
    share = np.cumsum(sizes * counts) / (sizes * counts).sum()
    bucket = np.minimum((share * most * 0.999999).astype(int), most - 1)
    scale = np.floor(np.log(sizes) / np.log(WIDTH)).astype(int)
    return np.concatenate([[0], np.cumsum((np.diff(bucket) != 0) | (np.diff(scale) != 0))])


def best_configuration(prices: np.ndarray, sizes: np.ndarray, capacity: int, most: np.ndarray | None = None) -> np.ndarray:
    """How many of each size fit the capacity at the highest total price, at most most of each: a bounded knapsack.

    The bound of a size is split into 1, 2, 4, ... pieces and a rest, each taken or not, so that a size costs as many steps over the table of
    best values as its bound has bits."""
    items: list[tuple[int, int]] = []
    for k, size in enumerate(sizes.tolist()):
        left, chunk = capacity // size if most is None else min(capacity // size, int(most[k])), 1
        while left > 0:
            items.append((k, min(chunk, left)))
            left -= chunk
            chunk *= 2
    best = np.zeros(capacity + 1)
    taken = np.zeros((len(items), capacity + 1), bool)
    for j, (k, times) in enumerate(items):
        size = int(sizes[k]) * times
        value = best[: capacity + 1 - size] + prices[k] * times
        better = value > best[size:]
        taken[j, size:] = better
        best[size:] = np.where(better, value, best[size:])
    out, c = np.zeros(len(sizes), np.int64), int(best.argmax())
    for j in range(len(items) - 1, -1, -1):
        if taken[j, c]:
            k, times = items[j]
            out[k] += times
            c -= int(sizes[k]) * times
    return out


def solve_configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[np.ndarray, float]]:
    """Configurations over the classes with their number of sequences: covering by multiplicative weights.

    sizes ascend. A class's price is its size, times a weight that falls exponentially as the class is covered. Each
    round buys the configuration of the highest price, as often as covers a share len(sizes) / rounds of the demand of its
    scarcest class, once at least. A configuration holds no more of a class than its demand that is not covered yet, so no class is covered
    beyond its demand; a class of less than a piece left is done."""
    left = counts.astype(float)
    bought: dict[bytes, list] = {}
    step = min(0.5, len(sizes) / max(1, rounds))
    while (left >= 1).any():
        covered = 1 - left / counts
        open_ = left >= 1
        weights = np.exp(-EAGER * (covered - covered[open_].min())) * sizes
        n = best_configuration(weights, sizes, capacity, np.floor(left))
        used = n > 0
        amount = max(1.0, step * float((counts[used] / n[used]).min()))
        amount = min(amount, float((left[used] / n[used]).min()))
        left[used] -= amount * n[used]
        bought.setdefault(n.tobytes(), [n, 0.0])[1] += amount
    return [(n, amount) for n, amount in bought.values()]


def plan_packing(histogram: dict[int, int], capacity: int, most_classes: int = CLASSES, rounds: int = ROUNDS) -> list[tuple[list[tuple[int, int]], int]]:
    """[([(length, how many), ...], number of such sequences)] that hold exactly the pieces of the histogram."""
    lengths = np.array(sorted(k for k, v in histogram.items() if v > 0), np.int64)
    if not len(lengths):
        return []
    left = np.array([histogram[int(k)] for k in lengths], np.int64)
    plan: list[tuple[tuple[tuple[int, int], ...], int]] = []
    full = lengths == capacity
    if full.any():
        plan.append((((capacity, 1),), int(left[full][0])))
        left[full] = 0
    rooms = Rooms(capacity)
    whole, loose = int(left.sum()), None
    # What rounding leaves is a smaller histogram, for which the program is solved anew.
    for _ in range(PASSES if rounds else 0):
        rest = np.flatnonzero(left > 0)
        if left.sum() <= LEFT_OVER * whole:
            break
        made = [(capacity - sum(a * b for a, b in contents.items()), contents, number) for contents, number in _rounded(lengths, left, rest, capacity, most_classes, rounds)]
        if loose is None:
            # Sequences with more room than usual, and more than a share LOOSE, are given up for the next pass or for best fit.
            loose = max(LOOSE * capacity, sum(r * n for r, _, n in made) / max(1, sum(n for _, _, n in made)))
        for room, contents, number in made:
            if room <= loose:
                rooms.put(room, contents, number)
                continue
            for length, times in contents.items():
                left[int(np.searchsorted(lengths, length))] += times * number
    for i in np.flatnonzero(left)[::-1]:
        rooms.place(int(lengths[i]), int(left[i]))
    merged: dict[tuple, int] = {}
    for contents, number in plan + rooms.contents():
        merged[contents] = merged.get(contents, 0) + number
    return [(list(c), n) for c, n in sorted(merged.items(), reverse=True)]


def _rounded(lengths: np.ndarray, left: np.ndarray, rest: np.ndarray, capacity: int, most_classes: int, rounds: int) -> Iterator[tuple[dict[int, int], int]]:
    """(contents, number of sequences) of a solution for the lengths at the places `rest`; what is used is taken from left.

    Fractions are carried on from one configuration to the next like it, so that as many sequences are used as the solution
    has. Each class gives its longest pieces first. Classes count as their longest piece, which leaves room: the last piece
    of a configuration's smallest class gives way to the longest piece that fits."""
    cls = _classes(lengths[rest], left[rest], most_classes)
    members = [rest[cls == k] for k in range(cls.max() + 1)]
    sizes = np.array([lengths[m].max() for m in members])
    counts = np.array([left[m].sum() for m in members], float)
    top = [len(m) - 1 for m in members]

    def take(k: int, n: int) -> list[tuple[int, int]]:
        """n pieces of class k as runs."""
        out = []
        while n:
            while left[members[k][top[k]]] == 0:
                top[k] -= 1
            i = members[k][top[k]]
            got = min(n, int(left[i]))
            left[i] -= got
            n -= got
            out.append((int(lengths[i]), got))
        return out

    carried = 0.0
    for n, amount in sorted(solve_configurations(sizes, counts, capacity, rounds), key=lambda x: tuple(x[0][::-1]), reverse=True):
        used = np.flatnonzero(n)
        carried += amount
        times = min(int(carried + 1e-9), *(int(left[members[k]].sum()) // int(n[k]) for k in used))
        if times <= 0:
            continue
        carried -= times
        columns = [take(k, times) for k in used for _ in range(int(n[k]) - (k == used[0]))]
        marks = sorted({0, times} | {m for c in columns for m in np.cumsum([x for _, x in c]).tolist()})
        ends = [(np.cumsum([x for _, x in c]), [length for length, _ in c]) for c in columns]
        for lo, hi in zip(marks, marks[1:], strict=False):
            contents: dict[int, int] = {}
            for run, own in ends:
                length = own[int(np.searchsorted(run, lo, side="right"))]
                contents[length] = contents.get(length, 0) + 1
            room, number = capacity - sum(a * b for a, b in contents.items()), hi - lo
            while number:
                i = int(np.searchsorted(lengths, room, side="right")) - 1
                while i >= 0 and not left[i]:
                    i -= 1
                got = min(number, int(left[i])) if i >= 0 else number
                if i >= 0:
                    left[i] -= got
                    yield contents | {int(lengths[i]): contents.get(int(lengths[i]), 0) + 1}, got
                else:
                    yield contents, got
                number -= got


class Rooms:
    """Sequences by the room that they have left; a run of equal contents is one entry."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_room: dict[int, list[tuple[dict[int, int], int]]] = {}
        self.keys: list[int] = []

    def put(self, room: int, contents: dict[int, int], number: int) -> None:
        if room not in self.by_room:
            self.by_room[room] = []
            bisect.insort(self.keys, room)
        self.by_room[room].append((contents, number))

    def place(self, length: int, n: int) -> None:
        """n pieces of a length, each where it leaves the least room; in new sequences where none has the room."""
        while n:
            at = bisect.bisect_left(self.keys, length)
            if at == len(self.keys):
                fit = min(n, self.capacity // length)
                number = n // fit
                self.put(self.capacity - fit * length, {length: fit}, number)
                n -= number * fit
                continue
            room = self.keys[at]
            contents, number = self.by_room[room].pop()
            if not self.by_room[room]:
                del self.by_room[room]
                self.keys.pop(at)
            fit = min(room // length, n)
            times = min(number, n // fit)
            if times < number:
                self.put(room, contents, number - times)
            self.put(room - fit * length, contents | {length: contents.get(length, 0) + fit}, times)
            n -= times * fit

    def contents(self) -> list[tuple[tuple[tuple[int, int], ...], int]]:
        return [(tuple(sorted(contents.items(), reverse=True)), number) for same in self.by_room.values() for contents, number in same]


def place_table(plan: list[tuple[list[tuple[int, int]], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length the runs of ranks (first rank, first sequence, how many in a sequence, offset of the first)."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for contents, number in plan:
        offset = 0
        for length, n in contents:
            rows.setdefault(length, []).append((ranks.get(length, 0), sequence, n, offset))
            ranks[length] = ranks.get(length, 0) + n * number
            offset += n * length
        sequence += number
    return {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in rows.items()}


def _placed(table: dict[int, tuple[np.ndarray, ...]]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank_").to_numpy(zero_copy_only=False)
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for k in np.unique(length):
                at = np.flatnonzero(length == k)
                first, seq, n, off = table[int(k)]
                j = np.searchsorted(first, rank[at], side="right") - 1
                within = rank[at] - first[j]
                sequence[at] = seq[j] + within // n[j]
                offset[at] = off[j] + within % n[j] * k
            cols = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return released(run)


def has_places(docs: DataFrame) -> bool:
    """Whether the rows come straight from files that number them, so that their order is known."""
    try:
        docs.select("_metadata.file_name", "_metadata.row_index")
    except AnalysisException:
        return False
    return True


def pack(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = 4096, end_id: int = 1, in_order: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of the end id alone. Rows are packed one by one: rows with equal ids
    or equal texts are separate documents, a null id stays null. An empty table gives no rows. Other
    columns are not read. Only documents longer than the capacity are cut. Pieces of one length are dealt to the sequences that take
    such in the order of the ids' md5; if in_order, in the order of docs' rows, which come straight from files: by the names
    of the files, then by the rows in them.
    """
    wanted = [F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text_")]
    place = [F.col("_metadata.file_name").alias("file_"), F.col("_metadata.row_index").alias("row_")] if in_order else []
    pieces = cut(docs.select(*wanted, *place).mapInArrow(_pieces(tokenizer_path, capacity, end_id), PIECES + ", file_ string, row_ long" * in_order), "pieces")
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    table = place_table(plan_packing(histogram, capacity))
    ranked = rank_within(pieces, "length", ["row_", "piece"], group="file_") if in_order else rank_within(pieces, "length", ["doc_id", "piece", "start", "ids_crc32"])
    return ranked.mapInArrow(_placed(table), PIECES + ", sequence_id long, offset long")
