"""Mixing sources to target weights by Pfair scheduling.

Every source's documents are cut into blocks. With weight w (a whole number of W, the sum over the sources that
still have blocks), block k of a source may start no earlier than slot floor(k*W/w) and must be done by
slot ceil((k+1)*W/w). Earliest-deadline-first over these windows gives every slot to one block; then after
every slot each source has the share of its whole weight to within less than one block. The windows repeat every W
slots, so one period is scheduled, whatever the number of blocks. When a source is used up the other
sources go on with their weights, from a new period. So all documents are kept, each once, and the
order is the mix.
"""

from __future__ import annotations

import heapq
from fractions import Fraction
from math import gcd, lcm

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import rank_within

#: Weights that are whole numbers of at most this sum, up to a common factor, are exact. Others are rounded to whole
#: numbers of this sum. A period has as many slots.
RESOLUTION = 10_000


def exact_weights(weights: dict[str | None, float], most: int = RESOLUTION) -> dict[str | None, int] | None:
    """The least whole numbers in the ratio of the weights, if their sum is at most `most`. A float is the simplest fraction that reads as it."""
    found = {k: next((y for y in (x.limit_denominator(most), x) if float(y) == float(w)), x) for k, w in weights.items() for x in [Fraction(w)]}
    scale = lcm(*(x.denominator for x in found.values()))
    whole = {k: int(x * scale) for k, x in found.items()}
    common = gcd(*whole.values())
    whole = {k: x // common for k, x in whole.items()}
    return whole if sum(whole.values()) <= most else None


def whole_weights(weights: dict[str | None, float], resolution: int = RESOLUTION) -> dict[str | None, int]:
    """Weights as whole numbers: exact if they have such of a sum of at most resolution, else of sum resolution (largest
    remainders), each at least 1. Shares of rounded weights are off by up to 1/resolution, and by more where a weight is raised to 1."""
    if any(not w > 0 or w == float("inf") for w in weights.values()):
        raise ValueError("weights must be positive and finite")
    exactly = exact_weights(weights, resolution)
    if exactly:
        return exactly
    total = sum(Fraction(w) for w in weights.values())
    exact = {k: Fraction(w) * resolution / total for k, w in weights.items()}
    out = {k: max(1, int(x)) for k, x in exact.items()}
    short = resolution - sum(out.values())
    for k in sorted(exact, key=lambda k: (int(exact[k]) - exact[k], _name(k)))[: max(0, short)]:
        out[k] += 1
    return out


def _name(source: str | None) -> tuple[bool, str]:
    return (source is not None, source or "")


def period(weights: dict[str | None, int]) -> list[str | None]:
    """The source of every slot of one period: earliest deadline first among the released blocks; ties go by name."""
    total = sum(weights.values())
    done = dict.fromkeys(weights, 0)
    coming = [(0, _name(k), k) for k in weights]
    heapq.heapify(coming)
    ready: list[tuple[int, tuple[bool, str], str | None]] = []
    slots: list[str | None] = []
    for slot in range(total):
        while coming and coming[0][0] <= slot:
            _, name, k = heapq.heappop(coming)
            heapq.heappush(ready, (-(-(done[k] + 1) * total // weights[k]), name, k))
        deadline, name, k = heapq.heappop(ready)
        if deadline < slot + 1:
            raise AssertionError("a deadline was missed")
        slots.append(k)
        done[k] += 1
        if done[k] < weights[k]:
            heapq.heappush(coming, (done[k] * total // weights[k], name, k))
    return slots


def phases(blocks: dict[str | None, int], weights: dict[str | None, int]) -> list[tuple]:
    """(source, first block, end block, first slot, slots in a period, places in the period) of every source and
    phase. A phase ends with the last block of the source that is used up first."""
    left = {k: n for k, n in blocks.items() if n > 0}
    used = dict.fromkeys(left, 0)
    out, start = [], 0
    while left:
        own = {k: weights[k] for k in left}
        slots = period(own)
        total = len(slots)
        places: dict[str | None, list[int]] = {k: [] for k in own}
        for i, k in enumerate(slots):
            places[k].append(i)
        # The slot in which each source's last block would run.
        last = {k: (n - 1) // own[k] * total + places[k][(n - 1) % own[k]] for k, n in left.items()}
        end = min(last.values())
        for k in list(left):
            whole, part = divmod(end + 1, total)
            import bisect

            n = whole * own[k] + bisect.bisect_left(places[k], part)
            if n:
                out.append((k, used[k], used[k] + n, start, total, places[k]))
            used[k] += n
            left[k] -= n
            if not left[k]:
                del left[k]
        start += end + 1
    return out


RESULTS = ("block_", "slot_", "place_")


def _slotted(docs: DataFrame, weights: dict[str | None, float] | None, block_rows: int, source_column: str, id_column: str) -> DataFrame:
    """(row_, id_, block_, slot_, place_): every row of docs as one struct, so that no name of its columns matters."""
    spark = docs.sparkSession
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row_"), F.col(source_column).cast("string").alias("source_"), F.col(id_column).alias("id_"))
    counts = {r[0]: r[1] for r in packed.groupBy("source_").count().collect()}
    given = {k: (weights or {}).get(k, 1.0) for k in counts}
    plan = phases({k: -(-n // block_rows) for k, n in counts.items()}, whole_weights(given, max(RESOLUTION, len(given)))) if counts else []
    schedule = spark.createDataFrame([(i, *row) for i, row in enumerate(plan)], "part_ int, named_ string, from_ long, to_ long, slot0_ long, period_ long, places_ array<long>")
    ranges = schedule.groupBy("named_").agg(F.array_sort(F.collect_list(F.struct("from_", "slot0_", "period_", "places_"))).alias("parts_"))
    ranked = rank_within(packed, "source_", ["id_"]).withColumn("block_", F.floor(F.col("rank_") / block_rows)).withColumn("place_", F.col("rank_") % block_rows)
    joined = ranked.join(F.broadcast(ranges), F.col("source_").eqNullSafe(F.col("named_")))
    # The last part that begins no later than the block.
    joined = joined.withColumn("part_", F.element_at(F.filter("parts_", lambda p: p["from_"] <= F.col("block_")), -1))
    k = F.col("block_") - F.col("part_.from_")
    n = F.size("part_.places_")
    slot = F.col("part_.slot0_") + F.floor(k / n) * F.col("part_.period_") + F.element_at("part_.places_", (k % n + 1).cast("int"))
    return joined.select("row_", "id_", "block_", slot.alias("slot_"), "place_")


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int = 64, source_column: str = "source", id_column: str = "doc_id") -> DataFrame:
    """docs with block_ (of its source), slot_ (of the whole mix) and place_ (in its block), all from 0.

    weights: a positive number for each source; sources that it doesn't name, or all if it is None, have weight
    1. A null source is a source of its own. Inside a source rows go by md5 of the id, then the id; rows with
    equal ids stay apart, a null id counts as an id. A source's last block may be short. An empty table gives no rows.
    Rows are never dropped or repeated, texts of any length or null are not looked at. Other columns of docs may have any
    names; its own block_, slot_ or place_ give way to the results. Only row counts by source come to the driver: the sources,
    and with them the phases, are taken to be few (a row each of the schedule is broadcast, places of at most
    RESOLUTION slots a phase).
    """
    slotted = _slotted(docs, weights, block_rows, source_column, id_column)
    return slotted.select(*[F.col("row_")[c].alias(c) for c in docs.columns if c not in RESULTS], *RESULTS)


def mixed_order(docs: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int = 64, source_column: str = "source", id_column: str = "doc_id") -> DataFrame:
    """docs with their own columns, whatever their names, in the order of the mix: range partitions of slots, each sorted. Nulls,
    ties, repeated rows and empty tables are as for mix: every row comes once."""
    slotted = _slotted(docs, weights, block_rows, source_column, id_column)
    tag = F.md5(F.concat_ws("\u0001", F.coalesce(F.col("id_").cast("string"), F.lit("\u0000"))))
    ordered = slotted.repartitionByRange("slot_", "place_").sortWithinPartitions("slot_", "place_", tag)
    return ordered.select(*[F.col("row_")[c].alias(c) for c in docs.columns])
