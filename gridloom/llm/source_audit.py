"""Source divergence audit with integer dictionaries: how the term shares of each (lang, source) differ from the other sources' and the lang's.

Terms are runs of letters A-Z (lower-cased) and of all characters beyond ASCII. Tasks count the terms of whole texts, coded as they
come; sums by (lang, source, term) follow in Spark. A lang keeps the terms that at least `least` of its documents hold. Kept terms
are sorted by their UTF-8 bytes over range partitions and numbered through, so that the order of ids is the order of bytes. A lang's ids
are dealt into chunks of CELLS // sources ids; a task holds a chunk's sorted term array, finds ids by searchsorted, makes dense count
vectors by bincount, a row a source, and from them the shares and divergences of the chunk. Sums over chunks and ranks follow in Spark.

All arithmetic is on whole numbers: p = 1 + floor(10^9 (count + 1) / (N + V)), f = floor((p - q)^2 / q), exact below 9 * 10^15 terms a
lang (steps of 1,000 in 64 bits), beyond which the job stops with an error instead of rounding.

Skew: a lang or a source may hold any share of the rows: rows are counted where they lie, sums start before the shuffle, and a lang is
worked on by chunks. Of a group at most `top` terms of a chunk leave it. The pairs of sources of a lang are the result itself.

Defined results: null text, lang or source are ''; texts of any length are counted whole; repeated rows count as often as they stand;
an empty table gives no rows; groups without terms count as groups; equal values rank by UTF-8 bytes; only text, lang and source are
read, so further columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import LOWER, cut, released, text_slices, word_bounds

SCALE = 1_000_000_000
#: Counts that a task's dense vectors hold at once: sources times ids of a chunk.
CELLS = 1 << 16
#: Bytes of text that are coded at once.
_SLICE = 4 << 20
_MOST = 9 * 10**15
_GAP = np.ones(256, bool)
_GAP[0x41:0x5B] = _GAP[0x61:0x7B] = _GAP[0x80:] = False


def _coded(lang: pa.Array, source: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, occurrences, documents) of a batch, by slices of whole texts."""
    pair = pa.StructArray.from_arrays([lang, source], ["lang", "source"])
    names = pa.array([f"{len(x['lang'])}:{x['lang']}{x['source']}" for x in pair.to_pylist()]).dictionary_encode()
    group_of, first = names.indices.to_numpy(zero_copy_only=False), {}
    for i, g in enumerate(group_of.tolist()):
        first.setdefault(g, i)
    for row, end, data, offsets in text_slices(lang, texts, _SLICE):
        starts, ends, per = word_bounds(data, offsets, _GAP)
        if not len(starts):
            continue
        letters = LOWER[data[~_GAP[data]]]
        bounds = np.concatenate([[0], np.cumsum(ends - starts)])
        spans = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(letters)])
        coded = spans.dictionary_encode()
        codes, terms = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        doc = np.repeat(np.arange(end - row), np.diff(per))
        n = len(terms)
        in_doc, times = np.unique(doc * n + codes, return_counts=True)
        key, place = np.unique(group_of[row:end].astype(np.int64)[in_doc // n] * n + in_doc % n, return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, place, times)
        held = np.bincount(place, minlength=len(key)).astype(np.int64)
        at = pa.array([first[g] for g in (key // n).tolist()], pa.int64())
        yield pa.RecordBatch.from_arrays([lang.take(at), source.take(at), terms.take(pa.array(key % n)).cast(pa.large_string()).cast(pa.string()), pa.array(total), pa.array(held)], names=["lang", "source", "term", "n", "docs"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from _coded(b.column("lang"), b.column("source"), b.column("text"))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold the term."""
    own = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    parts = own.mapInArrow(released(_count), "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with their partition and their place among the partition's rows of their lang."""
    part, seen = TaskContext.get().partitionId(), {}
    for b in batches:
        place = np.empty(b.num_rows, np.int64)
        lang = b.column("lang").dictionary_encode()
        code = lang.indices.to_numpy(zero_copy_only=False)
        for k, name in enumerate(lang.dictionary.to_pylist()):
            here = code == k
            count = int(here.sum())
            place[here] = np.arange(count) + seen.get(name, 0)
            seen[name] = seen.get(name, 0) + count
        yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("term"), pa.array(np.full(b.num_rows, part, np.int32)), pa.array(place)], names=["lang", "term", "part", "place"])


def dictionary(counts: DataFrame, least: int = 3) -> DataFrame:
    """(lang, term, id): the kept terms of a lang, ids from 0 in the order of UTF-8 bytes."""
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least).select("lang", "term")
    rows = cut(kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_numbered, "lang string, term string, part int, place long"), "terms")
    sizes = rows.groupBy("lang", "part").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(sizes.select("lang", "part", before.alias("before")), ["lang", "part"]).select("lang", "term", (F.col("before") + F.col("place")).alias("id"))


def shares(count: np.ndarray, n: np.ndarray, v: int) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / (n + v)), by long division in steps of 1,000."""
    below = n + v
    if below.size and int(below.max()) > _MOST:
        raise OverflowError("more terms of a lang than whole-number shares of 64 bits allow")
    rest, out = count + 1, np.zeros(count.shape, np.int64)
    for _ in range(3):
        rest = rest * 1000
        digit = rest // below
        rest -= digit * below
        out = out * 1000 + digit
    return out + 1


def _chunk(top: int):
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("id", pa.int64()), ("value", pa.int64())])

    def run(counts: pa.Table, groups: pa.Table) -> pa.Table:
        groups = groups.sort_by("source")
        names, n, v = groups.column("source").to_pylist(), groups.column("total").to_numpy(), int(groups.column("v")[0].as_py())
        lang, first_id = groups.column("lang")[0].as_py(), int(groups.column("chunk")[0].as_py()) * int(groups.column("width")[0].as_py())
        s = len(names)
        coded = counts.column("term").combine_chunks().dictionary_encode()
        found = np.array([x.encode() for x in coded.dictionary.to_pylist()], object)
        terms = np.sort(found)  # the sorted kept-term array: bytes in order
        width = len(terms)
        ids = np.searchsorted(terms, found)[coded.indices.to_numpy(zero_copy_only=False)] if width else np.empty(0, np.int64)
        row = pc.index_in(counts.column("source").combine_chunks(), pa.array(names)).to_numpy(zero_copy_only=False)
        dense = np.zeros(s * width, np.int64)
        # bincount adds in double precision; each cell has one count, so cells are placed by bincount and filled as whole numbers.
        cell = row.astype(np.int64) * width + ids
        filled = np.flatnonzero(np.bincount(cell, minlength=s * width))
        dense[filled] = counts.column("n").to_numpy()[np.argsort(cell, kind="stable")]
        dense = dense.reshape(s, width)
        p = shares(dense, n[:, None], v) if width else np.zeros((s, 0), np.int64)
        q = shares(dense.sum(0), np.array([n.sum()]), v) if width else np.zeros(0, np.int64)
        source, part, item, number, value = [], [], [], [], []
        for k in range(s):
            far = ((p[k] - p) ** 2 // p).sum(1)
            others = [j for j in range(s) if j != k]
            f = (p[k] - q) ** 2 // q
            above = np.flatnonzero((dense[k] > 0) & (p[k] > q))
            best = above[np.lexsort((above, -f[above]))[:top]]
            source += [names[k]] * (len(others) + len(best))
            part += ["pair"] * len(others) + ["term"] * len(best)
            item += [names[j] for j in others] + [terms[i].decode() for i in best]
            number += [-1] * len(others) + (best + first_id).tolist()
            value += far[others].tolist() + f[best].tolist()
        return pa.table([pa.array([lang] * len(source), pa.string()), source, part, item, pa.array(number, pa.int64()), pa.array(value, pa.int64())], schema=schema)

    return run


def audit(docs: DataFrame, least: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: divergences of each (lang, source) from the other sources of its lang
    (all of them), and its terms above the lang's share (the first `top`)."""
    counts = cut(term_counts(docs), "counts")
    ids = cut(dictionary(counts, least), "dictionary")
    present = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    kept = counts.join(ids, ["lang", "term"]).select("lang", "source", "term", "id", "n")
    kept = cut(kept, "kept")
    groups = present.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").fillna(0, ["total"])
    langs = present.groupBy("lang").agg(F.count("*").alias("s")).join(ids.groupBy("lang").agg(F.count("*").alias("v")), "lang", "left").fillna(0, ["v"])
    langs = cut(langs.withColumn("width", F.greatest(F.lit(1), F.floor(F.lit(CELLS) / F.col("s"))).cast("long")), "langs")
    # A lang without kept terms has one chunk, which says so for its pairs.
    last = F.greatest(F.lit(0), F.floor((F.col("v") - 1) / F.col("width"))).cast("long")
    of_chunk = groups.join(langs, "lang").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), last))).select("lang", "chunk", "source", "total", "v", "width")
    rows = kept.join(langs, "lang").select("lang", F.floor(F.col("id") / F.col("width")).cast("long").alias("chunk"), "source", "term", "n")
    told = rows.groupBy("lang", "chunk").cogroup(of_chunk.groupBy("lang", "chunk")).applyInArrow(_chunk(top), "lang string, source string, part string, item string, id long, value long")
    whole = told.groupBy("lang", "source", "part", "item", "id").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "id", "item")
    return whole.withColumn("rank", F.row_number().over(order)).where(f"part = 'pair' OR rank <= {int(top)}").select("lang", "source", "part", "item", "value", "rank")
