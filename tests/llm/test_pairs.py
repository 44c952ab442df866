"""Joins and near-duplicates against brute force."""

import pathlib
import random
import uuid

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from gridloom import storage
from gridloom.llm import components, jaccard_join
from gridloom.llm.components import connected_components
from gridloom.llm.embedding_dedup import near_duplicate_vectors
from gridloom.llm.jaccard_join import jaccard_components, keep_one

from . import brute

DOCS = "doc_id long, text string, lang string, fp long, bits string, n long, component string"


def _texts() -> list[tuple[int, str | None]]:
    r = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows: list[tuple[int, str | None]] = [(900, None), (901, ""), (902, " \t\n"), (903, "One"), (904, "one"), (905, "two words"), (906, "Two\x0bWORDS"), (907, "É école x"), (908, "é école x")]
    base = [r.choice(words) for _ in range(120)]
    for k in range(40):  # edits of one text, near and less near
        t = list(base)
        for _ in range(k % 9):
            t[r.randrange(len(t))] = r.choice(words)
        rows.append((k, " ".join(t)))
    passage = " ".join(r.choice(words) for _ in range(60))
    for k in range(40, 70):  # a passage that unlike texts share
        rows.append((k, passage + " " + " ".join(r.choice(words) for _ in range(r.choice([3, 10, 80])))))
    for k in range(70, 110):
        rows.append((k, " ".join(r.choice(words) for _ in range(r.randrange(1, 60)))))
    for k in range(110, 140):
        rows.append((k, rows[r.randrange(len(rows))][1]))
    rows.append((141, " ".join(r.choice(words) for _ in range(20000))))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("width", "threshold"), [(3, 90), (5, 80)])
def test_jaccard_equals_brute_force(spark, width, threshold):
    rows = _texts()
    # Other columns clash with the operator's own names.
    docs = spark.createDataFrame([(i, t, "en", 1, "x", 2, "c") for i, t in rows], DOCS).repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, width, threshold).collect()}
    assert got == brute.jaccard(rows, width, threshold)


def test_jaccard_edges(spark):
    one = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (9, "a b c d")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(one).collect()), key=str)
    assert got == [(5, 2, 5), (5, 2, 5), (9, 2, 5), (None, 2, None)]
    assert jaccard_components(one.limit(0)).collect() == []
    kept = keep_one(one.withColumn("extra", F.lit(1)), 3, 90)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [5, None]
    assert kept.columns == ["doc_id", "text", "extra"]
    # Equal ids with different texts, names that clash with the operator's own, nulls and empty texts.
    odd = spark.createDataFrame([(5, "b x y z", 1, 1), (5, "a x y z", 2, 1), (6, None, 3, 1), (7, "", 4, 1), (8, "", 5, 1), (None, "b x y z", 6, 1), (9, "B X Y Z", 7, 1), (10, "c d e f", 8, 1)], "doc_id long, text string, gone_ int, row_ int")
    kept = keep_one(odd, 3, 90)
    assert kept.columns == odd.columns
    assert sorted(((r.doc_id, r.text, r.gone_) for r in kept.collect()), key=str) == sorted([(5, "a x y z", 2), (6, None, 3), (7, "", 4), (8, "", 5), (None, "b x y z", 6), (10, "c d e f", 8)], key=str)
    assert keep_one(odd.limit(0), 3, 90).collect() == []


def test_components_are_found_again_only_where_needed(spark, monkeypatch):
    """Without groups left open the links' components are found once, and once more with the equal sets; codes of tasks stay small."""
    rows = [(i, " ".join(f"t{i // 3}w{k}" for k in range(40)) + f" end{i % 3}") for i in range(60)] + [(100, "t0w1 " * 5)]
    calls = []

    def counted(edges, *rest):
        calls.append(edges.columns)
        return connected_components(edges, *rest)

    monkeypatch.setattr(jaccard_join, "connected_components", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_components(df, 3, 90).collect()}
    assert got == brute.jaccard(rows, 3, 90)
    assert len(calls) == 2
    assert len(cloudpickle.dumps(jaccard_join._postings(3, 90, jaccard_join.packed_order(np.arange(1 << 20) % 97)))) < 4 << 20


def test_vectors_equal_brute_force(spark):
    r = np.random.default_rng(3)
    ids, vectors = [], []
    for g in range(60):
        centre = r.normal(size=16)
        for _ in range(int(r.integers(1, 6))):
            ids.append(len(ids))
            vectors.append((centre + r.normal(size=16) * r.choice([0.0, 0.05, 0.12, 0.3])).astype(np.float32).tolist())
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0], [-1.0, -2.0], [1e-30, 2e-30]]
    for v in odd:
        ids.append(len(ids))
        vectors.append(v)
    df = spark.createDataFrame(list(zip(ids, vectors, strict=True)), "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).withColumn("cell", F.lit("x")).repartition(4)
    got = {x.vec_id: (x.n_links, x.component_id) for x in near_duplicate_vectors(df).collect()}
    want = brute.near_vectors(ids, vectors, 0.95)
    assert got == want
    assert near_duplicate_vectors(df.limit(0)).collect() == []
    again = near_duplicate_vectors(df.where("vec_id < 3").union(df.where("vec_id < 3").withColumn("vec_id", F.lit(None).cast("long"))))
    assert [x.kept for x in again.where("vec_id is null").collect()] == [True] * 3


def test_vectors_move_once_however_many_meet(spark):
    """20,000 vectors without order, 64 of them near or equal to others: the boxes prune nothing, and still less than 3 times the vectors is shuffled."""
    r = np.random.default_rng(5)
    v = r.normal(size=(20_000, 64)).astype(np.float32)
    v[10_000:10_032] = v[:32] + r.normal(size=(32, 64)).astype(np.float32) * np.float32(0.05)
    v[15_000:15_032] = 2 * v[:32]
    df = spark.createDataFrame(list(enumerate(v.tolist())), "vec_id long, embedding array<float>").repartition(8)
    df = storage.cut(df, "test-vectors")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    got = {x.vec_id: (x.n_links, x.component_id) for x in near_duplicate_vectors(df).collect()}
    assert written() - before < 3 * v.nbytes
    want = {i: (0, i) for i in range(len(v))} | {i + k: (2, i) for i in range(32) for k in (0, 10_000, 15_000)}
    assert got == want


def test_vectors_in_double_precision_and_repeated_rows(spark):
    """Components beyond single precision decide; an id's row twice counts as a copy."""
    near, far = ([c, (1 - c * c) ** 0.5, 0.0] for c in (0.95 + 1e-9, 0.95 - 1e-9))
    df = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, far), (3, near), (3, near)], "vec_id long, embedding array<double>").repartition(3)
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in near_duplicate_vectors(df).collect())
    assert got == [(1, 2, 1), (2, 2, 1), (3, 3, 1), (3, 3, 1)]


def test_components_of_chains_and_stars(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(r.randrange(2000, 2100), r.randrange(2000, 2100)) for _ in range(80)] + [(7, 7)]
    r.shuffle(edges)
    g = brute.Sets(3000)
    for a, b in edges:
        g.join(a, b)
    low = g.least(list(range(3000)))
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long").repartition(7)
    got = {x.node: x.component for x in connected_components(df).collect()}
    touched = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: low[x] for x in touched}
    assert connected_components(df.limit(0)).collect() == []


def test_sets_and_settled_components_are_not_written_again(spark, monkeypatch):
    """Every file that a task writes costs its executor a few processes and every round some twenty stages: sets for verification
    stay in their shuffle, stars are told from one look, and a round's files give way to those of the next."""
    names = []

    def told(df, name, instead_of=None):
        names.append(name)
        return storage.cut(df, name, instead_of)

    monkeypatch.setattr(components, "cut", told)
    monkeypatch.setattr(jaccard_join, "cut", told)
    rows = _texts()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 3, 90).collect()}
    assert got == brute.jaccard(rows, 3, 90)
    assert names.count("jaccard-near") == names.count("jaccard-links") + names.count("jaccard-met") + names.count("jaccard-members")
    # What meets in one task after the shuffle needs no round.
    names.clear()
    chain = spark.createDataFrame([(k, k + 1) for k in range(400)] + [(k, 500) for k in range(501, 590)], "a long, b long").repartition(40)
    want = {k: 0 if k < 500 else 500 for k in [*range(401), *range(500, 590)]}
    assert {x.node: x.component for x in connected_components(chain, "short").collect()} == want
    assert names == ["short"]
    # Where it stays dealt, rounds are needed, and one folder is left of them.
    names.clear()
    chain_name = f"chain-{uuid.uuid4().hex}"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [(x.node, x.component) for x in connected_components(chain, chain_name).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(got) == sorted(want.items())
    folder = pathlib.Path(storage.checkpoint_root(spark).removeprefix("file:"), "gridloom")
    assert len(names) > 1 and len(list(folder.glob(f"{chain_name}-*"))) == 1
