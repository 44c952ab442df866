"""The pipeline's stages in a row, each held to what it decides."""

import collections

import corpus_pipeline
from gridloom import attach

from . import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    attach(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = [docs.toPandas()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        docs.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(docs.toPandas())
        assert set(kept[-1]["doc_id"]) <= set(kept[-2]["doc_id"])
        assert kept[-1]["doc_id"].is_unique
    before, after = kept[2], kept[3]
    want = brute.jaccard(list(zip(before["doc_id"], before["text"], strict=True)), 5, 80)
    assert set(after["doc_id"]) == {i for i, (_, c) in want.items() if i == c}
    assert set(kept[4]["doc_id"]) == set(after["doc_id"])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert set(packed["doc_id"]) == set(kept[4]["doc_id"])
    room = collections.Counter()
    for s, n in zip(packed["sequence_id"], packed["length"], strict=True):
        room[s] += n
    assert max(room.values()) <= 4096
    again = corpus_pipeline.run(spark, SF).toPandas()
    key = ["doc_id", "piece", "ids_crc32"]
    assert sorted(map(tuple, again[key].values)) == sorted(map(tuple, packed[key].values))


def test_packing_follows_the_mix(spark, tmp_path):
    """Pieces of one length fill the sequences in the order that mixture wrote, by turns from each source."""
    rows = [(i * 7919 % 1000, "word " * 500, "en", "s0" if i < 200 else "s1", 2500) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    stages["mixture"](spark, docs, SF).write.parquet(str(tmp_path / "mixed"))
    mixed = spark.read.parquet(str(tmp_path / "mixed"))
    written = [r[0] for f in sorted((tmp_path / "mixed").glob("*.parquet")) for r in spark.read.parquet(str(f)).select("doc_id", "_metadata.row_index").orderBy("row_index").collect()]
    packed = stages["packing"](spark, mixed, SF).orderBy("sequence_id", "offset").collect()
    assert len({r.length for r in packed}) == 1
    assert [r.doc_id for r in packed] == written
    source = {r[0]: r[3] for r in rows}
    assert {source[i] for i in written[:128]} == {"s0", "s1"}


def test_stages_with_odd_rows(spark):
    """Nulls in any column, empty and long texts, repeats, further columns and empty tables."""
    rows = [(None, "a text", "en", "s", 1), (900001, None, None, None, None), (900002, "", "en", "s", 0), (900003, "word " * 60_000, "en", "s", 9), (900004, "plain words of a text", "en", None, 3), (900004, "plain words of a text", "en", None, 3)]
    docs = spark.createDataFrame([(*r, "clash", 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score string, slot_ int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns
        left = {(r.doc_id, r.text) for r in got.collect()}
        assert left <= {r[:2] for r in rows}
        if name in ("mixture", "near_duplicates"):
            assert left == {r[:2] for r in rows}
        assert stage(spark, docs.limit(0), SF).collect() == []
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sum(r.length for r in packed if r.doc_id == 900001) == 1
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).collect() == []
