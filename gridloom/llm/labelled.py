"""The bounded sample of labelled rows that the classifiers learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import held_out_mod

#: Labelled rows of each class that a classifier learns from at most, and the bytes of their texts together.
MOST_PER_CLASS = 2000
MOST_BYTES = 16 << 20


def training_rows(docs: DataFrame, labels: DataFrame, label: str, id_column: str = "doc_id", text_column: str = "text", most_per_class: int = MOST_PER_CLASS, most_bytes: int = MOST_BYTES) -> list[tuple[str, int]]:
    """(text, label) of at most most_per_class rows of each class, the first by md5 of the id, for ids whose
    crc32 mod 5 is not 0. Rows without text, id or label are no examples; of several labels of an id the largest counts.
    Of these rows those are passed over that would take a class beyond most_bytes of text; a text is learned from whole.

    The ids are chosen from the labels and lengths alone, so only the chosen rows (a bounded number, broadcast) are
    picked out of the documents."""
    known = labels.select(F.col(id_column).cast("long").alias("id_"), F.col(label).cast("int").alias("y_")).where("id_ is not null and y_ in (0, 1)")
    known = known.where(held_out_mod(5, "id_") != 0).groupBy("id_").agg(F.max("y_").alias("y_"))
    texts = docs.select(F.col(id_column).cast("long").alias("id_"), F.col(text_column).cast("string").alias("t_")).where(F.col("t_").isNotNull())
    # A few labelled documents may be gone by now: their ids and lengths are asked for first.
    there = known.join(texts.groupBy("id_").agg(F.sum(F.octet_length("t_").cast("long")).alias("size_")), "id_")
    tag = F.md5(F.col("id_").cast("string"))
    rows = []
    for y in (0, 1):
        room = most_bytes
        for r in there.where(F.col("y_") == y).orderBy(tag, "id_").limit(most_per_class).collect():
            if r["size_"] <= room:
                room -= r["size_"]
                rows.append((r["id_"], r["y_"]))
    if not rows:
        return []
    picked = docs.sparkSession.createDataFrame(rows, "id_ long, y_ int")
    got = texts.join(F.broadcast(picked), "id_").select("id_", "t_", "y_").collect()
    return [(r["t_"], r["y_"]) for r in sorted(got, key=lambda r: (r["id_"], r["t_"]))]
