"""Fill-in-the-middle texts from relational units: matches, running sums of their lengths, cut requests joined by ordinal.

A text is cut into units (`UNITS`, left to right). Hashes of the seed and the id draw two cuts between units and the form:
plain (the text itself), psm (prefix, suffix, middle) or spm (suffix, prefix, middle), parts behind `TAGS`. Lengths of units are
exploded with their places, running sums (a window a document) give where each unit ends, the cut requests meet the units of
their ordinals, an aggregate a document makes two offsets of them, and substring cuts the text.

Defined results: a null text is empty, and an empty one or one that holds a tag is plain; a null id hashes as the seed and a colon;
texts of any length are cut whole; repeated rows (same id and text) are cut once and each gives its row; ids that repeat with other
texts are rows of their own; an empty table gives no rows; only doc_id and text are read, so further columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

#: A word with the white space before it, or white space that no word follows.
UNITS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
TAGS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
#: Units of a task: 48 bytes each while they are sorted.
UNITS_A_TASK = 2_000_000
_KEY = ["k1_", "k2_"]


def _drawn(seed: int, group: int) -> Column:
    """An 8-digit group of the sha256 of seed:id, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * group - 7, 8), 16, 10).cast("long")


def _with_form(docs: DataFrame, seed: int, rate: int, spm_rate: int) -> DataFrame:
    """doc_id, text and form, and two hashes of id and text, which name a row by what it holds, so that a task run again gives the same."""
    own = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    tagged = F.contains("text", F.lit(TAGS["prefix"])) | F.contains("text", F.lit(TAGS["suffix"])) | F.contains("text", F.lit(TAGS["middle"]))
    plain = (F.col("text") == "") | tagged | (_drawn(seed, 3) % 100 >= rate)
    form = F.when(plain, "plain").when(_drawn(seed, 4) % 100 < spm_rate, "spm").otherwise("psm")
    return own.withColumn("form", form).withColumn("k1_", F.xxhash64("doc_id", "text")).withColumn("k2_", F.xxhash64(F.lit(1), F.col("text"), F.col("doc_id")))


def cut_requests(apart: DataFrame, seed: int = 42) -> DataFrame:
    """A row a document that is not plain: keys, n, first and last (units before the middle and its end), lengths of its units."""
    lengths = F.transform(F.regexp_extract_all("text", F.lit(UNITS), 0), lambda x: F.length(x))
    n = F.size("lengths").cast("long")
    out = apart.select(*_KEY, lengths.alias("lengths"), _drawn(seed, 1).alias("h1"), _drawn(seed, 2).alias("h2"))
    out = out.withColumn("n", n).withColumn("x", F.col("h1") % (n + 1)).withColumn("y", F.col("h2") % (n + 1))
    return out.select(*_KEY, "n", F.least("x", "y").alias("first"), F.greatest("x", "y").alias("last"), "lengths")


def offsets(requests: DataFrame) -> DataFrame:
    """A row a key: n, and where the prefix (p) and the middle (m) end, in code points."""
    units = requests.agg(F.sum("n")).first()[0] or 0
    tasks = max(1, -(-units // UNITS_A_TASK))
    dealt = requests.select(*_KEY, "lengths").repartition(tasks, *_KEY).dropDuplicates(_KEY)
    unit = dealt.select(*_KEY, F.posexplode("lengths").alias("pos", "size"))
    to_here = Window.partitionBy(*_KEY).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ends = unit.select(*_KEY, (F.col("pos") + 1).cast("long").alias("ordinal"), F.sum("size").over(to_here).alias("end"))
    # One row a key, so that units stay where they are: both ordinals stand in it.
    asked = requests.select(*_KEY, "n", "first", "last").repartition(tasks, *_KEY).groupBy(*_KEY).agg(*[F.max(c).alias(c) for c in ("n", "first", "last")])
    # The last unit is met too, so that cuts before the first one, which meet none, leave their row.
    met = ends.join(asked.hint("shuffle_hash"), _KEY).where("ordinal = first OR ordinal = last OR ordinal = n")
    found = met.groupBy(*_KEY).agg(F.max("n").alias("n"), *[F.coalesce(F.max(F.when(F.col("ordinal") == F.col(c), F.col("end"))), F.lit(0)).alias(o) for c, o in (("first", "p"), ("last", "m"))])
    return found.select(*_KEY, "n", "p", "m")


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars (null if plain), output: a row a document. Plain texts are not moved."""
    formed = _with_form(docs, seed, rate, spm_rate)
    none, plain = F.lit(None).cast("long"), F.col("form") == "plain"
    left = formed.where(plain).select("doc_id", F.size(F.regexp_extract_all("text", F.lit(UNITS), 0)).cast("long").alias("n"), "form", none.alias("prefix_chars"), none.alias("middle_chars"), F.col("text").alias("output"))
    apart = formed.where(~plain)
    requests = cut(cut_requests(apart, seed), "units")
    full = apart.join(offsets(requests).hint("shuffle_hash"), _KEY)
    # Cuts past 2^31 code points cannot be: a string is shorter.
    p, m = F.col("p").cast("int"), F.col("m").cast("int")
    prefix, middle, suffix = F.substring("text", F.lit(1), p), F.substring("text", p + 1, m - p), F.substring("text", m + 1, F.length("text"))
    mark = {k: F.lit(v) for k, v in TAGS.items()}
    psm = F.concat(mark["prefix"], prefix, mark["suffix"], suffix, mark["middle"], middle)
    spm = F.concat(mark["suffix"], suffix, mark["prefix"], prefix, mark["middle"], middle)
    output = F.when(F.col("form") == "psm", psm).otherwise(spm)
    return left.unionByName(full.select("doc_id", "n", "form", F.col("p").alias("prefix_chars"), (F.col("m") - F.col("p")).alias("middle_chars"), output.alias("output")))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of the given form was made of. The parts hold no tag, and no tag begins inside another, so the first ones part them."""
    size = len(TAGS["prefix"])
    between = F.when(form == "psm", F.instr(output, F.lit(TAGS["suffix"]))).otherwise(F.instr(output, F.lit(TAGS["prefix"])))
    last = F.instr(output, F.lit(TAGS["middle"]))
    head, second, middle = F.substring(output, F.lit(size + 1), between - size - 1), F.substring(output, between + size, last - between - size), F.substring(output, last + size, F.length(output))
    return F.when(form == "psm", F.concat(head, middle, second)).when(form == "spm", F.concat(second, middle, head)).otherwise(output)


def digest(made: DataFrame) -> DataFrame:
    """The columns of fill_in_middle with hashes in place of the output, the second of the text rebuilt from output and form."""
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
