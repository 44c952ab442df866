"""Quality rules as a learned decision list, in DataFrame functions alone.

Statistics of every whole text are computed by built-in functions. A decision list is learned from the statistics
of labelled rows by sequential covering: a rule grows condition by condition (the threshold of highest
information gain), is pruned on rows that it was not grown on, and takes the rows that it covers out of the sample.
The rules become one ordered conditional expression over the statistics: first match decides, none keeps.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import held_out_mod

SPACES = " \t\n\x0b\f\r"
SPLIT = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The ratios that rules may ask for, each from statistics of the text.
RATIOS = ("symbols_per_word", "repeat_share", "dup_lines_per_word", "chars_per_word", "exclaims_per_word", "upper_share", "distinct_share", "n_words")
#: Labelled rows of each class that the list is learned from at most.
MOST_PER_CLASS = 2000


# ---------------------------------------------------------------- statistics


def statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, the columns keep, and the statistics of every text (null: no words).

    Each step is a select of its own, so that arrays are made once and not once for each element that
    looks at them."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    d = docs.select(F.col(id_column).cast("long").alias("doc_id"), *keep, text.alias("t_"))
    d = d.select("*", F.array_remove(F.split("t_", SPLIT), "").alias("w_"), F.filter(F.split("t_", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0).alias("l_"))
    chars = F.length("t_")
    d = d.select(
        "doc_id", *keep, "w_",
        F.size("w_").cast("long").alias("n_words"),
        F.length(F.translate("t_", SPACES, "")).cast("long").alias("word_chars"),
        (chars - F.length(F.translate("t_", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("l_") - F.size(F.array_distinct("l_"))).cast("long").alias("n_dup_lines"),
        (chars - F.length(F.translate("t_", "!", ""))).cast("long").alias("n_exclaims_"),
        (chars - F.length(F.translate("t_", UPPER, ""))).cast("long").alias("n_upper_"),
        F.transform("w_", lambda w: F.xxhash64(w)).alias("h1_"),
    )
    plain = ["doc_id", *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_exclaims_", "n_upper_"]
    d = d.select(*plain, F.size(F.array_distinct("h1_")).cast("long").alias("n_distinct_"), _doubled("h1_", 1).alias("h2_"))
    plain.append("n_distinct_")
    d = d.select(*plain, _doubled("h2_", 2).alias("h4_"))
    d = d.select(*plain, _doubled("h4_", 4).alias("h8_"))
    # Only texts in which some window comes twice look for where.
    repeated = F.size(F.array_distinct("h8_")) < F.size("h8_")
    d = d.select(*plain, F.when(repeated, F.sort_array(F.transform("h8_", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("s_"))
    same = F.zip_with(F.slice("s_", F.lit(1), F.size("s_") - 1), F.slice("s_", F.lit(2), F.size("s_") - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    d = d.select(*plain, F.sort_array(F.array_distinct(F.flatten(F.when(F.col("s_").isNotNull(), same)))).alias("at_"))
    # Windows begin at these words: each covers 8, or up to the next one.
    steps = F.zip_with(F.slice("at_", F.lit(1), F.size("at_") - 1), F.slice("at_", F.lit(2), F.size("at_") - 1), lambda a, b: F.least(b - a, F.lit(8)))
    covered = F.aggregate(steps, F.lit(8), lambda s, x: s + x)
    return d.select(*plain, F.coalesce(F.when(F.col("at_").isNotNull(), covered), F.lit(0)).cast("long").alias("n_repeat_words"))


def _doubled(column: str, step: int) -> Column:
    """Hashes of windows twice as wide: each with the one that begins `step` words later."""
    n = F.greatest(F.size(column) - step, F.lit(0))
    return F.zip_with(F.slice(column, F.lit(1), n), F.slice(column, F.lit(1 + step), n), lambda a, b: F.xxhash64(a, b))


def ratios() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "symbols_per_word": F.col("n_symbols") / words,
        "repeat_share": F.col("n_repeat_words") / words,
        "dup_lines_per_word": F.col("n_dup_lines") / words,
        "chars_per_word": F.col("word_chars") / words,
        "exclaims_per_word": F.col("n_exclaims_") / words,
        "upper_share": F.col("n_upper_") / F.greatest(F.col("word_chars"), F.lit(1)).cast("double"),
        "distinct_share": F.col("n_distinct_") / words,
        "n_words": F.col("n_words").cast("double"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words"))


# ---------------------------------------------------------------- learning


@dataclass(frozen=True)
class Condition:
    ratio: str
    above: bool
    threshold: float

    def holds(self, row: dict[str, float]) -> bool:
        return row[self.ratio] > self.threshold if self.above else row[self.ratio] <= self.threshold

    def column(self, columns: dict[str, Column]) -> Column:
        c = columns[self.ratio]
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.ratio} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, row: dict[str, float]) -> bool:
    return all(c.holds(row) for c in rule)


def _thresholds(rows: list[dict[str, float]], ratio: str, most: int) -> list[float]:
    values = sorted({r[ratio] for r in rows})
    middles = [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]
    return middles if len(middles) <= most else [middles[i * len(middles) // most] for i in range(most)]


def grow(rows: list[tuple[dict[str, float], int]], longest: int = 4, most: int = 48) -> Rule:
    """Conditions of highest gain p1 * (log2(p1/(p1+n1)) - log2(p0/(p0+n0))) until no bad row is left."""
    rule: Rule = ()
    now = rows
    while len(rule) < longest:
        p0 = sum(y for _, y in now)
        n0 = len(now) - p0
        if not p0 or not n0:
            break
        before, best = math.log2(p0 / len(now)), (0.0, None)
        for ratio in RATIOS:
            pairs = sorted((x[ratio], y) for x, y in now)
            run, k = [0, 0], 0
            for t in _thresholds([x for x, _ in now], ratio, most):
                while k < len(pairs) and pairs[k][0] <= t:
                    run[pairs[k][1]] += 1
                    k += 1
                for above, p, n in ((False, run[1], run[0]), (True, p0 - run[1], n0 - run[0])):
                    if p:
                        gain = p * (math.log2(p / (p + n)) - before)
                        if gain > best[0] + 1e-9:
                            best = (gain, Condition(ratio, above, t))
        if best[1] is None:
            break
        rule += (best[1],)
        now = [r for r in now if best[1].holds(r[0])]
    return rule


def prune(rule: Rule, rows: list[tuple[dict[str, float], int]]) -> Rule:
    """The beginning of the rule with the highest (p - n) / (p + n) on other rows."""

    def worth(r: Rule) -> float:
        got = [y for x, y in rows if _covers(r, x)]
        return (2 * sum(got) - len(got)) / len(got) if got else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)), default=())


def learn_list(rows: list[tuple[dict[str, float], int]], least_precision: float = 0.9, most_rules: int = 12) -> list[Rule]:
    """Rules that find rows of class 1, in order. Every third row is for pruning. A rule stays if it finds something
    and is right in at least least_precision of what it covers of the rows that are left."""
    left, rules = list(rows), []
    while len(rules) < most_rules and any(y for _, y in left):
        rule = prune(grow([r for i, r in enumerate(left) if i % 3]), left[::3]) if len(left) > 30 else grow(left)
        covered = [y for x, y in left if rule and _covers(rule, x)]
        if not sum(covered) or sum(covered) < least_precision * len(covered) or sum(covered) < 2:
            break
        rules.append(rule)
        left = [r for r in left if not _covers(rule, r[0])]
    return rules


def list_column(rules: list[Rule]) -> Column:
    """True for rows that no rule finds: an ordered conditional expression."""
    columns = ratios()
    out = None
    for rule in rules:
        test = rule[0].column(columns)
        for c in rule[1:]:
            test = test & c.column(columns)
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def training_statistics(docs: DataFrame, labels: DataFrame, label_column: str, id_column: str, text_column: str, most_per_class: int) -> list[tuple[dict[str, float], int]]:
    known = labels.select(F.col(id_column).cast("long").alias("id_"), F.col(label_column).cast("int").alias("y_")).where("id_ is not null and y_ in (0, 1)")
    known = known.where(held_out_mod(5, "id_") != 0).groupBy("id_").agg(F.max("y_").alias("y_"))
    tag = F.md5(F.col("id_").cast("string"))
    chosen = known.where("y_ = 0").orderBy(tag, "id_").limit(most_per_class).union(known.where("y_ = 1").orderBy(tag, "id_").limit(most_per_class))
    # At most 2 * most_per_class rows of two numbers: small whatever the labels' size.
    picked = docs.join(F.broadcast(chosen), docs[id_column].cast("long") == F.col("id_")).select(docs[id_column].alias("id__"), docs[text_column].alias("t__"), "y_")
    # Rows that fail the base go here and not in a filter, which the optimizer would push through every step of the statistics.
    found = statistics(picked, "id__", "t__", ["y_"]).select("doc_id", "y_", base_failed().alias("failed_"), *[c.alias(k + "_") for k, c in ratios().items()]).collect()
    return [({k: r[k + "_"] for k in RATIOS}, 1 - r["y_"]) for r in sorted(found, key=lambda r: (r["doc_id"], *[r[k + "_"] for k in RATIOS])) if not r["failed_"]]


def quality_rules(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", most_per_class: int = MOST_PER_CLASS) -> DataFrame:
    """One row per row of docs: doc_id, the statistics, base_failed, kept.

    kept is false where base_failed, else false where a rule of the learned list matches. Null and empty texts have no
    words and fail the base. A null id is kept as null. Without labelled rows of both classes the list is empty and
    keeps all that the base lets pass. Repeated rows are judged alike. Other columns are not read.
    """
    rules = learn_list(training_statistics(docs, labels, label_column, id_column, text_column, most_per_class))
    found = statistics(docs, id_column, text_column).withColumn("base_failed", base_failed())
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & list_column(rules)).alias("kept"))
