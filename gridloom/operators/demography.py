"""Seats, other vintages and the checks of population tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import half_up, round_to
from ..storage import cut


def apportion(pops: DataFrame, total_seats: int) -> DataFrame:
    """(state, pop, seats) by equal proportions: one seat each, the others to the highest priorities pop / sqrt(n(n+1));
    ties to the larger population, then by name. Taking the top priorities at once equals giving seats one by one,
    for each state's priorities fall. pops: (state, pop), a row a state."""
    states = pops.count()
    spare = total_seats - states
    if spare < 0:
        raise ValueError("fewer seats than states")
    n = F.explode(F.sequence(F.lit(1), F.lit(max(spare, 1)))).alias("n")
    asked = pops.select("state", "pop", n).withColumn("priority", F.col("pop") / F.sqrt((F.col("n") * (F.col("n") + 1)).cast("double")))
    top = asked.orderBy(F.col("priority").desc(), F.col("pop").desc(), "state").limit(spare)
    won = top.groupBy("state").agg(F.count(F.lit(1)).alias("won"))
    return pops.join(won, "state", "left").select("state", "pop", (1 + F.coalesce("won", F.lit(0))).cast("int").alias("seats"))


def seat_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(state, delta) of states whose seats differ."""
    both = before.select("state", F.col("seats").alias("b")).join(after.select("state", F.col("seats").alias("a")), "state")
    return both.select("state", (F.col("a") - F.col("b")).cast("int").alias("delta")).where("delta <> 0")


def growth(pops: DataFrame, before: str, after: str, n: int = 3) -> DataFrame:
    """(side, place, state, pct): the n fastest and slowest; ties by name."""
    g = pops.select("state", ((F.col(after) - F.col(before)) / F.col(before) * 100).alias("pct"))
    up = g.orderBy(F.col("pct").desc(), "state").limit(n).select(F.lit("fastest").alias("side"), F.row_number().over(Window.orderBy(F.col("pct").desc(), "state")).cast("long").alias("place"), "state", "pct")
    down = g.orderBy("pct", "state").limit(n).select(F.lit("slowest").alias("side"), F.row_number().over(Window.orderBy("pct", "state")).cast("long").alias("place"), "state", "pct")
    return up.unionByName(down)


def drift(pops: DataFrame, base: str, resident: str) -> DataFrame:
    """(max_drift_pct, state): the largest difference of an estimate's base to the published population."""
    d = pops.select("state", (F.abs(F.col(base) - F.col(resident)) / F.col(resident) * 100).alias("d"))
    best = d.agg(F.max("d").alias("max_drift_pct"), F.min_by("state", F.struct(-F.col("d"), "state")).alias("state"))
    return best


def county_ratios(base: DataFrame, vintage: DataFrame) -> DataFrame:
    """(state, county, pop, ratio, state_ratio): each county's growth to the vintage, null if it is not in it.

    base: (state, county, pop); vintage: (state, county, pop). state_ratio is of the matched counties."""
    v = vintage.select("state", "county", F.col("pop").cast("long").alias("then"))
    both = base.join(v, ["state", "county"], "left").withColumn("ratio", F.when(F.col("pop") > 0, F.col("then") / F.col("pop")))
    total = both.groupBy("state").agg(F.sum(F.when(F.col("then").isNotNull(), F.col("then"))).alias("t"), F.sum(F.when(F.col("then").isNotNull(), F.col("pop"))).alias("p"))
    return both.join(total, "state").select("state", "county", "pop", "ratio", F.when(F.col("p") > 0, F.col("t") / F.col("p")).otherwise(F.lit(1.0)).alias("state_ratio"))


def rescale(cell_counties: DataFrame, ratios: DataFrame) -> DataFrame:
    """(state, r, c, pop): cell populations at the vintage. Shares are added in the order of counties, then rounded half up."""
    own = cell_counties.join(ratios.select("state", "county", F.coalesce("ratio", "state_ratio").alias("ratio")), ["state", "county"])
    parts = own.groupBy("state", "r", "c").agg(F.array_sort(F.collect_list(F.struct("county", (F.col("pop") * F.col("ratio")).alias("x")))).alias("xs"))
    return parts.select("state", "r", "c", half_up(F.aggregate("xs", F.lit(0.0), lambda s, v: s + v["x"])).cast("long").alias("pop"))


def coverage(ratios: DataFrame) -> DataFrame:
    """(state, coverage): share of people in matched counties, to four places."""
    t = ratios.groupBy("state").agg(F.sum("pop").alias("all"), F.sum(F.when(F.col("ratio").isNotNull(), F.col("pop"))).alias("hit"))
    return t.select("state", round_to(F.coalesce("hit", F.lit(0)) / F.col("all"), 4).alias("coverage"))


def upper_median(df: DataFrame, column: str, *keys: str, bins: int = 4096, most_rounds: int = 2_000) -> DataFrame:
    """(keys.., low, median): the least value of a numeric column and the one at place floor(n/2) from 0, without interpolation.

    Values are selected, not gathered: a round counts each key's values in bins between the bounds that it has left, and keeps the bin in
    which the place falls; the bin's own least and largest values are the next bounds, until they are one. A task holds at most
    bins counts of a key. Not-a-number comes last; a key without values gives no row, no keys and no values a row of nulls."""
    own = df.where(F.col(column).isNotNull()).select(*keys, F.lit(0).alias("all_"), F.col(column).alias("x"))
    own = cut(own, "median-values")
    by = [*keys, "all_"]
    same = lambda a, b: reduce(lambda p, q: p & q, [a[k].eqNullSafe(b[k]) for k in by])
    facts = cut(own.groupBy(*by).agg(F.min("x").alias("low"), F.max("x").alias("hi"), F.floor(F.count(F.lit(1)) / 2).cast("long").alias("place")), "median")
    state = facts.select(*[F.col(k).alias(k) for k in by], F.col("low").alias("lo"), "hi", "place")
    for _ in range(most_rounds):
        open_ = state.where("lo < hi")
        if open_.isEmpty():
            break
        # Halves first, so that a difference cannot overflow; infinite bounds leave the middle as one bin.
        x, lo, hi = (F.col(c).cast("double") / 2 for c in ("x", "lo", "hi"))
        share = (x - lo) / (hi - lo)
        inner = F.when(F.isnan(share) | (share < 0) | (share > 1) | F.isnan(hi), F.lit(1)).otherwise(1 + F.least(F.lit(bins - 1), F.floor(share * bins))).cast("int")
        binned = own.join(open_, same(own, open_)).select(*[own[k] for k in by], "x", "lo", "hi", "place").where("x >= lo AND x <= hi")
        binned = binned.withColumn("bin", F.when(F.col("x") == F.col("lo"), 0).when(F.col("x") == F.col("hi"), bins + 1).otherwise(inner))
        counts = binned.groupBy(*by, "place", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy(*by).orderBy("bin"))
        hit = counts.withColumn("upto", upto).where("place < upto AND place >= upto - n").select(*by, "lo", "hi", (F.col("place") - F.col("upto") + F.col("n")).alias("place"))
        state = cut(state.where("NOT (lo < hi)").unionByName(hit), "median", instead_of=state)
    else:
        raise RuntimeError("the selection did not end")
    if not keys:
        return state.agg(F.min("lo").alias("median"), F.lit(0).alias("all_")).join(facts.agg(F.min("low").alias("low"), F.lit(0).alias("all_")), "all_").select("low", "median")
    return facts.join(state, same(facts, state)).select(*[facts[k] for k in keys], "low", F.col("lo").alias("median"))


def unpivot_vintages(wide: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """(key, vintage, pop) from one column a vintage; columns: column to vintage."""
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("vintage"), F.col(c).cast("long").alias("pop")) for c, v in columns.items()])).alias("x")
    return wide.select(key, pairs).select(key, "x.*").where("pop is not null")


def sum_check(parts: DataFrame, totals: DataFrame, key: str, tolerance_pct: float = 0.0) -> DataFrame:
    """(key, parts, total, ok): whether parts add up to the published totals; keys of either side are listed."""
    s = parts.groupBy(key).agg(F.sum("pop").cast("long").alias("parts"))
    both = s.join(totals.select(key, F.col("pop").cast("long").alias("total")), key, "full_outer")
    ok = F.abs(F.col("parts") - F.col("total")) * 100 <= F.abs(F.col("total")) * F.lit(tolerance_pct)
    return both.select(key, "parts", "total", F.coalesce(ok, F.lit(False)).alias("ok"))


def bad_numbers(rows: DataFrame, column: str) -> DataFrame:
    """(good, bad): how many texts are numbers."""
    n = F.expr(f"try_cast(trim({column}) AS DOUBLE)")
    return rows.agg(F.count(n).alias("good"), F.count(F.when(n.isNull(), 1)).alias("bad"))


def valid_counties(rows: DataFrame, column: str = "fips") -> DataFrame:
    """Five digits, a state of 1 to 56 but 11 (the District), not the state's total 000."""
    f = F.col(column)
    state = F.substring(f, 1, 2).try_cast("int")
    return rows.where(f.rlike("^[0-9]{5}$") & state.between(1, 56) & (state != 11) & (F.substring(f, 3, 3) != "000"))


def worklist(jobs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Jobs (key, ..) whose latest entry in the ledger (key, status, at) is not done."""
    last = ledger.groupBy("key").agg(F.max_by("status", "at").alias("status"))
    return jobs.join(last.where("status = 'done'"), "key", "left_anti")


def national(stats: DataFrame, resident: DataFrame) -> DataFrame:
    """One row: people in districts, people published, whether equal, states clean, flagged and failed."""
    s = stats.groupBy("state").agg(F.sum("pop").cast("long").alias("pop"), F.max("verdict").alias("verdict"))
    both = s.join(resident, "state", "full_outer")
    out = both.agg(F.sum("pop").cast("long").alias("pop"), F.sum("resident_pop").cast("long").alias("resident_pop"), F.count_if(F.col("verdict") == "pass").alias("clean"), F.count_if(F.col("verdict") == "flag").alias("flagged"), F.count_if(F.col("verdict") == "fail").alias("failed"))
    return out.withColumn("ok", F.col("pop") == F.col("resident_pop"))
