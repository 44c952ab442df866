"""Estimates and past decades: their sources, work-lists and the gates that they pass before anything is written."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .demography import apportion


# ---------------------------------------------------------------- sources


def summary_level(rows: DataFrame, level: str, column: str = "sumlev") -> DataFrame:
    """Rows of one summary level. Sources write levels with or without a leading zero ('050', '50')."""
    return rows.where(F.ltrim(F.regexp_replace(F.col(column).cast("string"), "^0+", "")) == level.lstrip("0"))


def with_abbreviation(rows: DataFrame, dim: DataFrame, column: str = "fips") -> DataFrame:
    """rows with the state that the first two digits of a code stand for; codes of no state are left out. dim: (state, fips), a row a state."""
    return rows.join(F.broadcast(dim.select("state", F.col("fips").alias("fips_"))), F.substring(column, 1, 2) == F.col("fips_")).drop("fips_")


def union_decades(*sources: DataFrame) -> DataFrame:
    """(fips, decade, pop) of all sources in long form; where several have a county and decade, the first source that has it counts."""
    ranked = reduce(DataFrame.unionByName, [s.select("fips", "decade", F.col("pop").cast("long").alias("pop"), F.lit(i).alias("source_")) for i, s in enumerate(sources)])
    return ranked.groupBy("fips", "decade").agg(F.min_by("pop", "source_").alias("pop"))


# ---------------------------------------------------------------- work-lists


def decade_jobs(apportionment: DataFrame, dim: DataFrame, decades: list[str] | None = None, only: list[str] | None = None) -> DataFrame:
    """(key, state, fips, decade, seats, kind, place) in the order of codes and decades. Pairs without seats (not a state then)
    are no jobs; one seat needs no map. apportionment: (decade, state, seats); dim: (state, fips)."""
    jobs = apportionment.where("seats >= 1").join(F.broadcast(dim.select("state", "fips")), "state")
    if decades is not None:
        jobs = jobs.where(F.col("decade").isin(decades))
    if only is not None:
        jobs = jobs.where(F.col("state").isin(only))
    kind = F.when(F.col("seats") == 1, "at-large").otherwise("map")
    # A row a state and decade: small by nature, so one window over all is no bottleneck.
    place = F.row_number().over(Window.orderBy("fips", "decade"))
    return jobs.select(F.concat_ws(":", "state", "decade").alias("key"), "state", "fips", "decade", "seats", kind.alias("kind"), place.cast("long").alias("place"))


def require_states(asked: DataFrame, dim: DataFrame) -> DataFrame:
    """asked with the columns of dim; raises for a state that dim does not have or has no population of. dim: (state, .., resident_pop)."""
    both = asked.join(F.broadcast(dim.withColumn("known_", F.lit(True))), "state", "left")
    message = F.when(F.col("known_").isNull(), F.concat(F.lit("unknown state "), F.coalesce("state", F.lit("null")))).when(F.col("resident_pop").isNull(), F.concat(F.lit("no verified population of "), "state"))
    return both.withColumn("state", F.when(message.isNull(), F.col("state")).otherwise(F.raise_error(message))).drop("known_")


def neighbours_in_order(rows: DataFrame, name: str) -> DataFrame:
    """rows with previous and next in the order of a name; the ends meet. For tables with a row a state."""
    w = Window.orderBy(name)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn("previous", F.coalesce(F.lag(name).over(w), F.last(name).over(whole))).withColumn("next", F.coalesce(F.lead(name).over(w), F.first(name).over(whole)))


def coverage_by_decade(ledger: DataFrame) -> DataFrame:
    """(decade, done, maps, mean_coverage): finished jobs of each decade, those with a map, and the mean coverage of these."""
    done = ledger.where("status = 'done'")
    is_map = F.col("kind") == "map"
    return done.groupBy("decade").agg(F.count(F.lit(1)).alias("done"), F.count_if(is_map).alias("maps"), F.avg(F.when(is_map, F.col("coverage"))).alias("mean_coverage"))


# ---------------------------------------------------------------- gates


def _gate(name: str, value: Column, ok: Column) -> Column:
    return F.struct(F.lit(name).alias("gate"), value.cast("double").alias("value"), F.coalesce(ok, F.lit(False)).alias("ok"))


def gates(one: DataFrame, *columns: Column) -> DataFrame:
    """(gate, value, ok) from a table of one row."""
    return one.select(F.explode(F.array(*columns)).alias("g")).select("g.*")


def require_all(checked: DataFrame) -> DataFrame:
    """checked, but raising with the name of a gate that is not ok: evaluated before anything is written."""
    return checked.withColumn("ok", F.when(F.col("ok"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("gate failed: "), "gate")).cast("boolean")))


def estimate_gates(estimates: DataFrame, us_total: DataFrame, states: int = 50, apart: tuple[str, ...] = ("District of Columbia", "Puerto Rico"), spread_pct: float = 10.0) -> DataFrame:
    """(gate, value, ok) of a table of estimates (name, base, est): how many states, what the national row (us_total: est) has beyond
    the states and those apart, and how many are further than spread_pct from their base."""
    own = estimates.where(~F.col("name").isin(*apart))
    one = own.agg(F.count(F.lit(1)).alias("n"), F.sum("est").alias("states"), F.count_if(F.abs(F.col("est") - F.col("base")) * 100 > F.lit(spread_pct) * F.col("base")).alias("far"))
    more = estimates.where(F.col("name").isin(*apart)).agg(*[F.coalesce(F.sum(F.when(F.col("name") == x, F.col("est"))), F.lit(0)).alias(f"apart{i}") for i, x in enumerate(apart)])
    row = one.crossJoin(more).crossJoin(us_total.select(F.col("est").alias("us")))  # one row each
    total, sums = F.col("states"), []
    for i in range(len(apart)):
        total = total + F.col(f"apart{i}")
        sums.append(total)
    last = F.lit(False)
    for s in [F.col("states"), *sums]:
        last = last | (s == F.col("us"))
    return gates(row, _gate("states", F.col("n"), F.col("n") == states), _gate("national sum", F.col("us") - F.col("states"), last), _gate("outliers", F.col("far"), F.col("far") == 0))


def spot_checks(values: DataFrame, expected: DataFrame, key: str = "name") -> DataFrame:
    """(key, value, delta, ok): values at a few known keys against low and high. expected: (key, low, high), a few rows."""
    both = F.broadcast(expected).join(values.select(key, "value"), key, "left")
    return both.select(key, "value", (F.col("value") - F.col("low")).alias("delta"), F.coalesce(F.col("value").between(F.col("low"), F.col("high")), F.lit(False)).alias("ok"))


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def county_gates(counties: DataFrame, states: DataFrame, low: int = 3000, high: int = 3200) -> DataFrame:
    """(gate, value, ok): number of counties, codes that are listed twice, states whose counties do not add up to the state table.
    counties: (fips, state, est); states: (state, est)."""
    sums = counties.groupBy("state").agg(F.sum("est").alias("got"))
    both = states.select("state", F.col("est").alias("want")).join(sums, "state", "full_outer")
    wrong = both.agg(F.count_if(~F.coalesce(F.col("got") == F.col("want"), F.lit(False))).alias("wrong"))
    per = counties.groupBy("fips").agg(F.count(F.lit(1)).alias("k"))
    row = per.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("k") > 1).alias("twice")).crossJoin(wrong)  # one row each
    return gates(row, _gate("county count", F.col("n"), F.col("n").between(low, high)), _gate("duplicates", F.col("twice"), F.col("twice") == 0), _gate("state sums", F.col("wrong"), F.col("wrong") == 0))


def history_checks(county_pops: DataFrame, published: DataFrame, anchors: DataFrame, national_pct: float = 1.0, anchor_pct: float = 0.1) -> DataFrame:
    """(decade, state, computed, published, diff_pct, ok): sums of counties against published numbers, within a share of these. The
    national row has state null. county_pops: (fips, decade, pop); published: (decade, pop); anchors: (decade, fips, pop), fips a state's."""
    state = county_pops.groupBy("decade", F.substring("fips", 1, 2).alias("fips")).agg(F.sum("pop").cast("long").alias("computed"))
    nation = state.groupBy("decade").agg(F.sum("computed").cast("long").alias("computed"))
    a = nation.join(F.broadcast(published), "decade").select("decade", F.lit(None).cast("string").alias("state"), "computed", F.col("pop").alias("published"), F.lit(national_pct).alias("most"))
    b = F.broadcast(anchors).join(state, ["decade", "fips"], "left").select("decade", F.col("fips").alias("state"), F.coalesce("computed", F.lit(0)).alias("computed"), F.col("pop").alias("published"), F.lit(anchor_pct).alias("most"))
    both = a.unionByName(b).withColumn("diff_pct", (F.col("computed") - F.col("published")) / F.col("published") * 100)
    return both.withColumn("ok", F.abs("diff_pct") < F.col("most")).drop("most")


# ---------------------------------------------------------------- the preview


def preview_gates(estimates: DataFrame, official: DataFrame, constants: DataFrame, total_seats: int, most_drift: float = 0.005) -> DataFrame:
    """(gate, value, ok) of the inputs of a preview: every state in all three tables; bases within most_drift of the published
    populations; the method gives the official seats; these are the constants. estimates: (state, base, est); official: (state,
    pop, seats); constants: (state, seats, resident_pop)."""
    names = constants.select("state", F.col("seats").alias("known"), "resident_pop")
    again = apportion(official.select("state", "pop"), total_seats).select("state", F.col("seats").alias("again"))
    both = names.join(estimates.select("state", "base", "est"), "state", "full_outer").join(official.select("state", "seats"), "state", "full_outer").join(again, "state", "left")
    lost = F.col("known").isNull() | F.col("base").isNull() | F.col("seats").isNull()
    row = both.agg(
        F.count_if(lost).alias("lost"), F.max(F.abs(F.col("base") - F.col("resident_pop")) / F.col("resident_pop")).alias("drift"),
        F.count_if(~F.coalesce(F.col("again") == F.col("seats"), F.lit(False))).alias("other"), F.count_if(~F.coalesce(F.col("known") == F.col("seats"), F.lit(False))).alias("stale"), F.sum("seats").alias("sum"),
    )
    return gates(row, _gate("inputs", F.col("lost"), F.col("lost") == 0), _gate("base drift", F.col("drift"), F.col("drift") <= most_drift), _gate("official seats again", F.col("other"), F.col("other") == 0), _gate("seats as known", F.col("stale"), (F.col("stale") == 0) & (F.col("sum") == total_seats)))


def preview(estimates: DataFrame, constants: DataFrame, total_seats: int) -> DataFrame:
    """(state, est, pct_change, seats, delta): seats by the estimates, against those known."""
    seats = apportion(estimates.select("state", F.col("est").alias("pop")), total_seats).select("state", F.col("pop").alias("est"), "seats")
    both = seats.join(constants.select("state", F.col("seats").alias("known"), "resident_pop"), "state")
    return both.select("state", "est", ((F.col("est") - F.col("resident_pop")) / F.col("resident_pop") * 100).alias("pct_change"), "seats", (F.col("seats") - F.col("known")).cast("int").alias("delta"))


def national_change(estimates: DataFrame, constants: DataFrame) -> DataFrame:
    """One row: people published, people estimated, the change in percent."""
    row = constants.select("state", "resident_pop").join(estimates.select("state", "est"), "state").agg(F.sum("resident_pop").cast("long").alias("resident_pop"), F.sum("est").cast("long").alias("est"))
    return row.withColumn("pct_change", (F.col("est") - F.col("resident_pop")) / F.col("resident_pop") * 100)


def ordered_changes(previewed: DataFrame) -> DataFrame:
    """(place, state, delta, seats) of states whose seats change, most won first, then by name."""
    own = previewed.where("delta <> 0")
    return own.select(F.row_number().over(Window.orderBy(F.col("delta").desc(), "state")).cast("long").alias("place"), "state", "delta", "seats")
