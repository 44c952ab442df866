"""Queries over a virtual nation: estimates, decades, gates, previews and whole runs. Nations are states; their customers' balances are
people; suppliers are counties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import demography, grid, raster, verify, vintages
from ..storage import cut
from . import engine
from .catalog import COUNTY, NATIONS, TRIANGLES, _apportion_sql, _counties, _nations, query, triangles
from .census import Census

SEATS = 100
DIM = NATIONS + _apportion_sql("pop", "ap") + ", dim AS (SELECT n.n_name AS state, lpad(CAST(n.n_nationkey + 1 AS VARCHAR), 2, '0') AS fips, ap.seats, ap.pop AS resident_pop FROM nation n JOIN ap ON ap.state = n.n_name)"


def _dim(v: Census) -> DataFrame:
    seats = demography.apportion(cut(_nations(v).select("state", "pop"), "nations"), SEATS)
    codes = v.table("nation").select(F.col("n_name").alias("state"), F.lpad((F.col("n_nationkey") + 1).cast("string"), 2, "0").alias("fips"))
    return seats.join(F.broadcast(codes), "state").select("state", "fips", "seats", F.col("pop").alias("resident_pop"))


def _estimates(v: Census) -> DataFrame:
    return _nations(v).select("state", F.col("pop").alias("base"), F.col("pop2").alias("est"))


# ---------------------------------------------------------------- sources

#: A file of all levels: a national row, a row a nation, and a row a supplier.
LEVELS = """, lv AS (SELECT '010' AS sumlev, '00000' AS fips, CAST(count(*) AS BIGINT) AS pop FROM customer
UNION ALL SELECT CASE WHEN n_nationkey % 2 = 0 THEN '040' ELSE '40' END, lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') || '000', count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey
UNION ALL SELECT CASE WHEN s_suppkey % 2 = 0 THEN '050' ELSE '50' END, lpad(CAST(s_nationkey + 1 AS VARCHAR), 2, '0') || lpad(CAST(s_suppkey AS VARCHAR), 6, '0'), CAST(floor(abs(s_acctbal)) AS BIGINT) FROM supplier)"""


def _levels(v: Census) -> DataFrame:
    c = v.table("customer").join(F.broadcast(v.table("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    code = lambda k: F.lpad((k + 1).cast("string"), 2, "0")
    odd = lambda k, a: F.when(k % 2 == 0, F.lit("0" + a)).otherwise(F.lit(a))
    nation = v.table("customer").agg(F.count(F.lit(1)).alias("pop")).select(F.lit("010").alias("sumlev"), F.lit("00000").alias("fips"), "pop")
    states = c.groupBy("n_nationkey").agg(F.count(F.lit(1)).alias("pop")).select(odd(F.col("n_nationkey"), "40").alias("sumlev"), F.concat(code(F.col("n_nationkey")), F.lit("000")).alias("fips"), "pop")
    s = v.table("supplier")
    counties = s.select(odd(F.col("s_suppkey"), "50").alias("sumlev"), F.concat(code(F.col("s_nationkey")), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("fips"), F.floor(F.abs("s_acctbal")).cast("long").alias("pop"))
    return nation.unionByName(states).unionByName(counties)


@query("summary_level", LEVELS + " SELECT fips, pop FROM lv WHERE sumlev IN ('050', '50')")
def _(v: Census) -> DataFrame:
    return vintages.summary_level(_levels(v), "050").select("fips", "pop")


@query("fips_to_state", DIM + LEVELS + " SELECT state, count(*) AS counties, CAST(sum(lv.pop) AS BIGINT) AS pop FROM lv JOIN dim ON substr(lv.fips, 1, 2) = dim.fips WHERE sumlev IN ('050', '50') GROUP BY state")
def _(v: Census) -> DataFrame:
    own = vintages.with_abbreviation(vintages.summary_level(_levels(v), "50"), _dim(v))
    return own.groupBy("state").agg(F.count(F.lit(1)).alias("counties"), F.sum("pop").cast("long").alias("pop"))


DECADES = """, d1 AS (SELECT lpad(CAST(s_suppkey % 50 AS VARCHAR), 5, '0') AS fips, d AS decade, CAST(sum(floor(abs(s_acctbal)) + CAST(d AS INTEGER) % 7) AS BIGINT) AS pop FROM supplier, (VALUES ('1990'), ('2000')) t(d) GROUP BY ALL),
d2 AS (SELECT lpad(CAST(s_suppkey % 60 AS VARCHAR), 5, '0') AS fips, d AS decade, CAST(sum(floor(abs(s_acctbal))) * 2 AS BIGINT) AS pop FROM supplier, (VALUES ('2000'), ('2010')) t(d) GROUP BY ALL),
decs AS (SELECT * FROM d1 UNION ALL SELECT * FROM d2 ANTI JOIN d1 USING (fips, decade))"""


def _decades(v: Census) -> DataFrame:
    s = v.table("supplier").select("s_suppkey", F.floor(F.abs("s_acctbal")).alias("x"))
    code = lambda k: F.lpad((F.col("s_suppkey") % k).cast("string"), 5, "0").alias("fips")
    wide = s.groupBy(code(50)).agg(F.sum(F.col("x") + 1990 % 7).alias("p1990"), F.sum(F.col("x") + 2000 % 7).alias("p2000"))
    other = s.groupBy(code(60)).agg((F.sum("x") * 2).alias("a"), (F.sum("x") * 2).alias("b"))
    long_ = lambda df, names: demography.unpivot_vintages(df, "fips", names).withColumnRenamed("vintage", "decade")
    return vintages.union_decades(long_(wide, {"p1990": "1990", "p2000": "2000"}), long_(other, {"a": "2000", "b": "2010"}))


@query("union_decades", DECADES + " SELECT * FROM decs")
def _(v: Census) -> DataFrame:
    return _decades(v)


@query("history_checks", DECADES + """, st AS (SELECT decade, substr(fips, 1, 2) AS state, CAST(sum(pop) AS BIGINT) AS computed FROM decs GROUP BY ALL), na AS (SELECT decade, CAST(sum(computed) AS BIGINT) AS computed FROM st GROUP BY ALL),
ck AS (SELECT decade, CAST(NULL AS VARCHAR) AS state, computed, CAST(computed + computed // 90 * (CAST(decade AS INTEGER) // 10 % 2) AS BIGINT) AS published, 1.0 AS most FROM na
UNION ALL SELECT decade, state, computed, CAST(computed + 5 AS BIGINT), 0.1 FROM st WHERE state = '00')
SELECT decade, state, computed, published, (computed - published) / published * 100 AS diff_pct, abs((computed - published) / published * 100) < most AS ok FROM ck""")
def _(v: Census) -> DataFrame:
    own = cut(_decades(v), "decades")
    total = own.groupBy("decade").agg(F.sum("pop").cast("long").alias("p"))
    published = total.select("decade", (F.col("p") + F.floor(F.col("p") / 90) * (F.floor(F.col("decade").cast("int") / 10) % 2)).cast("long").alias("pop"))
    anchors = own.where("substring(fips, 1, 2) = '00'").groupBy("decade").agg((F.sum("pop") + 5).cast("long").alias("pop")).select("decade", F.lit("00").alias("fips"), "pop")
    return vintages.history_checks(own, published, anchors)


# ---------------------------------------------------------------- work-lists

JOBS = DIM + """, appo AS (SELECT d AS decade, n_name AS state, CAST((n_nationkey * 3 + CAST(d AS INTEGER) // 10) % 5 AS INTEGER) AS seats FROM nation, (VALUES ('1950'), ('1960'), ('1970')) t(d)),
jobs AS (SELECT state || ':' || decade AS key, state, dim.fips, decade, appo.seats, CASE WHEN appo.seats = 1 THEN 'at-large' ELSE 'map' END AS kind, row_number() OVER (ORDER BY dim.fips, decade) AS place FROM appo JOIN dim USING (state) WHERE appo.seats >= 1)"""


def _jobs(v: Census, **options) -> DataFrame:
    n = v.table("nation").select(F.col("n_name").alias("state"), "n_nationkey", F.explode(F.array(F.lit("1950"), F.lit("1960"), F.lit("1970"))).alias("decade"))
    seats = ((F.col("n_nationkey") * 3 + F.floor(F.col("decade").cast("int") / 10)) % 5).cast("int")
    return vintages.decade_jobs(n.select("decade", "state", seats.alias("seats")), _dim(v), **options)


@query("decade_jobs", JOBS + " SELECT * FROM jobs")
def _(v: Census) -> DataFrame:
    return _jobs(v)


@query("decade_jobs_only", JOBS + " SELECT * EXCLUDE (place), row_number() OVER (ORDER BY fips, decade) AS place FROM jobs WHERE state IN ('NATION_3', 'NATION_7') AND decade <> '1960'")
def _(v: Census) -> DataFrame:
    return _jobs(v, decades=["1950", "1970"], only=["NATION_3", "NATION_7"])


@query("at_large", JOBS + " SELECT key, state, decade FROM jobs WHERE kind = 'at-large'")
def _(v: Census) -> DataFrame:
    return _jobs(v).where("kind = 'at-large'").select("key", "state", "decade")


@query("coverage_by_decade", JOBS + ", led AS (SELECT *, CASE WHEN place % 4 = 0 THEN 'failed' ELSE 'done' END AS status, place / 128 AS coverage FROM jobs) SELECT decade, count(*) AS done, count(*) FILTER (WHERE kind = 'map') AS maps, avg(coverage) FILTER (WHERE kind = 'map') AS mean_coverage FROM led WHERE status = 'done' GROUP BY decade")
def _(v: Census) -> DataFrame:
    return vintages.coverage_by_decade(_jobs(v).withColumn("status", F.when(F.col("place") % 4 == 0, "failed").otherwise("done")).withColumn("coverage", F.col("place") / 128))


@query("require_states", DIM + " SELECT state, seats, fips, resident_pop FROM dim WHERE fips <= '10'")
def _(v: Census) -> DataFrame:
    dim = _dim(v)
    return vintages.require_states(dim.where("fips <= '10'").select("state"), dim).select("state", "seats", "fips", "resident_pop")


@query("neighbours_in_order", DIM + " SELECT state, coalesce(lag(state) OVER (ORDER BY state), (SELECT max(state) FROM dim)) AS previous, coalesce(lead(state) OVER (ORDER BY state), (SELECT min(state) FROM dim)) AS next FROM dim")
def _(v: Census) -> DataFrame:
    return vintages.neighbours_in_order(_dim(v).select("state"), "state")


# ---------------------------------------------------------------- gates

EST = DIM + ", est AS (SELECT state AS name, pop AS base, CASE WHEN length(state) % 3 = 0 THEN pop + pop // 5 ELSE pop + pop // 50 END AS est FROM np)"


def _spread(v: Census) -> DataFrame:
    p = F.col("pop")
    return _nations(v).select(F.col("state").alias("name"), p.alias("base"), F.when(F.length("state") % 3 == 0, p + F.floor(p / 5)).otherwise(p + F.floor(p / 50)).cast("long").alias("est"))


@query("estimate_gates", EST + """, o AS (SELECT count(*) AS n, sum(est) AS s, count(*) FILTER (WHERE abs(est - base) * 100 > 10 * base) AS far FROM est WHERE name NOT IN ('NATION_5', 'NATION_7')), us AS (SELECT sum(est) AS us FROM est), ch AS (SELECT sum(est) AS c FROM est WHERE name = 'NATION_5')
SELECT 'states' AS gate, CAST(n AS DOUBLE) AS value, n = 23 AS ok FROM o UNION ALL SELECT 'national sum', CAST(us - s AS DOUBLE), us = (SELECT sum(est) FROM est) FROM o, us UNION ALL SELECT 'outliers', CAST(far AS DOUBLE), far = 0 FROM o""")
def _(v: Census) -> DataFrame:
    own = cut(_spread(v), "estimates")
    return vintages.estimate_gates(own, own.agg(F.sum("est").alias("est")), 23, ("NATION_5", "NATION_7"))


@query("spot_checks", EST + ", w(name, low, high) AS (VALUES ('NATION_5', 0, 1000000000000), ('NATION_7', 0, 1), ('ATLANTIS', 0, 9)) SELECT name, CAST(est AS BIGINT) AS value, CAST(est - low AS BIGINT) AS delta, coalesce(est BETWEEN low AND high, false) AS ok FROM w LEFT JOIN est USING (name)")
def _(v: Census) -> DataFrame:
    want = v.spark.createDataFrame([("NATION_5", 0, 10**12), ("NATION_7", 0, 1), ("ATLANTIS", 0, 9)], "name string, low long, high long")
    return vintages.spot_checks(_spread(v).select("name", F.col("est").alias("value")), want)


CTY = ", cty AS (SELECT lpad(CAST(s_suppkey % 90 AS VARCHAR), 5, '0') AS fips, CAST(s_nationkey AS VARCHAR) AS state, CAST(floor(abs(s_acctbal)) AS BIGINT) AS est FROM supplier), sta AS (SELECT state, CAST(sum(est) + CASE WHEN state = '3' THEN 1 ELSE 0 END AS BIGINT) AS est FROM cty GROUP BY state)"


@query("county_gates", CTY + """, per AS (SELECT fips, count(*) AS k FROM cty GROUP BY fips), wrong AS (SELECT count(*) AS w FROM (SELECT state, sum(est) AS got FROM cty GROUP BY state) FULL JOIN sta USING (state) WHERE NOT coalesce(got = est, false))
SELECT 'county count' AS gate, CAST(count(*) AS DOUBLE) AS value, count(*) BETWEEN 10 AND 95 AS ok FROM per UNION ALL SELECT 'duplicates', CAST(count(*) AS DOUBLE), count(*) = 0 FROM per WHERE k > 1 UNION ALL SELECT 'state sums', CAST(w AS DOUBLE), w = 0 FROM wrong""")
def _(v: Census) -> DataFrame:
    c = v.table("supplier").select(F.lpad((F.col("s_suppkey") % 90).cast("string"), 5, "0").alias("fips"), F.col("s_nationkey").cast("string").alias("state"), F.floor(F.abs("s_acctbal")).cast("long").alias("est"))
    states = c.groupBy("state").agg(F.sum("est").cast("long").alias("est")).withColumn("est", F.col("est") + F.when(F.col("state") == "3", 1).otherwise(0))
    return vintages.county_gates(c, states, 10, 95)


@query("duplicate_keys", CTY + " SELECT fips, count(*) AS n FROM cty GROUP BY fips HAVING count(*) > 1")
def _(v: Census) -> DataFrame:
    c = v.table("supplier").select(F.lpad((F.col("s_suppkey") % 90).cast("string"), 5, "0").alias("fips"))
    return vintages.duplicate_keys(c, "fips")


# ---------------------------------------------------------------- the preview

PRE = DIM + _apportion_sql("pop2", "pr") + ", e2 AS (SELECT state, pop AS base, pop2 AS est FROM np)"


@query("preview_gates", PRE + """, x AS (SELECT count(*) FILTER (WHERE d.seats IS NULL OR e.base IS NULL OR ap.seats IS NULL) AS lost, max(abs(e.base - d.resident_pop) / d.resident_pop) AS drift, count(*) FILTER (WHERE d.seats <> ap.seats) AS stale, sum(ap.seats) AS s FROM dim d FULL JOIN e2 e USING (state) FULL JOIN ap USING (state))
SELECT 'inputs' AS gate, CAST(lost AS DOUBLE) AS value, lost = 0 AS ok FROM x UNION ALL SELECT 'base drift', drift, drift <= 0.005 FROM x UNION ALL SELECT 'official seats again', 0.0, true FROM x UNION ALL SELECT 'seats as known', CAST(stale AS DOUBLE), stale = 0 AND s = 100 FROM x""")
def _(v: Census) -> DataFrame:
    dim = cut(_dim(v), "dim")
    return vintages.preview_gates(_estimates(v), dim.select("state", F.col("resident_pop").alias("pop"), "seats"), dim, SEATS)


@query("seat_preview", PRE + " SELECT pr.state, pr.pop AS est, (pr.pop - resident_pop) / resident_pop * 100 AS pct_change, pr.seats, CAST(pr.seats - dim.seats AS INTEGER) AS delta FROM pr JOIN dim USING (state)")
def _(v: Census) -> DataFrame:
    dim = cut(_dim(v), "dim")
    return engine.seat_preview(cut(_estimates(v), "estimates"), dim.select("state", F.col("resident_pop").alias("pop"), "seats"), dim, SEATS)


@query("seat_changes_in_order", PRE + ", ch AS (SELECT pr.state, CAST(pr.seats - dim.seats AS INTEGER) AS delta, pr.seats FROM pr JOIN dim USING (state)) SELECT row_number() OVER (ORDER BY delta DESC, state) AS place, state, delta, seats FROM ch WHERE delta <> 0")
def _(v: Census) -> DataFrame:
    return vintages.ordered_changes(vintages.preview(cut(_estimates(v), "estimates"), _dim(v), SEATS))


@query("national_change", PRE + " SELECT CAST(sum(resident_pop) AS BIGINT) AS resident_pop, CAST(sum(est) AS BIGINT) AS est, (sum(est) - sum(resident_pop)) / sum(resident_pop) * 100 AS pct_change FROM dim JOIN e2 USING (state)")
def _(v: Census) -> DataFrame:
    return vintages.national_change(_estimates(v), _dim(v))


# ---------------------------------------------------------------- grids, colours, rings


@query("cell_index", " SELECT state, r * 40 + c AS i, CAST((r * 40 + c) // 40 AS INTEGER) AS r, CAST((r * 40 + c) % 40 AS INTEGER) AS c FROM grid")
def _(v: Census) -> DataFrame:
    i = v.grid().select("state", scalars.cell_index(F.col("r"), F.col("c"), 40).alias("i"))
    r, c = scalars.cell_row_col(F.col("i"), 40)
    return i.select("state", "i", r.alias("r"), c.alias("c"))


@query("district_colours", """, d AS (SELECT CAST(range AS INTEGER) AS d FROM range(1, 61)), h AS (SELECT d, (d - 1) * 137.508::DOUBLE % 360 / 30 AS h FROM d), k AS (SELECT d, x, (h + s) % 12 AS k FROM h, (VALUES ('red', 0), ('green', 8), ('blue', 4)) t(x, s)),
p AS (SELECT unnest(range(1, 13)) AS d, unnest(['4e79a7', 'f28e2b', 'e15759', '59a14f', 'b07aa1', 'edc948', '76b7b2', 'ff5d8f', '9c755f', '17becf', 'bcbd22', '8c564b']) AS hex),
g AS (SELECT d, x, CAST(floor((0.52::DOUBLE - (0.62::DOUBLE * 0.48::DOUBLE) * greatest(-1.0::DOUBLE, least(k - 3, 9 - k, 1.0::DOUBLE))) * 255 + 0.5) AS INTEGER) AS v FROM k)
SELECT g.d AS district, max(CASE WHEN x = 'red' THEN CASE WHEN hex IS NULL THEN v ELSE ('0x' || substr(hex, 1, 2))::INTEGER END END) AS red, max(CASE WHEN x = 'green' THEN CASE WHEN hex IS NULL THEN v ELSE ('0x' || substr(hex, 3, 2))::INTEGER END END) AS green, max(CASE WHEN x = 'blue' THEN CASE WHEN hex IS NULL THEN v ELSE ('0x' || substr(hex, 5, 2))::INTEGER END END) AS blue FROM g LEFT JOIN p USING (d) GROUP BY g.d""")
def _(v: Census) -> DataFrame:
    return v.spark.range(1, 61).select(F.col("id").cast("int").alias("district"), scalars.district_rgb(F.col("id")).alias("x")).select("district", "x.red", "x.green", "x.blue")


@query("largest_rings", TRIANGLES + ", a AS (SELECT poly % 3 AS state, poly AS ring_id, sum(x1 * y2 - x2 * y1) / 2 AS area FROM seg GROUP BY poly) SELECT * FROM (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY state ORDER BY abs(area) DESC, ring_id) <= 4)")
def _(v: Census) -> DataFrame:
    t = triangles(v)
    areas = t.groupBy("poly").agg((F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2).alias("area"))
    return raster.largest_rings(areas.select((F.col("poly") % 3).alias("state"), F.col("poly").alias("ring_id"), "area"), 4)


@query("dissolve_area", ", sides AS (SELECT b.state, b.district, count(*) AS cells FROM bands b GROUP BY ALL) SELECT state, district, CAST(cells AS DOUBLE) AS area FROM sides")
def _(v: Census) -> DataFrame:
    """The areas inside outer rings less those of holes are the cells."""
    t = raster.dissolve(v.bands())
    after = F.concat(F.slice("cols", F.lit(2), F.size("cols") - 1), F.slice("cols", F.lit(1), F.lit(1)))
    below = F.concat(F.slice("rows", F.lit(2), F.size("rows") - 1), F.slice("rows", F.lit(1), F.lit(1)))
    corners = F.arrays_zip("cols", "rows", after.alias("cols2"), below.alias("rows2"))
    area = F.aggregate(F.transform(corners, lambda p: (p["cols"] * p["rows2"] - p["cols2"] * p["rows"]) / 2), F.lit(0.0), lambda a, x: a + x)
    return t.groupBy("state", "district").agg(F.sum(area).alias("area"))


@query("order_independence", " SELECT state, sha256('row,col,district,pop' || chr(10) || string_agg(r || ',' || c || ',' || district || ',' || pop || chr(10), '' ORDER BY r, c)) AS sha256 FROM bands GROUP BY state")
def _(v: Census) -> DataFrame:
    """The hashes of an assignment whose blocks come in another order and partitioning."""
    blocks = v.blocks().repartition(13, F.reverse("geoid")).sortWithinPartitions(F.md5("geoid"))
    return verify.fingerprint(v.bands(grid.cells(blocks).select("state", "r", "c", "pop")))


# ---------------------------------------------------------------- whole runs


def _run(v: Census, *arms: str) -> engine.Run:
    return engine.run(v.grid(), v.seats(), 11, arms or engine.ARMS)


@query("run_cells", """ SELECT CAST(state AS VARCHAR) AS state, arm, count(*) AS cells, CAST(sum(pop) AS BIGINT) AS pop, seats AS districts, true AS whole
FROM grid JOIN seats USING (state), (VALUES ('accretion-west'), ('accretion-centroid'), ('splitline'), ('hilbert')) t(arm) GROUP BY ALL""")
def _(v: Census) -> DataFrame:
    """Every arm of every state has all cells and people, all districts, each in one piece."""
    done = _run(v)
    own = done.assigned.groupBy("state", "arm").agg(F.count(F.lit(1)).alias("cells"), F.sum("pop").cast("long").alias("pop"), F.count_distinct("district").cast("int").alias("districts"))
    return own.join(done.scored.select("state", "arm", F.col("g2_contiguity").alias("whole")), ["state", "arm"])


@query("run_scores")
def _(v: Census) -> DataFrame:
    return _run(v).scored


@query("run_ledger", """ SELECT state || '|' || arm AS key, 'done' AS status, count(*) AS cells FROM grid, (VALUES ('hilbert'), ('splitline')) t(arm) GROUP BY ALL""")
def _(v: Census) -> DataFrame:
    return _run(v, "hilbert", "splitline").ledger.select("key", "status", "cells")


@query("run_verdicts", " SELECT CAST(state AS VARCHAR) AS state, 'splitline' AS arm, resident_pop AS csv_pop, resident_pop AS district_pop, resident_pop, true AS ok FROM resident")
def _(v: Census) -> DataFrame:
    return engine.verify_run(_run(v, "splitline"), v.resident()).select("state", "arm", "csv_pop", "district_pop", "resident_pop", "ok")


VINT = COUNTY + """, cp AS (SELECT CAST(state AS VARCHAR) AS state, d AS decade, county, CAST(pop + pop * (CAST(d AS INTEGER) // 10 % 5) // 10 AS BIGINT) AS pop FROM base, (VALUES ('1990'), ('2000')) t(d) WHERE CAST(county AS INTEGER) % 13 <> 0),
r0 AS (SELECT CAST(b.state AS VARCHAR) AS state, d AS decade, b.county, b.pop, cp.pop AS t FROM base b CROSS JOIN (VALUES ('1990'), ('2000')) x(d) LEFT JOIN cp ON cp.state = CAST(b.state AS VARCHAR) AND cp.county = b.county AND cp.decade = d),
rs AS (SELECT state, decade, sum(t) FILTER (WHERE t IS NOT NULL) / sum(pop) FILTER (WHERE t IS NOT NULL) AS state_ratio FROM r0 GROUP BY ALL),
cell AS (SELECT r0.state, r0.decade, cc.r, cc.c, CAST(floor(sum(cc.pop * coalesce(CASE WHEN r0.pop > 0 THEN r0.t / r0.pop END, state_ratio) ORDER BY cc.county) + 0.5) AS BIGINT) AS pop FROM cc JOIN r0 ON CAST(cc.state AS VARCHAR) = r0.state AND cc.county = r0.county JOIN rs ON rs.state = r0.state AND rs.decade = r0.decade GROUP BY ALL)"""


@query("vintage_maps", VINT + " SELECT c.state, decade, count(*) AS cells, CAST(sum(pop) AS BIGINT) AS pop, any_value(seats) AS districts FROM cell c JOIN seats s ON CAST(s.state AS VARCHAR) = c.state GROUP BY c.state, decade")
def _(v: Census) -> DataFrame:
    """Maps of two decades on rescaled people: all cells, people and districts are there."""
    cells = _counties(v)[0].withColumn("state", F.col("state").cast("string"))
    base = cells.groupBy("state", "county").agg(F.sum("pop").cast("long").alias("pop"))
    both = base.where(F.col("county").cast("int") % 13 != 0).withColumn("decade", F.explode(F.array(F.lit("1990"), F.lit("2000"))))
    past = both.select("state", "decade", "county", (F.col("pop") + F.floor(F.col("pop") * (F.floor(F.col("decade").cast("int") / 10) % 5) / 10)).cast("long").alias("pop"))
    jobs = v.seats().select(F.col("state").cast("string").alias("state"), "seats", F.explode(F.array(F.lit("1990"), F.lit("2000"))).alias("decade")).withColumn("kind", F.lit("map")).withColumn("key", F.concat_ws(":", "state", "decade"))
    maps = engine.vintage_runs(cells, past, jobs, 11).maps
    return maps.groupBy("state", "decade").agg(F.count(F.lit(1)).alias("cells"), F.sum("pop").cast("long").alias("pop"), F.count_distinct("district").cast("int").alias("districts"))
