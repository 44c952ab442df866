"""The queries over the virtual census, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import ballots, demography, graph, grid, kernels, metrics, orders, raster, repair, splitline, verify
from ..storage import cut
from .census import SQL, Census

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
Plan = Callable[[Census], DataFrame]


def query(name: str, sql: str | None = None, recursive: bool = False) -> Callable[[Plan], Plan]:
    def add(plan: Plan) -> Plan:
        QUERIES[name] = lambda spark, sf_dir: plan(Census(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = f"WITH {'RECURSIVE ' if recursive else ''}{SQL}{sql}"
        return plan

    return add


# ---------------------------------------------------------------- grid


@query("grid_cells", "SELECT state, r, c, CAST(sum(pop) AS BIGINT) AS pop, count(*) AS blocks FROM block GROUP BY ALL")
def _(v: Census) -> DataFrame:
    return grid.cells(v.blocks())


@query("cell_blocks", "SELECT state, r, c, count(*) AS n, sha256(string_agg(geoid, ',' ORDER BY geoid)) AS sha FROM block WHERE pop > 0 GROUP BY ALL")
def _(v: Census) -> DataFrame:
    return grid.cell_blocks(v.blocks()).select("state", "r", "c", F.size("geoids").cast("long").alias("n"), F.sha2(F.array_join("geoids", ","), 256).alias("sha"))


@query("grid_extent", """, box AS (SELECT state, min(c * 1000.0 + 500) AS x0, max(c * 1000.0 + 500) AS x1, min(r * -1000.0) AS y0, max(r * -1000.0) AS y1 FROM block GROUP BY state),
o AS (SELECT *, floor((x0 - 1609.344::DOUBLE) / 1609.344::DOUBLE) * 1609.344::DOUBLE AS origin_x, ceil((y1 + 1609.344::DOUBLE) / 1609.344::DOUBLE) * 1609.344::DOUBLE AS origin_y_top FROM box)
SELECT state, origin_x, origin_y_top, CAST(ceil((origin_y_top - (y0 - 1609.344::DOUBLE)) / 1609.344::DOUBLE) AS INTEGER) AS rows,
CAST(ceil((x1 + 1609.344::DOUBLE - origin_x) / 1609.344::DOUBLE) AS INTEGER) AS cols FROM o""".replace("1000.0", "1000.0::DOUBLE"))
def _(v: Census) -> DataFrame:
    return grid.extent(v.blocks().select("state", (F.col("c") * 1000.0 + 500).alias("x"), (F.col("r") * -1000.0).alias("y")))


@query("bin_points", """, p AS (SELECT state, c * 1000.0::DOUBLE + 500 AS x, r * -1000.0::DOUBLE AS y, pop FROM block),
box AS (SELECT state, floor((min(x) - 1609.344::DOUBLE) / 1609.344::DOUBLE) * 1609.344::DOUBLE AS ox, ceil((max(y) + 1609.344::DOUBLE) / 1609.344::DOUBLE) * 1609.344::DOUBLE AS oy FROM p GROUP BY state)
SELECT state, CAST(floor((oy - y) / 1609.344::DOUBLE) AS INTEGER) AS r, CAST(floor((x - ox) / 1609.344::DOUBLE) AS INTEGER) AS c, CAST(sum(pop) AS BIGINT) AS pop, count(*) AS blocks FROM p JOIN box USING (state) GROUP BY ALL""")
def _(v: Census) -> DataFrame:
    points = v.blocks().select("state", (F.col("c") * 1000.0 + 500).alias("x"), (F.col("r") * -1000.0).alias("y"), "pop")
    return grid.cells(grid.bin_points(points, grid.extent(points)).select("state", "r", "c", "pop"))


@query("conservation", ", g AS (SELECT state, CAST(sum(pop) AS BIGINT) AS pop FROM grid GROUP BY state) SELECT state, pop, resident_pop, pop = resident_pop AS ok FROM resident JOIN g USING (state)")
def _(v: Census) -> DataFrame:
    return grid.conservation(v.grid(), v.resident())


EDGES = ", edge AS (SELECT a.state, a.r, a.c, b.r AS nr, b.c AS nc FROM grid a JOIN grid b ON a.state = b.state AND abs(a.r - b.r) + abs(a.c - b.c) = 1)"


@query("neighbour_edges", EDGES + " SELECT * FROM edge")
def _(v: Census) -> DataFrame:
    return grid.neighbour_edges(v.grid())


@query("boundary_cells", EDGES + ", n AS (SELECT state, r, c, count(*) AS k FROM edge GROUP BY ALL) SELECT state, r, c, CAST(coalesce(k, 0) AS INTEGER) AS neighbours FROM grid LEFT JOIN n USING (state, r, c) WHERE coalesce(k, 0) < 4")
def _(v: Census) -> DataFrame:
    return grid.boundary(v.grid())


@query("in_state_cells", " SELECT DISTINCT state, r, c FROM (SELECT state, r, c FROM grid WHERE pop % 3 = 0 UNION ALL SELECT state, r, c FROM grid WHERE r % 2 = 0)")
def _(v: Census) -> DataFrame:
    return grid.in_state(v.grid().where("pop % 3 = 0"), v.grid().where("r % 2 = 0"))


@query("state_extremes", " SELECT state, CAST(max(pop) AS BIGINT) AS max_cell, round(max(pop) / any_value(ideal), 9) AS share FROM grid JOIN ideal USING (state) GROUP BY state")
def _(v: Census) -> DataFrame:
    m = v.grid().groupBy("state").agg(F.max("pop").alias("max_cell"))
    return m.join(F.broadcast(v.ideal()), "state").select("state", "max_cell", F.round(F.col("max_cell") / F.col("ideal"), 9).alias("share"))


@query("block_probe", " SELECT state, count(*) AS n, CAST(count_if(pop > 0) AS BIGINT) AS populated, CAST(sum(pop) AS BIGINT) AS total, max(pop) AS largest FROM block GROUP BY state")
def _(v: Census) -> DataFrame:
    return v.blocks().groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pop") > 0).alias("populated"), F.sum("pop").cast("long").alias("total"), F.max("pop").alias("largest"))


# ---------------------------------------------------------------- splitline


def _splitline_sql(levels: int) -> str:
    """Levels of cuts as CTEs: g0 .. g(levels) are the regions, b1 .. the cuts."""
    out = ", g0 AS (SELECT state, r, c, pop, 0 AS seat_lo, seats AS s FROM grid JOIN seats USING (state))"
    key = "CASE fam WHEN 0 THEN {0}c WHEN 1 THEN {0}r WHEN 2 THEN {0}r + {0}c ELSE {0}r - {0}c END"
    for n in range(1, levels + 1):
        g = f"g{n - 1}"
        out += f""", z{n} AS (SELECT *, count(*) OVER (PARTITION BY state, seat_lo, s) AS n FROM {g}), w{n} AS (SELECT * FROM z{n} WHERE s >= 2 AND n > s),
f{n} AS (SELECT *, {key.format("")} AS k FROM w{n}, (VALUES (0), (1), (2), (3)) x(fam)),
k{n} AS (SELECT state, seat_lo, s, fam, k, CAST(sum(pop) AS BIGINT) AS pop FROM f{n} GROUP BY ALL),
p{n} AS (SELECT *, sum(pop) OVER (PARTITION BY state, seat_lo, s, fam ORDER BY k) AS prefix, max(k) OVER (PARTITION BY state, seat_lo, s, fam) AS last,
    sum(pop) OVER (PARTITION BY state, seat_lo, s, fam) AS whole FROM k{n}),
e{n} AS (SELECT a.state, a.seat_lo, a.s, fam, least({key.format("a.")}, {key.format("b.")}) AS k, count(*) AS cut_len FROM w{n} a JOIN w{n} b
    ON a.state = b.state AND a.seat_lo = b.seat_lo AND a.s = b.s AND ((b.r = a.r AND b.c = a.c + 1) OR (b.r = a.r + 1 AND b.c = a.c)), (VALUES (0), (1), (2), (3)) x(fam)
    WHERE {key.format("a.")} <> {key.format("b.")} GROUP BY ALL),
q{n} AS (SELECT state, seat_lo, s, fam, k AS t, abs(prefix - (floor(s / 2) / s) * whole) AS err, coalesce(cut_len, 0) AS cut_len FROM p{n} LEFT JOIN e{n} USING (state, seat_lo, s, fam, k) WHERE k < last),
b{n} AS (SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY state, seat_lo, s ORDER BY err, cut_len, fam, t) AS place FROM q{n}) WHERE place = 1),
g{n} AS (SELECT state, r, c, pop, seat_lo, s FROM z{n} WHERE s < 2
    UNION ALL SELECT state, r, c, pop, CAST(seat_lo + row_number() OVER (PARTITION BY state, seat_lo, s ORDER BY r, c) - 1 AS INTEGER), 1 FROM z{n} WHERE s >= 2 AND n <= s
    UNION ALL SELECT state, r, c, pop, CAST(CASE WHEN {key.format("")} <= t THEN seat_lo ELSE seat_lo + floor(s / 2) END AS INTEGER), CAST(CASE WHEN {key.format("")} <= t THEN floor(s / 2) ELSE s - floor(s / 2) END AS INTEGER)
    FROM w{n} JOIN b{n} USING (state, seat_lo, s))"""
    return out


@query("cut_candidates", _splitline_sql(1) + " SELECT state, seat_lo, s, fam, t, err, CAST(cut_len AS BIGINT) AS cut_len FROM q1")
def _(v: Census) -> DataFrame:
    return splitline.cut_candidates(splitline.start(v.grid(), v.seats()))


@query("best_cut", _splitline_sql(1) + " SELECT state, seat_lo, s, err, CAST(cut_len AS BIGINT) AS cut_len, fam, t FROM b1")
def _(v: Census) -> DataFrame:
    return splitline.best_cuts(splitline.cut_candidates(splitline.start(v.grid(), v.seats())))


def _levels(v: Census, n: int) -> DataFrame:
    g = splitline.start(v.grid(), v.seats())
    for _ in range(n):
        g = cut(splitline.level(g)[0], "splitline")
    return g.select("state", "r", "c", "pop", "seat_lo", "s")


for _n in (1, 2, 3):
    query(f"splitline_l{_n}", _splitline_sql(_n) + f" SELECT state, r, c, pop, seat_lo, s FROM g{_n}")(lambda v, n=_n: _levels(v, n))


@query("cut_trace", _splitline_sql(4) + " " + " UNION ALL ".join(f"SELECT {n} AS level, state, seat_lo, s, fam, t, err, CAST(cut_len AS BIGINT) AS cut_len FROM b{n}" for n in range(1, 5)))
def _(v: Census) -> DataFrame:
    _, cuts = splitline.splitline(v.grid(), v.seats(), 11, cut)
    out = None
    for n, made in enumerate(cuts, 1):
        own = made.select(F.lit(n).alias("level"), "state", "seat_lo", "s", "fam", "t", "err", "cut_len")
        out = own if out is None else out.unionByName(own)
    return out


DISTRICTS = _splitline_sql(4) + ", district AS (SELECT state, r, c, pop, CAST(seat_lo + 1 AS INTEGER) AS district FROM g4)"


def districts(v: Census) -> DataFrame:
    return splitline.splitline(v.grid(), v.seats(), 11, cut)[0]


@query("splitline", DISTRICTS + " SELECT * FROM district")
def _(v: Census) -> DataFrame:
    return districts(v)


@query("anchors", DISTRICTS + " SELECT state, district, CAST(floor(min(r * 100000 + c) / 100000) AS INTEGER) AS r, CAST(min(r * 100000 + c) % 100000 AS INTEGER) AS c FROM district GROUP BY state, district")
def _(v: Census) -> DataFrame:
    return splitline.anchors(districts(v))


# ---------------------------------------------------------------- metrics


def _stats_sql(source: str, name: str = "stats") -> str:
    return f""", i_{name} AS (SELECT a.state, a.district, count(*) AS inner_ FROM {source} a JOIN {source} b ON a.state = b.state AND a.district = b.district AND abs(a.r - b.r) + abs(a.c - b.c) = 1 GROUP BY ALL),
d_{name} AS (SELECT state, district, CAST(sum(pop) AS BIGINT) AS pop, count(*) AS cells, max(c) - min(c) + 1 AS w, max(r) - min(r) + 1 AS h FROM {source} GROUP BY ALL),
x_{name} AS (SELECT d.*, 4 * cells - coalesce(inner_, 0) AS exposed, ideal FROM d_{name} d LEFT JOIN i_{name} USING (state, district) JOIN ideal USING (state)),
y_{name} AS (SELECT state, district, pop, cells, exposed, (pop - ideal) / ideal * 100 AS deviation_pct, ((4 * pi()) * cells / (exposed * exposed)) / (pi() / 4) AS ppn,
    greatest(w, h) / least(w, h) AS aspect, cells / (w * h) AS fill FROM x_{name}),
{name} AS (SELECT *, ppn < 0.45 OR aspect > 2 OR fill < 0.45 AS irregular FROM y_{name})"""


@query("district_stats", DISTRICTS + _stats_sql("district") + " SELECT * FROM stats")
def _(v: Census) -> DataFrame:
    return metrics.district_stats(districts(v), v.ideal())


@query("band_stats", _stats_sql("bands") + " SELECT * FROM stats")
def _(v: Census) -> DataFrame:
    return metrics.district_stats(v.bands(), v.ideal())


ARMS = DISTRICTS + _stats_sql("district") + _stats_sql("bands", "bstats") + """, arms AS (SELECT 'splitline' AS arm, * FROM stats UNION ALL SELECT 'bands', * FROM bstats),
named AS (SELECT * REPLACE (CASE state WHEN 0 THEN 'CO' WHEN 1 THEN 'NY' ELSE 'S' || state END AS state), state AS n FROM arms),
cellarm AS (SELECT 'splitline' AS arm, * FROM district UNION ALL SELECT 'bands', state, r, c, pop, district FROM bands),
reach AS (SELECT arm, state, district, r, c, r AS r0, c AS c0 FROM cellarm UNION SELECT b.arm, b.state, b.district, b.r, b.c, a.r0, a.c0 FROM reach a JOIN cellarm b ON a.arm = b.arm AND a.state = b.state AND a.district = b.district AND abs(a.r - b.r) + abs(a.c - b.c) = 1),
lab AS (SELECT arm, state, district, r, c, min(r0 * 1000 + c0) AS k FROM reach GROUP BY ALL),
piece AS (SELECT arm, state, district, k, count(*) AS n, sum(pop) AS p FROM lab JOIN cellarm USING (arm, state, district, r, c) GROUP BY ALL),
loose AS (SELECT arm, state, max(q) = 1 AS contiguous, CAST(sum(CASE WHEN q > 1 THEN n ELSE 0 END) AS BIGINT) AS repair_moves FROM (SELECT *, row_number() OVER (PARTITION BY arm, state, district ORDER BY p DESC, n DESC, k) AS q FROM piece) GROUP BY ALL),
score0 AS (SELECT named.state, named.arm, max(abs(deviation_pct)) AS max_abs_dev_pct, avg(abs(deviation_pct)) AS mean_abs_dev_pct, CAST(count_if(irregular) AS INTEGER) AS irregular_count,
    avg(ppn) AS mean_ppn, CAST(count(*) AS INTEGER) AS districts, 3 + 2 * any_value(n) AS seats, any_value(contiguous) AS g2_contiguity, any_value(repair_moves) AS repair_moves FROM named JOIN loose ON loose.state = n AND loose.arm = named.arm GROUP BY named.state, named.arm),
score1 AS (SELECT * EXCLUDE (seats), CASE WHEN max_abs_dev_pct <= CASE state WHEN 'CO' THEN 1.0 ELSE 2.0 END THEN 'pass' WHEN state IN ('NY', 'CA', 'IL', 'NJ') THEN 'flag' ELSE 'fail' END AS g1_population, districts = seats AS g4_coverage FROM score0),
score AS (SELECT *, g1_population <> 'fail' AND g2_contiguity AND g4_coverage AS eligible, concat_ws('+', CASE g1_population WHEN 'fail' THEN 'G1-population' WHEN 'flag' THEN 'G1-flagged-not-failed' END, CASE WHEN NOT g2_contiguity THEN 'G2-contiguity' END, CASE WHEN NOT g4_coverage THEN 'G4-coverage' END) AS said FROM score1)"""
_scores = ["state", "arm", "irregular_count", "districts", "repair_moves", "g1_population", "g2_contiguity", "g4_coverage", "eligible"]


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("state", F.when(F.col("state") == 0, "CO").when(F.col("state") == 1, "NY").otherwise(F.concat(F.lit("S"), F.col("state").cast("string"))))


def _scored(v: Census) -> DataFrame:
    """Both arms from one census: grid, districts and ideals are made once."""
    cells = cut(v.grid(), "grid")
    ideal = F.broadcast(cells.groupBy("state").agg(F.sum("pop").alias("p")).join(v.seats(), "state").select("state", (F.col("p") / F.col("seats")).alias("ideal")))
    cut_up = splitline.splitline(cells, v.seats(), 11, cut)[0]
    both = cut_up.withColumn("arm", F.lit("splitline")).unionByName(v.bands(cells).withColumn("arm", F.lit("bands")))
    both = cut(both.withColumn("state", F.concat_ws("|", "state", "arm")).drop("arm"), "arms")
    parts = lambda df: df.withColumn("arm", F.element_at(F.split("state", "[|]"), 2)).withColumn("state", F.element_at(F.split("state", "[|]"), 1).cast("int"))
    each = ideal.crossJoin(F.broadcast(v.spark.createDataFrame([("splitline",), ("bands",)], "arm string"))).select(F.concat_ws("|", "state", "arm").alias("state"), "ideal")
    stats = parts(metrics.district_stats(both, each))
    loose = parts(metrics.detached(graph.components(both, "district")))
    whole = loose.select("state", "arm", F.col("whole").alias("contiguous"))
    return metrics.scores(_named(stats), _named(v.seats()), _named(whole), _named(loose.select("state", "arm", F.col("cells").alias("repair_moves"))))


@query("scores", ARMS + f""" SELECT {", ".join(_scores)}, round(max_abs_dev_pct, 6) AS max_abs_dev_pct, round(mean_abs_dev_pct, 6) AS mean_abs_dev_pct, round(mean_ppn, 6) AS mean_ppn,
CASE said WHEN '' THEN 'none' ELSE said END AS gate_failures FROM score""", recursive=True)
def _(v: Census) -> DataFrame:
    return _scored(v).select(*_scores, *[F.round(c, 6).alias(c) for c in ("max_abs_dev_pct", "mean_abs_dev_pct", "mean_ppn")], "gate_failures")


@query("arm_rank", ARMS + " SELECT state, arm, row_number() OVER (PARTITION BY state ORDER BY eligible DESC, irregular_count, mean_ppn DESC, repair_moves, max_abs_dev_pct, arm) AS arm_rank FROM score", recursive=True)
def _(v: Census) -> DataFrame:
    return metrics.rank_arms(_scored(v)).select("state", "arm", "arm_rank")


@query("gate_policy", """, x AS (SELECT n_name AS name, CASE n_nationkey % 5 WHEN 0 THEN 'CO' WHEN 1 THEN 'NY' WHEN 2 THEN 'CA' WHEN 3 THEN 'RI' ELSE 'TX' END AS state, (n_nationkey % 7) * 0.5 AS dev FROM nation)
SELECT name, state, CASE WHEN dev <= CASE state WHEN 'CO' THEN 1.0 ELSE 2.0 END THEN 'pass' WHEN state IN ('NY', 'CA', 'IL', 'NJ') THEN 'flag' ELSE 'fail' END AS verdict FROM x""")
def _(v: Census) -> DataFrame:
    k = F.col("n_nationkey") % 5
    state = F.when(k == 0, "CO").when(k == 1, "NY").when(k == 2, "CA").when(k == 3, "RI").otherwise("TX")
    x = v.table("nation").select(F.col("n_name").alias("name"), state.alias("state"), ((F.col("n_nationkey") % 7) * 0.5).alias("dev"))
    return x.select("name", "state", metrics.population_verdict(F.col("state"), F.col("dev")).alias("verdict"))


ADJACENT = DISTRICTS + ", touch AS (SELECT DISTINCT a.state, a.district, b.district AS other FROM district a JOIN district b ON a.state = b.state AND abs(a.r - b.r) + abs(a.c - b.c) = 1 AND a.district <> b.district)"


@query("district_adjacency", ADJACENT + " SELECT * FROM touch")
def _(v: Census) -> DataFrame:
    return metrics.district_adjacency(districts(v))


@query("neediest_neighbour", ADJACENT + ", p AS (SELECT state, district AS other, sum(pop) AS pop FROM district GROUP BY ALL), m AS (SELECT t.state, t.district, t.other, row_number() OVER (PARTITION BY t.state, t.district ORDER BY pop, t.other) AS k FROM touch t JOIN p USING (state, other)) SELECT state, district, other AS target FROM m WHERE k = 1")
def _(v: Census) -> DataFrame:
    d = cut(districts(v), "districts")
    return metrics.neediest_neighbour(metrics.district_adjacency(d), d.groupBy("state", "district").agg(F.sum("pop").alias("pop")))


# ---------------------------------------------------------------- verification


def _damaged(v: Census) -> DataFrame:
    """The bands with a few cells missing, doubled and added."""
    b = v.bands()
    return b.where("(r + c) % 17 <> 0").unionByName(b.where("(r + 2 * c) % 29 = 0")).unionByName(b.where("r % 13 = 0").withColumn("c", F.col("c") + 100))


DAMAGED = ", damaged AS (SELECT * FROM bands WHERE (r + c) % 17 <> 0 UNION ALL SELECT * FROM bands WHERE (r + 2 * c) % 29 = 0 UNION ALL SELECT * REPLACE (c + 100 AS c) FROM bands WHERE r % 13 = 0)"


@query("coverage_missing", DAMAGED + " SELECT state, r, c FROM grid ANTI JOIN damaged USING (state, r, c)")
def _(v: Census) -> DataFrame:
    return verify.missing_cells(v.grid(), _damaged(v))


@query("coverage_extra", DAMAGED + " SELECT state, r, c FROM damaged ANTI JOIN grid USING (state, r, c)")
def _(v: Census) -> DataFrame:
    return verify.extra_cells(v.grid(), _damaged(v))


@query("coverage_dups", DAMAGED + " SELECT state, r, c, count(*) AS n FROM damaged GROUP BY ALL HAVING count(*) > 1")
def _(v: Census) -> DataFrame:
    return verify.duplicate_cells(_damaged(v))


@query("empty_districts", ", want AS (SELECT state, CAST(unnest(range(1, seats + 1)) AS INTEGER) AS district FROM seats) SELECT * FROM want ANTI JOIN bands USING (state, district)")
def _(v: Census) -> DataFrame:
    return verify.empty_districts(v.bands(), v.seats())


@query("first_offenders", DAMAGED + """, o AS (SELECT state, r, c FROM damaged ANTI JOIN grid USING (state, r, c)), k AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY r, c) AS k FROM o)
SELECT state, count(*) AS total, string_agg(r || ',' || c, ' ' ORDER BY k) FILTER (WHERE k <= 5) AS sample FROM k GROUP BY state""")
def _(v: Census) -> DataFrame:
    return verify.first_offenders(verify.extra_cells(v.grid(), _damaged(v)))


LINES = ", lines AS (SELECT CAST(floor((o_custkey % 40) / 8) AS INTEGER) AS state, o_orderkey AS line, CAST(floor(o_custkey / 40) AS INTEGER) AS r, CAST(o_custkey % 40 AS INTEGER) AS c FROM orders)"


@query("order_violations", LINES + ", b AS (SELECT *, lag(r) OVER w AS br, lag(c) OVER w AS bc FROM lines WINDOW w AS (PARTITION BY state ORDER BY line)) SELECT state, line, r, c FROM b WHERE br IS NOT NULL AND (r < br OR (r = br AND c <= bc))")
def _(v: Census) -> DataFrame:
    k = F.col("o_custkey")
    lines = v.table("orders").select(F.floor((k % 40) / 8).cast("int").alias("state"), F.col("o_orderkey").alias("line"), F.floor(k / 40).cast("int").alias("r"), (k % 40).cast("int").alias("c"))
    return verify.order_violations(lines)


@query("stats_diff", _stats_sql("bands") + """, rep AS (SELECT * REPLACE (CASE WHEN district = 2 THEN pop + 1 ELSE pop END AS pop) FROM stats WHERE NOT (state = 4 AND district = 3)),
z AS (SELECT s.state, s.district, unnest([{'column': 'pop', 'derived': CAST(s.pop AS DOUBLE), 'reported': CAST(rep.pop AS DOUBLE)}, {'column': 'cells', 'derived': CAST(s.cells AS DOUBLE), 'reported': CAST(rep.cells AS DOUBLE)}]) AS x FROM stats s FULL JOIN rep USING (state, district))
SELECT state, district, x.column, x.derived, x.reported FROM z WHERE NOT coalesce(abs(x.derived - x.reported) <= 1e-9, false)""")
def _(v: Census) -> DataFrame:
    s = metrics.district_stats(v.bands(), v.ideal())
    reported = s.where("not (state = 4 and district = 3)").withColumn("pop", F.when(F.col("district") == 2, F.col("pop") + 1).otherwise(F.col("pop")))
    return verify.stats_diff(s, reported, ["pop", "cells"])


@query("verify_population", _stats_sql("bands") + """, csv AS (SELECT state, CAST(sum(pop) AS BIGINT) AS csv_pop FROM bands GROUP BY state), d AS (SELECT state, CAST(sum(pop) AS BIGINT) AS district_pop, max(abs(deviation_pct)) AS m FROM stats GROUP BY state),
w AS (SELECT state, min(district) AS worst_district FROM stats JOIN d USING (state) WHERE abs(deviation_pct) = m GROUP BY state)
SELECT state, csv_pop, district_pop, resident_pop, m AS max_abs_dev_pct, worst_district, csv_pop = district_pop AND csv_pop = resident_pop AS ok FROM csv JOIN d USING (state) JOIN resident USING (state) JOIN w USING (state)""")
def _(v: Census) -> DataFrame:
    return verify.population(v.bands(), metrics.district_stats(v.bands(), v.ideal()), v.resident())


@query("unknown_geoids", ", cb AS (SELECT state, geoid || CASE WHEN pop % 97 = 0 THEN 'x' ELSE '' END AS geoid FROM block WHERE pop > 0) SELECT state, geoid FROM cb ANTI JOIN block USING (state, geoid)")
def _(v: Census) -> DataFrame:
    b = v.blocks()
    changed = b.withColumn("geoid", F.concat("geoid", F.when(F.col("pop") % 97 == 0, "x").otherwise("")))
    return verify.unknown_geoids(grid.cell_blocks(changed), b)


@query("unbacked_cells", DAMAGED + " SELECT state, r, c, pop FROM damaged ANTI JOIN (SELECT state, r, c FROM block WHERE pop > 0) USING (state, r, c) WHERE pop > 0")
def _(v: Census) -> DataFrame:
    return verify.unbacked_cells(_damaged(v), grid.cell_blocks(v.blocks()))


@query("fingerprint", " SELECT state, sha256('row,col,district,pop' || chr(10) || string_agg(r || ',' || c || ',' || district || ',' || pop, chr(10) ORDER BY r, c) || chr(10)) AS sha256 FROM bands GROUP BY state")
def _(v: Census) -> DataFrame:
    return verify.fingerprint(v.bands())


# ---------------------------------------------------------------- graph

REACH = ", reach AS (SELECT state, r, c, r AS r0, c AS c0 FROM island WHERE r = 0 OR c % 11 = 6 UNION SELECT b.state, b.r, b.c, a.r0, a.c0 FROM reach a JOIN island b ON a.state = b.state AND abs(a.r - b.r) + abs(a.c - b.c) = 1)"
COMPONENT = REACH + ", comp AS (SELECT island.state, island.r, island.c, pop, CAST(floor(min(r0 * 1000 + c0) / 1000) AS INTEGER) AS comp_r, CAST(min(r0 * 1000 + c0) % 1000 AS INTEGER) AS comp_c FROM island JOIN reach USING (state, r, c) GROUP BY ALL)"


@query("components", COMPONENT + " SELECT * FROM comp", recursive=True)
def _(v: Census) -> DataFrame:
    return graph.components(v.island())


@query("bridges", COMPONENT + """, size AS (SELECT state, comp_r, comp_c, row_number() OVER (PARTITION BY state ORDER BY count(*) DESC, comp_r, comp_c) AS k FROM comp GROUP BY state, comp_r, comp_c),
n AS (SELECT a.state, a.r, a.c, count(*) AS k FROM island a JOIN island b ON a.state = b.state AND abs(a.r - b.r) + abs(a.c - b.c) = 1 GROUP BY ALL),
e AS (SELECT comp.*, size.k FROM comp JOIN size USING (state, comp_r, comp_c) LEFT JOIN n USING (state, r, c) WHERE coalesce(n.k, 0) < 4),
pair AS (SELECT a.state, a.comp_r, a.comp_c, a.r AS ar, a.c AS ac, b.r AS br, b.c AS bc, (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) AS d2 FROM e a JOIN e b ON a.state = b.state WHERE a.k > 1 AND b.k = 1)
SELECT state, ar, ac, br, bc, d2 FROM (SELECT *, row_number() OVER (PARTITION BY state, comp_r, comp_c ORDER BY d2, ar, ac, br, bc) AS p FROM pair) WHERE p = 1""", recursive=True)
def _(v: Census) -> DataFrame:
    return graph.bridges(graph.components(v.island()))


@query("contiguity", ", ib AS (SELECT * FROM bands WHERE c % 11 <> 5 AND r % 19 <> 7), reach AS (SELECT state, district, r, c, r AS r0, c AS c0 FROM ib UNION SELECT b.state, b.district, b.r, b.c, a.r0, a.c0 FROM reach a JOIN ib b ON a.state = b.state AND a.district = b.district AND abs(a.r - b.r) + abs(a.c - b.c) = 1), comp AS (SELECT state, district, r, c, min(r0 * 1000 + c0) AS k FROM reach GROUP BY ALL) SELECT state, district, count(DISTINCT k) AS pieces, count(DISTINCT k) = 1 AS ok FROM comp GROUP BY state, district", recursive=True)
def _(v: Census) -> DataFrame:
    return graph.contiguity(graph.components(v.bands(v.grid().where("c % 11 <> 5 and r % 19 <> 7")), "district"))


# ---------------------------------------------------------------- orders and kernels


def _hilbert_sql(side: int) -> str:
    out, prev = ", h0 AS (SELECT *, CAST(c AS BIGINT) AS x, CAST(r AS BIGINT) AS y, CAST(0 AS BIGINT) AS d FROM grid)", "h0"
    s, n = side // 2, 1
    while s:
        out += f""", b{n} AS (SELECT *, CASE WHEN x & {s} > 0 THEN 1 ELSE 0 END AS rx, CASE WHEN y & {s} > 0 THEN 1 ELSE 0 END AS ry FROM {prev}),
h{n} AS (SELECT state, r, c, pop, CASE WHEN ry = 1 THEN x WHEN rx = 1 THEN {s - 1} - y ELSE y END AS x, CASE WHEN ry = 1 THEN y WHEN rx = 1 THEN {s - 1} - x ELSE x END AS y, d + {s * s} * xor(3 * rx, ry) AS d FROM b{n})"""
        prev, s, n = f"h{n}", s // 2, n + 1
    return out + f", hil AS (SELECT state, r, c, pop, d AS key, row_number() OVER (PARTITION BY state ORDER BY d, r, c) - 1 AS ord FROM {prev})"


SIDE = 1024


@query("hilbert_order", _hilbert_sql(SIDE) + " SELECT state, r, c, key, ord FROM hil")
def _(v: Census) -> DataFrame:
    return orders.hilbert_order(v.grid(), SIDE).select("state", "r", "c", "key", "ord")


def _greedy_sql(ordered: str) -> str:
    return f""", walk AS (SELECT o.state, o.ord, 1 AS d, CAST(o.pop AS BIGINT) AS p, CAST(resident_pop AS BIGINT) AS rest, seats FROM {ordered} o JOIN seats USING (state) JOIN resident USING (state) WHERE ord = 0
UNION ALL SELECT o.state, o.ord, CASE WHEN w.d = w.seats OR w.p = 0 OR abs(w.p + o.pop - w.rest / (w.seats - w.d + 1)) <= abs(w.p - w.rest / (w.seats - w.d + 1)) THEN w.d ELSE w.d + 1 END,
CASE WHEN w.d = w.seats OR w.p = 0 OR abs(w.p + o.pop - w.rest / (w.seats - w.d + 1)) <= abs(w.p - w.rest / (w.seats - w.d + 1)) THEN w.p + o.pop ELSE o.pop END,
CASE WHEN w.d = w.seats OR w.p = 0 OR abs(w.p + o.pop - w.rest / (w.seats - w.d + 1)) <= abs(w.p - w.rest / (w.seats - w.d + 1)) THEN w.rest ELSE w.rest - w.p END, w.seats FROM walk w JOIN {ordered} o ON o.state = w.state AND o.ord = w.ord + 1)
SELECT o.state, r, c, pop, CAST(d AS INTEGER) AS district FROM walk JOIN {ordered} o USING (state, ord)"""


@query("hilbert_cut", _hilbert_sql(SIDE).replace(", hil AS (", ", hil AS MATERIALIZED (") + _greedy_sql("hil"), recursive=True)
def _(v: Census) -> DataFrame:
    return kernels.cut_along_order(orders.hilbert_order(v.grid(), SIDE), v.seats())


@query("serpentine_order", """, k AS (SELECT state, greatest(1, floor(sqrt(any_value(ideal) / (sum(pop) / count(*))) + 0.5)) AS k0 FROM grid JOIN ideal USING (state) GROUP BY state), b AS (SELECT g.*, floor(c / k0) AS band FROM grid g JOIN k USING (state))
SELECT state, r, c, row_number() OVER (PARTITION BY state ORDER BY band, CASE WHEN band % 2 = 0 THEN r ELSE -r END, c) - 1 AS ord FROM b""")
def _(v: Census) -> DataFrame:
    return orders.serpentine_order(v.grid(), orders.band_width(v.grid(), v.ideal())).select("state", "r", "c", "ord")


@query("centre_order", ", m AS (SELECT state, avg(r) AS mr, avg(c) AS mc FROM grid GROUP BY state) SELECT state, r, c, row_number() OVER (PARTITION BY state ORDER BY (r - mr) * (r - mr) + (c - mc) * (c - mc), r, c) - 1 AS ord FROM grid JOIN m USING (state)")
def _(v: Census) -> DataFrame:
    return orders.centre_order(v.grid()).select("state", "r", "c", "ord")


@query("accretion_west")
def _(v: Census) -> DataFrame:
    return kernels.grow(orders.serpentine_order(v.grid(), orders.band_width(v.grid(), v.ideal())), v.seats())


@query("accretion_centre")
def _(v: Census) -> DataFrame:
    return kernels.grow(orders.centre_order(v.grid()), v.seats())


@query("repair_hilbert")
def _(v: Census) -> DataFrame:
    island = v.island()
    links = graph.bridges(graph.components(island)).drop("d2")
    return repair.repair_all(kernels.cut_along_order(orders.hilbert_order(island, SIDE), v.seats()), v.seats(), links)


@query("repair_splitline")
def _(v: Census) -> DataFrame:
    return repair.repair_all(districts(v), v.seats())


# ---------------------------------------------------------------- demography

COUNTY = ", cc AS (SELECT state, r, c, county, CAST(sum(pop) AS BIGINT) AS pop FROM block GROUP BY ALL), base AS (SELECT state, county, CAST(sum(pop) AS BIGINT) AS pop FROM block GROUP BY ALL), vint AS (SELECT state, county, pop + pop * (CAST(county AS INTEGER) % 7) // 10 AS pop FROM base WHERE CAST(county AS INTEGER) % 13 <> 0)"
RATIO = COUNTY + ", r0 AS (SELECT b.state, b.county, b.pop, v.pop AS t, CASE WHEN b.pop > 0 THEN v.pop / b.pop END AS ratio FROM base b LEFT JOIN vint v USING (state, county)), rs AS (SELECT state, coalesce(sum(t) FILTER (WHERE t IS NOT NULL) / nullif(sum(pop) FILTER (WHERE t IS NOT NULL), 0), 1.0) AS state_ratio FROM r0 GROUP BY state), ratios AS (SELECT state, county, pop, ratio, state_ratio FROM r0 JOIN rs USING (state))"


def _counties(v: Census) -> tuple[DataFrame, DataFrame]:
    cells = v.blocks().groupBy("state", "r", "c", "county").agg(F.sum("pop").cast("long").alias("pop"))
    base = v.blocks().groupBy("state", "county").agg(F.sum("pop").cast("long").alias("pop"))
    k = F.col("county").cast("int")
    vintage = base.where(k % 13 != 0).select("state", "county", (F.col("pop") + F.floor(F.col("pop") * (k % 7) / 10)).alias("pop"))
    return cells, demography.county_ratios(base, vintage)


@query("county_cell_pop", COUNTY + " SELECT * FROM cc")
def _(v: Census) -> DataFrame:
    return _counties(v)[0]


@query("county_ratios", RATIO + " SELECT * FROM ratios")
def _(v: Census) -> DataFrame:
    return _counties(v)[1]


@query("rescale", RATIO + " SELECT state, r, c, CAST(floor(sum(cc.pop * coalesce(ratio, state_ratio)) + 0.5) AS BIGINT) AS pop FROM cc JOIN ratios USING (state, county) GROUP BY state, r, c")
def _(v: Census) -> DataFrame:
    cells, ratios = _counties(v)
    return demography.rescale(cells, ratios)


@query("coverage_ratio", RATIO + " SELECT state, floor(coalesce(sum(pop) FILTER (WHERE ratio IS NOT NULL), 0) / sum(pop) * 10000 + 0.5) / 10000 AS coverage FROM ratios GROUP BY state")
def _(v: Census) -> DataFrame:
    return demography.coverage(_counties(v)[1])


@query("coverage_median", RATIO + " SELECT state, min(ratio) AS low, list_sort(list(ratio))[CAST(floor(count(*) / 2) + 1 AS INTEGER)] AS median FROM ratios WHERE ratio IS NOT NULL GROUP BY state")
def _(v: Census) -> DataFrame:
    return demography.upper_median(_counties(v)[1], "ratio", "state")


NATIONS = ", np AS (SELECT n_name AS state, CAST(sum(floor(c_acctbal * c_acctbal / 1000)) AS BIGINT) + 1 AS pop, CAST(sum(floor(abs(c_acctbal))) AS BIGINT) + 1 AS pop2 FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name)"


def _apportion_sql(pop: str, name: str) -> str:
    return f", pr_{name} AS (SELECT state, {pop} AS p, {pop} / sqrt(CAST(n * (n + 1) AS DOUBLE)) AS priority FROM np, range(1, 76) x(n)), top_{name} AS (SELECT * FROM pr_{name} ORDER BY priority DESC, p DESC, state LIMIT 75), {name} AS (SELECT state, {pop} AS pop, CAST(1 + (SELECT count(*) FROM top_{name} t WHERE t.state = np.state) AS INTEGER) AS seats FROM np)"


def _nations(v: Census) -> DataFrame:
    c = v.table("customer").join(F.broadcast(v.table("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    a = F.col("c_acctbal")
    return c.groupBy(F.col("n_name").alias("state")).agg((F.sum(F.floor(a * a / 1000)).cast("long") + 1).alias("pop"), (F.sum(F.floor(F.abs(a))).cast("long") + 1).alias("pop2"))


@query("apportion", NATIONS + _apportion_sql("pop", "ap") + " SELECT * FROM ap")
def _(v: Census) -> DataFrame:
    return demography.apportion(cut(_nations(v).select("state", "pop"), "nations"), 100)


@query("seat_changes", NATIONS + _apportion_sql("pop", "ap") + _apportion_sql("pop2", "aq") + " SELECT state, CAST(aq.seats - ap.seats AS INTEGER) AS delta FROM ap JOIN aq USING (state) WHERE ap.seats <> aq.seats")
def _(v: Census) -> DataFrame:
    n = cut(_nations(v), "nations")
    return demography.seat_changes(demography.apportion(n.select("state", "pop"), 100), demography.apportion(n.select("state", F.col("pop2").alias("pop")), 100))


@query("growth_top3", NATIONS + ", g AS (SELECT state, (pop2 - pop) / pop * 100 AS pct FROM np), k AS (SELECT *, row_number() OVER (ORDER BY pct DESC, state) AS up, row_number() OVER (ORDER BY pct, state) AS down FROM g) SELECT 'fastest' AS side, up AS place, state, pct FROM k WHERE up <= 3 UNION ALL SELECT 'slowest', down, state, pct FROM k WHERE down <= 3")
def _(v: Census) -> DataFrame:
    return demography.growth(_nations(v), "pop", "pop2")


@query("drift", NATIONS + ", d AS (SELECT state, abs(pop2 - pop) / pop * 100 AS d FROM np) SELECT d AS max_drift_pct, state FROM d ORDER BY d DESC, state LIMIT 1")
def _(v: Census) -> DataFrame:
    return demography.drift(_nations(v), "pop2", "pop")


@query("unpivot_vintages", NATIONS + " SELECT state, '2020' AS vintage, pop FROM np UNION ALL SELECT state, '2025', pop2 FROM np")
def _(v: Census) -> DataFrame:
    return demography.unpivot_vintages(_nations(v), "state", {"pop": "2020", "pop2": "2025"})


@query("validate_sums", COUNTY + ", s AS (SELECT state, CAST(sum(pop) AS BIGINT) AS parts FROM vint GROUP BY state) SELECT state, parts, resident_pop AS total, coalesce(abs(parts - resident_pop) * 100 <= abs(resident_pop) * 30.0, false) AS ok FROM s FULL JOIN resident USING (state)")
def _(v: Census) -> DataFrame:
    base = v.blocks().groupBy("state", "county").agg(F.sum("pop").cast("long").alias("pop"))
    k = F.col("county").cast("int")
    vintage = base.where(k % 13 != 0).select("state", (F.col("pop") + F.floor(F.col("pop") * (k % 7) / 10)).alias("pop"))
    return demography.sum_check(vintage, v.resident().withColumnRenamed("resident_pop", "pop"), "state", 30.0)


@query("bad_numbers", " SELECT count(TRY_CAST(x AS DOUBLE)) AS good, count(*) - count(TRY_CAST(x AS DOUBLE)) AS bad FROM (SELECT CASE WHEN o_orderkey % 10 = 0 THEN '(X)' ELSE CAST(o_orderkey AS VARCHAR) END AS x FROM orders)")
def _(v: Census) -> DataFrame:
    x = v.table("orders").select(F.when(F.col("o_orderkey") % 10 == 0, "(X)").otherwise(F.col("o_orderkey").cast("string")).alias("x"))
    return demography.bad_numbers(x, "x")


@query("valid_counties", " SELECT DISTINCT f AS fips FROM (SELECT lpad(CAST(c_custkey % 60000 * 37 % 60000 AS VARCHAR), 5, '0') AS f FROM customer) WHERE CAST(f[1:2] AS INTEGER) BETWEEN 1 AND 56 AND f[1:2] <> '11' AND f[3:5] <> '000'")
def _(v: Census) -> DataFrame:
    f = v.table("customer").select(F.lpad((F.col("c_custkey") % 60000 * 37 % 60000).cast("string"), 5, "0").alias("fips")).distinct()
    return demography.valid_counties(f)


@query("worklist", ", jobs AS (SELECT DISTINCT o_custkey AS key FROM orders), last AS (SELECT o_custkey AS key, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS s FROM orders GROUP BY 1) SELECT key FROM jobs ANTI JOIN (SELECT * FROM last WHERE s = 'F') USING (key)")
def _(v: Census) -> DataFrame:
    o = v.table("orders").where("o_custkey is not null")
    ledger = o.select(F.col("o_custkey").alias("key"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("open").alias("status"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    return demography.worklist(o.select(F.col("o_custkey").alias("key")).distinct(), ledger)


@query("national", _stats_sql("bands") + ", x AS (SELECT state, CAST(sum(pop) AS BIGINT) AS pop, max(CASE WHEN abs(deviation_pct) <= 50 THEN 'pass' WHEN state = 1 THEN 'flag' ELSE 'fail' END) AS v FROM stats GROUP BY state) SELECT CAST(sum(pop) AS BIGINT) AS pop, CAST(sum(resident_pop) AS BIGINT) AS resident_pop, CAST(count_if(v = 'pass') AS BIGINT) AS clean, CAST(count_if(v = 'flag') AS BIGINT) AS flagged, CAST(count_if(v = 'fail') AS BIGINT) AS failed, sum(pop) = sum(resident_pop) AS ok FROM x FULL JOIN resident USING (state)")
def _(v: Census) -> DataFrame:
    s = metrics.district_stats(v.bands(), v.ideal())
    return demography.national(s.withColumn("verdict", F.when(F.abs("deviation_pct") <= 50, "pass").when(F.col("state") == 1, "flag").otherwise("fail")), v.resident())


# ---------------------------------------------------------------- rasters

VALUED = ", cells AS (SELECT state, r, c, CAST(1 + pop % 3 AS INTEGER) AS v FROM island)"
RUNS = VALUED + """, box AS (SELECT state, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM cells GROUP BY state), rr AS (SELECT *, unnest(range(r0, r1 + 1)) AS r FROM box), cc AS (SELECT *, unnest(range(c0, c1 + 1)) AS c FROM rr),
v AS (SELECT state, (cc.r - r0) * (c1 - c0 + 1) + cc.c - c0 AS i, coalesce(v, 0) AS v FROM cc LEFT JOIN cells USING (state, r, c)), n AS (SELECT *, CASE WHEN v IS DISTINCT FROM lag(v) OVER (PARTITION BY state ORDER BY i) THEN 1 ELSE 0 END AS new FROM v),
runs AS (SELECT state, i, v, sum(new) OVER (PARTITION BY state ORDER BY i) AS run FROM n)"""


def _valued(v: Census) -> DataFrame:
    return v.island().select("state", "r", "c", (1 + F.col("pop") % 3).cast("int").alias("v"))


@query("rle", RUNS + " SELECT state, CAST(run AS BIGINT) AS run, any_value(v) AS v, count(*) AS len FROM runs GROUP BY state, run")
def _(v: Census) -> DataFrame:
    return raster.rle_encode(_valued(v)).select("state", F.col("run").cast("long").alias("run"), "v", "len")


@query("rle_roundtrip", RUNS + " SELECT state, i, v FROM v WHERE v <> 0")
def _(v: Census) -> DataFrame:
    return raster.rle_decode(raster.rle_encode(_valued(v))).select("state", F.col("i").cast("long").alias("i"), "v")


@query("majority_downsample", VALUED + ", n AS (SELECT state, floor(r / 5)::BIGINT AS br, floor(c / 5)::BIGINT AS bc, v, count(*) AS n FROM cells GROUP BY ALL) SELECT state, br, bc, v FROM (SELECT *, row_number() OVER (PARTITION BY state, br, bc ORDER BY n DESC, v) AS k FROM n) WHERE k = 1")
def _(v: Census) -> DataFrame:
    return raster.majority(_valued(v), 5)


@query("outline_edges", ", d(side, dr, dc) AS (VALUES (0, -1, 0), (1, 0, 1), (2, 1, 0), (3, 0, -1)) SELECT a.state, a.district, a.r, a.c, d.side FROM bands a, d WHERE NOT EXISTS (SELECT 1 FROM bands b WHERE b.state = a.state AND b.district = a.district AND b.r = a.r + d.dr AND b.c = a.c + d.dc)")
def _(v: Census) -> DataFrame:
    return raster.outline_edges(v.bands())


@query("dissolve")
def _(v: Census) -> DataFrame:
    return raster.dissolve(v.bands(v.island()))


TRIANGLES = ", tri AS (SELECT n_nationkey AS poly, n_nationkey * 3.0 AS x, n_nationkey % 7 * 4.0 AS y FROM nation), seg AS (SELECT poly, x AS x1, y AS y1, x + 20 AS x2, y + 5 AS y2 FROM tri UNION ALL SELECT poly, x + 20, y + 5, x + 7, y + 23 FROM tri UNION ALL SELECT poly, x + 7, y + 23, x, y FROM tri)".replace("3.0", "3.0::DOUBLE").replace("4.0", "4.0::DOUBLE")


def triangles(v: Census) -> DataFrame:
    t = v.table("nation").select(F.col("n_nationkey").alias("poly"), (F.col("n_nationkey") * 3.0).alias("x"), (F.col("n_nationkey") % 7 * 4.0).alias("y"))
    corner = [(F.col("x"), F.col("y")), (F.col("x") + 20, F.col("y") + 5), (F.col("x") + 7, F.col("y") + 23)]
    sides = F.array(*[F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2"), F.lit(i).alias("seq")) for i, (a, b) in enumerate(zip(corner, corner[1:] + corner[:1], strict=True))])
    return t.select("poly", F.explode(sides).alias("s")).select("poly", "s.*")


@query("point_in_polygon", TRIANGLES + ", h AS (SELECT poly AS state, g.r, g.c, count(*) AS n FROM (SELECT DISTINCT r, c FROM grid) g, seg WHERE (y1 > g.r + 0.37) <> (y2 > g.r + 0.37) AND g.c + 0.41 < (x2 - x1) * (g.r + 0.37 - y1) / (y2 - y1) + x1 GROUP BY ALL) SELECT state, r, c FROM h WHERE n % 2 = 1".replace("0.37", "0.37::DOUBLE").replace("0.41", "0.41::DOUBLE"))
def _(v: Census) -> DataFrame:
    cells = v.grid().select("r", "c").distinct()
    ids = v.table("nation").select(F.col("n_nationkey").alias("state"))
    points = cells.crossJoin(F.broadcast(ids)).select("state", "r", "c", (F.col("c") + 0.41).alias("x"), (F.col("r") + 0.37).alias("y"))  # 25 test polygons
    return grid.points_in_polygons(points, triangles(v).withColumnRenamed("poly", "state"), 4.0)


@query("scanline", TRIANGLES + ", x AS (SELECT poly, y, x1 + (y + 0.001 - y1) * (x2 - x1) / (y2 - y1) AS x FROM (SELECT *, unnest(range(CAST(floor(least(y1, y2)) AS BIGINT), CAST(ceil(greatest(y1, y2)) AS BIGINT) + 1)) AS y FROM seg) WHERE (y1 > y + 0.001) <> (y2 > y + 0.001)), k AS (SELECT *, floor((row_number() OVER (PARTITION BY poly, y ORDER BY x) - 1) / 2) AS p FROM x) SELECT poly, y, min(x) AS x_from, max(x) AS x_to FROM k GROUP BY poly, y, p".replace("0.001", "0.001::DOUBLE"))
def _(v: Census) -> DataFrame:
    return raster.scanline(triangles(v))


@query("ring_area", TRIANGLES + " SELECT poly AS state, 0 AS ring_id, sum(x1 * y2 - x2 * y1) / 2 AS area FROM seg GROUP BY poly")
def _(v: Census) -> DataFrame:
    return grid.ring_area(triangles(v).select(F.col("poly").alias("state"), F.lit(0).alias("ring_id"), "seq", F.col("x1").alias("x"), F.col("y1").alias("y")))


@query("fit_rect", TRIANGLES + ", b AS (SELECT poly, min(x1) AS x0, max(x1) AS x9, min(y1) AS y0, max(y1) AS y9 FROM seg GROUP BY poly), s AS (SELECT *, least(96 / (x9 - x0), 60 / (y9 - y0)) AS scale FROM b) SELECT poly, scale, (96 - scale * (x9 + x0)) / 2 AS dx, (60 - scale * (y9 + y0)) / 2 AS dy FROM s")
def _(v: Census) -> DataFrame:
    return raster.fit_rect(triangles(v).select("poly", F.col("x1").alias("x"), F.col("y1").alias("y")), 96.0, 60.0)


@query("albers_roundtrip")
def _(v: Census) -> DataFrame:
    p = v.grid().select("state", "r", "c", (F.lit(-125.0) + F.col("c") * 1.4).alias("lon"), (F.lit(25.0) + F.col("r") % 25).alias("lat"))
    x, y = scalars.to_albers(F.col("lon"), F.col("lat"))
    p = p.withColumn("x", x).withColumn("y", y)
    lon, lat = scalars.to_lonlat(F.col("x"), F.col("y"))
    return p.withColumn("lon_error", F.abs(lon - F.col("lon"))).withColumn("lat_error", F.abs(lat - F.col("lat")))


# ---------------------------------------------------------------- ballots

BALLOT = ", ballot AS (SELECT evaluator, option, row_number() OVER (PARTITION BY evaluator ORDER BY w DESC, option) AS rank, w AS score FROM (SELECT o_custkey % 7 AS evaluator, o_orderpriority AS option, CAST(sum(floor(o_totalprice / 1000)) AS BIGINT) AS w FROM orders GROUP BY ALL))"


def _ballots(v: Census) -> DataFrame:
    w = v.table("orders").groupBy((F.col("o_custkey") % 7).alias("evaluator"), F.col("o_orderpriority").alias("option")).agg(F.sum(F.floor(F.col("o_totalprice") / 1000)).cast("long").alias("score"))
    return w.withColumn("rank", F.row_number().over(Window.partitionBy("evaluator").orderBy(F.col("score").desc(), "option")))


@query("borda", BALLOT + " SELECT option, CAST(sum((SELECT count(DISTINCT option) FROM ballot) - rank) AS BIGINT) AS points, CAST(count_if(rank = 1) AS BIGINT) AS firsts FROM ballot GROUP BY option")
def _(v: Census) -> DataFrame:
    return ballots.borda(_ballots(v))


@query("pairwise", BALLOT + " SELECT x.option AS a, y.option AS b, count(*) AS wins FROM ballot x JOIN ballot y ON x.evaluator = y.evaluator AND x.rank < y.rank GROUP BY ALL")
def _(v: Census) -> DataFrame:
    return ballots.pairwise(_ballots(v))


@query("condorcet", BALLOT + ", w AS (SELECT x.option AS a, y.option AS b, count_if(x.rank < y.rank) AS w, count_if(x.rank > y.rank) AS l FROM ballot x JOIN ballot y ON x.evaluator = y.evaluator AND x.option <> y.option GROUP BY ALL) SELECT a AS option FROM w GROUP BY a HAVING bool_and(w > l)")
def _(v: Census) -> DataFrame:
    return ballots.condorcet(_ballots(v))


@query("mean_scores", " SELECT o_orderpriority AS option, o_orderstatus AS criterion, avg(CAST(floor(o_totalprice / 1000) AS BIGINT)) AS mean FROM orders GROUP BY ALL")
def _(v: Census) -> DataFrame:
    return ballots.mean_scores(v.table("orders").select(F.col("o_orderpriority").alias("option"), F.col("o_orderstatus").alias("criterion"), F.floor(F.col("o_totalprice") / 1000).alias("score")))


@query("plurality", ", v AS (SELECT state * 100 + district AS district, CASE WHEN pop % 2 = 0 THEN 'P' ELSE 'G' END AS party, count(*) AS v FROM bands GROUP BY ALL), t AS (SELECT district, max(v) AS m FROM v GROUP BY district), b AS (SELECT v.district, count(*) AS n, min(party) AS party FROM v JOIN t ON v.district = t.district AND v = m GROUP BY v.district) SELECT CASE WHEN n = 1 THEN party END AS winner, count(*) AS districts FROM b GROUP BY 1")
def _(v: Census) -> DataFrame:
    b = v.bands().select((F.col("state") * 100 + F.col("district")).alias("district"), F.when(F.col("pop") % 2 == 0, "P").otherwise("G").alias("party"), F.lit(1).alias("votes"))
    return ballots.plurality(b)
