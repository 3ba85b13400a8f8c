"""The driver's queries for the station operators, with DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geodrift.functions import columns as C
from geodrift.functions.geodesy import projected
from geodrift.operators import midas, raster, rates, reshape, robust, series, spatial, trend
from geodrift.sources import text

from . import adapters as A

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Common table expressions that mirror the adapters.
SPARSE = "sparse AS (SELECT CAST(l_suppkey AS VARCHAR) AS station, CAST(l_shipdate AS DATE) AS date, avg(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"
DENSE = """dense AS (SELECT r_name AS station, CAST(l_shipdate AS DATE) AS date, avg(l_quantity) AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)"""
TIDY = """tidy AS (SELECT CAST(l_suppkey AS VARCHAR) AS station, CAST(l_shipdate AS DATE) AS date, CASE WHEN l_linenumber % 2 = 1 THEN 'los_gps' ELSE 'los_insar' END AS measurement, l_quantity AS value FROM lineitem
  UNION ALL SELECT CAST(l_suppkey AS VARCHAR), CAST(l_shipdate AS DATE), 'similarity', l_discount FROM lineitem WHERE l_linenumber = 2
  UNION ALL SELECT CAST(l_suppkey AS VARCHAR), CAST(l_shipdate AS DATE), 'temporal_coherence', l_tax FROM lineitem WHERE l_linenumber = 2)"""
_MEAN = "avg(value) FILTER (WHERE measurement = '{0}') AS {0}"
WIDE = "wide AS (SELECT station, date, " + ", ".join(_MEAN.format(m) for m in ("los_gps", "los_insar", "similarity", "temporal_coherence")) + " FROM {source} GROUP BY station, date)"
STATIONS = "stations AS (SELECT CAST(s_suppkey AS VARCHAR) AS name, CAST(s_suppkey * 37 % 640 AS DOUBLE) / 10 - CAST(0.05 AS DOUBLE) AS lon, CAST(s_suppkey * 91 % 5000 AS DOUBLE) / 10 - CAST(0.05 AS DOUBLE) AS lat FROM supplier)"
TIMED = "timed AS (SELECT *, date_diff('day', min(date) OVER (PARTITION BY station), date) / CAST(365.25 AS DOUBLE) AS years FROM wide)"
KEPT = "kept AS (SELECT * FROM tidy WHERE abs(value) < 50)"


def query(name: str, sql: str | None = None):
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in names})


@query("rates_l2", f"""WITH {TIDY}, {KEPT}, {WIDE.format(source="kept")}, {TIMED}
SELECT station, round(CASE WHEN count(los_gps) > 2 THEN regr_slope(los_gps, years) * 1000 END, 4) AS gps_velocity_l2, round(CASE WHEN count(los_insar) > 2 THEN regr_slope(los_insar, years) * 1000 END, 4) AS insar_velocity_l2,
  count(los_gps) AS num_gps_points, round(max(years), 8) AS gps_time_span_years FROM timed GROUP BY station""")
def rates_l2(spark, d):
    found = rates.calculate_rates_l2(A.tidy_rows(spark, d))
    return rounded(found.select("station", "gps_velocity_l2", "insar_velocity_l2", "num_gps_points", "gps_time_span_years"), 4, "gps_velocity_l2", "insar_velocity_l2").withColumn("gps_time_span_years", F.round("gps_time_span_years", 8))


@query("tidy_melt", f"""WITH {TIDY}, {WIDE.format(source="tidy")}
SELECT station, date, m AS measurement, round(CASE m WHEN 'los_gps' THEN los_gps WHEN 'los_insar' THEN los_insar WHEN 'similarity' THEN similarity ELSE temporal_coherence END, 6) AS value
FROM wide, (VALUES ('los_gps'), ('los_insar'), ('similarity'), ('temporal_coherence')) v(m)""")
def tidy_melt(spark, d):
    return rounded(reshape.tidy(reshape.wide(A.tidy_rows(spark, d))), 6, "value")


@query("wide_pivot", f"""WITH {TIDY}, {WIDE.format(source="tidy")}
SELECT station, date, round(los_gps, 6) AS los_gps, round(los_insar, 6) AS los_insar, round(similarity, 6) AS similarity, round(temporal_coherence, 6) AS temporal_coherence FROM wide""")
def wide_pivot(spark, d):
    return rounded(reshape.wide(A.tidy_rows(spark, d)), 6, *reshape.MEASUREMENTS)


@query("outlier_filter", f"WITH {TIDY} SELECT station, date, measurement, value FROM tidy WHERE abs(value) < 50")
def outlier_filter(spark, d):
    return series.without_outliers(A.tidy_rows(spark, d))


@query("zero_by_mean", f"WITH {DENSE} SELECT station, date, round(value - avg(value) OVER (PARTITION BY station), 6) AS value FROM dense")
def zero_by_mean(spark, d):
    return rounded(series.zeroed(A.dense(spark, d), ("value",)), 6, "value")


@query("zero_by_start", f"""WITH {DENSE}, placed AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY date) AS k FROM dense)
SELECT station, date, round(value - avg(value) FILTER (WHERE k <= 10) OVER (PARTITION BY station), 6) AS value FROM placed""")
def zero_by_start(spark, d):
    return rounded(series.zeroed(A.dense(spark, d), ("value",), "start"), 6, "value")


@query("date_range", f"WITH {SPARSE} SELECT station, date, value FROM sparse WHERE date BETWEEN DATE '1996-03-01' AND DATE '1998-09-02'")
def date_range(spark, d):
    return series.date_range(A.sparse(spark, d), "1996-03-01", "1998-09-02")


LOS = """enu AS (SELECT CAST(l_suppkey AS VARCHAR) AS station, CAST(l_shipdate AS DATE) AS date, avg(l_quantity) AS east, avg(l_discount) AS north, avg(l_tax) AS up FROM lineitem GROUP BY 1, 2),
vectors AS (SELECT CAST(s_suppkey AS VARCHAR) AS station, CAST(s_suppkey % 4 AS DOUBLE) * 0.2041::DOUBLE AS e, CAST(s_suppkey % 4 AS DOUBLE) * 0.1193::DOUBLE AS n, CAST(s_suppkey % 4 AS DOUBLE) * 0.2357::DOUBLE AS u FROM supplier)"""


@query("los_projection", f"""WITH {LOS}, moved AS (SELECT station, date, east * e + north * n + up * u AS v, row_number() OVER (PARTITION BY station ORDER BY date) AS k FROM enu JOIN vectors USING (station) WHERE NOT (abs(e) <= 1e-8 AND abs(n) <= 1e-8 AND abs(u) <= 1e-8))
SELECT station, date, round(v - avg(v) FILTER (WHERE k <= 10) OVER (PARTITION BY station), 6) AS los_gps FROM moved""")
def los_projection(spark, d):
    lines = A.table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("station"), F.col("l_shipdate").cast("date").alias("date"), "l_quantity", "l_discount", "l_tax")
    enu = lines.groupBy("station", "date").agg(F.avg("l_quantity").alias("east"), F.avg("l_discount").alias("north"), F.avg("l_tax").alias("up"))
    k = F.col("s_suppkey") % 4
    vectors = A.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("station"), (k * 0.2041).alias("e"), (k * 0.1193).alias("n"), (k * 0.2357).alias("u"))
    return rounded(series.line_of_sight(enu, vectors), 6, "los_gps")


@query("gps_insar_left_join", f"""WITH {TIDY}, gps AS (SELECT station, date, avg(value) AS los_gps FROM tidy WHERE measurement = 'los_gps' GROUP BY 1, 2), insar AS (SELECT station, date, avg(value) AS los_insar FROM tidy WHERE measurement = 'los_insar' GROUP BY 1, 2)
SELECT station, date, round(los_gps, 6) AS los_gps, round(los_insar, 6) AS los_insar FROM gps LEFT JOIN insar USING (station, date)""")
def gps_insar_left_join(spark, d):
    rows = A.tidy_rows(spark, d)
    gps, insar = (rows.where(F.col("measurement") == m).groupBy("station", "date").agg(F.avg("value").alias(m)) for m in ("los_gps", "los_insar"))
    return rounded(reshape.with_insar(gps, insar), 6, "los_gps", "los_insar")


@query("relative_to_reference", f"""WITH {TIDY}, {WIDE.format(source="tidy")}, reference AS (SELECT date, los_gps AS g, los_insar AS i FROM wide WHERE station = '1')
SELECT station, date, round(los_gps - g, 6) AS relative_gps, round(los_insar - i, 6) AS relative_insar, round((los_insar - i) - (los_gps - g), 6) AS difference FROM wide JOIN reference USING (date)""")
def relative_to_reference(spark, d):
    return rounded(reshape.relative_to(reshape.wide(A.tidy_rows(spark, d)), reference_station="1"), 6, "relative_gps", "relative_insar", "difference")


@query("lookup_left_join", """SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS grid_point, l_orderkey, l_linenumber, CAST(n_regionkey AS DOUBLE) AS longitude, CAST(n_nationkey AS DOUBLE) AS latitude FROM lineitem LEFT JOIN nation ON l_suppkey = n_nationkey""")
def lookup_left_join(spark, d):
    lookup = A.table(spark, d, "nation").select(C.padded_grid_point(F.col("n_nationkey").cast("string")).alias("grid_point"), F.col("n_regionkey").cast("double").alias("longitude"), F.col("n_nationkey").cast("double").alias("latitude"))
    rows = A.table(spark, d, "lineitem").select(C.padded_grid_point(F.col("l_suppkey").cast("string")).alias("grid_point"), "l_orderkey", "l_linenumber")
    return reshape.with_lookup(rows, lookup)


@query("lon_wrap", "SELECT c_custkey, CAST(c_custkey AS DOUBLE) * 7.25 - 360 * round_even(CAST(c_custkey AS DOUBLE) * 7.25 / 360, 0) AS lon FROM customer")
def lon_wrap(spark, d):
    return A.table(spark, d, "customer").select("c_custkey", C.wrapped_longitude(F.col("c_custkey").cast("double") * 7.25).alias("lon"))


@query("decimal_year", """SELECT c_custkey, CAST(make_date(1990 + c_custkey % 40, 1, 1) + CAST(round_even((CAST(c_custkey * 13 % 1000 AS DOUBLE) / 1024) * 365.25::DOUBLE, 0) AS INTEGER) AS DATE) AS day FROM customer""")
def decimal_year(spark, d):
    year = 1990 + F.col("c_custkey") % 40 + (F.col("c_custkey") * 13 % 1000) / 1024.0
    return A.table(spark, d, "customer").select("c_custkey", C.decimal_year_date(year).alias("day"))


@query("days_since_first", """SELECT event_id, round((epoch(date_trunc('second', ts)) - min(epoch(date_trunc('second', ts))) OVER (PARTITION BY user_id)) / 86400.0::DOUBLE, 9) AS days FROM events""")
def days_since_first(spark, d):
    return A.table(spark, d, "events").select("event_id", F.round(C.days_since_first(F.col("ts"), "user_id"), 9).alias("days"))


@query("moving_average", f"""WITH {DENSE} SELECT station, date, round(CASE WHEN count(value) OVER w = 7 THEN avg(value) OVER w END, 6) AS smooth FROM dense WINDOW w AS (PARTITION BY station ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def moving_average(spark, d):
    return rounded(series.moving_average(A.dense(spark, d), "value").select("station", "date", "smooth"), 6, "smooth")


FIT = "dated AS (SELECT station, date, date_diff('day', min(date) OVER (PARTITION BY station), date) AS t, value AS y FROM dense), fit AS (SELECT station, regr_slope(y, t) AS a, regr_intercept(y, t) AS b FROM dated GROUP BY station)"


@query("detrended_std", f"WITH {DENSE}, {FIT} SELECT station, round(stddev_pop(y - (a * t + b)), 6) AS std FROM dated JOIN fit USING (station) GROUP BY station")
def detrended_std(spark, d):
    return rounded(trend.flat_std(A.dense(spark, d)), 6, "std")


@query("linear_trend_last", f"WITH {DENSE}, {FIT} SELECT station, round(arg_max(a * t + b, date), 6) AS trend FROM dated JOIN fit USING (station) GROUP BY station")
def linear_trend_last(spark, d):
    return rounded(trend.last_trend(A.dense(spark, d)), 6, "trend")


@query("first_valid_quality", f"""WITH {TIDY}, {WIDE.format(source="tidy")} SELECT station, round(arg_min(similarity, date) FILTER (WHERE similarity IS NOT NULL), 6) AS similarity, round(arg_min(temporal_coherence, date) FILTER (WHERE temporal_coherence IS NOT NULL), 6) AS temporal_coherence FROM wide GROUP BY station""")
def first_valid_quality(spark, d):
    wide = reshape.wide(A.tidy_rows(spark, d))
    names = ("similarity", "temporal_coherence")
    return rounded(wide.groupBy("station").agg(*[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("date"))).alias(c) for c in names]), 6, *names)


@query("pearson_rmse", f"""WITH {TIDY}, {WIDE.format(source="tidy")} SELECT station, count(*) AS n, round(corr(los_gps, los_insar), 8) AS pearson, round(sqrt(avg(pow(los_gps - los_insar, 2))), 6) AS rmse FROM wide WHERE los_gps IS NOT NULL AND los_insar IS NOT NULL GROUP BY station""")
def pearson_rmse(spark, d):
    found = rates.comparison_stats(reshape.wide(A.tidy_rows(spark, d)), "los_gps", "los_insar", "station")
    return found.withColumns({"pearson": F.round("pearson", 8), "rmse": F.round("rmse", 6)})


@query("theil_sen", f"""WITH {SPARSE}, r AS (SELECT station, date_diff('day', min(date) OVER (PARTITION BY station), date) AS t, value AS y FROM sparse),
p AS (SELECT a.station, (b.y - a.y) / (b.t - a.t) AS s FROM r a JOIN r b ON a.station = b.station AND b.t - a.t > 180 AND abs((b.t - a.t + 180) % 365 - 180) < 30),
m AS (SELECT station, median(s) AS slope, count(*) AS n FROM p GROUP BY station), q AS (SELECT p.station, median(abs(s - slope)) AS mad FROM p JOIN m USING (station) GROUP BY p.station),
i AS (SELECT r.station, median(y - slope * t) AS b FROM r JOIN m USING (station) GROUP BY r.station)
SELECT station, round(slope, 8) AS slope, round(b, 5) AS intercept, round(3 * sqrt(pi() / 2) * 1.4826 * mad / sqrt(n / 4.0::DOUBLE), 8) AS uncertainty, n AS n_pairs FROM m JOIN q USING (station) JOIN i USING (station)""")
def theil_sen(spark, d):
    found = trend.theil_sen(A.sparse(spark, d))
    return found.withColumns({"slope": F.round("slope", 8), "intercept": F.round("intercept", 5), "uncertainty": F.round("uncertainty", 8)})


def _midas_cte(source: str) -> str:
    """Pairs in whole days: an exact partner is 365 days on; else the gap rule with a cursor carried along."""
    return f"""{source.upper()}S AS (SELECT station, date_diff('day', min(date) OVER (PARTITION BY station), date) AS d, value AS y, row_number() OVER (PARTITION BY station ORDER BY date) - 1 AS k, count(*) OVER (PARTITION BY station) AS m FROM {source}),
turned AS (SELECT station, 'forward' AS direction, d AS t, k, m FROM {source.upper()}S UNION ALL SELECT station, 'backward', -d, m - 1 - k, m FROM {source.upper()}S),
ends AS (SELECT station, direction, max(t) AS last FROM turned GROUP BY ALL),
reach AS (SELECT a.station, a.direction, a.k AS i, a.m, min(b.k) AS j, min(b.t - a.t) AS gap FROM turned a JOIN ends e USING (station, direction) JOIN turned b ON a.station = b.station AND a.direction = b.direction AND b.t - a.t >= 365 WHERE a.t <= e.last - 365 GROUP BY ALL),
walk AS (SELECT station, direction, i, CASE WHEN gap = 365 THEN j ELSE greatest(0, j) END AS p, CASE WHEN gap = 365 THEN j WHEN j = m - 1 THEN 1 ELSE j + 1 END AS c FROM reach WHERE i = 0
  UNION ALL SELECT r.station, r.direction, r.i, CASE WHEN r.gap = 365 THEN r.j ELSE greatest(w.c, r.j) END, CASE WHEN r.gap = 365 THEN greatest(w.c, r.j) WHEN greatest(w.c, r.j) = r.m - 1 THEN 1 ELSE greatest(w.c, r.j) + 1 END FROM walk w JOIN reach r ON r.station = w.station AND r.direction = w.direction AND r.i = w.i + 1),
pairs AS (SELECT w.station, w.direction, CASE w.direction WHEN 'forward' THEN i ELSE m - 1 - p END AS first, CASE w.direction WHEN 'forward' THEN p ELSE m - 1 - i END AS second FROM walk w JOIN (SELECT DISTINCT station, m FROM {source.upper()}S) USING (station))"""


@query("midas_pairs", f"WITH RECURSIVE {SPARSE}, {_midas_cte('sparse')} SELECT station, direction, first, second FROM pairs")
def midas_pairs(spark, d):
    return midas.midas_pairs(A.sparse(spark, d))


def _rates_cte(source: str) -> str:
    """Rates from ``pairs``: the median, again without outliers, and the median offset."""
    epochs = f"{source.upper()}S"
    return f"""v AS (SELECT p.station, (b.y - a.y) / ((b.d - a.d) / 365.25::DOUBLE) AS v FROM pairs p JOIN {epochs} a ON a.station = p.station AND a.k = p.first JOIN {epochs} b ON b.station = p.station AND b.k = p.second),
c AS (SELECT station, median(v) AS v50, count(*) AS n FROM v GROUP BY station), s AS (SELECT v.station, 1.4826::DOUBLE * median(abs(v - v50)) AS sd FROM v JOIN c USING (station) GROUP BY v.station),
k AS (SELECT v.station, v FROM v JOIN c USING (station) JOIN s USING (station) WHERE abs(v - v50) < 2 * sd), f AS (SELECT station, median(v) AS vel, count(*) AS kept FROM k GROUP BY station),
u AS (SELECT k.station, median(abs(v - vel)) AS d50 FROM k JOIN f USING (station) GROUP BY k.station), o AS (SELECT x.station, median(y - vel * (d / 365.25::DOUBLE)) AS x50 FROM {epochs} x JOIN f USING (station) GROUP BY x.station)"""


MIDAS_COLUMNS = "station, n AS n_pairs, round(vel, 6) AS velocity, round(3 * 1.2533 * 1.4826 * d50 / sqrt(kept / 4.0::DOUBLE), 6) AS velocity_uncertainty, round(x50, 6) AS reference_position, round((n - kept) / n::DOUBLE, 8) AS outlier_fraction, round(sd, 6) AS velocity_scatter"
MIDAS_TABLES = "c JOIN s USING (station) JOIN f USING (station) JOIN u USING (station) JOIN o USING (station)"


def midas_result(found: DataFrame) -> DataFrame:
    return rounded(found, 6, "velocity", "velocity_uncertainty", "reference_position", "velocity_scatter").withColumn("outlier_fraction", F.round("outlier_fraction", 8))


@query("midas_velocity", f"""WITH RECURSIVE {DENSE}, {_midas_cte('dense')},
{_rates_cte('dense')}
SELECT {MIDAS_COLUMNS}
FROM {MIDAS_TABLES}""")
def midas_velocity(spark, d):
    return midas_result(midas.midas_rates(A.dense(spark, d)).select("station", "n_pairs", "velocity", "velocity_uncertainty", "reference_position", "outlier_fraction", "velocity_scatter"))


#: Pairs that no step separates, in whole days: epochs before the next step and a year or more from it, first partners before that step.
STEPPED = """DENSES AS (SELECT station, date_diff('day', min(date) OVER (PARTITION BY station), date) AS d, value AS y, row_number() OVER (PARTITION BY station ORDER BY date) - 1 AS k, count(*) OVER (PARTITION BY station) AS m FROM dense),
moved AS (SELECT station, date_diff('day', min(date), day) AS jump FROM dense JOIN (VALUES ('ASIA', DATE '1998-01-01'), ('EUROPE', DATE '1997-06-15'), ('EUROPE', DATE '1999-06-15')) given(station, day) USING (station) GROUP BY station, day),
turned AS (SELECT station, 'forward' AS direction, d AS t, k, m FROM DENSES UNION ALL SELECT station, 'backward', -d, m - 1 - k, m FROM DENSES),
walls AS (SELECT station, 'forward' AS direction, jump FROM moved UNION ALL SELECT station, 'backward', -jump FROM moved),
ahead AS (SELECT t.*, min(jump) AS step, max(t.t) OVER (PARTITION BY t.station, t.direction) AS latest FROM turned t LEFT JOIN walls w ON w.station = t.station AND w.direction = t.direction AND w.jump >= t.t GROUP BY t.station, t.direction, t.t, t.k, t.m),
usable AS (SELECT *, row_number() OVER (PARTITION BY station, direction ORDER BY t) AS place FROM ahead WHERE t <= latest - 365 AND (step IS NULL OR t <= step - 365)),
reach AS MATERIALIZED (SELECT a.station, a.direction, a.place, a.k AS i, a.m, min(b.k) FILTER (WHERE b.t >= a.t + 365) AS j, min(b.t) FILTER (WHERE b.t >= a.t + 365) - a.t AS gap, coalesce(min(b.k) FILTER (WHERE b.t >= a.step), a.m + 1) AS wall
  FROM usable a JOIN turned b ON a.station = b.station AND a.direction = b.direction GROUP BY a.station, a.direction, a.place, a.k, a.m, a.t, a.step),
walk AS (SELECT station, direction, 0::BIGINT AS place, NULL::BIGINT AS i, NULL::BIGINT AS p, 0::BIGINT AS c FROM DENSES, (VALUES ('forward'), ('backward')) v(direction) WHERE k = 0
  UNION ALL SELECT station, direction, place, i, CASE WHEN barred THEN NULL WHEN gap = 365 THEN j WHEN taken < wall THEN taken END,
    CASE WHEN barred THEN greatest(c, least(wall, m - 1)) WHEN gap = 365 THEN greatest(c, j) WHEN taken >= wall THEN taken WHEN taken = m - 1 THEN 1 ELSE taken + 1 END
  FROM (SELECT r.*, w.c, r.j >= least(r.wall, r.m) AS barred, CASE WHEN greatest(w.c, r.j) >= r.wall THEN r.j + 1 ELSE greatest(w.c, r.j) END AS taken
    FROM walk w JOIN reach r ON r.station = w.station AND r.direction = w.direction AND r.place = w.place + 1)),
pairs AS (SELECT w.station, w.direction, CASE w.direction WHEN 'forward' THEN i ELSE m - 1 - p END AS first, CASE w.direction WHEN 'forward' THEN p ELSE m - 1 - i END AS second FROM walk w JOIN (SELECT DISTINCT station, m FROM DENSES) USING (station) WHERE p IS NOT NULL)"""


@query("midas_steps", f"""WITH RECURSIVE {DENSE}, {STEPPED},
{_rates_cte('dense')}
SELECT m.n, {MIDAS_COLUMNS.replace(", n AS", ", c.n AS").replace("(n - kept) / n::", "(c.n - kept) / c.n::")}
FROM {MIDAS_TABLES} JOIN (SELECT station, count(*) AS n FROM dense GROUP BY station) m USING (station)""")
def midas_steps(spark, d):
    steps = {"ASIA": ["1998-01-01"], "EUROPE": ["1997-06-15", "1999-06-15"]}
    return midas_result(midas.midas_rates(A.dense(spark, d), steps=steps).drop("residuals"))


#: Suppliers whose line is fitted twice: brute force over point pairs is cubic, so its series are monthly means.
MONTHLY = "monthly AS (SELECT station, date_trunc('month', date)::DATE AS date, round(avg(value), 3) AS value FROM dense GROUP BY 1, 2)"


@query("robust_fit", f"""WITH {DENSE}, {MONTHLY}, r AS (SELECT station, date_diff('day', min(date) OVER (PARTITION BY station), date) / 365.25::DOUBLE AS x, value AS y FROM monthly),
l AS (SELECT a.station, (b.y - a.y) / (b.x - a.x) AS s, a.y - (b.y - a.y) / (b.x - a.x) * a.x AS o FROM r a JOIN r b ON a.station = b.station AND a.x < b.x),
c AS (SELECT l.station, s, o, sum(abs(y - s * x - o)) AS total FROM l JOIN r USING (station) GROUP BY l.station, s, o)
SELECT station, round(min(total), 6) AS objective FROM c GROUP BY station""")
def robust_fit(spark, d):
    monthly = A.dense(spark, d).groupBy("station", F.trunc("date", "month").alias("date")).agg(F.round(F.avg("value"), 3).alias("value"))
    return rounded(robust.robust_lines(monthly).select("station", "objective"), 6, "objective")


@query("robust_fit_daily")
def robust_fit_daily(spark, d):
    """The lines of the whole daily series, for which SQL over point pairs would be cubic; tests hold them against brute force."""
    return robust.robust_lines(A.dense(spark, d))


@query("station_rates")
def station_rates(spark, d):
    return rates.calculate_rates(A.tidy_rows(spark, d))


GPS = "gps AS (SELECT station, date, los_gps AS value FROM wide WHERE los_gps IS NOT NULL)"
FITTED = "CASE WHEN count({0}) > 2 THEN regr_slope({0}, years) * 1000 END"
FIRST = "CASE WHEN count(los_insar) > 2 THEN arg_min({0}, date) FILTER (WHERE {0} IS NOT NULL) END AS {0}"


@query("station_rates_midas", f"""WITH RECURSIVE {TIDY}, {KEPT}, {WIDE.format(source="kept")}, {TIMED}, {GPS}, {_midas_cte('gps')},
{_rates_cte('gps')},
least AS (SELECT station, {FITTED.format("los_insar")} AS insar, {FITTED.format("los_gps")} AS gps, {FIRST.format("temporal_coherence")}, {FIRST.format("similarity")}, count(los_gps) AS num_gps_points, max(years) AS span FROM timed GROUP BY station),
far AS (SELECT c.station, vel, d50, kept, c.n, sd FROM c JOIN s USING (station) LEFT JOIN f USING (station) LEFT JOIN u USING (station))
SELECT least.station, round(insar, 4) AS insar_velocity_l2, round(temporal_coherence, 6) AS temporal_coherence, round(similarity, 6) AS similarity, num_gps_points, round(span, 8) AS gps_time_span_years, round(gps, 4) AS gps_velocity_l2,
  CASE WHEN num_gps_points > 2 THEN round(1000 * vel, 7) END AS gps_velocity, CASE WHEN num_gps_points > 2 THEN round(1000 * 3 * 1.2533 * 1.4826 * d50 / sqrt(kept / 4.0::DOUBLE), 7) END AS gps_velocity_uncertainty,
  CASE WHEN num_gps_points > 2 THEN round((n - kept) / n::DOUBLE, 8) END AS gps_outlier_fraction, CASE WHEN num_gps_points > 2 THEN round(1000 * sd, 7) END AS gps_velocity_scatter
FROM least LEFT JOIN far USING (station)""")
def station_rates_midas(spark, d):
    """``station_rates`` but for the L1 rates, whose brute force in SQL is cubic."""
    found = rates.calculate_rates(A.tidy_rows(spark, d)).drop("difference", "insar_velocity")
    found = rounded(rounded(found, 4, "insar_velocity_l2", "gps_velocity_l2"), 7, "gps_velocity", "gps_velocity_uncertainty", "gps_velocity_scatter")
    return rounded(rounded(found, 6, "temporal_coherence", "similarity"), 8, "gps_time_span_years", "gps_outlier_fraction")


@query("extreme_rates", f"""WITH {TIDY}, {KEPT}, {WIDE.format(source="kept")}, {TIMED}, r AS (SELECT station, {FITTED.format("los_gps")} AS g, {FITTED.format("los_insar")} AS i FROM timed GROUP BY station)
SELECT station, round(g, 4) AS gps_velocity, round(i, 4) AS insar_velocity FROM r WHERE abs(g) > 15 OR abs(i) > 15""")
def extreme_rates(spark, d):
    found = rates.calculate_rates_l2(A.tidy_rows(spark, d)).select("station", F.col("gps_velocity_l2").alias("gps_velocity"), F.col("insar_velocity_l2").alias("insar_velocity"))
    return rounded(rates.extreme_rates(found), 4, "gps_velocity", "insar_velocity")


@query("trend_at", f"""WITH {DENSE}, {FIT}, asked AS (SELECT station, date, date_diff('day', min(date) OVER (PARTITION BY station), date) AS t FROM dense WHERE date BETWEEN DATE '1996-03-01' AND DATE '1998-09-02')
SELECT station, date, round(a * t + b, 6) AS trend FROM asked JOIN fit USING (station)""")
def trend_at(spark, d):
    dense = A.dense(spark, d)
    return rounded(trend.trend_at(trend.line_fit(dense), series.date_range(dense, "1996-03-01", "1998-09-02")), 6, "trend")


@query("line_fit_median", f"""WITH {DENSE}, r AS (SELECT station, date_diff('day', min(date) OVER (PARTITION BY station), date) AS t, value AS y FROM dense),
p AS (SELECT a.station, (b.y - a.y) / (b.t - a.t) AS s FROM r a JOIN r b ON a.station = b.station AND b.t - a.t > 180 AND abs((b.t - a.t + 180) % 365 - 180) < 30), m AS (SELECT station, median(s) AS slope FROM p GROUP BY station)
SELECT r.station, round(any_value(slope), 8) AS slope, round(median(y - slope * t), 5) AS intercept FROM r JOIN m USING (station) GROUP BY r.station""")
def line_fit_median(spark, d):
    return trend.line_fit(A.dense(spark, d), median=True).withColumns({"slope": F.round("slope", 8), "intercept": F.round("intercept", 5)})


@query("mad", f"WITH {DENSE} SELECT station, round(mad(value), 6) AS mad FROM dense GROUP BY station")
def mad(spark, d):
    return rounded(trend.mad(A.dense(spark, d), "value", "station"), 6, "mad")


@query("excluded_stations", f"WITH {DENSE} SELECT station, date, round(value, 6) AS value FROM dense WHERE station NOT IN ('ASIA', 'EUROPE')")
def excluded_stations(spark, d):
    return rounded(series.excluded(A.dense(spark, d), ["asia", "Europe"], "station"), 6, "value")


def ordered_days(spark, d) -> DataFrame:
    """(station, date): the days of each customer's orders."""
    return A.table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("station"), F.col("o_orderdate").cast("date").alias("date"))


ORDERED = "ordered AS (SELECT CAST(o_custkey AS VARCHAR) AS station, CAST(o_orderdate AS DATE) AS date FROM orders)"


@query("stations_without_overlap", f"WITH {ORDERED} SELECT DISTINCT station FROM ordered WHERE station NOT IN (SELECT station FROM ordered WHERE date IN (SELECT date FROM ordered WHERE station = '1'))")
def stations_without_overlap(spark, d):
    return reshape.stations_without_overlap(ordered_days(spark, d), reference_station="1")


@query("missing_stations", f"WITH {ORDERED} SELECT CAST(c_custkey AS VARCHAR) AS name FROM customer WHERE name NOT IN (SELECT station FROM ordered WHERE date BETWEEN DATE '1996-03-01' AND DATE '1998-09-02')")
def missing_stations(spark, d):
    return reshape.missing_stations(A.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("name")), series.date_range(ordered_days(spark, d), "1996-03-01", "1998-09-02"))


@query("compact_date", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + to_years(CAST(o_orderkey % 60 AS INTEGER)) AS DATE) AS day FROM orders")
def compact_date(spark, d):
    day = F.add_months(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 60 * 12).cast("int"))
    return A.table(spark, d, "orders").select("o_orderkey", C.compact_date(F.upper(F.date_format(day, "yyMMMdd"))).alias("day"))


def dated_files(spark, d) -> DataFrame:
    """(o_orderkey, path): an interferogram's file per order, all with one reference date."""
    day = F.col("o_orderdate").cast("date")
    return A.table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("stack/19910101/19910101_"), F.date_format(day, "yyyyMMdd"), F.lit(".unw.tif")).alias("path"))


@query("file_dates", "SELECT o_orderkey, DATE '1991-01-01' AS ref_date, CAST(o_orderdate AS DATE) AS sec_date FROM orders")
def file_dates(spark, d):
    return text.file_dates(dated_files(spark, d)).select("o_orderkey", "ref_date", "sec_date")


@query("analysis_range", "SELECT DATE '1991-01-01' AS first_date, CAST(max(o_orderdate) AS DATE) AS last_date FROM orders")
def analysis_range(spark, d):
    return spark.createDataFrame([text.analysis_range(text.file_dates(dated_files(spark, d)))], "first_date date, last_date date")


@query("stations_in_bounds", f"WITH {STATIONS} SELECT name, lon, lat, CAST(label AS VARCHAR) AS raster_id FROM stations, (SELECT DISTINCT label FROM embeddings), (SELECT max(vec_id) + 1 AS h FROM embeddings) WHERE lon > 0 AND lon < 64 AND lat > 0 AND lat < h")
def stations_in_bounds(spark, d):
    return spatial.in_bounds(A.stations(spark, d), A.raster(spark, d)[0])


TILE = (1, 64)
SAMPLED = """sampled AS (SELECT name, CAST(l.label AS VARCHAR) AS raster_id, CAST(e.embedding[CAST(floor(lon) AS INTEGER) + 1] AS DOUBLE) AS value, lon, lat FROM stations CROSS JOIN (SELECT DISTINCT label FROM embeddings) l LEFT JOIN embeddings e ON e.label = l.label AND e.vec_id = floor(lat) AND lon >= 0 AND lon < 64)"""


@query("raster_sample", f"WITH {STATIONS}, {SAMPLED} SELECT name, raster_id, value FROM sampled WHERE raster_id = '0'")
def raster_sample(spark, d):
    meta, tiles = A.raster(spark, d)
    return raster.sample(A.stations(spark, d), meta.where("raster_id = '0'"), tiles.where("raster_id = '0'"), tile_size=TILE).select("name", "raster_id", "value")


@query("raster_stack_sample", f"WITH {STATIONS}, {SAMPLED} SELECT name, raster_id, value FROM sampled")
def raster_stack_sample(spark, d):
    return raster.sample(A.stations(spark, d), *A.raster(spark, d), tile_size=TILE).select("name", "raster_id", "value")


@query("stations_valid_pixel", f"WITH {STATIONS}, {SAMPLED} SELECT name, raster_id, value FROM sampled WHERE value IS NOT NULL AND NOT abs(value) <= 1e-8")
def stations_valid_pixel(spark, d):
    return spatial.with_valid_pixel(raster.sample(A.stations(spark, d), *A.raster(spark, d), tile_size=TILE).select("name", "raster_id", "value"))


@query("raster_window", f"""WITH {STATIONS}, spot AS (SELECT name, CAST(round_even(lon, 0) AS INTEGER) AS c, CAST(round_even(lat, 0) AS INTEGER) AS r FROM stations)
SELECT name, CAST(label AS VARCHAR) AS raster_id, CAST(vec_id AS INTEGER) AS row, CAST(c + dc AS INTEGER) AS col, CAST(embedding[c + dc + 1] AS DOUBLE) AS value FROM spot JOIN embeddings ON vec_id BETWEEN r - 1 AND r + 1 CROSS JOIN (VALUES (-1), (0), (1)) o(dc) WHERE c + dc BETWEEN 0 AND 63""")
def raster_window(spark, d):
    return raster.window(A.stations(spark, d), *A.raster(spark, d), buffer_pixels=1, tile_size=TILE).select("name", "raster_id", "row", "col", "value")


CELLS = "cells AS (SELECT label, vec_id, unnest(range(0, 64)) AS col, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"


@query("raster_mask", f"WITH {CELLS} SELECT CAST(label AS VARCHAR) AS raster_id, CAST(vec_id AS INTEGER) AS row, CAST(col AS INTEGER) AS col, CASE WHEN v = 0.25 THEN NULL ELSE v END AS value FROM cells WHERE vec_id % 5 = 0 AND col % 3 = 1")
def raster_mask(spark, d):
    meta, tiles = A.raster(spark, d)
    cells = raster.pixels(meta.withColumn("nodata", F.lit(0.25)), tiles, TILE)
    return raster.raster_slice(cells, slice(0, None, 5), slice(1, None, 3), [1]).select("raster_id", "row", "col", "value")


@query("phase_to_metres", f"WITH {CELLS} SELECT vec_id, CAST(col AS INTEGER) AS col, round(v * 0.0044138253091923615::DOUBLE, 12) AS metres FROM cells")
def phase_to_metres(spark, d):
    cells = A.table(spark, d, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("col", "v"))
    return cells.select("vec_id", "col", F.round(C.metres(F.col("v"), F.lit("radians")), 12).alias("metres"))


@query("frame_overlap", f"""WITH {STATIONS}, corners AS (SELECT n_nationkey AS frame_id, CAST(n_nationkey % 5 * 12 AS DOUBLE) AS x, CAST(floor(n_nationkey / 5) * 90 AS DOUBLE) AS y FROM nation WHERE n_regionkey <= 2),
rings AS (SELECT frame_id, [x, x + 13, x + 11, x - 2, x] AS xs, [y, y + 20, y + 95, y + 70, y] AS ys FROM corners),
edges AS (SELECT frame_id, xs[i] AS ax, ys[i] AS ay, xs[i + 1] AS bx, ys[i + 1] AS cy FROM rings, (SELECT unnest(range(1, 5)) AS i)),
crossed AS (SELECT frame_id, name, lon, lat, count(*) AS n FROM stations JOIN edges ON ((ay > lat) <> (cy > lat)) AND lon < (bx - ax) * (lat - ay) / (cy - ay) + ax GROUP BY ALL)
SELECT frame_id, name, lon AS x, lat AS y FROM crossed WHERE n % 2 = 1""")
def frame_overlap(spark, d):
    return spatial.frame_overlap(A.stations(spark, d), A.frames(spark, d), cell_degrees=10.0)


#: Vincenty's inverse formula on WGS84, sixty steps of the longitude, far more than such pairs need.
GEODESIC = """ends AS (SELECT a.name AS name1, b.name AS name2, a.lon AS lon1, a.lat / 6 AS lat1, b.lon AS lon2, b.lat / 6 AS lat2 FROM stations a JOIN stations b ON CAST(b.name AS BIGINT) = CAST(a.name AS BIGINT) % (SELECT count(*) FROM stations) + 1),
reduced AS (SELECT name1, name2, atan((1 - f) * tan(radians(lat1))) AS u1, atan((1 - f) * tan(radians(lat2))) AS u2, radians(lon2 - lon1) AS l, f FROM ends, (SELECT 1 / 298.257223563::DOUBLE AS f)),
step AS (SELECT name1, name2, u1, u2, l, f, l AS lam, 0 AS n FROM reduced
  UNION ALL SELECT name1, name2, u1, u2, l, f, l + (1 - c) * f * sa * (sigma + c * ss * (mid + c * cs * (2 * mid * mid - 1))), n + 1
  FROM (SELECT *, f / 16 * ca * (4 + f * (4 - 3 * ca)) AS c FROM (SELECT *, CASE WHEN ca > 1e-15 THEN cs - 2 * sin(u1) * sin(u2) / ca ELSE 0 END AS mid FROM (SELECT *, 1 - sa * sa AS ca FROM (SELECT *, atan2(ss, cs) AS sigma, CASE WHEN ss > 0 THEN cos(u1) * cos(u2) * sin(lam) / ss ELSE 0 END AS sa
    FROM (SELECT *, sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs FROM step WHERE n < 60)))))),
settled AS (SELECT *, atan2(ss, cs) AS sigma, CASE WHEN ss > 0 THEN cos(u1) * cos(u2) * sin(lam) / ss ELSE 0 END AS sa FROM (SELECT *, sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs FROM step WHERE n = 60)),
coefficients AS (SELECT *, CASE WHEN 1 - sa * sa > 1e-15 THEN cs - 2 * sin(u1) * sin(u2) / (1 - sa * sa) ELSE 0 END AS mid, (1 - sa * sa) * (1 / pow(1 - f, 2) - 1) AS g FROM settled),
series AS (SELECT *, 1 + g / 16384 * (4096 + g * (g * (320 - 175 * g) - 768)) AS a, g / 1024 * (256 + g * (g * (74 - 47 * g) - 128)) AS b FROM coefficients)"""


@query("station_distance", f"""WITH RECURSIVE {STATIONS}, {GEODESIC}
SELECT name1, name2, round(6378137 * (1 - f) * a * (sigma - b * ss * (mid + b / 4 * (cs * (2 * mid * mid - 1) - b / 6 * mid * (4 * ss * ss - 3) * (4 * mid * mid - 3)))), 3) AS metres FROM series""")
def station_distance(spark, d):
    places = A.stations(spark, d).select("name", "lon", (F.col("lat") / 6).alias("lat"))
    pairs = places.select(F.col("name").alias("name1"), ((F.col("name").cast("int") % places.count()) + 1).cast("string").alias("name2"))
    return rounded(spatial.station_pairs_distance(pairs, places), 3, "metres")


@query("mercator", f"WITH {STATIONS} SELECT name, round(6378137 * radians(lon), 4) AS x, round(6378137 * atanh(sin(radians(lat / 6))), 4) AS y FROM stations")
def mercator(spark, d):
    xy = projected(F.col("lon"), F.col("lat") / 6, "EPSG:3857")
    return A.stations(spark, d).withColumn("xy", xy).select("name", F.round("xy.x", 4).alias("x"), F.round("xy.y", 4).alias("y"))


@query("station_lookup", f"WITH {STATIONS} SELECT lon, lat FROM stations WHERE name = '7'")
def station_lookup(spark, d):
    return spark.createDataFrame([spatial.station_lon_lat(A.stations(spark, d), "7")], "lon double, lat double")


@query("distinct_files", "SELECT DISTINCT lpad(CAST(c_nationkey AS VARCHAR), 6, '0') || '_IGS14.tenv8' AS file FROM customer")
def distinct_files(spark, d):
    key = F.lpad(F.col("c_nationkey").cast("string"), 6, "0")
    pages = A.table(spark, d, "customer").select(F.concat(F.lit('<a href="'), key, F.lit('_IGS14.tenv8">'), key, F.lit("_IGS14.tenv8</a>")).alias("html"))
    return text.listed_files(pages)


@query("plate_regex", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN upper(n_name[1:2]) END AS plate FROM nation")
def plate_regex(spark, d):
    code = F.upper(F.substring("n_name", 1, 2))
    page = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("Reference: "), code, F.lit(" Plate Fixed"))).otherwise(F.lit("none"))
    return A.table(spark, d, "nation").select("n_nationkey", text.plate_code(page).alias("plate"))
