"""The named queries over the driver's tables, each with its SQL where SQL can express it.

Values are whole cents, so that sums do not depend on the order of addition; derived doubles are rounded.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs
from ..functions.scalar import cyclic_slot, nanoseconds
from ..operators import hitters, p2, profile, rings, running, sketches, states
from ..operators.matrices import Matrix
from ..operators.rings import Ring
from ..session import table
from ..sources import messages
from ..streaming import processors
from . import monitor as mon
from .p2_sql import p2_sql

HOUR = 3_600_000_000_000
Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Catalog:
    queries: dict[str, Query]
    sql: dict[str, str]

    def add(self, name: str, sql: str | None = None):
        def register(query: Query) -> Query:
            self.queries[name] = query
            if sql:
                self.sql[name] = sql
            return query

        return register


CATALOG = Catalog({}, {})
add = CATALOG.add


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded, and never -0.0."""
    return F.round(c, digits) + F.lit(0.0)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, event_type, user_id, seq, seq_late, cents, ns, hour, value, props, ts."""
    e = table(spark, sf_dir, "events")
    return e.withColumns({"seq": F.col("event_id"), "seq_late": F.col("event_id") * 7919 % 1000003, "cents": F.round(F.col("value") * 100).cast("bigint"), "ns": nanoseconds("ts")})


EVENTS = "(SELECT *, event_id AS seq, event_id * 7919 % 1000003 AS seq_late, CAST(round(value * 100) AS BIGINT) AS cents, epoch_us(ts) * 1000 AS ns, epoch_us(ts) * 1000 // 3600000000000 AS hour FROM events)"

# ---- running statistics

STATS = """SELECT event_type, CAST(count(*) AS DOUBLE) AS "count", round(avg(cents), 6) AS avg, round(coalesce(var_samp(cents), 0), 2) AS variance,
 round(coalesce(stddev_samp(cents), 0), 6) AS sd, round(CASE WHEN count(*) > 1 THEN stddev_pop(cents) ELSE 0 END, 6) AS usd FROM {e} GROUP BY event_type"""


def _stats(df: DataFrame) -> DataFrame:
    s = running.running_stats(df, "cents", ["event_type"])
    return s.withColumns({"avg": rounded(F.col("avg")), "variance": rounded(F.col("variance"), 2), "sd": rounded(F.col("sd")), "usd": rounded(F.col("usd"))})


@add("running_stats_by_key", STATS.format(e=EVENTS))
def running_stats_by_key(spark, sf_dir):
    return _stats(events(spark, sf_dir))


@add("running_stats_merged", f"SELECT event_type, count(*) AS n, round(avg(cents), 6) AS mean, round(coalesce(var_samp(cents), 0), 2) AS variance FROM {EVENTS} GROUP BY event_type")
def running_stats_merged(spark, sf_dir):
    """Per user, then merged: what several partitions' states give."""
    e = events(spark, sf_dir)
    states = running.as_state(running.running_stats(e, "cents", ["event_type", "user_id"]))
    whole = running.merge_stats(states, ["event_type"])
    return whole.select("event_type", F.col("count").cast("bigint").alias("n"), rounded(F.col("mean")).alias("mean"), rounded(F.coalesce(F.try_divide("m2", F.col("count") - 1), F.lit(0.0)), 2).alias("variance"))


@add("running_mean_prefix", f"SELECT event_id, event_type, count(cents) OVER w AS n, round(avg(cents) OVER w, 6) AS mean_so_far FROM {EVENTS} WINDOW w AS (PARTITION BY event_type ORDER BY seq ROWS UNBOUNDED PRECEDING)")
def running_mean_prefix(spark, sf_dir):
    got = running.running_prefix(events(spark, sf_dir), "cents", "seq", ["event_type"])
    return got.select("event_id", "event_type", F.col("count_so_far").alias("n"), rounded(F.col("mean_so_far")).alias("mean_so_far"))


# ---- rings

HOURLY = Ring(168, HOUR, ("event_type",))
CELLS = f"(SELECT event_type, hour AS bucket, CAST(least(greatest(sum(cents), -2147483648), 2147483647) AS INT) AS v FROM {EVENTS} GROUP BY ALL)"
NEWEST = f"(SELECT event_type, greatest(max(hour), 167) AS newest FROM {EVENTS} GROUP BY 1)"
RING = f"(SELECT event_type, bucket, v, newest FROM {CELLS} JOIN {NEWEST} USING (event_type) WHERE bucket > newest - 168)"
GRID = f"(SELECT event_type, i, newest - 167 + i AS bucket FROM {NEWEST}, (SELECT unnest(range(168)) AS i))"
FULL = f"(SELECT event_type, i, bucket, coalesce(v, 0) AS v FROM {GRID} LEFT JOIN {RING} USING (event_type, bucket))"


def hourly(spark, sf_dir) -> DataFrame:
    return HOURLY.add(events(spark, sf_dir), "ns", "cents")


add("ts_ring_add", f"SELECT event_type, bucket, v, newest FROM {RING}")(hourly)


@add("ts_ring_add_late", f"SELECT event_type, bucket, v, newest FROM {RING}")
def ts_ring_add_late(spark, sf_dir):
    """The same from events in a shuffled order."""
    return HOURLY.add(events(spark, sf_dir).orderBy("seq_late"), "ns", "cents")


def _set_sql(order: str) -> str:
    return f"SELECT event_type, bucket, v, newest FROM (SELECT event_type, hour AS bucket, CAST(arg_max(cents, {order}) AS INT) AS v FROM {EVENTS} GROUP BY ALL) JOIN {NEWEST} USING (event_type) WHERE bucket > newest - 168"


@add("ts_ring_set", _set_sql("seq"))
def ts_ring_set(spark, sf_dir):
    return HOURLY.set(events(spark, sf_dir), "ns", "cents", "seq")


@add("ts_ring_set_late", _set_sql("seq_late"))
def ts_ring_set_late(spark, sf_dir):
    return HOURLY.set(events(spark, sf_dir), "ns", "cents", "seq_late")


@add("ts_add_prefix", f"""SELECT event_type, seq, CAST(CASE WHEN hour > m - 168 THEN sum(cents) OVER (PARTITION BY event_type, hour ORDER BY seq_late) END AS INT) AS value
 FROM (SELECT *, greatest(max(hour) OVER (PARTITION BY event_type ORDER BY seq_late), 167) AS m FROM {EVENTS})""")
def ts_add_prefix(spark, sf_dir):
    """What every add returns, events coming late: null once the ring has moved on."""
    return rings.ring_prefix(events(spark, sf_dir), HOURLY, "ns", "cents", "seq_late", ["seq"]).select("event_type", "seq", "value")


BIG = "CASE WHEN event_id % 3 = 0 THEN -cents ELSE cents END * 60000"


@add("ts_saturating_add", f"""SELECT event_type, bucket, CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), vs), lambda a, x: greatest(least(a + x, 2147483647), -2147483648)) AS INT) AS v, newest
 FROM (SELECT event_type, hour AS bucket, list({BIG} ORDER BY seq) AS vs FROM {EVENTS} GROUP BY ALL) JOIN {NEWEST} USING (event_type) WHERE bucket > newest - 168""")
def ts_saturating_add(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("big", F.expr(BIG))
    return HOURLY.ordered_add(e, "ns", "big", "seq")


@add("ts_current_time", f"SELECT event_type, newest * 3600000000000 AS current_time FROM {NEWEST}")
def ts_current_time(spark, sf_dir):
    return HOURLY.current_time(hourly(spark, sf_dir))


AT = 1_706_500_000_000_000_000  # 2024-01-29 03:46:40


@add("ts_get", f"SELECT event_type, CASE WHEN {AT // HOUR} BETWEEN n.newest - 167 AND n.newest THEN coalesce(v, 0) END AS value FROM {NEWEST} n LEFT JOIN (SELECT * FROM {RING} WHERE bucket = {AT // HOUR}) USING (event_type)")
def ts_get(spark, sf_dir):
    return HOURLY.get(hourly(spark, sf_dir), AT)


@add("ts_get_range", f"SELECT event_type, i, bucket, v FROM {FULL} WHERE i < 100")
def ts_get_range(spark, sf_dir):
    return HOURLY.range(hourly(spark, sf_dir), None, 100)


@add("ts_range_array", f"SELECT event_type, md5(string_agg(CAST(v AS VARCHAR), ',' ORDER BY i)) AS digest FROM {FULL} GROUP BY 1")
def ts_range_array(spark, sf_dir):
    got = HOURLY.range_array(hourly(spark, sf_dir), None, 168)
    return got.select("event_type", F.md5(F.array_join(F.col("values").cast("array<string>"), ",")).alias("digest"))


def _ring_stats_sql(where: str) -> str:
    return f"""SELECT event_type, CAST(coalesce(sum(v) FILTER ({where}), 0) AS BIGINT) AS "sum", min(v) FILTER ({where}) AS "min", max(v) FILTER ({where}) AS "max", round(coalesce(avg(v) FILTER ({where}), 0), 4) AS avg,
 round(coalesce(stddev_samp(v) FILTER ({where}), 0), 4) AS sd, round(CASE WHEN count(*) FILTER ({where}) > 1 THEN stddev_pop(v) FILTER ({where}) ELSE 0 END, 4) AS usd, count(*) FILTER ({where}) AS rows_used FROM {FULL} GROUP BY 1"""


def _ring_stats(spark, sf_dir, zero: bool) -> DataFrame:
    s = HOURLY.stats(hourly(spark, sf_dir), None, 168, include_zero=zero)
    return s.withColumns({c: rounded(F.col(c), 4) for c in ("avg", "sd", "usd")})


@add("ts_stats", _ring_stats_sql("v <> 0"))
def ts_stats(spark, sf_dir):
    return _ring_stats(spark, sf_dir, False)


@add("ts_stats_zero", _ring_stats_sql("true"))
def ts_stats_zero(spark, sf_dir):
    return _ring_stats(spark, sf_dir, True)


DAILY = Ring(5, 24 * HOUR, ("event_type",))
DAYS = f"(SELECT event_type, hour // 24 AS day, CAST(sum(cents) AS BIGINT) AS v FROM {EVENTS} GROUP BY ALL)"
DAY_RING = f"(SELECT g.event_type, g.day AS part, g.day * 24 AS bucket, coalesce(d.v, 0) AS v FROM (SELECT event_type, newest - 4 + i AS day FROM (SELECT event_type, max(day) AS newest FROM {DAYS} GROUP BY 1), (SELECT unnest(range(5)) AS i)) g LEFT JOIN {DAYS} d ON d.event_type = g.event_type AND d.day = g.day)"


def _merged_sql(combine: str) -> str:
    return f"""SELECT event_type, bucket, v, newest FROM (SELECT event_type, bucket, CAST({combine} AS INT) AS v FROM (SELECT event_type, -1 AS part, bucket, v FROM {RING} UNION ALL SELECT event_type, part, bucket, v FROM {DAY_RING}) GROUP BY ALL)
 JOIN {NEWEST} USING (event_type) WHERE bucket > newest - 168"""


@add("ts_merge_add", _merged_sql("least(greatest(sum(v), -2147483648), 2147483647)"))
def ts_merge_add(spark, sf_dir):
    return HOURLY.merge_add(hourly(spark, sf_dir), DAILY.add(events(spark, sf_dir), "ns", "cents"), DAILY)


@add("ts_merge_set", _merged_sql("arg_max(v, part)"))
def ts_merge_set(spark, sf_dir):
    return HOURLY.merge_set(hourly(spark, sf_dir), DAILY.add(events(spark, sf_dir), "ns", "cents"), DAILY)


@add("hourly_ring_with_stats", f"SELECT r.event_type, r.bucket, r.v, s.avg, s.sd FROM {RING} r JOIN ({STATS.format(e=EVENTS)}) s USING (event_type)")
def hourly_ring_with_stats(spark, sf_dir):
    """Flagship: each type's hourly ring beside its running statistics (one row per type: broadcast by its checked size)."""
    return hourly(spark, sf_dir).select("event_type", "bucket", "v").join(_stats(events(spark, sf_dir)).select("event_type", "avg", "sd"), "event_type")


# ---- matrices

USERS_BY_HOUR = Matrix(25, 24)
M_CELLS = f"(SELECT CAST(user_id % 25 AS INT) AS r, CAST(hour % 24 AS INT) AS c, seq, cents FROM {EVENTS})"
M_INT = f"(SELECT r, c, CAST(least(greatest(sum(cents), -2147483648), 2147483647) AS INT) AS v FROM {M_CELLS} GROUP BY ALL)"
E_CELLS = "(SELECT CAST(vec_id AS INT) AS r, CAST(i AS INT) AS c, embedding[i + 1] AS v FROM embeddings, (SELECT unnest(range(64)) AS i))"


def user_cells(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).select((F.col("user_id") % 25).cast("int").alias("r"), (F.expr(f"ns div {HOUR}") % 24).cast("int").alias("c"), "seq", F.col("cents").alias("v"))


def int_matrix(spark, sf_dir) -> DataFrame:
    return USERS_BY_HOUR.build(user_cells(spark, sf_dir))


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("r"), F.posexplode("embedding").alias("c", "v"))


add("matrix_build", f"SELECT r, c, v FROM {M_INT}")(int_matrix)


@add("matrix_set", f"SELECT r, c, CAST(arg_max(cents, seq) AS INT) AS v FROM {M_CELLS} GROUP BY ALL")
def matrix_set(spark, sf_dir):
    return USERS_BY_HOUR.set(user_cells(spark, sf_dir))


@add("matrix_get", f"SELECT coalesce(max(v), 0) AS value FROM {M_INT} WHERE r = 3 AND c = 5")
def matrix_get(spark, sf_dir):
    return USERS_BY_HOUR.get(int_matrix(spark, sf_dir), 3, 5)


@add("matrix_get_row", f"SELECT g.r, md5(string_agg(CAST(coalesce(v, 0) AS VARCHAR), ',' ORDER BY g.c)) AS digest FROM (SELECT DISTINCT m.r, i AS c FROM {M_INT} m, (SELECT unnest(range(24)) AS i)) g LEFT JOIN {M_INT} m ON m.r = g.r AND m.c = g.c GROUP BY g.r")
def matrix_get_row(spark, sf_dir):
    got = USERS_BY_HOUR.rows_as_arrays(int_matrix(spark, sf_dir))
    return got.select("r", F.md5(F.array_join(F.col("values").cast("array<string>"), ",")).alias("digest"))


@add("matrix_sum", f"SELECT r, CAST(sum(v) AS BIGINT) AS \"sum\" FROM {M_INT} GROUP BY r")
def matrix_sum(spark, sf_dir):
    return USERS_BY_HOUR.sums(int_matrix(spark, sf_dir))


@add("matrix_sum_float", f"SELECT r, round(sum(CAST(v AS DOUBLE)), 5) + 0.0 AS \"sum\" FROM {E_CELLS} GROUP BY r")
def matrix_sum_float(spark, sf_dir):
    return Matrix(1_000_000, 64, "float").sums(vectors(spark, sf_dir)).withColumn("sum", rounded(F.col("sum"), 5))


@add("matrix_clear_row", f"SELECT r, c, v FROM {M_INT} WHERE r <> 4")
def matrix_clear_row(spark, sf_dir):
    return USERS_BY_HOUR.clear_row(int_matrix(spark, sf_dir), 4)


def _pcc_sql(cells: str, cols: int, row: int) -> str:
    """pcc of every other row; constant rows have none."""
    return f"""(WITH x AS (SELECT r, c, CAST(v AS DOUBLE) AS x FROM {cells}), t AS (SELECT c, x AS y FROM x WHERE r = {row}), tt AS (SELECT sum(y) AS ty, sum(y * y) AS tyy FROM t),
 s AS (SELECT r, sum(x) AS sx, sum(x * x) AS sxx, coalesce(sum(x * y), 0) AS sxy FROM x LEFT JOIN t USING (c) WHERE r <> {row} GROUP BY r)
 SELECT r, ({cols} * sxy - sx * ty) / sqrt(nullif(greatest(({cols} * sxx - sx * sx) * ({cols} * tyy - ty * ty), 0), 0)) AS pcc FROM s, tt)"""


def _best_sql(cells: str, cols: int, row: int, mode: str) -> str:
    order = "DESC" if mode == "max" else "ASC"
    return f"SELECT round(pcc, 9) + 0.0 AS pcc, r AS closest FROM {_pcc_sql(cells, cols, row)} WHERE pcc IS NOT NULL ORDER BY pcc {order}, r LIMIT 1"


for _mode in ("max", "min"):

    @add(f"matrix_pcc_{_mode}", _best_sql(M_INT, 24, 3, _mode))
    def matrix_pcc(spark, sf_dir, mode=_mode):
        return USERS_BY_HOUR.best_match(int_matrix(spark, sf_dir), 3, mode).withColumn("pcc", rounded(F.col("pcc"), 9))

    @add(f"matrix_pcc_{_mode}_float", _best_sql(E_CELLS, 64, 7, _mode))
    def matrix_pcc_float(spark, sf_dir, mode=_mode):
        return Matrix(1_000_000, 64, "float").best_match(vectors(spark, sf_dir), 7, mode).withColumn("pcc", rounded(F.col("pcc"), 9))


@add("matrix_correlations_float", f"SELECT r, round(pcc, 6) + 0.0 AS pcc FROM {_pcc_sql(E_CELLS, 64, 7)}")
def matrix_correlations_float(spark, sf_dir):
    return Matrix(1_000_000, 64, "float").correlations(vectors(spark, sf_dir), 7).withColumn("pcc", rounded(F.col("pcc")))


SMALL = Matrix(10, 12)
SMALL_SQL = f"(SELECT * FROM {M_INT} WHERE r < 10 AND c < 12)"


@add("matrix_merge_add", f"SELECT r, c, CAST(least(greatest(sum(v), -2147483648), 2147483647) AS INT) AS v FROM (SELECT * FROM {M_INT} UNION ALL SELECT * FROM {SMALL_SQL}) GROUP BY ALL")
def matrix_merge_add(spark, sf_dir):
    return USERS_BY_HOUR.merge_add(int_matrix(spark, sf_dir), SMALL.build(user_cells(spark, sf_dir)), SMALL)


@add("matrix_merge_set", f"SELECT r, c, v FROM {M_INT} WHERE r >= 10 OR c >= 12 UNION ALL SELECT r, c, CAST(arg_max(cents, seq) AS INT) FROM {M_CELLS} WHERE r < 10 AND c < 12 GROUP BY ALL")
def matrix_merge_set(spark, sf_dir):
    return USERS_BY_HOUR.merge_set(int_matrix(spark, sf_dir), SMALL.set(user_cells(spark, sf_dir)), SMALL)


def _halves(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    v = vectors(spark, sf_dir)
    return v, v.withColumn("c", 63 - F.col("c")).withColumn("v", F.when(F.col("c") % 5 == 0, F.lit(float("nan")).cast("float")).otherwise(F.col("v")))


HALVES = f"SELECT r, c, v, 0 AS part FROM {E_CELLS} UNION ALL SELECT r, 63 - c, CASE WHEN (63 - c) % 5 = 0 THEN NULL ELSE v END, 1 FROM {E_CELLS}"


@add("matrix_merge_add_float", f"SELECT r, c, round(CAST(CAST(sum(CAST(v AS DOUBLE)) AS FLOAT) AS DOUBLE), 5) + 0.0 AS v FROM ({HALVES}) GROUP BY ALL")
def matrix_merge_add_float(spark, sf_dir):
    m = Matrix(1_000_000, 64, "float")
    got = m.merge_add(*_halves(spark, sf_dir), m)
    return got.select("r", "c", rounded(F.when(~F.isnan("v"), F.col("v").cast("double")), 5).alias("v"))


@add("matrix_merge_set_float", f"SELECT r, c, round(CAST(CASE WHEN c < 32 THEN b ELSE a END AS DOUBLE), 5) + 0.0 AS v FROM (SELECT r, c, max(v) FILTER (part = 0) AS a, max(v) FILTER (part = 1) AS b, bool_or(part = 0) AS ha, bool_or(part = 1) AS hb FROM ({HALVES}) GROUP BY ALL) WHERE CASE WHEN c < 32 THEN hb ELSE ha END")
def matrix_merge_set_float(spark, sf_dir):
    a, b = _halves(spark, sf_dir)
    part = Matrix(1_000_000, 32, "float")
    got = Matrix(1_000_000, 64, "float").merge_set(a, b.where("c < 32"), part)
    return got.select("r", "c", rounded(F.when(~F.isnan("v"), F.col("v").cast("double")), 5).alias("v"))


# ---- matrix profile

MP_N, MP_M = 168, 12
SERIES = f"(SELECT i, CAST(sum(v) AS DOUBLE) AS v FROM {FULL} GROUP BY i)"
MP_SQL = f"""(WITH w AS (SELECT i, v, avg(v) OVER f AS mu, stddev_pop(v) OVER f AS sd FROM {SERIES} WINDOW f AS (ORDER BY i ROWS BETWEEN CURRENT ROW AND {MP_M - 1} FOLLOWING)),
 p AS (SELECT a.i AS j, b.i AS k, a.i - b.i AS g, a.mu AS mj, b.mu AS mk, a.sd AS sj, b.sd AS sk, a.v * b.v AS vv FROM w a JOIN w b ON a.i - b.i > {MP_M // 4} WHERE a.i - b.i < {MP_N - MP_M + 1}),
 q AS (SELECT *, sum(vv) OVER (PARTITION BY g ORDER BY j ROWS BETWEEN CURRENT ROW AND {MP_M - 1} FOLLOWING) AS qt FROM p),
 d AS (SELECT j, k, 2 * ({MP_M} - (qt - {MP_M} * mj * mk) / nullif(sj * sk, 0)) AS d FROM q WHERE j < {MP_N - MP_M + 1}),
 u AS (SELECT j AS i, k AS nn, d FROM d WHERE d IS NOT NULL UNION ALL SELECT k, j, d FROM d WHERE d IS NOT NULL)
 SELECT i, sqrt(abs(min(d))) AS mp, arg_min(nn, d) AS mpi FROM u GROUP BY i)"""


def series(spark, sf_dir) -> DataFrame:
    return HOURLY.range(hourly(spark, sf_dir), None, MP_N).groupBy(F.col("i").cast("bigint").alias("i")).agg(F.sum(F.col("v").cast("bigint")).alias("v"))


def _profile(spark, sf_dir) -> DataFrame:
    return profile.matrix_profile(series(spark, sf_dir), MP_N, MP_M)


@add("mp_profile", f"SELECT i, round(mp, 5) AS mp, mpi FROM {MP_SQL}")
def mp_profile(spark, sf_dir):
    return _profile(spark, sf_dir).withColumn("mp", rounded(F.col("mp"), 5))


@add("mp_profile_blocked", f"SELECT i, round(mp, 5) AS mp, mpi FROM {MP_SQL}")
def mp_profile_blocked(spark, sf_dir):
    return profile.matrix_profile_blocked(series(spark, sf_dir), MP_N, MP_M, tasks=8).withColumn("mp", rounded(F.col("mp"), 5))


@add("mp_profile_long")
def mp_profile_long(spark, sf_dir):
    """The longest series of the reference's benchmark: 11,520 values, windows of 60, all diagonals; rows of 225 seconds."""
    ring = Ring(11_520, 225_000_000_000)
    cells = ring.add(events(spark, sf_dir), "ns", "cents")
    return profile.matrix_profile_blocked(ring.range(cells, None, 11_520).select(F.col("i").cast("bigint").alias("i"), "v"), 11_520, 60, tasks=64).withColumn("mp", rounded(F.col("mp"), 5))


MP_TYPE_SQL = f"""WITH w AS (SELECT event_type, i, CAST(v AS DOUBLE) AS v, avg(v) OVER f AS mu, stddev_pop(v) OVER f AS sd FROM {FULL} WINDOW f AS (PARTITION BY event_type ORDER BY i ROWS BETWEEN CURRENT ROW AND {MP_M - 1} FOLLOWING)),
 p AS (SELECT a.event_type, a.i AS j, b.i AS k, a.i - b.i AS g, a.mu AS mj, b.mu AS mk, a.sd AS sj, b.sd AS sk, a.v * b.v AS vv FROM w a JOIN w b ON a.event_type = b.event_type AND a.i - b.i > {MP_M // 4} WHERE a.i - b.i < {MP_N - MP_M + 1}),
 q AS (SELECT *, sum(vv) OVER (PARTITION BY event_type, g ORDER BY j ROWS BETWEEN CURRENT ROW AND {MP_M - 1} FOLLOWING) AS qt FROM p),
 d AS (SELECT event_type, j, k, 2 * ({MP_M} - (qt - {MP_M} * mj * mk) / nullif(sj * sk, 0)) AS d FROM q WHERE j < {MP_N - MP_M + 1}),
 u AS (SELECT event_type, j AS i, d FROM d WHERE d IS NOT NULL UNION ALL SELECT event_type, k, d FROM d WHERE d IS NOT NULL)
 SELECT w.event_type, w.i, round(sqrt(abs(min(u.d))), 3) AS mp FROM w LEFT JOIN u ON u.event_type = w.event_type AND u.i = w.i WHERE w.i < {MP_N - MP_M + 1} GROUP BY ALL"""


@add("mp_profile_by_type", MP_TYPE_SQL)
def mp_profile_by_type(spark, sf_dir):
    """One profile per event type at once: the keyed form; null where a window has no neighbour."""
    p = profile.matrix_profile(HOURLY.range(hourly(spark, sf_dir), None, MP_N).select("event_type", "i", "v"), MP_N, MP_M, ["event_type"])
    return p.select("event_type", "i", rounded(F.when(F.col("mp") < float("inf"), F.col("mp")), 3).alias("mp"))


MP_DIAGONALS = f"(SELECT unnest(range({MP_M // 4 + 1}, {MP_N - MP_M + 1})) AS diag ORDER BY md5(diag || ':1'), diag LIMIT {int(0.25 * (MP_N - MP_M + 1) + 1) + 1})"
MP_SAMPLED = MP_SQL.replace(f"JOIN w b ON a.i - b.i > {MP_M // 4}", f"JOIN w b ON a.i - b.i IN (SELECT diag FROM {MP_DIAGONALS})")


@add("mp_profile_sampled", f"SELECT x.i, coalesce(round(m.mp, 5), CAST('Infinity' AS DOUBLE)) AS mp, coalesce(m.mpi, 0) AS mpi FROM (SELECT unnest(range({MP_N - MP_M + 1})) AS i) x LEFT JOIN {MP_SAMPLED} m USING (i)")
def mp_profile_sampled(spark, sf_dir):
    return profile.matrix_profile(series(spark, sf_dir), MP_N, MP_M, percent=25, seed=1).withColumn("mp", rounded(F.col("mp"), 5))


def _anomaly_sql(source: str) -> str:
    q = lambda p: p2_sql(f"(SELECT 0 AS key, i AS seq, mp AS x FROM {source})", p=p)
    last = lambda p: f"(SELECT q2 FROM {q(p)} ORDER BY rn DESC LIMIT 1)"
    return f"SELECT \"at\", round((d - e95) / (d - e50) * 100, 4) AS relative_pct, round(d - e50, 5) AS distance FROM (SELECT arg_max(i, mp) AS \"at\", max(mp) AS d FROM {source}), (SELECT {last(0.95)} AS e95, {last(0.5)} AS e50)"


def _rounded_anomaly(df: DataFrame) -> DataFrame:
    return df.select("at", rounded(F.col("relative_pct"), 4).alias("relative_pct"), rounded(F.col("distance"), 5).alias("distance"))


@add("mp_anomaly", _anomaly_sql(MP_SQL))
def mp_anomaly(spark, sf_dir):
    return _rounded_anomaly(profile.anomaly(_profile(spark, sf_dir)))


@add("mp_anomaly_current", _anomaly_sql(f"(SELECT * FROM {MP_SQL} WHERE i >= {MP_N - MP_M + 1 - MP_M})"))
def mp_anomaly_current(spark, sf_dir):
    return _rounded_anomaly(profile.anomaly(_profile(spark, sf_dir), last=MP_M))


# ---- quantiles

BY_TYPE = "(SELECT event_type AS key, seq, CAST(cents AS DOUBLE) AS x FROM " + EVENTS + ")"


def _markers_sql(fold: str, count: int) -> str:
    cases = lambda c: "[" + ", ".join(f"{c}{i}" for i in range(count)) + "]"
    return f"SELECT key AS event_type, marker, round(qs[marker + 1], 4) AS estimate, CAST(ns[marker + 1] AS BIGINT) AS n FROM (SELECT key, {cases('q')} AS qs, {cases('n')} AS ns FROM {fold} QUALIFY rn = max(rn) OVER (PARTITION BY key)), (SELECT CAST(unnest(range({count})) AS INT) AS marker)"


def _cents(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).withColumn("x", F.col("cents").cast("double"))


@add("p2_quantile", _markers_sql(p2_sql(BY_TYPE, p=0.75), 5))
def p2_quantile(spark, sf_dir):
    return p2.quantile(_cents(spark, sf_dir), "x", "seq", 0.75, ["event_type"]).withColumn("estimate", rounded(F.col("estimate"), 4))


@add("p2_quantile_prefix", f"SELECT e.event_type, e.seq, e.cents AS value, round(q2, 4) AS estimate FROM (SELECT event_type, seq, CAST(cents AS DOUBLE) AS cents, row_number() OVER (PARTITION BY event_type ORDER BY seq) AS rn FROM {EVENTS}) e LEFT JOIN {p2_sql(BY_TYPE, p=0.5)} f ON f.key = e.event_type AND f.rn = e.rn")
def p2_quantile_prefix(spark, sf_dir):
    return p2.quantile_prefix(_cents(spark, sf_dir), "x", "seq", 0.5, ["event_type"]).withColumn("estimate", rounded(F.col("estimate"), 4))


@add("p2_histogram", _markers_sql(p2_sql(BY_TYPE, buckets=6), 7))
def p2_histogram(spark, sf_dir):
    return p2.histogram(_cents(spark, sf_dir), "x", "seq", 6, ["event_type"]).withColumn("estimate", rounded(F.col("estimate"), 4))


@add("exact_percentiles", f"SELECT event_type, p, round(value, 4) AS value FROM (SELECT event_type, unnest([0.25, 0.5, 0.95]) AS p, unnest(quantile_cont(CAST(cents AS DOUBLE), [0.25, 0.5, 0.95])) AS value FROM {EVENTS} GROUP BY event_type)".replace("unnest([0.25, 0.5, 0.95])", "unnest([CAST(0.25 AS DOUBLE), 0.5, 0.95])"))
def exact_percentiles(spark, sf_dir):
    return p2.exact_percentiles(_cents(spark, sf_dir), "x", [0.25, 0.5, 0.95], ["event_type"]).withColumn("value", rounded(F.col("value"), 4))


@add("mergeable_percentiles", f"SELECT event_type, p, CAST(v[CAST(ceil(p * len(v)) AS BIGINT)] AS DOUBLE) AS value FROM (SELECT event_type, list_sort(list(cents)) AS v FROM {EVENTS} GROUP BY 1), (SELECT unnest([0.25, 0.5, 0.95]::DOUBLE[]) AS p)")
def mergeable_percentiles(spark, sf_dir):
    return p2.mergeable_percentiles(_cents(spark, sf_dir), "x", [0.25, 0.5, 0.95], ["event_type"])


# ---- sketches

SHAPE = sketches.Shape(0.01, 0.01)
HASHED = "('0x' || substr(md5(CAST(user_id AS VARCHAR)), {a}, 8))::BIGINT"
CMS_KEYS = f"(SELECT user_id, n, h1, h2, d, (h1 + d * h2 + d * d) % 4294967296 % {SHAPE.width} AS w FROM (SELECT user_id, sum(cents) AS n, {HASHED.format(a=1)} AS h1, {HASHED.format(a=9)} AS h2 FROM {EVENTS} GROUP BY user_id), (SELECT unnest(range({SHAPE.depth})) AS d))"
CMS_CELLS = f"(SELECT CAST(d AS INT) AS d, CAST(w AS INT) AS w, CAST(sum(n) AS BIGINT) AS cnt FROM {CMS_KEYS} GROUP BY ALL)"


NOT_FINITE = "CASE WHEN event_id % 11 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 13 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN event_id % 17 = 0 THEN CAST('-Infinity' AS DOUBLE) ELSE cents END"


@add("running_stats_not_finite", STATS.format(e=f"(SELECT event_type, x AS cents FROM (SELECT event_type, {NOT_FINITE} AS x FROM {EVENTS}) WHERE isfinite(x))"))
def running_stats_not_finite(spark, sf_dir):
    """NaN and infinities among the values are no observations."""
    return _stats(events(spark, sf_dir).withColumn("cents", F.expr(NOT_FINITE)))


def _keyed(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).withColumn("key", F.col("user_id").cast("string"))


def _linear(spark, sf_dir) -> DataFrame:
    return sketches.linear_sketch(_keyed(spark, sf_dir), "key", "cents", SHAPE, "md5")


add("cms_linear_cells", f"SELECT d, w, cnt FROM {CMS_CELLS}")(_linear)


@add("cms_linear_merged", f"SELECT d, w, cnt FROM {CMS_CELLS}")
def cms_linear_merged(spark, sf_dir):
    e = _keyed(spark, sf_dir)
    return sketches.merge_sketches(*(sketches.linear_sketch(e.where(f"event_id % 3 = {k}"), "key", "cents", SHAPE, "md5") for k in range(3)))


@add("cms_linear_query", f"SELECT CAST(k.user_id AS VARCHAR) AS key, CAST(min(c.cnt) AS BIGINT) AS estimate FROM {CMS_KEYS} k JOIN {CMS_CELLS} c ON c.d = k.d AND c.w = k.w GROUP BY 1")
def cms_linear_query(spark, sf_dir):
    return sketches.linear_query(_linear(spark, sf_dir), _keyed(spark, sf_dir), "key", SHAPE, "md5")


SIGNED = "CASE WHEN event_id % 7 = 0 THEN -1 ELSE 1 END"


@add("cms_counts", f"SELECT CAST(sum(n) AS BIGINT) AS items, count(*) FILTER (n > 0) AS \"unique\" FROM (SELECT user_id, sum({SIGNED}) AS n FROM {EVENTS} GROUP BY 1)")
def cms_counts(spark, sf_dir):
    return sketches.exact_counts(_keyed(spark, sf_dir).withColumn("n", F.expr(SIGNED)), "key", "n")


def xxh32_sql(key: str, seed: int) -> str:
    """XXH32 of an ASCII key of fewer than 16 characters, from its published definition."""
    word = "4294967296"
    codes = f"list_transform(string_split({key}, ''), lambda c: CAST(ascii(c) AS HUGEINT))"
    turn = lambda x, n: f"(({x}) * {2**n} % {word} + ({x}) // {2 ** (32 - n)})"
    four = f"list_transform(range(0, len({key}) // 4), lambda i: CAST(ascii({key}[4 * i + 1]) + 256 * ascii({key}[4 * i + 2]) + 65536 * ascii({key}[4 * i + 3]) + 16777216 * CAST(ascii({key}[4 * i + 4]) AS BIGINT) AS HUGEINT))"
    h = f"list_reduce(list_concat([CAST({seed} + 374761393 + len({key}) AS HUGEINT)], {four}), lambda h, x: " + turn(f"(h + x * 3266489917) % {word}", 17) + f" * 668265263 % {word})"
    h = f"list_reduce(list_concat([{h}], list_slice({codes}, len({key}) // 4 * 4 + 1, len({key}))), lambda h, x: " + turn(f"(h + x * 374761393) % {word}", 11) + f" * 2654435761 % {word})"
    for shift, prime in ((15, 2246822519), (13, 3266489917)):
        h = f"list_transform([{h}], lambda h: xor(h, h // {2**shift}) * {prime} % {word})[1]"
    return f"CAST(list_transform([{h}], lambda h: xor(h, h // 65536))[1] AS BIGINT)"


KEYS = "(SELECT DISTINCT CAST(user_id AS VARCHAR) AS key FROM events UNION SELECT DISTINCT props FROM events UNION SELECT DISTINCT event_type FROM events)"


@add("xxh32_keys", f"SELECT key, {xxh32_sql('key', 1)} AS h1, {xxh32_sql('key', 2)} AS h2 FROM {KEYS} WHERE len(key) < 16")
def xxh32_keys(spark, sf_dir):
    e = events(spark, sf_dir)
    keys = e.select(F.col("user_id").cast("string").alias("key")).union(e.select("props")).union(e.select("event_type")).distinct().where("length(key) < 16")
    return keys.select("key", *(sketches.xxh32(F.col("key").cast("binary"), seed).alias(f"h{seed}") for seed in (1, 2)))


SPOTS = f"list_transform(range({SHAPE.depth}), lambda d: CAST(d * {SHAPE.width} + (h1 + d * h2 + d * d) % 4294967296 % {SHAPE.width} + 1 AS BIGINT))"
#: Conservative updates one after the other, with the whole sketch as a list.
CONSERVATIVE = f"""(WITH RECURSIVE k AS MATERIALIZED (SELECT key, {SPOTS} AS spots FROM (SELECT key, {xxh32_sql('key', 1)} AS h1, {xxh32_sql('key', 2)} AS h2 FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS key FROM events))),
 u AS MATERIALIZED (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY seq) AS rn, spots, {SIGNED} AS n FROM {EVENTS} JOIN k ON k.key = CAST(user_id AS VARCHAR)),
 f AS (SELECT DISTINCT event_type, CAST(0 AS BIGINT) AS rn, list_transform(range({SHAPE.width * SHAPE.depth}), lambda i: CAST(0 AS BIGINT)) AS cells, CAST(0 AS BIGINT) AS items, CAST(0 AS BIGINT) AS "unique" FROM u UNION ALL
 SELECT event_type, rn, CASE WHEN n > 0 THEN list_transform(cells, lambda x, i: CASE WHEN list_contains(spots, i) THEN greatest(x, low + n) ELSE x END) WHEN low > 0 THEN list_transform(cells, lambda x, i: CASE WHEN list_contains(spots, i) THEN x - least(-n, low) ELSE x END) ELSE cells END,
 items + CASE WHEN n > 0 THEN n ELSE -least(-n, low) END, "unique" + CASE WHEN n > 0 AND low = 0 THEN 1 WHEN n < 0 AND low > 0 AND -n >= low THEN -1 ELSE 0 END
 FROM (SELECT u.event_type, u.rn, f.cells, f.items, f."unique", u.spots, u.n, list_min(list_transform(u.spots, lambda i: f.cells[i])) AS low FROM f JOIN u ON u.event_type = f.event_type AND u.rn = f.rn + 1))
 SELECT l.event_type, k.key, CAST(list_min(list_transform(k.spots, lambda i: l.cells[i])) AS BIGINT) AS estimate, CAST(l.items AS BIGINT) AS items, CAST(l."unique" AS BIGINT) AS "unique"
 FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY rn DESC) = 1) l JOIN (SELECT DISTINCT event_type, CAST(user_id AS VARCHAR) AS key FROM events) o USING (event_type) JOIN k USING (key))"""


@add("cms_conservative_query", f"SELECT * FROM {CONSERVATIVE}")
def cms_conservative_query(spark, sf_dir):
    e = _keyed(spark, sf_dir).withColumn("n", F.expr(SIGNED))
    by = ["event_type"]
    sketch = sketches.conservative_sketch(e, "key", "n", "seq", SHAPE, by)
    return sketches.conservative_query(sketch, e, "key", SHAPE, by).join(sketches.conservative_totals(sketch, by), by)


@add("distinct_exact", "SELECT event_type, count(DISTINCT user_id) AS \"unique\" FROM events GROUP BY 1")
def distinct_exact(spark, sf_dir):
    return sketches.distinct_exact(events(spark, sf_dir), "user_id", ["event_type"])


@add("distinct_hll")
def distinct_hll(spark, sf_dir):
    return sketches.distinct_hll(events(spark, sf_dir), "user_id", ["event_type"])


# ---- frequencies


@add("set_counts", "SELECT event_type, user_id, cnt, CAST(row_number() OVER (PARTITION BY event_type ORDER BY f) AS INT) AS idx FROM (SELECT event_type, user_id, count(*) AS cnt, min(event_id) AS f FROM events GROUP BY ALL)")
def set_counts(spark, sf_dir):
    return hitters.set_counts(events(spark, sf_dir), "user_id", "seq", ["event_type"])


@add("heavy_hitters_mg", f"""WITH RECURSIVE u AS MATERIALIZED (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY seq) AS rn, CAST(user_id AS VARCHAR) AS x FROM {EVENTS}),
 f AS (SELECT DISTINCT event_type, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(v VARCHAR, n BIGINT)[]) AS w FROM u UNION ALL
 SELECT u.event_type, u.rn, CASE WHEN len(list_filter(w, lambda e: e.v = x)) > 0 THEN list_transform(w, lambda e: {{'v': e.v, 'n': e.n + CASE WHEN e.v = x THEN 1 ELSE 0 END}})
 WHEN len(w) < 50 THEN list_append(w, {{'v': x, 'n': CAST(1 AS BIGINT)}}) ELSE list_transform(list_filter(w, lambda e: e.n > 1), lambda e: {{'v': e.v, 'n': e.n - 1}}) END FROM f JOIN u ON u.event_type = f.event_type AND u.rn = f.rn + 1)
 SELECT event_type, e.v AS value, e.n AS weight FROM (SELECT event_type, unnest(w) AS e FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY rn DESC) = 1))""")
def heavy_hitters_mg(spark, sf_dir):
    return hitters.heavy_hitters(events(spark, sf_dir), "user_id", "seq", 50, ["event_type"])


@add("frequent_values", "SELECT event_type, user_id, cnt FROM (SELECT event_type, user_id, count(*) AS cnt FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY cnt DESC, user_id) <= 10")
def frequent_values(spark, sf_dir):
    """A top-10 report."""
    return hitters.frequent_values(events(spark, sf_dir), "user_id", 10, ["event_type"])


PCT_SQL = f"(SELECT event_type, hour // 24 AS interval_, count(*) AS total, count(DISTINCT user_id) AS u, (1 - least(count(DISTINCT user_id) / count(*), 1)) * 100 AS pct FROM {EVENTS} GROUP BY ALL)"


@add("duplicate_pct_by_interval", f"""SELECT event_type, interval_ AS "interval", total, u AS "unique", round(pct, 6) AS duplicate_pct, round(least(min(pct) OVER b, min(pct) OVER a), 6) AS other_min, round(greatest(max(pct) OVER b, max(pct) OVER a), 6) AS other_max FROM {PCT_SQL}
 WINDOW b AS (PARTITION BY event_type ORDER BY interval_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY event_type ORDER BY interval_ ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)""")
def duplicate_pct_by_interval(spark, sf_dir):
    pct = hitters.duplicate_pct(events(spark, sf_dir), "user_id", F.expr(f"ns div {24 * HOUR}"), ["event_type"], exact=True)
    return hitters.duplicate_range(pct, ["event_type"]).withColumns({c: rounded(F.col(c)) for c in ("duplicate_pct", "other_min", "other_max")})


@add("hier_counts", "SELECT n_name AS nation, c_mktsegment AS segment, CAST(2 - (grouping(n_name) + grouping(c_mktsegment)) AS INT) AS level, count(*) AS cnt FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name, c_mktsegment) HAVING grouping(n_name) = 0")
def hier_counts(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return hitters.path_counts(c.select(F.col("n_name").alias("nation"), F.col("c_mktsegment").alias("segment")), ["nation", "segment"])


@add("cyclic_slots", f"SELECT event_type, CAST(hour % 25 + 1 AS INT) AS slot, count(*) AS cnt FROM {EVENTS} GROUP BY ALL")
def cyclic_slots(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type", cyclic_slot(F.col("ns"), HOUR, 25).alias("slot")).agg(F.count("*").alias("cnt"))


# ---- states


@add("codec_roundtrip", STATS.format(e=EVENTS).replace("SELECT event_type,", "SELECT event_type, 0 AS error, 24 AS bytes,", 1).replace("round(coalesce(stddev_samp(cents), 0), 6) AS sd, round(CASE WHEN count(*) > 1 THEN stddev_pop(cents) ELSE 0 END, 6) AS usd", "1 AS short_error"))
def codec_roundtrip(spark, sf_dir):
    s = running.as_state(running.running_stats(events(spark, sf_dir), "cents", ["event_type"]))
    stored = s.withColumn("state", codecs.stats_binary(F.col("count"), F.col("mean"), F.col("m2")))
    read = stored.select("event_type", F.length("state").alias("bytes"), codecs.binary_stats(F.col("state")).alias("s"), codecs.binary_stats(F.substring("state", 1, 23)).alias("short"))
    return read.select("event_type", F.col("s.error").alias("error"), "bytes", F.col("s.count").alias("count"), rounded(F.col("s.mean")).alias("avg"), rounded(F.coalesce(F.try_divide(F.col("s.m2"), F.col("s.count") - 1), F.lit(0.0)), 2).alias("variance"), F.col("short.error").alias("short_error"))


@add("state_resumed_quantile", _markers_sql(p2_sql(BY_TYPE, p=0.75), 5))
def state_resumed_quantile(spark, sf_dir):
    """States of the events so far, then the rest of the events from them."""
    e = _cents(spark, sf_dir)
    half = states.quantile_state(e.where("event_id < 400"), "x", "seq", 0.75, ["event_type"])
    whole = states.quantile_state(e.where("event_id >= 400"), "x", "seq", 0.75, ["event_type"], half)
    return states.markers(whole, ["event_type"], lambda b: codecs.unpack_quantile(b, 0.75)).withColumn("estimate", rounded(F.col("estimate"), 4))


@add("state_ring", f"SELECT event_type, bucket, v, newest FROM {RING} WHERE v <> 0")
def state_ring(spark, sf_dir):
    return states.ring_from_state(states.ring_state(hourly(spark, sf_dir), HOURLY), HOURLY)


@add("state_matrix", f"SELECT CAST(a AS INT) AS r, CAST(b AS INT) AS c, coalesce(v, 0) AS v FROM (SELECT unnest(range(25)) AS a), (SELECT unnest(range(24)) AS b) LEFT JOIN {M_INT} ON r = a AND c = b")
def state_matrix(spark, sf_dir):
    return states.matrix_from_state(states.matrix_state(int_matrix(spark, sf_dir), USERS_BY_HOUR), USERS_BY_HOUR)


# ---- messages and the monitor

SETTINGS = mon.Settings(samples=25, alert_submissions=50, many=100, duplicate_change=0.5)


def _messages(spark, sf_dir) -> DataFrame:
    return messages.from_events(table(spark, sf_dir, "events"))


@add("message_entries", f"""SELECT event_type AS logger, kind, name, count(*) AS cnt, min(seq) AS first_seq, max(ns) AS last_ns FROM (
 SELECT event_type, seq, ns, 'header' AS kind, 'Pid' AS name FROM {EVENTS} UNION ALL SELECT event_type, seq, ns, 'field', unnest(['value', 'user_id', 'props']) FROM {EVENTS}) GROUP BY ALL""")
def message_entries(spark, sf_dir):
    e = messages.explode_entries(_messages(spark, sf_dir))
    return e.groupBy(F.col("path")[0].alias("logger"), "kind", "name").agg(F.count("*").alias("cnt"), F.min("seq").alias("first_seq"), F.max("ns").alias("last_ns"))


@add("message_sample", "SELECT event_id AS seq FROM events WHERE ('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 2))::INT < 3")
def message_sample(spark, sf_dir):
    """A sampling operator: three 256ths of the messages."""
    return messages.sampled(_messages(spark, sf_dir), "seq").select("seq")


def _monitored(spark, sf_dir) -> DataFrame:
    return mon.monitor(_messages(spark, sf_dir), SETTINGS)


@add("monitor_schema")
def monitor_schema(spark, sf_dir):
    return _monitored(spark, sf_dir).select(F.array_join("path", "->").alias("path"), "kind", "name", "cnt", "value_type", "representation", "subtype", "created", "updated", "cint", "report")


@add("monitor_entries", f"""SELECT event_type AS path, kind, name, count(*) AS cnt, any_value(code) AS value_type, coalesce(arg_min(ns, seq) FILTER (kind = 'field'), 0) AS created, max(ns) AS updated FROM (
 SELECT event_type, seq, ns, 'header' AS kind, 'Pid' AS name, CAST(NULL AS INT) AS code FROM {EVENTS} UNION ALL SELECT event_type, seq, ns, 'field', unnest(['value', 'user_id', 'props']), unnest([3, 2, 0]) FROM {EVENTS}) GROUP BY event_type, kind, name""")
def monitor_entries(spark, sf_dir):
    return _monitored(spark, sf_dir).select(F.array_join("path", "->").alias("path"), "kind", "name", "cnt", "value_type", "created", "updated")


@add("monitor_set_counts", f"""WITH e AS (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY seq) AS rn FROM {EVENTS}),
 early AS (SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS d FROM e WHERE rn <= 255 GROUP BY 1), c AS (SELECT event_type, CAST(user_id AS VARCHAR) AS value, count(*) AS cnt FROM e GROUP BY ALL)
 SELECT event_type AS path, 'field' AS kind, 'user_id' AS name, value, cnt FROM c JOIN early USING (event_type) WHERE n = 255 AND n >= 2 * d
 UNION ALL SELECT event_type, 'header', 'Pid', value, cnt FROM c JOIN early USING (event_type) WHERE n = 255 AND n > d""")
def monitor_set_counts(spark, sf_dir):
    """Of the users, the two entries that the SQL names; whole counts, also of sets that a monitor's state can't hold."""
    return mon.whole_set_counts(_messages(spark, sf_dir), SETTINGS, exclude=["Fields[value]", "Fields[props]"]).withColumn("path", F.array_join("path", "->"))


#: Days compared with days, and every deviation an alert.
DRIFT = mon.Settings(samples=6, sample_interval_ns=24 * HOUR, alert_submissions=1, alert_pcc=0.99, many=1, duplicate_change=0.0)


@add("monitor_drift")
def monitor_drift(spark, sf_dir):
    return mon.alerts(mon.monitor(_messages(spark, sf_dir), DRIFT)).withColumn("path", F.array_join("path", "->"))


@add("monitor_report_json")
def monitor_report_json(spark, sf_dir):
    return mon.reports(_monitored(spark, sf_dir), _messages(spark, sf_dir))


# ---- streams, run to their present end


def _stream(spark, sf_dir) -> DataFrame:
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")


@add("stream_ring", f"SELECT event_type, bucket, v, newest FROM {RING}")
def stream_ring(spark, sf_dir):
    e = _stream(spark, sf_dir).withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))
    sums = processors.to_present(processors.stream_ring(e, "ts", "cents", HOURLY), ["event_type", "bucket"])
    return processors.trim_ring(sums, HOURLY)


@add("stream_ring_keyed", f"SELECT event_type, bucket, v, newest, CAST(0 AS BIGINT) AS late FROM {RING}")
def stream_ring_keyed(spark, sf_dir):
    e = _stream(spark, sf_dir).withColumns({"cents": F.round(F.col("value") * 100).cast("bigint"), "ns": nanoseconds("ts")})
    return processors.to_present(processors.stream_ring_keyed(e, "ns", "cents", "event_id", HOURLY), ["event_type"])


@add("stream_ring_keyed_late", f"""WITH e AS (SELECT event_type, seq_late, cents, ns // {HOUR} AS bucket FROM {EVENTS}), m AS (SELECT *, greatest(max(bucket) OVER (PARTITION BY event_type ORDER BY seq_late), {HOURLY.rows - 1}) AS newest FROM e),
 t AS (SELECT event_type, max(newest) AS newest, count(*) FILTER (bucket <= newest - {HOURLY.rows}) AS late FROM m GROUP BY 1)
 SELECT event_type, bucket, CAST(sum(cents) AS INT) AS v, t.newest, t.late FROM m JOIN t USING (event_type) WHERE bucket > m.newest - {HOURLY.rows} AND bucket > t.newest - {HOURLY.rows} GROUP BY event_type, bucket, t.newest, t.late""")
def stream_ring_keyed_late(spark, sf_dir):
    """Events that arrive in another order, so that many are too late for the ring."""
    e = _stream(spark, sf_dir).withColumns({"seq_late": F.col("event_id") * 7919 % 1000003, "cents": F.round(F.col("value") * 100).cast("bigint"), "ns": nanoseconds("ts")})
    return processors.to_present(processors.stream_ring_keyed(e, "ns", "cents", "seq_late", HOURLY), ["event_type"])


@add("stream_p2_quantile", _markers_sql(p2_sql(BY_TYPE, p=0.75), 5))
def stream_p2_quantile(spark, sf_dir):
    e = _stream(spark, sf_dir).withColumn("x", F.round(F.col("value") * 100).cast("bigint").cast("double"))
    got = processors.to_present(processors.stream_quantile(e, "x", "event_id", 0.75, ["event_type"]), ["event_type"])
    return got.withColumn("estimate", rounded(F.col("estimate"), 4))


@add("stream_monitor")
def stream_monitor(spark, sf_dir):
    got = processors.to_present(processors.stream_monitor(messages.from_events(_stream(spark, sf_dir)), SETTINGS), ["path", "kind", "name"])
    return got.select("path", "kind", "name", "cnt", "value_type", "subtype", "cint", "report")
