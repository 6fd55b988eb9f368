"""Queries over the driver's tables, each with DuckDB SQL for the same rows where SQL has it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ethanode.config import EngineConfig
from ethanode.functions import dates
from ethanode.functions import identifiers as ids
from ethanode.operators import aggregates, cleaning, crop, curve, features, joins, learning, leave_one_out, plot_data, smoothing, windows
from ethanode.plans import cohort
from ethanode.sources import recordings, results, workbooks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Shared heads of the SQL: readings r of episodes (a user's month, from 6:00), and metadata m.
R = """WITH e AS (SELECT event_id, user_id, event_type, CAST(ts AS TIMESTAMP) AS ts, value AS tac, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(ts AS TIMESTAMP) - INTERVAL 6 HOUR AS sh FROM events),
d AS (SELECT *, user_id || '_' || strftime(sh, '%Y-%m') AS episode FROM e),
r AS (SELECT episode, event_id, user_id, event_type, ts, tac, k / 100.0 AS motion, CAST(22 + k % 16 AS DOUBLE) AS temp,
 row_number() OVER w - 1 AS idx, (epoch_us(ts) / 1e6 - epoch_us(first_value(ts) OVER w) / 1e6) / 3600 AS hours
 FROM d WINDOW w AS (PARTITION BY episode ORDER BY ts, event_id)),
b AS (SELECT episode, count(*) AS n, CASE WHEN count(*) > 10 THEN avg(tac) FILTER (idx <= 10) + stddev_samp(tac) FILTER (idx <= 10) END AS thr FROM r GROUP BY episode)"""
M = """WITH m AS (SELECT c_custkey AS user_id, CAST(1 + c_nationkey % 2 AS INTEGER) AS sex, floor(abs(c_acctbal) % 8) AS drinks,
 CASE c_mktsegment WHEN 'BUILDING' THEN 'Alc' WHEN 'MACHINERY' THEN 'Non' ELSE 'Unk' END AS condition, CASE WHEN c_nationkey = 3 THEN 'N' ELSE 'Y' END AS use_data FROM customer)"""
#: Peak, begin and end of each episode's curve over the plain threshold.
C = """, p AS (SELECT r.*, b.thr, b.n, min_by(idx, (-tac, idx)) OVER (PARTITION BY r.episode) AS p FROM r JOIN b USING (episode)),
c AS (SELECT episode, any_value(n) AS n, max(p) AS p, any_value(coalesce(thr, 0)) AS thr, coalesce(max(idx) FILTER (idx < p AND idx >= 1 AND tac < coalesce(thr, 0)), 0) AS bi,
 coalesce(min(idx) FILTER (idx > p AND idx < n - 1 AND tac < coalesce(thr, 0) + least(0.005 * (idx - p - 1), 5.0)), max(idx)) AS ei, max(tac) AS top FROM p GROUP BY episode),
q AS (SELECT c.*, x.hours AS hp, y.hours AS hb, z.hours AS he, y.tac AS vb, z.tac AS ve, CASE WHEN top > 0.5 THEN top ELSE 1.0 END AS peak
 FROM c JOIN r x ON x.episode = c.episode AND x.idx = c.p JOIN r y ON y.episode = c.episode AND y.idx = c.bi JOIN r z ON z.episode = c.episode AND z.idx = c.ei)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def neat(df: DataFrame, *cols: str) -> DataFrame:
    """The columns, doubles rounded to six places, without negative zeros."""
    df = df.select(*cols) if cols else df
    return df.withColumns({f.name: F.round(f.name, 6) + F.lit(0.0) for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)})


readings = recordings.event_readings


@query(R + " SELECT user_id, strftime(ts - INTERVAL 6 HOUR, '%Y-%m-%d') AS day, count(*) AS n, min(ts) AS first, max(ts) AS last FROM r WHERE ts - INTERVAL 6 HOUR <> date_trunc('day', ts - INTERVAL 6 HOUR) GROUP BY ALL")
def episode_split_day(spark, sf):
    out = results.split_manifest(crop.day_episodes(readings(spark, sf), name="day"), ["user_id", "day"])
    return out.select("user_id", "day", "n", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"))


@query(R + " SELECT c_name AS email, strftime(ts - INTERVAL 6 HOUR, '%Y-%m-%d') AS day, count(*) AS n, min(ts) AS first, max(ts) AS last FROM r JOIN customer ON c_custkey = user_id WHERE c_name IS NOT NULL AND ts - INTERVAL 6 HOUR <> date_trunc('day', ts - INTERVAL 6 HOUR) GROUP BY ALL")
def email_split_day(spark, sf):
    owners = recordings.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("email"))
    out = results.split_manifest(crop.owner_days(joins.merged(readings(spark, sf), owners, "user_id", ["email"])), ["email", "day"])
    return out.select("email", "day", "n", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"))


@query(R + """ SELECT episode, count(*) AS n, round(avg(tac), 6) AS mean, round(stddev_samp(tac), 6) AS sd, round(stddev_samp(tac) / sqrt(count(tac)), 6) AS sem,
 round(CASE WHEN max(tac) > 0.5 THEN max(tac) ELSE 1.0 END, 6) AS peak, min_by(idx, (-tac, idx)) AS peak_index, round(sum(step) * 0.1, 6) AS auc_total, round(max(hours), 6) AS hours
 FROM (SELECT *, (tac + lag(tac) OVER (PARTITION BY episode ORDER BY idx)) / 2 AS step FROM r) GROUP BY episode""")
def episode_summary(spark, sf):
    return neat(aggregates.episode_summary(readings(spark, sf)))


@query(R + " SELECT event_id, episode, idx, round(hours, 6) AS hours FROM r")
def time_elapsed(spark, sf):
    return neat(readings(spark, sf), "event_id", "episode", "idx", "hours")


@query(R + " SELECT episode, round_even(60 / avg(s), 0) AS sampling_rate FROM (SELECT episode, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY episode ORDER BY idx))) / 1e6 AS s FROM r) GROUP BY episode")
def sampling_rate(spark, sf):
    return aggregates.sampling_rate(readings(spark, sf))


@query(R + " SELECT episode, round(avg(tac), 6) AS mean, round(stddev_samp(tac), 6) AS sd, round(stddev_samp(tac) / sqrt(count(tac)), 6) AS sem FROM r GROUP BY episode")
def mean_stdev_sem(spark, sf):
    return neat(aggregates.mean_sd_sem(readings(spark, sf)))


@query(R + " SELECT user_id, round(CASE WHEN max(tac) > 0.5 THEN max(tac) ELSE 1.0 END, 6) AS peak FROM r GROUP BY user_id")
def peak_floor(spark, sf):
    return neat(readings(spark, sf).groupBy("user_id").agg(aggregates.floored_peak(F.max("tac")).alias("peak")))


@query(R + """, x AS (SELECT r.*, n, CASE WHEN idx - 20 > 0 THEN 20 ELSE idx - 1 END AS bk, CASE WHEN idx + 20 < n THEN 20 ELSE n - 21 END AS ah FROM r JOIN b USING (episode))
 SELECT x.event_id, round(CASE WHEN max(y.tac) > 0.5 THEN max(y.tac) ELSE 1.0 END, 6) AS local_peak FROM x LEFT JOIN r y ON y.episode = x.episode AND y.idx >= greatest(x.idx - bk, 0) AND y.idx <= x.idx + ah GROUP BY x.event_id""")
def windowed_peak(spark, sf):
    return neat(aggregates.windowed_peak(readings(spark, sf), 20), "event_id", "local_peak")


@query(R + " SELECT episode, min_by(idx, (-tac, idx)) AS peak_index FROM r GROUP BY episode")
def peak_index(spark, sf):
    return readings(spark, sf).groupBy("episode").agg(aggregates.first_peak_index().alias("peak_index"))


@query(R + """ SELECT episode, CASE WHEN count(*) > 10 THEN round(avg(tac) FILTER (idx <= 10), 6) END AS baseline_mean, CASE WHEN count(*) > 10 THEN round(stddev_samp(tac) FILTER (idx <= 10), 6) END AS baseline_sd FROM r GROUP BY episode""")
def baseline_stats(spark, sf):
    return neat(aggregates.baseline(readings(spark, sf)), "episode", "baseline_mean", "baseline_sd")


@query(R + " SELECT episode, round(thr, 6) AS curve_threshold FROM b")
def curve_threshold(spark, sf):
    return neat(aggregates.baseline(readings(spark, sf)), "episode", "curve_threshold")


@query(R + """ SELECT episode, round(sum(s) * 0.1, 6) AS auc_total, round(sum(s) * 0.1 / max(hours), 6) AS auc_per_hour, round(sum(s * dh), 6) AS auc_time
 FROM (SELECT *, (tac + lag(tac) OVER w) / 2 AS s, hours - lag(hours) OVER w AS dh FROM r WINDOW w AS (PARTITION BY episode ORDER BY idx)) GROUP BY episode""")
def auc_trapezoid(spark, sf):
    return neat(aggregates.area(readings(spark, sf)))


@query(R + C + """, z2 AS (SELECT r.episode, idx, greatest(tac, q.thr) AS v, q.hp - q.hb + q.he - q.hp AS dur FROM r JOIN q ON q.episode = r.episode AND idx >= bi AND idx <= CASE WHEN bi = ei THEN ei + 1 ELSE ei END),
 z3 AS (SELECT *, (v + lag(v) OVER (PARTITION BY episode ORDER BY idx)) / 2 AS s FROM z2)
 SELECT episode, round(coalesce(sum(s), 0) * 0.1, 6) AS curve_auc, round(CASE WHEN coalesce(sum(s), 0) <> 0 AND max(dur) <> 0 THEN sum(s) * 0.1 / max(dur) END, 6) AS curve_auc_per_hour FROM z3 GROUP BY episode""")
def curve_auc_clip(spark, sf):
    df = _thresholded(spark, sf)
    return neat(curve.curve_area(df, curve.curve_measures(curve.curve_bounds(df))))


def _thresholded(spark, sf):
    return curve.thresholded(readings(spark, sf)).withColumn("curve_threshold", F.coalesce("curve_threshold", F.lit(0.0)))


@query(R + " SELECT episode, round(avg(abs(d)), 6) AS avg_tac_diff FROM (SELECT episode, tac - lag(tac) OVER (PARTITION BY episode ORDER BY idx) AS d FROM r) GROUP BY episode")
def avg_abs_diff(spark, sf):
    return neat(aggregates.mean_absolute_step(readings(spark, sf)))


@query(R + """, u AS (SELECT episode, idx, tac - lag(tac) OVER (PARTITION BY episode ORDER BY idx) >= 0 AS up FROM r),
 f AS (SELECT episode, CAST(up <> lag(up) OVER (PARTITION BY episode ORDER BY idx) AS BIGINT) AS flip FROM u)
 SELECT episode, CAST(coalesce(sum(flip), 0) AS BIGINT) AS alterations, count(*) - 1 AS steps, CASE WHEN count(*) > 1 THEN round(coalesce(sum(flip), 0) * 100.0 / (count(*) - 1), 6) END AS alteration_percent FROM f GROUP BY episode""")
def direction_flips(spark, sf):
    return neat(aggregates.direction_changes(readings(spark, sf)))


@query(R + " SELECT episode, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS proportion FROM r GROUP BY episode")
def value_proportion(spark, sf):
    return neat(aggregates.value_proportion(readings(spark, sf), "event_type", "error"))


@query(R + """, o AS (SELECT r.*, idx - lag(idx) OVER (PARTITION BY episode ORDER BY idx) AS g FROM r JOIN b USING (episode) WHERE tac > coalesce(thr, 0)),
 i AS (SELECT *, sum(CASE WHEN g * 30.0 / 60 >= 0.6 THEN 1 ELSE 0 END) OVER (PARTITION BY episode ORDER BY idx) AS run FROM o),
 g AS (SELECT episode, run, min(idx) AS lo, max(idx) AS hi FROM i GROUP BY episode, run),
 h AS (SELECT *, lead(lo) OVER (PARTITION BY episode ORDER BY run) AS nx FROM g),
 k AS (SELECT h.episode, run, max(r.tac) AS pk FROM h JOIN r ON r.episode = h.episode AND r.idx >= greatest(lo - CASE WHEN run = 0 THEN 1 ELSE 0 END, 0) AND r.idx <= nx
  WHERE nx IS NOT NULL AND (hi - lo + CASE WHEN run = 0 THEN 1 ELSE 0 END) * 30.0 / 60 >= 0.5 GROUP BY h.episode, run)
 SELECT b.episode, count(pk) FILTER (pk > 5) AS curve_count FROM b LEFT JOIN k USING (episode) GROUP BY b.episode""")
def curve_count_islands(spark, sf):
    return curve.curve_count(_thresholded(spark, sf), rate=30, separation_h=0.6)


@query(R + C + " SELECT episode, p AS peak_index, bi AS begin, round(hp - hb, 6) AS rise_duration FROM q")
def rise_duration(spark, sf):
    return neat(curve.curve_bounds(_thresholded(spark, sf)), "episode", "peak_index", "begin", "rise_duration")


@query(R + C + " SELECT episode, ei AS \"end\", round(he - hp, 6) AS fall_duration FROM q")
def fall_duration_ramp(spark, sf):
    return neat(curve.curve_bounds(_thresholded(spark, sf)), "episode", "end", "fall_duration")


@query(R + C + """ SELECT episode, round(peak - thr, 6) AS relative_peak, round(CASE WHEN hp <> hb THEN (peak - thr) / (hp - hb) ELSE 0 END, 6) AS rise_rate, round(CASE WHEN he <> hp THEN (peak - thr) / (he - hp) ELSE 0 END, 6) AS fall_rate, round(hp - hb + (he - hp), 6) AS curve_duration FROM q""")
def rise_fall_rates(spark, sf):
    return neat(curve.curve_measures(curve.curve_bounds(_thresholded(spark, sf))), "episode", "relative_peak", "rise_rate", "fall_rate", "curve_duration")


COMPLETION = """ , w AS (SELECT episode, CASE WHEN vb - thr <= 0 THEN 1.0 ELSE (peak - thr - (vb - thr)) / (peak - thr) END AS rc, CASE WHEN ve - thr <= 0 THEN 1.0 ELSE (peak - thr - (ve - thr)) / (peak - thr) END AS fc, hp - hb AS rd, he - hp AS fd FROM q)"""


@query(R + C + COMPLETION + " SELECT episode, round(rc, 6) AS rise_completion, round(fc, 6) AS fall_completion FROM w")
def completion(spark, sf):
    return neat(curve.curve_measures(curve.curve_bounds(_thresholded(spark, sf))), "episode", "rise_completion", "fall_completion")


@query(R + C + COMPLETION + """ SELECT episode, round(CASE WHEN fc < 0.5 THEN fd WHEN fc < 0.9 THEN fd / nullif(fc, 0) ELSE fd END, 6) AS fall_duration_revised, round(CASE WHEN rc < 0.5 THEN rd WHEN rc < 0.9 THEN rd / nullif(fc, 0) ELSE rd END, 6) AS rise_duration_revised FROM w""")
def revise_incomplete(spark, sf):
    return neat(curve.revised(curve.curve_measures(curve.curve_bounds(_thresholded(spark, sf)))), "episode", "fall_duration_revised", "rise_duration_revised")


@query(R + " SELECT event_id, idx FROM r WHERE hours <= 240")
def crop_max_duration(spark, sf):
    return crop.max_duration(readings(spark, sf), 240.0).select("event_id", "idx")


TEMPS = """, t AS (SELECT r.*, b.n, CASE WHEN temp < 27 THEN 1.0 ELSE 0.0 END AS cold1 FROM r JOIN b USING (episode)),
 a AS (SELECT episode, any_value(n) AS n, max(CASE WHEN temp <= 27 AND idx >= n - 6 THEN 1 ELSE 0 END) = 1 AND avg(cold1) <= 0.9 AS cut, coalesce(max(idx) FILTER (temp > 27 AND idx BETWEEN 6 AND n - 6), 6) AS last,
 max(CASE WHEN temp <= 27 AND idx <= 6 THEN 1 ELSE 0 END) = 1 AND avg(cold1) <= 0.9 AS cut0, coalesce(min(idx) FILTER (temp > 27 AND idx >= 6), any_value(n) - 1) AS first FROM t GROUP BY episode)"""


@query(R + TEMPS + " SELECT r.event_id, r.idx - CASE WHEN cut0 THEN first ELSE 0 END AS idx, CASE WHEN cut0 THEN first + 1 ELSE 0 END AS cropped_start FROM r JOIN a USING (episode) WHERE NOT cut0 OR idx >= first")
def crop_temp_start(spark, sf):
    return crop.cold_start(readings(spark, sf)).select("event_id", "idx", "cropped_start")


@query(R + TEMPS + " SELECT r.event_id, r.idx, CASE WHEN cut THEN greatest(n - 1 - last, 0) + 2 ELSE 0 END AS cropped_end FROM r JOIN a USING (episode) WHERE NOT cut OR idx <= last")
def crop_temp_end(spark, sf):
    return crop.cold_end(readings(spark, sf)).select("event_id", "idx", "cropped_end")


@query(R + """, v AS (SELECT episode, min(ts) FILTER (event_type = 'signup') AS lo, max(ts) FILTER (event_type = 'error') AS hi FROM r GROUP BY episode)
 SELECT event_id, row_number() OVER (PARTITION BY episode ORDER BY idx) - 1 AS idx FROM r JOIN v USING (episode) WHERE ts > lo AND ts < hi""")
def crop_timestamps(spark, sf):
    df = readings(spark, sf)
    bounds = df.groupBy("episode").agg(F.min(F.when(F.col("event_type") == "signup", F.col("ts"))).alias("begin"), F.max(F.when(F.col("event_type") == "error", F.col("ts"))).alias("end"))
    return crop.between(df, bounds).select("event_id", "idx")


@query(R + """, s AS (SELECT episode, (avg(idx * tac) - avg(idx) * avg(tac)) / (avg(idx * idx) - avg(idx) * avg(idx)) < -3 AND min(tac) < 10 AS hit FROM r WHERE idx <= 12 GROUP BY episode HAVING count(*) > 1)
 SELECT event_id, CAST(coalesce(hit, false) AND idx <= 11 AS INTEGER) AS sloped_start, round(CASE WHEN coalesce(hit, false) AND idx <= 12 THEN 0 ELSE tac END, 6) AS tac FROM r LEFT JOIN s USING (episode)""")
def sloped_start(spark, sf):
    return neat(cleaning.sloped_start(readings(spark, sf)), "event_id", "sloped_start", "tac")


@query(R + " SELECT event_id, CAST(tac - 20 < 0 AS INTEGER) AS negative_reassigned_zero, round(greatest(tac - 20, 0), 6) AS tac FROM r")
def negative_reset(spark, sf):
    return neat(cleaning.negatives_to_zero(readings(spark, sf, 20.0)), "event_id", "negative_reassigned_zero", "tac")


@query(R + """ SELECT episode, idx - 1 AS before, pts AS start, round(g, 6) AS length_h FROM (SELECT *, lag(ts) OVER w AS pts, hours - lag(hours) OVER w AS g FROM r WINDOW w AS (PARTITION BY episode ORDER BY idx)) WHERE g > 12""")
def gap_detect(spark, sf):
    return neat(cleaning.gaps(readings(spark, sf), 12.0).withColumn("start", F.col("start").cast("timestamp_ntz")))


@query(R + """, g AS (SELECT r.*, lag(ts) OVER w AS pts, hours - lag(hours) OVER w AS g, n FROM r JOIN b USING (episode) WINDOW w AS (PARTITION BY r.episode ORDER BY idx)),
 x AS (SELECT episode, event_id, pts, unnest(range(1, CAST(floor(g * 60 / 60) AS BIGINT) + 1)) AS k FROM g WHERE g > 12 AND n * 60 > 60)
 SELECT episode, event_id, pts + INTERVAL 60 MINUTE * k AS ts, 1 AS gap_imputed FROM x UNION ALL SELECT episode, event_id, ts, 0 FROM r""")
def gap_row_insert(spark, sf):
    df = cleaning.insert_gap_rows(readings(spark, sf), 12.0, 60.0)
    return df.select("episode", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "gap_imputed")


@query(R + """, h AS (SELECT r.*, n, max(tac) OVER (PARTITION BY r.episode) - min(tac) OVER (PARTITION BY r.episode) AS rng, CASE WHEN tac <= 100 THEN tac END AS ok FROM r JOIN b USING (episode)),
 f AS (SELECT *, last_value(ok IGNORE NULLS) OVER (PARTITION BY episode ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a, first_value(ok IGNORE NULLS) OVER (PARTITION BY episode ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS z FROM h)
 SELECT event_id, CAST(tac > 100 AND n > 30 AND rng > 5 AS INTEGER) AS extreme_outlier, round(CASE WHEN tac > 100 AND n > 30 AND rng > 5 AND a IS NOT NULL AND z IS NOT NULL THEN (a + z) / 2 ELSE tac END, 6) AS tac FROM f""")
def extreme_bridge(spark, sf):
    return neat(cleaning.bridge_extremes(readings(spark, sf), 100.0), "event_id", "extreme_outlier", "tac")


@query(R + " SELECT event_id, round(tac - lag(tac) OVER w, 6) AS tac_diff_prior, round(lead(tac) OVER w - tac, 6) AS tac_diff_post FROM r WINDOW w AS (PARTITION BY episode ORDER BY idx)")
def neighbour_diffs(spark, sf):
    return neat(windows.neighbour_differences(readings(spark, sf)), "event_id", "tac_diff_prior", "tac_diff_post")


@query(R + """ SELECT event_id, round(tac - avg(tac) OVER (PARTITION BY episode ORDER BY idx ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 6) AS tac_mean_change_pre,
 round(tac - avg(tac) OVER (PARTITION BY episode ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING), 6) AS tac_mean_change_post FROM r""")
def neighbour_means(spark, sf):
    return neat(windows.neighbour_mean_changes(readings(spark, sf)), "event_id", "tac_mean_change_pre", "tac_mean_change_post")


@query(R + """ SELECT event_id, round(CASE WHEN count(tac) OVER w >= 2 THEN regr_slope(tac, idx) OVER w END, 6) AS tac_slope FROM r WINDOW w AS (PARTITION BY episode ORDER BY idx ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""")
def rolling_slope(spark, sf):
    return neat(windows.rolling_slope(readings(spark, sf)), "event_id", "tac_slope")


@query(R + """, l AS (SELECT r.event_id, y.tac AS y, row_number() OVER (PARTITION BY r.event_id ORDER BY y.idx DESC) - 1 AS j, count(*) OVER (PARTITION BY r.event_id) AS m, (max(y.hours) OVER (PARTITION BY r.event_id) - min(y.hours) OVER (PARTITION BY r.event_id)) * 60 AS span FROM r JOIN r y ON y.episode = r.episode AND y.idx BETWEEN r.idx - 10 AND r.idx),
 u AS (SELECT *, j - (m - 1) / 2.0 AS u FROM l WHERE m > 5 AND span > 0),
 s AS (SELECT event_id, any_value(m) AS m, any_value(span) AS span, sum(u*u) AS s2, sum(u*u*u*u) AS s4, sum(y) AS y0, sum(y*u) AS y1, sum(y*u*u) AS y2 FROM u GROUP BY event_id),
 k AS (SELECT event_id, (m * y2 - s2 * y0) / (m * s4 - s2 * s2) AS a, y1 / s2 AS b, (y0 - (m * y2 - s2 * y0) / (m * s4 - s2 * s2) * s2) / m AS c, (m - 1) / span AS q, (m - 1) / 2.0 AS h FROM s)
 SELECT r.event_id, round(a*q*q * 1e6, 4) + 0.0 AS a_e6, round((b*q - 2*a*q*h) * 1e3, 4) + 0.0 AS b_e3, round(a*h*h - b*h + c + 1e-6, 4) + 0.0 AS c FROM r LEFT JOIN k USING (event_id)""")
def quadratic_fit(spark, sf):
    df = windows.quadratic_fits(readings(spark, sf))
    scaled = {"a_e6": F.col("tac_a_pre") * 1e6, "b_e3": F.col("tac_b_pre") * 1e3, "c": F.col("tac_c_pre") + 1e-6}  # c away from exact halves of the last place
    return df.select("event_id", *[(F.round(v, 4) + F.lit(0.0)).alias(k) for k, v in scaled.items()])


SG = ", ".join(f"({j}, CAST({c!r} AS DOUBLE))" for j, c in enumerate(smoothing.coefficients(51, 3)))


@query(R + f""", w(j, c) AS (VALUES {SG}), x AS (SELECT r.episode, r.event_id, r.idx, n, c, CASE WHEN n = 1 THEN 0 ELSE ((r.idx + j - 25) % (2 * (n - 1)) + 2 * (n - 1)) % (2 * (n - 1)) END AS q FROM r JOIN b USING (episode) CROSS JOIN w)
 SELECT x.event_id, round(sum(c * y.tac), 6) AS smooth FROM x JOIN r y ON y.episode = x.episode AND y.idx = CASE WHEN q < n THEN q ELSE 2 * (n - 1) - q END GROUP BY x.event_id""")
def savgol_smooth(spark, sf):
    return neat(smoothing.smoothed(readings(spark, sf)), "event_id", "smooth")


@query(R + """, x AS (SELECT r.*, n, avg(tac) OVER f + stddev_samp(tac) OVER f AS thr, max(tac) OVER g AS pk, min(tac) OVER g AS fl, max(tac) OVER h AS ld FROM r JOIN b USING (episode)
 WINDOW f AS (PARTITION BY r.episode ORDER BY idx ROWS BETWEEN CURRENT ROW AND 10 FOLLOWING), g AS (PARTITION BY r.episode ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), h AS (PARTITION BY r.episode ORDER BY idx ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING)),
 y AS (SELECT *, pk - fl AS rg, (pk - fl - 0.5) / 7 + 1 AS ra FROM x), z AS (SELECT *, idx <= n - 12 AND (thr < rg / ra + fl OR rg < 3 OR (rg < 5 AND pk - thr < 1)) AS good,
 CASE WHEN thr < fl OR thr > pk THEN fl + 0.8 * rg WHEN pk - thr < 8 AND ld >= pk THEN rg / ra + fl ELSE thr END AS t FROM y),
 a AS (SELECT episode, any_value(n) AS n, max(pk) FILTER (idx = 0) AS pk, max(fl) FILTER (idx = 0) AS fl, min(idx) FILTER (good) AS d, min_by(t, idx) FILTER (good) AS t, max(hours) AS hours FROM z GROUP BY episode),
 v AS (SELECT *, CASE WHEN pk - fl < 2 THEN 0 ELSE coalesce(d, greatest(n - 11, 0)) END AS dd FROM a),
 k AS (SELECT *, pk - fl >= 2 AND dd > 0 AND (hours - dd / n * hours < 1 OR dd / n * hours > (hours - dd / n * hours) / 3) AS back FROM v)
 SELECT episode, CAST(CASE WHEN back THEN 0 ELSE dd END AS BIGINT) AS dropped, round(CASE WHEN pk - fl < 2 OR back OR d IS NULL THEN (pk + fl) / 2 ELSE t END, 6) AS threshold FROM k""")
def threshold_suffix_search(spark, sf):
    return neat(curve.threshold_search(readings(spark, sf)))


@query(R + """ SELECT episode, round(avg(CASE WHEN temp <= 27 THEN 1.0 ELSE 0.0 END) * 100, 6) AS not_worn_percent, round(avg(CASE WHEN temp <= 27 THEN 1.0 ELSE 0.0 END) * max(hours), 6) AS not_worn_hours,
 round((1 - avg(CASE WHEN temp <= 27 THEN 1.0 ELSE 0.0 END)) * max(hours), 6) AS worn_hours, round(100 - avg(CASE WHEN temp <= 27 THEN 1.0 ELSE 0.0 END) * 100, 6) AS worn_percent FROM r GROUP BY episode""")
def wear_flag_stats(spark, sf):
    return neat(aggregates.wear_statistics(readings(spark, sf)))


@query(R + """, x AS (SELECT episode, avg(CASE WHEN motion = 0 OR temp <= 27 THEN 1.0 ELSE 0.0 END) AS i, avg(CASE WHEN tac > 100 THEN 1.0 ELSE 0.0 END) AS m, max(hours) AS h FROM r GROUP BY episode),
 y AS (SELECT episode, i * 100 AS ip, (1 - i) * h AS ah, m * 100 AS mp FROM x)
 SELECT episode, round(ip, 6) AS inactive_percent, round(ah, 6) AS active_hours, round(mp, 6) AS imputed_percent, CASE WHEN ip >= 36 THEN 'inactive' WHEN ah <= 1 THEN 'short' WHEN mp > 15 THEN 'imputed' END AS invalid_reason,
 CAST(NOT (ip >= 36 OR ah <= 1 OR mp > 15) AS INTEGER) AS valid FROM y""")
def qc_validity(spark, sf):
    df = cleaning.worn(readings(spark, sf)).withColumn("extreme_outlier", (F.col("tac") > 100).cast("int"))
    return neat(aggregates.quality_control(df, 1.0, 36.0, 15.0), "episode", "inactive_percent", "active_hours", "imputed_percent", "invalid_reason", "valid")


@query(M + """ SELECT user_id, CASE WHEN drinks = 0 THEN 'None' WHEN (sex = 1 AND drinks >= 5) OR (sex = 2 AND drinks >= 4) THEN 'Heavy' WHEN drinks > 0 THEN 'Light' ELSE 'Unk' END AS binge FROM m""")
def binge_label(spark, sf):
    return recordings.customer_metadata(spark, sf).select("user_id", ids.binge(F.col("drinks"), F.col("sex")).alias("binge"))


@query(R + M.replace("WITH m", ", m") + " SELECT event_id, condition, sex, round(drinks, 6) AS drinks FROM r LEFT JOIN m USING (user_id)")
def metadata_join(spark, sf):
    return neat(joins.with_metadata(readings(spark, sf), recordings.customer_metadata(spark, sf), ["user_id"]), "event_id", "condition", "sex", "drinks")


@query(R + " SELECT event_id, c_name, round(c_acctbal, 6) AS c_acctbal FROM r LEFT JOIN customer ON c_custkey = user_id")
def merge_left(spark, sf):
    extra = recordings.table(spark, sf, "customer").withColumnRenamed("c_custkey", "user_id")
    return neat(joins.merged(readings(spark, sf), extra, "user_id", ["c_name", "c_acctbal"]), "event_id", "c_name", "c_acctbal")


@query(R + " SELECT coalesce(r.user_id, c.c_custkey) AS user_id, count(event_id) AS n, any_value(c_name) AS c_name FROM r FULL JOIN customer c ON c_custkey = user_id GROUP BY 1")
def merge_outer(spark, sf):
    extra = recordings.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return joins.outer_by_row(readings(spark, sf), extra, "user_id").groupBy("user_id").agg(F.count("event_id").alias("n"), F.first("c_name").alias("c_name"))


EVENTS = ", v AS (SELECT episode, CASE event_type WHEN 'error' THEN 'off' ELSE 'on' END AS event_name, min(ts) AS event_ts FROM r WHERE event_type IN ('error', 'signup') GROUP BY ALL)"


@query(R + EVENTS.replace("min(ts) AS event_ts", "min(ts) + INTERVAL 100 MINUTE AS event_ts") + " SELECT episode, event_name, event_ts, min_by(idx, (abs(epoch_us(ts) - epoch_us(event_ts)), idx)) AS idx FROM r JOIN v USING (episode) GROUP BY ALL")
def nearest_event_asof(spark, sf):
    events = recordings.day_events(spark, sf).withColumn("event_ts", F.col("event_ts") + F.expr("INTERVAL 100 MINUTES"))  # away from the readings themselves
    return joins.nearest_reading(readings(spark, sf), events).withColumn("event_ts", F.col("event_ts").cast("timestamp_ntz"))


@query(R + EVENTS + """ SELECT event_id, CAST(arg_max(CASE event_name WHEN 'off' THEN 0 ELSE 1 END, (event_ts, event_name = 'off')) FILTER (event_ts IS NOT NULL) AS INTEGER) AS device_on_label FROM r LEFT JOIN v ON v.episode = r.episode AND event_ts <= ts GROUP BY event_id""")
def interval_label(spark, sf):
    return joins.labelled_by_events(readings(spark, sf), recordings.day_events(spark, sf)).select("event_id", "device_on_label")


@query(M + " SELECT user_id FROM m WHERE condition <> 'Unk' AND use_data <> 'N'")
def anti_join_excluded(spark, sf):
    meta = recordings.customer_metadata(spark, sf)
    gone = meta.where("condition = 'Unk' or use_data = 'N'")
    return joins.anti(meta, gone, ["user_id"]).select("user_id")


@query(R + " SELECT event_id FROM r WHERE user_id IN (SELECT user_id FROM r GROUP BY user_id ORDER BY min(event_id) LIMIT 10)")
def semi_join_training(spark, sf):
    return windows.first_groups(readings(spark, sf), "user_id", 10, "event_id").select("event_id")


@query("SELECT c_custkey AS id, c_name AS name, round(c_acctbal, 6) AS balance, CAST(NULL AS VARCHAR) AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, round(s_acctbal, 6), 'supplier' FROM supplier")
def union_by_name(spark, sf):
    c = recordings.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    s = recordings.table(spark, sf, "supplier").select(F.lit("supplier").alias("segment"), F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return neat(joins.stacked(c, s), "id", "name", "balance", "segment")


@query(M + " SELECT DISTINCT sex, condition, use_data FROM m WHERE condition <> 'Unk'")
def distinct_features(spark, sf):
    meta = recordings.customer_metadata(spark, sf).select("sex", "condition", "use_data")
    return joins.excluded_and_kept(meta, {"condition": ["Unk"]})[0]


@query(R + " SELECT event_id FROM r JOIN b USING (episode) WHERE idx >= 10 AND idx < n - 10")
def head_tail_exclusion(spark, sf):
    return windows.without_ends(readings(spark, sf)).select("event_id")


@query(M + """, f AS (SELECT CAST(condition = 'Alc' AS INTEGER) AS t, CAST(drinks >= 4 AS INTEGER) AS p FROM m WHERE condition <> 'Unk')
 SELECT CAST(sum(t * p) AS BIGINT) AS tp, CAST(sum((1 - t) * (1 - p)) AS BIGINT) AS tn, CAST(sum((1 - t) * p) AS BIGINT) AS fp, CAST(sum(t * (1 - p)) AS BIGINT) AS fn,
 round(sum(t * p + (1 - t) * (1 - p)) / count(*), 6) AS accuracy, round(sum(t * p) / sum(t), 6) AS sensitivity, round(sum((1 - t) * (1 - p)) / sum(1 - t), 6) AS specificity FROM f""")
def confusion_counts(spark, sf):
    meta = recordings.customer_metadata(spark, sf).where("condition <> 'Unk'")
    rows = meta.select((F.col("condition") == "Alc").cast("int").alias("truth"), (F.col("drinks") >= 4).cast("int").alias("predicted"))
    return neat(aggregates.confusion(rows, positive=1, negative=0))


@query(R + """ SELECT event_type, round(min(tac), 6) AS low, round(quantile_cont(tac, 0.25), 6) AS q25, round(quantile_cont(tac, 0.5), 6) AS q50, round(quantile_cont(tac, 0.75), 6) AS q75, round(max(tac), 6) AS high FROM r GROUP BY event_type""")
def box_whisker(spark, sf):
    return neat(aggregates.quartiles(readings(spark, sf), "tac", ["event_type"]))


@query(R + " SELECT CAST(20 + CASE WHEN temp = 40 THEN 9 ELSE floor((temp - 20) / 2) END * 2 AS DOUBLE) AS bin, count(*) AS n FROM r WHERE temp BETWEEN 20 AND 40 GROUP BY 1")
def temp_histogram(spark, sf):
    return aggregates.histogram(readings(spark, sf))


@query(R + " SELECT event_id, round((tac - avg(tac) OVER w) / stddev_samp(tac) OVER w, 6) AS tac_z FROM r WINDOW w AS (PARTITION BY episode)")
def zscore(spark, sf):
    return neat(windows.standardized(readings(spark, sf)), "event_id", "tac_z")


@query(R + " SELECT event_id, round(tac - 20 - least(min(tac - 20) OVER (PARTITION BY episode), 0), 6) AS tac_baseline FROM r")
def baseline_correct(spark, sf):
    return neat(windows.baseline_corrected(readings(spark, sf, 20.0)), "event_id", "tac_baseline")


NAMES = "CAST(1000 + c_custkey AS VARCHAR) || '_' || CASE WHEN c_custkey % 7 = 0 THEN '000' ELSE lpad(CAST(c_nationkey AS VARCHAR), 3, '0') END || '_' || c_mktsegment || '.csv'"


@query(f"""WITH n AS (SELECT c_custkey, {NAMES} AS name FROM customer), s AS (SELECT *, string_split(string_split(name, '.')[1], '_') AS p FROM n)
 SELECT c_custkey, nullif(regexp_extract(name, '^(\\d{{3,6}})', 1), '') AS subid, CASE WHEN regexp_full_match(p[2], '\\d{{3}}') AND p[2] <> '000' THEN p[2] END AS dataset_identifier, substr(p[3], 1, 3) AS extra, 'csv' AS extension,
 CASE WHEN contains(name, 'Alc') THEN 'Alc' WHEN contains(name, 'Non') THEN 'Non' ELSE 'Unk' END AS condition FROM s""")
def filename_parse(spark, sf):
    c = recordings.table(spark, sf, "customer")
    ds = F.when(F.col("c_custkey") % 7 == 0, "000").otherwise(F.lpad(F.col("c_nationkey").cast("string"), 3, "0"))
    name = F.concat((F.col("c_custkey") + 1000).cast("string"), F.lit("_"), ds, F.lit("_"), F.col("c_mktsegment"), F.lit(".csv"))
    rows = c.select("c_custkey", name.alias("name"))
    n = F.col("name")
    return rows.select("c_custkey", ids.subid_of(n).alias("subid"), ids.dataset_of(n).alias("dataset_identifier"), ids.extra_text_of(n).alias("extra"), ids.extension_of(n).alias("extension"), ids.condition_in_name(n).alias("condition"))


@query("""WITH x AS (SELECT o_orderkey, strftime(CAST(o_orderdate AS TIMESTAMP), '%d/%m/%Y') AS t FROM orders), f AS (SELECT bool_or(try_strptime(t, '%d/%m/%Y') IS NOT NULL) AND NOT bool_and(try_strptime(t, '%m/%d/%Y') IS NOT NULL) AS dmy FROM x)
 SELECT o_orderkey, CAST(CASE WHEN dmy THEN try_strptime(t, '%d/%m/%Y') ELSE try_strptime(t, '%m/%d/%Y') END AS DATE) AS d FROM x, f""")
def date_format_detect(spark, sf):
    o = recordings.table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("d"))
    return dates.standard_dates(o, "d")


@query(R + """, s AS (SELECT event_id, tac - 20 AS raw, greatest(tac - 20, 0) AS neg, CASE WHEN tac > 100 THEN 100 ELSE greatest(tac - 20, 0) END AS cap FROM r)
 SELECT event_id, CASE WHEN neg <> raw AND neg = cap THEN 'neg' WHEN cap <> raw AND cap <> neg THEN 'cap' END AS cleaning_stage FROM s""")
def cleaning_stage(spark, sf):
    df = readings(spark, sf).select("event_id", (F.col("tac") - 20).alias("raw"), F.greatest(F.col("tac") - 20, F.lit(0.0)).alias("neg"), F.when(F.col("tac") > 100, 100.0).otherwise(F.greatest(F.col("tac") - 20, F.lit(0.0))).alias("cap"))
    return features.cleaning_stage(df, ["raw", "neg", "cap"]).select("event_id", "cleaning_stage")


@query(R + """, v AS (SELECT *, tac < 20 AS gone, CASE WHEN tac >= 20 THEN hours END AS kh, CASE WHEN tac >= 20 THEN tac END AS kv FROM r),
 w AS (SELECT *, last_value(kh IGNORE NULLS) OVER a AS ah, last_value(kv IGNORE NULLS) OVER a AS av, first_value(kh IGNORE NULLS) OVER z AS zh, first_value(kv IGNORE NULLS) OVER z AS zv FROM v
  WINDOW a AS (PARTITION BY episode ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), z AS (PARTITION BY episode ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT event_id, round(CASE WHEN NOT gone THEN tac WHEN zh > ah THEN av + (zv - av) * (hours - ah) / (zh - ah) ELSE coalesce(av, zv, 0) END, 6) AS filled FROM w""")
def impute_linear(spark, sf):
    df = readings(spark, sf).withColumn("gone", F.col("tac") < 20)
    return neat(cleaning.fill_linear(df, "gone", "filled"), "event_id", "filled")


@query(R + """ SELECT event_id, CAST(sum(CASE WHEN g > 12 THEN 1 ELSE 0 END) OVER (PARTITION BY episode ORDER BY idx) AS BIGINT) AS run FROM (SELECT *, hours - lag(hours) OVER (PARTITION BY episode ORDER BY idx) AS g FROM r)""")
def find_ranges(spark, sf):
    return windows.runs(readings(spark, sf), F.col("hours"), 12.0).select("event_id", "run")


@query(R + """ SELECT event_id, CASE WHEN tac >= m THEN mn <= m ELSE mx >= m END AS returns FROM (SELECT event_id, tac, avg(tac) OVER (PARTITION BY episode ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS m,
 min(tac) OVER (PARTITION BY episode ORDER BY idx ROWS BETWEEN CURRENT ROW AND 119 FOLLOWING) AS mn, max(tac) OVER (PARTITION BY episode ORDER BY idx ROWS BETWEEN CURRENT ROW AND 119 FOLLOWING) AS mx FROM r)""")
def returns_to_baseline(spark, sf):
    return windows.returns_to_baseline(readings(spark, sf)).select("event_id", "returns")


@query(R.replace("WITH e AS", "WITH RECURSIVE e AS") + """, t AS (SELECT episode, idx, event_id, epoch_us(ts) / 1e6 AS t FROM r),
 k AS (SELECT episode, idx, event_id, t FROM t WHERE idx = 0 UNION ALL SELECT s.episode, s.idx, s.event_id, s.t FROM (SELECT t.*, row_number() OVER (PARTITION BY t.episode ORDER BY t.idx) AS rn FROM k JOIN t ON t.episode = k.episode AND t.idx > k.idx AND t.t - k.t >= 36000) s WHERE rn = 1)
 SELECT event_id, row_number() OVER (PARTITION BY episode ORDER BY idx) - 1 AS idx FROM k""")
def greedy_downsample(spark, sf):
    return cleaning.thinned(readings(spark, sf), 36000.0).select("event_id", "idx")


@query(R + TEMPS + " SELECT r.event_id, CAST(NOT cut OR idx <= last AS INTEGER) AS kept FROM r JOIN a USING (episode)")
def plot_cropping(spark, sf):
    df = readings(spark, sf)
    return plot_data.cropping(df, crop.cold_end(df)).select("event_id", "kept")


@query(R + " SELECT episode, CASE WHEN temp > 30 THEN 'on' ELSE 'off' END AS side, count(*) AS n FROM r GROUP BY ALL")
def plot_device_removal(spark, sf):
    return plot_data.device_removal(readings(spark, sf), 30.0).groupBy("episode", "side").agg(F.count(F.lit(1)).alias("n"))


@query(R + " SELECT episode, round(hours, 6) AS hours, 'tac' AS series, round(tac, 6) AS value FROM r UNION ALL SELECT episode, round(hours, 6), 'temp', round(temp, 6) FROM r")
def plot_tac_and_temp(spark, sf):
    return neat(plot_data.column_series(readings(spark, sf), ["tac", "temp"]))


@query(R + EVENTS + """, k AS (SELECT episode, event_name, event_ts, min_by(idx, (abs(epoch_us(ts) - epoch_us(event_ts)), idx)) AS idx FROM r JOIN v USING (episode) GROUP BY ALL)
 SELECT k.episode, event_name, k.idx, round(hours, 6) AS hours, round(tac, 6) AS tac FROM k JOIN r ON r.episode = k.episode AND r.idx = k.idx""")
def plot_event_lines(spark, sf):
    df = readings(spark, sf)
    return neat(plot_data.event_lines(joins.nearest_reading(df, recordings.day_events(spark, sf)), df), "episode", "event_name", "idx", "hours", "tac")


@query("""WITH u AS (SELECT c_nationkey, list(DISTINCT 1 + c_custkey % 5) AS l FROM customer GROUP BY c_nationkey)
 SELECT CAST(1000 + c_nationkey AS VARCHAR) AS subid, len(l) AS n, lpad(CAST(list_min(list_filter(range(1, 8), lambda x: NOT list_contains(l, x))) AS VARCHAR), 3, '0') AS free FROM u""")
def dataset_identifiers(spark, sf):
    c = recordings.table(spark, sf, "customer")
    files = c.select(F.concat((F.col("c_nationkey") + 1000).cast("string"), F.lit("_"), F.lpad((1 + F.col("c_custkey") % 5).cast("string"), 3, "0"), F.lit(".csv")).alias("file_name"))
    used = recordings.used_datasets(files)
    return used.select("subid", F.size("datasets").cast("long").alias("n")).join(recordings.free_dataset(used).withColumnRenamed("dataset", "free"), "subid")


@query("SELECT c_custkey, CAST(c_nationkey AS VARCHAR) || '_' || lpad(CAST(c_custkey % 50 AS VARCHAR), 3, '0') || 'e1' AS full_identifier FROM customer")
def full_identifiers(spark, sf):
    c = recordings.table(spark, sf, "customer")
    return c.select("c_custkey", ids.full_identifier(F.col("c_nationkey"), F.col("c_custkey") % 50, F.lit(1)).alias("full_identifier"))


@query(R + " SELECT episode, CAST(count(DISTINCT CASE WHEN user_id % 3 = 0 AND day(ts) > 15 THEN 2 ELSE 1 END) > 1 AS INTEGER) AS several FROM r GROUP BY episode")
def multiple_devices(spark, sf):
    device = F.when((F.col("user_id") % 3 == 0) & (F.dayofmonth("ts") > 15), 2).otherwise(1)  # every third user's was exchanged
    return readings(spark, sf).groupBy("episode").agg((F.count_distinct(device) > 1).cast("int").alias("several"))


@query(R + " SELECT event_id, episode FROM r JOIN b USING (episode) WHERE n > 60")
def size_gate(spark, sf):
    return crop.large_enough(readings(spark, sf), 60).select("event_id", "episode")


@query(R + " SELECT event_id FROM r JOIN b USING (episode) WHERE idx < 5 OR idx >= n - 5")
def group_head_tail(spark, sf):
    return windows.head_and_tail(readings(spark, sf), 5).select("event_id")


@query(M + " SELECT a.user_id, a.sex, a.condition FROM m a JOIN (SELECT * FROM m WHERE use_data = 'Y') b ON a.user_id = b.user_id AND a.sex IS NOT DISTINCT FROM b.sex")
def natural_merge(spark, sf):
    meta = recordings.customer_metadata(spark, sf)
    return joins.natural(meta.select("user_id", "sex", "condition"), meta.where("use_data = 'Y'").select("user_id", "sex", "use_data")).select("user_id", "sex", "condition")


@query(M + """, f AS (SELECT user_id, sex, condition, CAST(condition = 'Alc' AS INTEGER) AS truth, CASE WHEN (condition = 'Alc') = (drinks >= 4) THEN 'correct' ELSE 'incorrect' END AS result FROM m),
 g AS (SELECT sex, truth, condition, max(CASE WHEN result = 'incorrect' THEN 1 ELSE 0 END) AS bad FROM f GROUP BY ALL)
 SELECT user_id, CASE WHEN bad = 1 THEN 'incorrect' ELSE 'correct' END AS cv_result FROM f JOIN g USING (sex, truth, condition)""")
def cv_write_back(spark, sf):
    meta = recordings.customer_metadata(spark, sf)
    rows = meta.select("user_id", "sex", "condition", (F.col("condition") == "Alc").cast("int").alias("truth"), (F.col("drinks") >= 4).cast("int").alias("predicted"))
    results_ = learning.outcome_kind(rows)
    return joins.cross_validation_marks(rows, results_, ("sex", "truth", "condition")).select("user_id", "cv_result")


@query(R + """, g AS (SELECT user_id, min(event_id) AS f FROM r GROUP BY user_id), h AS (SELECT user_id FROM g ORDER BY f LIMIT CAST(round_even((SELECT count(*) FROM g) * 0.3, 0) AS INTEGER))
 SELECT event_id, CAST(user_id IN (SELECT user_id FROM h) AS INTEGER) AS held FROM r""")
def holdout_groups(spark, sf):
    train, held = learning.holdout(readings(spark, sf), "user_id", "event_id")
    return train.select("event_id", F.lit(0).alias("held")).unionByName(held.select("event_id", F.lit(1).alias("held")))


@query(R + " SELECT episode, 'mean' AS feature, round(avg(tac), 6) AS value FROM r GROUP BY episode UNION ALL SELECT episode, 'sd', round(stddev_samp(tac), 6) FROM r GROUP BY episode UNION ALL SELECT episode, 'sem', round(stddev_samp(tac) / sqrt(count(*)), 6) FROM r GROUP BY episode")
def feature_report(spark, sf):
    return neat(results.long_features(aggregates.mean_sd_sem(readings(spark, sf)), ["episode"]))


@query(R + " SELECT round(1 - sum((tac - 50) * (tac - 50)) / (var_pop(tac) * count(*)), 6) AS r2 FROM r")
def r_squared(spark, sf):
    return neat(aggregates.r_squared(readings(spark, sf).withColumn("fit", F.lit(50.0)), "tac", "fit"))


@query(R + """, v AS (SELECT r.*, n, greatest(tac - 20, 0) AS v, max(greatest(tac - 20, 0)) OVER w - min(greatest(tac - 20, 0)) OVER w AS rng FROM r JOIN b USING (episode) WINDOW w AS (PARTITION BY r.episode))
 SELECT episode, CAST(sum(CAST(tac - 20 < 0 AS INTEGER)) AS BIGINT) AS negative_reassigned_zero_count, CAST(sum(CAST(v > 80 AND n > 30 AND rng > 5 AS INTEGER)) AS BIGINT) AS extreme_outlier_count FROM v GROUP BY episode""")
def cleaning_counts(spark, sf):
    df = cleaning.bridge_extremes(cleaning.negatives_to_zero(readings(spark, sf, 20.0)), 80.0)
    return aggregates.flag_counts(df, ["negative_reassigned_zero", "extreme_outlier"])


@query(R + " SELECT episode, CAST(temp > 27 AS INTEGER) AS device_on, count(*) AS n FROM r GROUP BY ALL")
def device_on_counts(spark, sf):
    return aggregates.value_counts(cleaning.worn(readings(spark, sf)), "device_on")


@query(R + """, t AS (SELECT episode, idx FROM (SELECT episode, idx, row_number() OVER (PARTITION BY episode ORDER BY idx) AS rn FROM r WHERE idx <= 15 AND tac - 40 < 3) WHERE rn = 3),
 h AS (SELECT episode, max(tac - 40) AS top FROM r WHERE idx <= 5 GROUP BY episode)
 SELECT event_id, round(CASE WHEN top > 10 AND r.idx < t.idx THEN 0 ELSE tac - 40 END, 6) AS tac FROM r LEFT JOIN t USING (episode) LEFT JOIN h USING (episode)""")
def baseline_artifact(spark, sf):
    return neat(cleaning.zero_high_baseline(readings(spark, sf, 40.0)), "event_id", "tac")


@query(R + """, x AS (SELECT episode, avg(CASE WHEN motion = 0 OR temp <= 27 THEN 1.0 ELSE 0.0 END) AS i, avg(CASE WHEN tac > 100 THEN 1.0 ELSE 0.0 END) AS m, max(hours) AS h FROM r GROUP BY episode)
 SELECT episode, CASE WHEN i * 100 >= 36 OR (1 - i) * h <= 1 OR m * 100 > 15 THEN 'invalid' ELSE 'valid' END AS part FROM x""")
def valid_episodes(spark, sf):
    df = cleaning.worn(readings(spark, sf)).withColumn("extreme_outlier", (F.col("tac") > 100).cast("int"))
    good, bad = features.valid_and_invalid(aggregates.quality_control(df, 1.0, 36.0, 15.0))
    return good.select("episode", F.lit("valid").alias("part")).unionByName(bad.select("episode", F.lit("invalid").alias("part")))


@query(M + " SELECT user_id, condition, CASE WHEN condition <> 'Unk' THEN CAST(drinks >= 4 AS INTEGER) END AS predicted FROM m")
def prediction_write_back(spark, sf):
    meta = recordings.customer_metadata(spark, sf)
    found = meta.where("condition <> 'Unk'").withColumn("predicted", (F.col("drinks") >= 4).cast("int"))
    return joins.written_back(meta, found, ["user_id"], ["predicted"]).select("user_id", "condition", "predicted")


@query(M + " SELECT user_id, format('Predicted {} with probability {:.2f}', CASE WHEN drinks >= 4 THEN 'Alc' ELSE 'Non' END, drinks / 10) AS sentence FROM m")
def prediction_sentence(spark, sf):
    rows = recordings.customer_metadata(spark, sf).select("user_id", F.when(F.col("drinks") >= 4, "Alc").otherwise("Non").alias("predicted"), (F.col("drinks") / 10).alias("probability"))
    return rows.select("user_id", learning.outcome_text("predicted", "probability").alias("sentence"))


@query(M + """, f AS (SELECT CAST(condition = 'Alc' AS INTEGER) AS t, CAST(drinks >= 4 AS INTEGER) AS p, drinks FROM m WHERE condition <> 'Unk'),
 k AS (SELECT t, rank() OVER (ORDER BY drinks) + (count(*) OVER (PARTITION BY drinks) - 1) / 2.0 AS rk FROM f),
 a AS (SELECT (sum(rk) FILTER (t = 1) - sum(t) * (sum(t) + 1) / 2.0) / (sum(t) * sum(1 - t)) AS auc FROM k)
 SELECT CAST(sum(t * p) AS BIGINT) AS tp, CAST(sum((1 - t) * (1 - p)) AS BIGINT) AS tn, CAST(sum((1 - t) * p) AS BIGINT) AS fp, CAST(sum(t * (1 - p)) AS BIGINT) AS fn,
 round(sum(t * p + (1 - t) * (1 - p)) / count(*), 2) AS accuracy, round(sum(t * p) / sum(t), 2) AS sensitivity, round(sum((1 - t) * (1 - p)) / sum(1 - t), 2) AS specificity, round(any_value(auc), 4) AS auc FROM f, a""")
def performance_report(spark, sf):
    meta = recordings.customer_metadata(spark, sf).where("condition <> 'Unk'")
    rows = meta.select((F.col("condition") == "Alc").cast("int").alias("truth"), (F.col("drinks") >= 4).cast("int").alias("predicted"), (F.col("drinks") / 10).alias("probability"))
    return results.model_performance(aggregates.confusion(rows, positive=1, negative=0), rows)


@query(M + " SELECT CAST(user_id AS VARCHAR) || '_' || lpad(CAST(user_id % 50 AS VARCHAR), 3, '0') || 'e1' AS \"ID\", round(1 - drinks / 10, 2) AS negative, round(drinks / 10, 2) AS positive FROM m")
def probability_report(spark, sf):
    rows = recordings.customer_metadata(spark, sf).withColumn("probability", F.col("drinks") / 10)
    return results.model_probabilities(rows, ids.full_identifier(F.col("user_id"), F.col("user_id") % 50, F.lit(1)))


@query("""WITH n AS (SELECT c_custkey, CAST(1000 + c_custkey AS VARCHAR) AS s, lpad(CAST(1 + c_nationkey AS VARCHAR), 3, '0') AS d FROM customer)
 SELECT c_custkey, len(s) - 1 AS subid_end, len(s) + 1 AS dataset_start, s AS subid, d AS dataset_identifier FROM n""")
def filename_slices(spark, sf):
    c = recordings.table(spark, sf, "customer")
    name = F.concat((F.col("c_custkey") + 1000).cast("string"), F.lit("_"), F.lpad((F.col("c_nationkey") + 1).cast("string"), 3, "0"), F.lit(".csv"))
    rows = c.select("c_custkey", name.alias("name")).withColumn("at", ids.slice_positions(F.col("name")))
    return rows.withColumn("cut", ids.sliced(F.col("name"), F.col("at"))).select("c_custkey", F.col("at")[1].alias("subid_end"), F.col("at")[2].alias("dataset_start"), "cut.*")


@query(R + M.replace("WITH m", ", m") + """ SELECT user_id, CASE WHEN coalesce(any_value(use_data), 'N') <> 'Y' THEN 'excluded by metadata' WHEN count(DISTINCT CASE WHEN user_id % 3 = 0 AND day(ts) > 15 THEN 2 ELSE 1 END) > 1 THEN 'multiple devices' END AS reason FROM r LEFT JOIN m USING (user_id) GROUP BY user_id""")
def initial_validity(spark, sf):
    device = F.when((F.col("user_id") % 3 == 0) & (F.dayofmonth("ts") > 15), 2).otherwise(1)
    return cohort.initial_validity(readings(spark, sf).withColumn("device_id", device), recordings.customer_metadata(spark, sf), ["user_id"])


@query("""SELECT o_orderkey, 'ordered' AS event_name, CAST(o_orderdate AS TIMESTAMP) AS event_ts FROM orders
 UNION ALL SELECT o_orderkey, 'urgent', CAST(o_orderdate AS TIMESTAMP) + INTERVAL 90 MINUTE FROM orders WHERE o_orderpriority = '1-URGENT'""")
def event_sheet(spark, sf):
    """A sheet of event times as text, in two formats, and rows that do not parse."""
    o = recordings.table(spark, sf, "orders").withColumn("t", F.col("o_orderdate").cast("timestamp"))
    later = F.date_format(F.col("t") + F.expr("INTERVAL 90 MINUTES"), "yyyy-MM-dd HH:mm:ss")
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", later).when(F.col("o_orderpriority") == "2-HIGH", "none")
    sheet = o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate", F.date_format("t", "yyyy-MM-dd HH:mm").alias("ordered"), urgent.alias("urgent"))
    return recordings.event_times(sheet, ["o_orderkey"]).select("o_orderkey", "event_name", F.col("event_ts").cast("timestamp_ntz").alias("event_ts"))


@query("SELECT CAST(c_nationkey AS VARCHAR) AS file, CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, round(c_acctbal, 6) AS c_acctbal, c_mktsegment FROM customer")
def workbook_round_trip(spark, sf):
    """Customers as one workbook a nation, written and read again in the executors."""
    files = workbooks.as_workbooks(recordings.table(spark, sf, "customer"), "c_nationkey", order=["c_custkey"])
    rows = workbooks.sheet_table(files, path_col="file")
    return neat(rows.withColumn("c_acctbal", F.col("c_acctbal").cast("double")), "file", "c_custkey", "c_name", "c_acctbal", "c_mktsegment")


SHEET = """SELECT CAST(1000 + c_custkey AS VARCHAR) AS subid, lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AS dataset_identifier, 'e1' AS episode_identifier, CASE WHEN c_nationkey = 3 THEN 'N' ELSE 'Y' END AS use_data,
 CASE c_mktsegment WHEN 'BUILDING' THEN 'Alc' WHEN 'MACHINERY' THEN 'Non' ELSE c_mktsegment END AS condition, round(c_acctbal, 6) AS total_drinks, CAST(1 + c_custkey % 2 AS INTEGER) AS sex, strftime(DATE '2024-01-01' + CAST(c_custkey % 300 AS INTEGER), '%Y-%m-%d') AS crop_begin_date FROM customer"""


def _sheet(spark, sf):
    c = recordings.table(spark, sf, "customer")
    condition = F.when(F.col("c_mktsegment") == "BUILDING", "Alc").when(F.col("c_mktsegment") == "MACHINERY", "Non").otherwise(F.col("c_mktsegment"))
    rows = c.select(
        F.expr("c_custkey div 1000").alias("file"), (F.col("c_custkey") + 1000).alias("SubID"), F.col("c_nationkey").alias("Dataset_Identifier"), F.lit(1).alias("Episode_Identifier"), F.when(F.col("c_nationkey") == 3, "N").otherwise("Y").alias("Use_Data"),
        condition.alias("Condition"), F.col("c_acctbal").alias("TotalDrks"), (F.col("c_custkey") % 2 + 1).alias("Sex"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 300).cast("int")), "M/d/yyyy").alias("Crop Begin Date"),
    )
    return recordings.metadata_of(workbooks.sheet_table(workbooks.as_workbooks(rows, "file")))


@query(SHEET)
def metadata_sheets(spark, sf):
    """Customers as sheets of study metadata, read again into its canonical columns."""
    return neat(_sheet(spark, sf), "subid", "dataset_identifier", "episode_identifier", "use_data", "condition", "total_drinks", "sex", "crop_begin_date")


@query(f"SELECT subid, CASE WHEN condition IN ('Alc', 'Non') THEN condition ELSE 'Unk' END AS condition, CAST(floor(total_drinks) % 2 = 0 AS BOOLEAN) AS even FROM ({SHEET})")
def condition_coercion(spark, sf):
    return _sheet(spark, sf).select("subid", ids.coerced_condition(F.col("condition")).alias("condition"), (F.pmod(F.floor("total_drinks"), F.lit(2)) == 0).alias("even"))


@query(M + " SELECT DISTINCT sex, condition, use_data FROM m WHERE condition = 'Unk'")
def excluded_features(spark, sf):
    meta = recordings.customer_metadata(spark, sf).select("sex", "condition", "use_data")
    return joins.excluded_and_kept(meta, {"condition": ["Unk"]})[1]


@query(R + """, f AS (SELECT episode, count(*) AS n_N, avg(tac) AS mean, round(stddev_samp(tac), 2) AS sd FROM r GROUP BY episode) SELECT episode, n_N * 1.005 AS "n_N", round(mean, 6) AS mean, sd FROM f""")
def rounded_columns(spark, sf):
    """Report columns in order, rounded from the fourth on but for those that count."""
    rows = aggregates.mean_sd_sem(readings(spark, sf)).join(readings(spark, sf).groupBy("episode").agg((F.count(F.lit(1)) * 1.005).cast("double").alias("n_N")), "episode")
    return neat(results.rounded(results.present(rows, ["episode", "n_N", "mean"]), after=3), "episode", "n_N", "mean", "sd")


@query(R.replace("WITH e AS", "WITH RECURSIVE e AS") + """, s AS (SELECT episode, idx, event_id, CAST(epoch_us(ts) AS BIGINT) // 900 AS t FROM r), pace AS (SELECT episode, coalesce(round_even(60.0 * (count(*) - 1) * 1e6 / nullif(max(t) - min(t), 0), 0) > 1, true) AND count(*) > 1 AS dense FROM s GROUP BY episode),
 k AS (SELECT s.* FROM s JOIN pace USING (episode) WHERE dense AND idx = 0 UNION ALL SELECT x.episode, x.idx, x.event_id, x.t FROM (SELECT s.*, row_number() OVER (PARTITION BY s.episode ORDER BY s.idx) AS rn FROM k JOIN s ON s.episode = k.episode AND s.idx > k.idx AND s.t - k.t >= 59000000) x WHERE rn = 1)
 SELECT event_id FROM k UNION ALL SELECT event_id FROM s JOIN pace USING (episode) WHERE NOT dense""")
def dense_thinning(spark, sf):
    """Only episodes of more than one row a minute are thinned; the readings' time is taken 900 times as fast."""
    df = readings(spark, sf).withColumn("ts", F.timestamp_micros(F.expr("unix_micros(ts) div 900")))
    return cleaning.thinned_where_dense(df).select("event_id")


@query(R + """, l AS (SELECT r.event_id, y.tac AS y, row_number() OVER (PARTITION BY r.event_id ORDER BY y.idx) - 1 AS j, count(*) OVER (PARTITION BY r.event_id) AS m, (max(y.hours) OVER (PARTITION BY r.event_id) - min(y.hours) OVER (PARTITION BY r.event_id)) * 60 AS span FROM r JOIN r y ON y.episode = r.episode AND y.idx BETWEEN r.idx AND r.idx + 10),
 u AS (SELECT *, j - (m - 1) / 2.0 AS u FROM l WHERE m > 5 AND span > 0),
 s AS (SELECT event_id, any_value(m) AS m, any_value(span) AS span, sum(u*u) AS s2, sum(u*u*u*u) AS s4, sum(y) AS y0, sum(y*u) AS y1, sum(y*u*u) AS y2 FROM u GROUP BY event_id),
 k AS (SELECT event_id, (m * y2 - s2 * y0) / (m * s4 - s2 * s2) AS a, y1 / s2 AS b, (y0 - (m * y2 - s2 * y0) / (m * s4 - s2 * s2) * s2) / m AS c, (m - 1) / span AS q, (m - 1) / 2.0 AS h FROM s)
 SELECT r.event_id, round(a*q*q * 1e6, 4) + 0.0 AS a_e6, round((b*q - 2*a*q*h) * 1e3, 4) + 0.0 AS b_e3, round(a*h*h - b*h + c + 1e-6, 4) + 0.0 AS c FROM r LEFT JOIN k USING (event_id)""")
def quadratic_fit_after(spark, sf):
    df = windows.quadratic_fits(readings(spark, sf))
    scaled = {"a_e6": F.col("tac_a_post") * 1e6, "b_e3": F.col("tac_b_post") * 1e3, "c": F.col("tac_c_post") + 1e-6}
    return df.select("event_id", *[(F.round(v, 4) + F.lit(0.0)).alias(k) for k, v in scaled.items()])


USERS = " , u AS (SELECT user_id, avg(tac) AS mean, max(tac) AS peak FROM r JOIN customer ON c_custkey = user_id GROUP BY user_id)"


@query(R + USERS + ", k AS (SELECT regr_slope(peak, mean) AS a, regr_intercept(peak, mean) AS c FROM u) SELECT user_id, round(mean, 6) AS mean, round(peak, 6) AS peak, round(a * mean + c, 6) AS prediction FROM u, k")
def linreg_estimator(spark, sf):
    df = _user_features(spark, sf)
    found = learning.estimated(df, learning.feature_estimators(df, {"peak": ["mean"]}))
    return neat(found.withColumnRenamed("predicted_peak", "prediction"), "user_id", "mean", "peak", "prediction")


def _regression(y: str, xs: tuple[str, str, str]) -> str:
    """SQL of coefficients b1, b2, b3 and b0 of y on three columns of w, by Cramer's rule on covariances."""
    s = {(i, j): f"covar_pop({xs[i]}, {xs[j]})" for i in range(3) for j in range(3)}
    t = [f"covar_pop({x}, {y})" for x in xs]

    def det(c):
        return " + ".join(f"({c[0, i]}) * (({c[1, j]}) * ({c[2, k]}) - ({c[1, k]}) * ({c[2, j]}))" for i, j, k in ((0, 1, 2), (1, 2, 0), (2, 0, 1)))

    over = [", ".join([f"({det({(i, j): t[i] if j == n else s[i, j] for i in range(3) for j in range(3)})}) / ({det(s)}) AS b{n + 1}"]) for n in range(3)]
    means = ", ".join(f"avg({x}) AS m{i + 1}" for i, x in enumerate(xs))
    return f"(SELECT b1, b2, b3, m0 - b1 * m1 - b2 * m2 - b3 * m3 AS b0 FROM (SELECT {', '.join(over)}, avg({y}) AS m0, {means} FROM w))"


@query(R + C + f""", w AS (SELECT episode, peak - thr AS rp, hp - hb AS rd, he - hp AS fd, CASE WHEN hp <> hb THEN (peak - thr) / (hp - hb) ELSE 0 END AS rr, CASE WHEN he <> hp THEN (peak - thr) / (he - hp) ELSE 0 END AS fr,
 CASE WHEN vb - thr <= 0 THEN 1.0 ELSE (peak - thr - (vb - thr)) / (peak - thr) END AS rc, CASE WHEN ve - thr <= 0 THEN 1.0 ELSE (peak - thr - (ve - thr)) / (peak - thr) END AS fc FROM q),
 kf AS {_regression("fd", ("rp", "rd", "rr"))}, kr AS {_regression("rd", ("rp", "fd", "fr"))},
 z AS (SELECT w.*, kf.b0 + kf.b1 * rp + kf.b2 * rd + kf.b3 * rr AS pf, kr.b0 + kr.b1 * rp + kr.b2 * fd + kr.b3 * fr AS pr FROM w, kf, kr)
 SELECT episode, round(CASE WHEN fc < 0.5 THEN pf WHEN fc < 0.9 THEN fd / nullif(fc, 0) ELSE fd END, 4) AS fall_duration_revised, round(CASE WHEN rc < 0.5 THEN pr WHEN rc < 0.9 THEN rd / nullif(fc, 0) ELSE rd END, 4) AS rise_duration_revised,
 round(CASE WHEN fc < 0.5 AND pf <> 0 THEN rp / pf ELSE fr END, 4) AS fall_rate_revised, round(CASE WHEN rc < 0.5 AND pr <> 0 THEN rp / pr ELSE rr END, 4) AS rise_rate_revised FROM z""")
def revise_by_models(spark, sf):
    rows = curve.curve_measures(curve.curve_bounds(_thresholded(spark, sf)))
    models = learning.feature_estimators(rows, {k: learning.ESTIMATED[k] for k in ("fall_duration", "rise_duration")})
    found = features.revised_features(rows, models)
    return found.select("episode", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("fall_duration_revised", "rise_duration_revised", "fall_rate_revised", "rise_rate_revised")])


def _left_out() -> str:
    """SQL of z: user_id, y, x1 to x3 of w, with the coefficients that all other rows give, with (k) and without (g) a constant, by Cramer's rule."""
    names = ["x1", "x2", "x3", "y"]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = ", ".join([*[f"sum({a} * {b}) OVER () - {a} * {b} AS s_{a}_{b}" for a, b in pairs], *[f"sum({a}) OVER () - {a} AS s_{a}" for a in names], "count(*) OVER () - 1 AS n"])
    of = lambda a, b: f"s_{min(a, b)}_{max(a, b)}"
    centred = lambda a, b: f"({of(a, b)} - s_{a} * s_{b} / n)"

    def det(c):
        return " + ".join(f"({c[0, i]}) * (({c[1, j]}) * ({c[2, k]}) - ({c[1, k]}) * ({c[2, j]}))" for i, j, k in ((0, 1, 2), (1, 2, 0), (2, 0, 1)))

    def solved(m, name):
        s = {(i, j): m(names[i], names[j]) for i in range(3) for j in range(3)}
        return ", ".join(f"({det({(i, j): m(names[i], 'y') if j == c else s[i, j] for i in range(3) for j in range(3)})}) / ({det(s)}) AS {name}{c + 1}" for c in range(3))

    return f"z AS (SELECT *, s_y / n - k1 * s_x1 / n - k2 * s_x2 / n - k3 * s_x3 / n AS k0, 0.0 AS g0 FROM (SELECT *, {solved(centred, 'k')}, {solved(of, 'g')} FROM (SELECT user_id, x1, x2, x3, y, {sums} FROM w)))"


LEFT_OUT = R + f""", w AS (SELECT user_id, avg(tac) AS x1, coalesce(stddev_samp(tac), 0) AS x2, CAST(count(*) AS DOUBLE) AS x3, max(tac) AS y FROM r JOIN customer ON c_custkey = user_id GROUP BY user_id), {_left_out()},
 f AS (SELECT user_id, true AS intercept, y, k0 + k1 * x1 + k2 * x2 + k3 * x3 AS predicted FROM z UNION ALL SELECT user_id, false, y, g1 * x1 + g2 * x2 + g3 * x3 FROM z)"""


@query(LEFT_OUT + " SELECT user_id, intercept, round(y, 4) AS peak, round(predicted, 4) AS predicted FROM f")
def linear_leave_one_out(spark, sf):
    """Each user's peak from the models of all other users, with and without a constant."""
    found = leave_one_out.linear_leave_one_out(_user_features(spark, sf), ["mean", "sd", "n"], "peak")
    return found.select("user_id", "intercept", F.round("peak", 4).alias("peak"), F.round("predicted", 4).alias("predicted"))


@query(LEFT_OUT + " SELECT intercept, round(avg((predicted - y) * (predicted - y)), 4) AS squared_error FROM f GROUP BY intercept")
def linear_grid_by_subject(spark, sf):
    """The whole linear grid, every user a fold."""
    return leave_one_out.linear_grid(_user_features(spark, sf), ["mean", "sd", "n"], "peak").select("intercept", F.round("squared_error", 4).alias("squared_error"))


# --- no SQL for the same rows: grouped or fitted -------------------------------------------


@query()
def impute_gp(spark, sf):
    df = readings(spark, sf).withColumn("gone", (F.col("idx") % 60).between(20, 25))
    return neat(cleaning.fill_missing(df, "gone", "filled", extend=0, limit=0.7), "event_id", "filled")


@query()
def impute_artifacts(spark, sf):
    return neat(cleaning.artifacts_removed(readings(spark, sf)), "event_id", "tac", "major_outlier", "minor_outlier")


@query()
def row_features(spark, sf):
    return neat(windows.row_features(readings(spark, sf)).drop("ts", "props", "user_id", "event_type", "tac", "hours"))


@query()
def cohort_features(spark, sf):
    """Every stage from readings to features; the readings are some hours apart, so durations and gaps are in days where a study has them in hours."""
    config = EngineConfig(max_duration_h=24.0 * 31, gap_fill_h=24.0, sampling_rate=240.0)
    return neat(cohort.cohort_features(cohort.processed(readings(spark, sf), ["episode"], config), ["episode"], config))


def _user_features(spark, sf) -> DataFrame:
    df = readings(spark, sf).groupBy("user_id").agg(F.avg("tac").alias("mean"), F.coalesce(F.stddev_samp("tac"), F.lit(0.0)).alias("sd"), F.max("tac").alias("peak"), F.avg("motion").alias("motion"), F.avg("temp").alias("temp"), F.count(F.lit(1)).cast("double").alias("n"))
    return df.join(recordings.customer_metadata(spark, sf), "user_id").withColumns({"label": (F.col("drinks") >= 4).cast("double"), "subid": F.col("user_id").cast("string")})


PREDICTORS = ["mean", "sd", "peak", "motion", "temp", "n"]


@query()
def rf_cv(spark, sf):
    model = learning.grid("RF", 0, small=True)[0].copy({}).setNumTrees(20).setMaxDepth(4)
    return neat(learning.outcome_kind(learning.cross_validated(_user_features(spark, sf), model, PREDICTORS, folds=3), "label"), "user_id", "label", "predicted", "probability", "outcome", "result")


@query()
def lr_cv(spark, sf):
    model = learning.grid("LR", 100, small=True)[0].copy({}).setRegParam(0.01)
    return neat(learning.outcome_kind(learning.cross_validated(_user_features(spark, sf), model, PREDICTORS, folds=3), "label"), "user_id", "label", "predicted", "probability", "outcome", "result")


@query()
def logistic_grid_by_subject(spark, sf):
    """The whole logistic grid, seven penalties of two kinds, every user a fold: accuracies."""
    return neat(leave_one_out.logistic_grid(_user_features(spark, sf), PREDICTORS))


@query()
def cluster_extremes(spark, sf):
    """Clusters of values that lie apart, in readings of four times the size."""
    df = readings(spark, sf).select("event_id", "episode", "idx", "hours", (F.col("tac") * 4).alias("tac"))
    return neat(cleaning.drop_clusters(df), "event_id", "tac", "extreme_outlier")


@query()
def linreg_search(spark, sf):
    """Both settings of the linear grid with their squared errors over three folds of subjects."""
    _, found = learning.optimized(_user_features(spark, sf), "LinearReg", ["mean", "sd", "n"], "peak", folds=3)
    return spark.createDataFrame([(bool(p["fitIntercept"]), round(x, 6)) for p, x in found], "intercept boolean, squared_error double")


@query()
def trained_models(spark, sf):
    """A forest of condition by the study design, rows without a known condition excluded."""
    df = _user_features(spark, sf).drop("label")
    scored = learning.trained(df, learning.model_names({"RF": ["Alc_vs_Non"]}), PREDICTORS, folds=3, small=True)["RF_Alc_vs_Non"][2]
    return neat(scored, "user_id", "condition", "predicted", "probability", "outcome", "result")


@query()
def wear_model(spark, sf):
    """A forest that tells worn from removed rows by temperature and motion around them, with its held-out episodes."""
    df = windows.row_features(joins.labelled_by_events(readings(spark, sf), recordings.day_events(spark, sf)))
    shapes = [f"{c}_{k}_{side}" for c in ("temp", "motion") for k in ("a", "b", "c", "mean_change", "diff") for side in ("pre" if k != "diff" else "prior", "post")]
    forest = learning.grid("RF", 0, small=True)[0].copy({}).setNumTrees(20).setMaxDepth(5)
    _, scored = learning.wear_model(df, ["temp", "motion", *shapes], forest)
    return neat(scored, "event_id", "part", "device_on_label", "predicted", "probability")


def _vectors(spark, sf) -> DataFrame:
    """vec_id and vector: all entries of each embedding."""
    entries = F.col("embedding").cast("array<double>")
    return recordings.table(spark, sf, "embeddings").select("vec_id", F.when(F.forall(entries, lambda x: x.isNotNull()), array_to_vector(entries)).alias("vector"))


@query()
def pca_variance(spark, sf):
    df = _vectors(spark, sf)
    shares = learning.explained_variance(df, ["vector"], 4)
    return spark.createDataFrame([(i, s) for i, s in enumerate(shares)], "component int, share double")


@query()
def kmeans_knee(spark, sf):
    df = _vectors(spark, sf)
    return learning.clustered(df, ["vector"]).select("vec_id", "cluster")


@query()
def feature_importance(spark, sf):
    rows = learning.assembled(_user_features(spark, sf), PREDICTORS)
    model = learning.grid("RF", 0, small=True)[0].copy({}).setNumTrees(20).setMaxDepth(4).fit(rows)
    return spark.createDataFrame(learning.importances(model, PREDICTORS), "feature string, importance double")
