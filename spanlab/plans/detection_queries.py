"""Queries of detection evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlab.operators import detection as D
from spanlab.plans.joins_queries import triggers
from spanlab.plans.registry import query
from spanlab.plans.views import prop_k, sql, table, v_pred, v_scores, v_streams, v_targets, v_targets_raw

HALF_DAY = 43_200_000_000


def _match(spark, d):
    t = triggers(spark, d).select("stream_id", F.col("t_us").alias("t"), F.col("event_id").alias("trigger_id"))
    g = v_targets(spark, d).select("stream_id", "target_id", F.col("s_us").alias("s"), F.col("e_us").alias("e"))
    return D.match(t, g, "stream_id", 0, HALF_DAY)


@query("dt1_detect", sql("SELECT stream_id, t_us, event_id FROM v_triggers", "v_triggers"))
def dt1(spark, d):
    return triggers(spark, d).select("stream_id", "t_us", "event_id")


_HITS = """k AS (SELECT g.stream_id, g.target_id, g.s_us, g.e_us, t.t_us, t.event_id, row_number() OVER (PARTITION BY g.stream_id, g.target_id ORDER BY t.t_us, t.event_id) AS n FROM v_targets g LEFT JOIN v_triggers t ON g.stream_id = t.stream_id AND t.t_us BETWEEN g.s_us AND g.e_us + 43200000000),
    h AS (SELECT * FROM k WHERE n = 1), o AS (SELECT t.stream_id, t.event_id, CASE WHEN h.target_id IS NOT NULL THEN 'hit' WHEN EXISTS (SELECT 1 FROM v_targets g WHERE g.stream_id = t.stream_id AND t.t_us BETWEEN g.s_us AND g.e_us + 43200000000) THEN 'duplicate' ELSE 'false_accept' END AS outcome FROM v_triggers t LEFT JOIN h ON h.stream_id = t.stream_id AND h.event_id = t.event_id)"""


@query("dt2_match", sql(f"WITH {_HITS} SELECT stream_id, event_id AS trigger_id, outcome FROM o", "v_targets", "v_triggers"))
def dt2(spark, d):
    return _match(spark, d)[0].select("stream_id", "trigger_id", "outcome")


@query("dt2_latency", sql(f"WITH {_HITS} SELECT stream_id, target_id, t_us - e_us AS latency FROM h", "v_targets", "v_triggers"))
def dt2_latency(spark, d):
    return _match(spark, d)[1].select("stream_id", "target_id", "latency")


def exposed(spark, d):
    g = v_targets_raw(spark, d).select("stream_id", (F.col("s_us") - 1_704_067_200_000_000).alias("s"), (F.col("e_us") - 1_704_067_200_000_000).alias("e"))
    return D.exposure(v_streams(spark, d), g, "stream_id", 3_600_000_000, 0, HALF_DAY)


_EXPOSED = """z AS (SELECT stream_id, greatest(s_us - 1704067200000000, 3600000000) AS a, least(e_us - 1704067200000000 + 43200000000, 2592000000000) AS b FROM v_targets_raw WHERE least(e_us - 1704067200000000 + 43200000000, 2592000000000) > greatest(s_us - 1704067200000000, 3600000000)),
    f AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY stream_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS f FROM z), i AS (SELECT *, sum(f) OVER (PARTITION BY stream_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM f),
    u AS (SELECT stream_id, sum(b - a) AS c FROM (SELECT stream_id, i, min(a) AS a, max(b) AS b FROM i GROUP BY 1, 2) GROUP BY 1), x AS (SELECT s.*, 2592000000000 - 3600000000 - coalesce(c, 0)::BIGINT AS exposure FROM v_streams s LEFT JOIN u ON s.stream_id = u.stream_id)"""


@query("dt3_exposure", sql(f"WITH {_EXPOSED} SELECT stream_id, exposure FROM x", "v_targets_raw", "v_streams"))
def dt3(spark, d):
    return exposed(spark, d).select("stream_id", "exposure")


@query("dt4_stream_report", sql(f"""WITH {_HITS}, {_EXPOSED}, a AS (SELECT stream_id, count_if(outcome = 'false_accept') AS fa, count_if(outcome = 'duplicate') AS du FROM o GROUP BY 1), b AS (SELECT stream_id, count(*) AS tg, count(event_id) AS hi FROM h GROUP BY 1),
    p AS (SELECT x.*, coalesce(fa, 0) AS fa, coalesce(du, 0) AS du, coalesce(tg, 0) AS tg, coalesce(hi, 0) AS hi FROM x LEFT JOIN a ON x.stream_id = a.stream_id LEFT JOIN b ON x.stream_id = b.stream_id),
    q AS (SELECT 'all' AS dimension, 'all' AS value, * FROM p UNION ALL SELECT 'condition', condition, * FROM p UNION ALL SELECT 'set_name', set_name, * FROM p)
    SELECT dimension, value, sum(tg)::BIGINT AS targets, sum(hi)::BIGINT AS hits, sum(fa)::BIGINT AS false_accepts, sum(du)::BIGINT AS duplicates, sum(exposure)::BIGINT AS exposure, sum(hi) / sum(tg)::DOUBLE AS detection_rate, sum(fa) / (sum(exposure) / 3600000000.0::DOUBLE) AS fa_per_hour FROM q GROUP BY 1, 2""", "v_targets", "v_triggers", "v_streams"))
def dt4(spark, d):
    t, g = _match(spark, d)
    return D.stream_report(exposed(spark, d), t, g, "stream_id", ["condition", "set_name"])


_GRID = """g AS (SELECT unnest([40.0, 60.0, 80.0, 99.9])::DOUBLE AS threshold), fl AS (SELECT s.*, threshold, sum((score >= threshold)::INT) OVER (PARTITION BY stream_id, threshold ORDER BY t_us, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS above FROM v_scores s, g),
    c AS (SELECT *, row_number() OVER (PARTITION BY stream_id, threshold ORDER BY t_us, event_id) AS n FROM fl WHERE score >= threshold AND above >= 2),
    w AS (SELECT stream_id, threshold, n, event_id, t_us, t_us AS last, true AS hit FROM c WHERE n = 1 UNION ALL SELECT c.stream_id, c.threshold, c.n, c.event_id, c.t_us, CASE WHEN c.t_us - w.last >= 43200000000 THEN c.t_us ELSE w.last END, c.t_us - w.last >= 43200000000 FROM w JOIN c ON c.stream_id = w.stream_id AND c.threshold = w.threshold AND c.n = w.n + 1)"""


@query("dt5_sweep", sql(f"WITH {_GRID} SELECT threshold, count(*) AS triggers FROM w WHERE hit GROUP BY 1", "v_scores").replace("WITH v_scores", "WITH RECURSIVE v_scores"))
def dt5(spark, d):
    s = D.sweep(v_scores(spark, d), [40, 60, 80, 99.9], "stream_id", "t_us", "score", HALF_DAY, 2, 3, "event_id")
    return s.groupBy("threshold").agg(F.count("*").alias("triggers"))


@query("dt5_threshold_curve", sql(f"""WITH {_EXPOSED}, {_GRID}, t AS (SELECT threshold, stream_id, t_us, event_id FROM w WHERE hit), k AS (SELECT g.threshold, v.stream_id, v.target_id, t.event_id, row_number() OVER (PARTITION BY g.threshold, v.stream_id, v.target_id ORDER BY t.t_us, t.event_id) AS n
        FROM v_targets v CROSS JOIN g LEFT JOIN t ON t.threshold = g.threshold AND t.stream_id = v.stream_id AND t.t_us BETWEEN v.s_us AND v.e_us + 43200000000),
    h AS (SELECT threshold, count(*) AS targets, count(event_id) AS hits FROM k WHERE n = 1 GROUP BY 1), y AS (SELECT t.threshold, t.event_id, EXISTS (SELECT 1 FROM v_targets v WHERE v.stream_id = t.stream_id AND t.t_us BETWEEN v.s_us AND v.e_us + 43200000000) AS inside, t.event_id IN (SELECT event_id FROM k WHERE n = 1 AND k.threshold = t.threshold AND event_id IS NOT NULL) AS hit FROM t),
    z2 AS (SELECT threshold, count_if(NOT inside) AS fa, count_if(inside AND NOT hit) AS du FROM y GROUP BY 1), e AS (SELECT sum(exposure)::BIGINT AS exposure FROM x)
    SELECT h.threshold, targets, hits, coalesce(fa, 0) AS false_accepts, coalesce(du, 0) AS duplicates, exposure, hits / targets::DOUBLE AS detection_rate, 1 - hits / targets::DOUBLE AS miss_rate, coalesce(fa, 0) / (exposure / 3600000000.0::DOUBLE) AS fa_per_hour FROM h LEFT JOIN z2 ON h.threshold = z2.threshold, e""", "v_targets", "v_streams", "v_scores").replace("WITH v_targets_raw", "WITH RECURSIVE v_targets_raw", 1))
def dt5_curve(spark, d):
    g = v_targets(spark, d).select("stream_id", "target_id", F.col("s_us").alias("s"), F.col("e_us").alias("e"))
    return D.threshold_curve(v_scores(spark, d), [40, 60, 80, 99.9], exposed(spark, d), g, "stream_id", "t_us", "score", "event_id", HALF_DAY, 2, 3, 0, HALF_DAY)


@query("dt7_outcome", sql("SELECT CASE WHEN truth = pred THEN 'correct' WHEN truth = 'unknown' THEN 'false_action' WHEN pred = 'unknown' THEN 'asks_again' ELSE 'wrong' END AS outcome, count(*) AS n FROM v_pred GROUP BY 1", "v_pred"))
def dt7(spark, d):
    return v_pred(spark, d).groupBy(D.outcome(F.col("truth"), F.col("pred")).alias("outcome")).agg(F.count("*").alias("n"))


@query("dt8_duration_limit_rescore", "SELECT \"limit\", count_if(least(k * 100, user_id * 10 + \"limit\") < k * 100) AS cut, sum(least(k * 100, user_id * 10 + \"limit\"))::BIGINT AS kept FROM (SELECT user_id, regexp_extract(props, '[0-9]+')::BIGINT AS k, unnest([1000, 3000, 5000])::BIGINT AS \"limit\" FROM events) GROUP BY 1")
def dt8(spark, d):
    c = table(spark, d, "events").select((F.col("user_id") * 10).alias("start"), (prop_k() * 100).alias("length"))
    return D.duration_limits(c, [1000, 3000, 5000], "start", "length").groupBy("limit").agg(F.count_if("is_cut").alias("cut"), F.sum("cut").alias("kept"))


@query("me19_per_event_outcomes", "SELECT event_type, count(*) AS events, count_if(w) AS woke, count_if(w) / count(*)::DOUBLE AS woke_rate, count_if(w AND c) AS correct, count_if(w AND r) AS rejected, count_if(w AND NOT c AND NOT r) AS wrong, count_if(w AND c) / count(*)::DOUBLE AS end_to_end, round(count_if(w) / (sum(k + 1) / 60.0::DOUBLE), 9) AS wakes_per_hour, round(count_if(w AND NOT r) / (sum(k + 1) / 60.0::DOUBLE), 9) AS actions_per_hour FROM (SELECT event_type, k, value > 20 AS w, k % 3 = 0 AS c, k % 3 = 1 AS r FROM (SELECT *, regexp_extract(props, '[0-9]+')::BIGINT AS k FROM events)) GROUP BY 1")
def me19(spark, d):
    k = prop_k()
    out = D.per_event_outcomes(table(spark, d, "events"), "event_type", F.col("value") > 20, k % 3 == 0, k % 3 == 1, (k + 1) / 60)
    return out.withColumns({c: F.round(c, 9) for c in ("wakes_per_hour", "actions_per_hour")})
