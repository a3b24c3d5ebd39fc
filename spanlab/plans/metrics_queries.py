"""Queries of the metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlab.operators import aggregates as A
from spanlab.operators import metrics as M
from spanlab.plans.aggregates_queries import _RATES
from spanlab.plans.registry import query
from spanlab.plans.views import sql, table, v_policy, v_pred, v_probs



def _pos():
    return F.col("truth") == "R"


@query("me1_roc_auc", sql("WITH c AS (SELECT p, count_if(truth = 'R') AS a, count_if(truth <> 'R') AS b FROM v_pred GROUP BY 1), r AS (SELECT *, sum(b) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS under FROM c) SELECT round(sum(a * (2 * coalesce(under, 0) + b))::BIGINT / (2 * sum(a)::BIGINT * sum(b)::BIGINT)::DOUBLE, 12) AS auc FROM r", "v_pred"))
def me1(spark, d):
    return M.roc_auc(v_pred(spark, d), "p", _pos()).select(F.round("auc", 12).alias("auc"))


@query("me1_roc_auc_by_group", sql("WITH c AS (SELECT grp, p, count_if(truth = 'R') AS a, count_if(truth <> 'R') AS b FROM v_pred GROUP BY 1, 2), r AS (SELECT *, sum(b) OVER (PARTITION BY grp ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS under FROM c) SELECT grp, round(sum(a * (2 * coalesce(under, 0) + b))::BIGINT / (2 * sum(a)::BIGINT * sum(b)::BIGINT)::DOUBLE, 12) AS auc FROM r GROUP BY 1 HAVING sum(a) > 0", "v_pred"))
def me1_groups(spark, d):
    return M.roc_auc(v_pred(spark, d), "p", _pos(), ["grp"]).where("NOT isnan(auc)").select("grp", F.round("auc", 12).alias("auc"))


_TIE = ["l_orderkey", "l_linenumber", "grp"]


@query("me2_average_precision", sql("WITH r AS (SELECT *, row_number() OVER w AS i, sum((truth = 'R')::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS h FROM v_pred WINDOW w AS (PARTITION BY l_suppkey ORDER BY p DESC, l_orderkey, l_linenumber, grp)) SELECT l_suppkey, round(sum(CASE WHEN truth = 'R' THEN h / i::DOUBLE ELSE 0 END) / greatest(1, count_if(truth = 'R')), 9) AS ap FROM r GROUP BY 1", "v_pred"))
def me2(spark, d):
    return M.average_precision(v_pred(spark, d), ["l_suppkey"], "p", _pos(), _TIE).select("l_suppkey", F.round("ap", 9).alias("ap"))


_THR = "SELECT {k}, n, coalesce(max(CASE WHEN i = kk + 1 THEN score END), min(score)) AS boundary, count_if(i = kk + 1) > 0 AS strict FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY score DESC) AS i, count(*) OVER (PARTITION BY {k}) AS n, floor(count(*) OVER (PARTITION BY {k}) * 0.01)::BIGINT AS kk FROM {t}) GROUP BY {k}, n"


@query("me3_threshold_at_fpr", sql(_THR.format(k="category", t="v_policy"), "v_policy"))
def me3(spark, d):
    return M.threshold_at_fpr(v_policy(spark, d), ["category"], "score", 0.01)


@query("me4_choose_threshold", sql(f"WITH r AS (SELECT * FROM v_policy WHERE subset <> 3), c AS (SELECT category, count(*) AS cn FROM r GROUP BY 1), p AS (SELECT CASE WHEN cn < 3000 THEN 'pooled' ELSE r.category END AS pool, score FROM r JOIN c ON r.category = c.category), t AS ({_THR.format(k='pool', t='p')}) SELECT *, max(boundary) OVER () AS operating FROM t", "v_policy"))
def me4(spark, d):
    return M.choose_threshold(v_policy(spark, d), "category", "subset", [3], "score", 0.01, 3000)


_WILSON = "((k / n::DOUBLE + {z2} / (2 * n)) {sign} {z} * sqrt(k / n::DOUBLE * (1 - k / n::DOUBLE) / n + {z2} / (4.0::DOUBLE * n * n))) / (1 + {z2} / n)"
_LOW, _HIGH = (_WILSON.format(sign=s, z=f"{M.Z95!r}::DOUBLE", z2=f"{M.Z95 * M.Z95!r}::DOUBLE") for s in "-+")


@query("me5_rate_table", sql(f"SELECT category, subset, by_category, by_subset, n, k, k / n::DOUBLE AS rate, round({_LOW}, 9) AS low, round({_HIGH}, 9) AS high, round(mean_score, 6) AS mean_score, max_score FROM (SELECT category, subset, 1 - grouping(category) AS by_category, 1 - grouping(subset) AS by_subset, count(*) AS n, count_if(score > 60000) AS k, avg(score) AS mean_score, max(score) AS max_score FROM v_policy GROUP BY CUBE (category, subset)) WHERE by_category = 1 OR by_subset = 1", "v_policy"))
def me5(spark, d):
    out = M.rate_table(v_policy(spark, d), ["category", "subset"], F.col("score") > 60000, "score", p99=False)
    return out.withColumns({"low": F.round("low", 9), "high": F.round("high", 9), "mean_score": F.round("mean_score", 6)})


@query("me6_proportion_ci")
def me6(spark, d):
    g = v_pred(spark, d).groupBy("l_suppkey").agg(F.count_if(F.col("truth") == F.col("pred")).alias("k"), F.count("*").alias("n"))
    return g.select("*", M.proportion_ci(F.col("k"), F.col("n")).alias("ci")).select("l_suppkey", "k", "n", "ci.low", "ci.high")


@query("me7_poisson_rate_ci")
def me7(spark, d):
    g = table(spark, d, "events").where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("k"))
    return g.select("*", M.poisson_rate_ci(F.col("k"), F.lit(720.0)).alias("ci")).select("user_id", "k", "ci.low", "ci.high")


@query("udf2_exact_ci")
def udf2(spark, d):
    """Both exact intervals of each group's errors: as a share of its rows, and as a rate over its rows as hours."""
    g = v_pred(spark, d).groupBy("grp", "truth").agg(F.count_if(F.col("truth") != F.col("pred")).alias("k"), F.count("*").alias("n"))
    both = g.select("*", M.proportion_ci(F.col("k"), F.col("n")).alias("share"), M.poisson_rate_ci(F.col("k"), F.col("n")).alias("rate"))
    return both.select("grp", "truth", "k", "n", F.col("share.low").alias("share_low"), F.col("share.high").alias("share_high"), F.col("rate.low").alias("rate_low"), F.col("rate.high").alias("rate_high"))


_Z = "1.959963984540054::DOUBLE"


@query("me8_wilson_ci", sql(f"SELECT l_suppkey, round((k / n + {_Z} * {_Z} / (2 * n) - {_Z} * sqrt(k / n * (1 - k / n) / n + {_Z} * {_Z} / (4 * n * n))) / (1 + {_Z} * {_Z} / n), 9) AS low, round((k / n + {_Z} * {_Z} / (2 * n) + {_Z} * sqrt(k / n * (1 - k / n) / n + {_Z} * {_Z} / (4 * n * n))) / (1 + {_Z} * {_Z} / n), 9) AS high FROM (SELECT l_suppkey, count_if(truth = pred)::DOUBLE AS k, count(*)::DOUBLE AS n FROM v_pred GROUP BY 1)", "v_pred"))
def me8(spark, d):
    g = v_pred(spark, d).groupBy("l_suppkey").agg(F.count_if(F.col("truth") == F.col("pred")).alias("k"), F.count("*").alias("n"))
    return g.select("l_suppkey", M.wilson_ci(F.col("k"), F.col("n")).alias("c")).select("l_suppkey", F.round("c.low", 9).alias("low"), F.round("c.high", 9).alias("high"))


@query("me9_sweep_roc", sql("WITH g AS (SELECT DISTINCT unnest(quantile_cont(p, [" + ", ".join(str(i / 20) for i in range(21)) + "])) AS threshold FROM v_pred), n AS (SELECT count_if(truth = 'R') AS a, count_if(truth <> 'R') AS b FROM v_pred) SELECT threshold, count_if(truth = 'R' AND p >= threshold) / max(a)::DOUBLE AS detection_rate, count_if(truth <> 'R' AND p >= threshold) / max(b)::DOUBLE AS fpr FROM g, v_pred, n GROUP BY 1", "v_pred"))
def me9(spark, d):
    return M.sweep_roc(v_pred(spark, d), "p", _pos(), 21)


_DECIDE = "CASE WHEN greatest(p_A, p_R, p_unknown) < 0.4 THEN 'unknown' WHEN p_A = greatest(p_A, p_R, p_unknown) THEN 'A' WHEN p_R = greatest(p_A, p_R, p_unknown) THEN 'R' ELSE 'unknown' END"


@query("me10_decide", sql(f"SELECT truth, {_DECIDE} AS decided, count(*) AS n FROM v_probs GROUP BY 1, 2", "v_probs"))
def me10(spark, d):
    p = {"A": F.col("p_A"), "R": F.col("p_R"), "unknown": F.col("p_unknown")}
    return v_probs(spark, d).groupBy("truth", M.decide(p, 0.4, "unknown").alias("decided")).agg(F.count("*").alias("n"))


@query("me11_choose_cutoff", sql("""WITH x AS (SELECT grp, truth, greatest(p_A, p_R) AS p, CASE WHEN p_A >= p_R THEN 'A' ELSE 'R' END AS best FROM v_probs), g AS (SELECT i FROM range(0, 201) t(i)), r AS (SELECT i, grp, count_if(best <> truth AND p >= i / 200.0::DOUBLE) / count(*)::DOUBLE AS r FROM x, g GROUP BY 1, 2), m AS (SELECT i, avg(r) AS rate FROM r GROUP BY 1)
    SELECT coalesce(min(CASE WHEN rate <= 0.05 THEN i END), 200) / 200.0::DOUBLE AS cutoff FROM m""", "v_probs"))
def me11(spark, d):
    x = v_probs(spark, d).select("grp", "truth", F.greatest("p_A", "p_R").alias("p"), F.when(F.col("p_A") >= F.col("p_R"), "A").otherwise("R").alias("best"))
    return M.choose_cutoff(x, "grp", "p", F.col("best") != F.col("truth"), 0.05)


@query("me12_classification_report", sql("""WITH b AS (SELECT truth, pred, grp FROM v_pred UNION ALL SELECT truth, pred, 'ALL' FROM v_pred), c AS (SELECT DISTINCT grp, truth AS cls FROM b UNION SELECT DISTINCT grp, pred FROM b), n AS (SELECT c.grp, cls, count_if(truth = cls) AS s, count_if(pred = cls) AS q, count_if(truth = cls AND pred = cls) AS tp FROM c JOIN b ON b.grp = c.grp GROUP BY 1, 2)
    SELECT grp, cls, s AS support, CASE WHEN q > 0 THEN tp / q::DOUBLE ELSE 0 END AS precision, CASE WHEN s > 0 THEN tp / s::DOUBLE ELSE 0 END AS recall, CASE WHEN s + q > 0 THEN 2 * tp / (s + q)::DOUBLE ELSE 0 END AS f1, CASE WHEN 4 * s + q > 0 THEN 5 * tp / (4 * s + q)::DOUBLE ELSE 0 END AS f2 FROM n""", "v_pred"))
def me12(spark, d):
    return M.classification_report(v_pred(spark, d), "truth", "pred", "grp", "unknown")


@query("me12_macro_report", sql("""WITH p AS (SELECT truth, CASE WHEN p >= 0.1 THEN pred END AS pred, grp FROM v_pred), b AS (SELECT truth, pred, grp FROM p UNION ALL SELECT truth, pred, 'ALL' FROM p), c AS (SELECT DISTINCT grp, truth AS cls FROM b UNION SELECT DISTINCT grp, pred FROM b WHERE pred IS NOT NULL),
    n AS (SELECT c.grp, cls, count_if(truth = cls)::DOUBLE AS s, count_if(coalesce(pred = cls, false))::DOUBLE AS q, count_if(truth = cls AND coalesce(pred = cls, false))::DOUBLE AS tp FROM c JOIN b ON b.grp = c.grp GROUP BY 1, 2), m AS (SELECT grp, avg(CASE WHEN s > 0 THEN tp / s END) AS balanced_accuracy, avg(CASE WHEN q > 0 THEN tp / q ELSE 0 END) AS macro_precision, avg(CASE WHEN s > 0 THEN tp / s ELSE 0 END) AS macro_recall,
    avg(CASE WHEN s + q > 0 THEN 2 * tp / (s + q) ELSE 0 END) AS macro_f1, avg(CASE WHEN 4 * s + q > 0 THEN 5 * tp / (4 * s + q) ELSE 0 END) AS macro_f2 FROM n GROUP BY 1), t AS (SELECT grp, count(*) AS n, count_if(coalesce(truth = pred, false)) / count(*)::DOUBLE AS accuracy, count_if(pred IS NULL) AS no_response FROM b GROUP BY 1)
    SELECT t.*, round(balanced_accuracy, 9) AS balanced_accuracy, round(macro_precision, 9) AS macro_precision, round(macro_recall, 9) AS macro_recall, round(macro_f1, 9) AS macro_f1, round(macro_f2, 9) AS macro_f2 FROM t JOIN m ON t.grp = m.grp""", "v_pred"))
def me12_macro(spark, d):
    out = M.macro_report(v_pred(spark, d).withColumn("pred", F.when(F.col("p") >= 0.1, F.col("pred"))), "truth", "pred", "grp", "unknown")
    return out.withColumns({c: F.round(c, 9) for c in ("balanced_accuracy", "macro_precision", "macro_recall", "macro_f1", "macro_f2")})


@query("me12_error_summary", sql("""WITH b AS (SELECT truth, pred, grp FROM v_pred UNION ALL SELECT truth, pred, 'ALL' FROM v_pred) SELECT grp, count(*) AS n, count_if(truth = pred) / count(*)::DOUBLE AS accuracy, CASE WHEN count_if(truth = 'unknown') > 0 THEN count_if(truth = 'unknown' AND pred <> 'unknown') / count_if(truth = 'unknown')::DOUBLE END AS false_accept,
    CASE WHEN count_if(truth <> 'unknown') > 0 THEN count_if(truth <> 'unknown' AND pred = 'unknown') / count_if(truth <> 'unknown')::DOUBLE END AS false_reject, CASE WHEN count_if(truth <> 'unknown') > 0 THEN count_if(truth <> 'unknown' AND pred <> 'unknown' AND pred <> truth) / count_if(truth <> 'unknown')::DOUBLE END AS misfire FROM b GROUP BY 1""", "v_pred"))
def me12_errors(spark, d):
    return M.error_summary(v_pred(spark, d), "truth", "pred", "grp", "unknown")


@query("me13_slot_errors", "SELECT count_if(a = b) / count(*)::DOUBLE AS exact, sum(abs(x - y)) / count(*)::DOUBLE AS l1, sum(least(abs(x - y), 1440 - abs(x - y))) / count(*)::DOUBLE AS circular, sum(levenshtein(a, b)) / count(*)::DOUBLE AS char_distance FROM (SELECT o_orderpriority AS a, CASE WHEN o_custkey % 5 = 0 THEN '3-MEDIUM' ELSE o_orderpriority END AS b, o_orderkey % 1440 AS x, (o_orderkey + o_custkey) % 1440 AS y FROM orders)")
def me13(spark, d):
    a, k = F.col("o_orderpriority"), F.col("o_orderkey")
    b = F.when(F.col("o_custkey") % 5 == 0, "3-MEDIUM").otherwise(a)
    return M.slot_errors(table(spark, d, "orders"), a, b, k % 1440, (k + F.col("o_custkey")) % 1440).drop("sounds_alike")


@query("me14_unseen_report", sql(f"WITH u AS (SELECT * FROM v_pred WHERE l_suppkey % 4 = 1), c AS ({_RATES.replace('FROM v_pred', 'FROM u')}) SELECT grp, count(*) AS classes, sum(clips)::BIGINT AS clips, round(avg(correct), 9) AS correct FROM c GROUP BY 1", "v_pred"))
def me14(spark, d):
    p = v_pred(spark, d)
    out = M.unseen_report(p, p.where("l_suppkey % 4 <> 1"), "l_suppkey", "truth", "pred", "grp", "unknown")
    return out.select("grp", "classes", "clips", F.round("correct", 9).alias("correct"))


@query("me15_select_model", sql("WITH m AS (SELECT l_suppkey % 10 AS model, count_if(truth = pred) / count(*)::DOUBLE AS score FROM v_pred GROUP BY 1) SELECT model, score FROM m WHERE score >= (SELECT max(score) FROM m) - 0.005 ORDER BY model LIMIT 1", "v_pred"))
def me15(spark, d):
    m = v_pred(spark, d).groupBy((F.col("l_suppkey") % 10).alias("model")).agg((F.count_if(F.col("truth") == F.col("pred")) / F.count("*")).alias("s")).withColumn("size", F.col("model"))
    return M.select_model(m, "model", "size", F.col("s"), 0.005)


@query("me16_compare_runs", sql("WITH a AS (SELECT l_suppkey, count_if(truth = pred) / count(*)::DOUBLE AS v FROM v_pred WHERE grp = 'F' AND l_suppkey % 3 > 0 GROUP BY 1), b AS (SELECT l_suppkey, count_if(truth = pred) / count(*)::DOUBLE AS v FROM v_pred WHERE grp = 'O' AND l_suppkey % 5 > 0 GROUP BY 1) SELECT coalesce(a.l_suppkey, b.l_suppkey) AS l_suppkey, a.v AS a, b.v AS b, b.v - a.v AS difference, CASE WHEN a.v IS NULL OR b.v IS NULL THEN 'not_run' ELSE 'compared' END AS state FROM a FULL JOIN b ON a.l_suppkey = b.l_suppkey", "v_pred"))
def me16(spark, d):
    p = v_pred(spark, d)
    run = lambda w: p.where(w).groupBy("l_suppkey").agg((F.count_if(F.col("truth") == F.col("pred")) / F.count("*")).alias("v"))
    return M.compare_runs(run("grp = 'F' AND l_suppkey % 3 > 0"), run("grp = 'O' AND l_suppkey % 5 > 0"), "l_suppkey", "v")


@query("me17_paired_disagreement", sql("SELECT truth, count(*) AS n, count_if(a AND NOT b) AS only_a, count_if(b AND NOT a) AS only_b, count_if(a AND b) AS \"both\" FROM (SELECT truth, truth = pred AS a, truth = CASE WHEN l_suppkey % 3 = 0 THEN truth ELSE 'R' END AS b FROM v_pred) GROUP BY 1", "v_pred"))
def me17(spark, d):
    b = F.when(F.col("l_suppkey") % 3 == 0, F.col("truth")).otherwise("R")
    return M.paired_disagreement(v_pred(spark, d), "truth", F.col("truth") == F.col("pred"), F.col("truth") == b)


@query("me18_condition_report", sql("SELECT condition, count(*) AS n, count_if(truth = pred) / count(*)::DOUBLE AS correct FROM (SELECT *, unnest(list_filter([CASE WHEN grp = 'F' THEN 'first' END, CASE WHEN p > 0.5 THEN 'sure' END, CASE WHEN l_suppkey % 2 = 0 THEN 'even' END], lambda x: x IS NOT NULL)) AS condition FROM v_pred) GROUP BY 1", "v_pred"))
def me18(spark, d):
    return M.condition_report(v_pred(spark, d), {"first": F.col("grp") == "F", "sure": F.col("p") > 0.5, "even": F.col("l_suppkey") % 2 == 0}, F.col("truth") == F.col("pred"))
