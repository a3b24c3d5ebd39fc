"""Queries of diagnostics and of the function surface."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlab.functions import udfs as U
from spanlab.operators import diagnostics as D
from spanlab.plans.intervals_queries import _NEG_STARTS
from spanlab.plans.registry import query
from spanlab.plans.text_queries import _spoken_sql
from spanlab.plans.views import sql, table, v_pred, v_spans

_AUC = "WITH c AS (SELECT p, count_if(s) AS a, count_if(NOT s) AS b FROM {t} GROUP BY 1), r AS (SELECT *, sum(b) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS under FROM c) SELECT round(sum(a * (2 * coalesce(under, 0) + b))::BIGINT / (2 * sum(a)::BIGINT * sum(b)::BIGINT)::DOUBLE, 12) AS auc FROM r"


@query("dg1_source_auc", sql(_AUC.format(t="(SELECT p, grp = 'F' AS s FROM v_pred WHERE truth <> 'R')"), "v_pred"))
def dg1(spark, d):
    return D.source_auc(v_pred(spark, d).where("truth <> 'R'"), "p", F.col("grp") == "F").select(F.round("auc", 12).alias("auc"))


_MATCHED = """WITH d AS (SELECT p_partkey AS id, p_size::BIGINT AS x, floor(p_retailprice)::BIGINT % 60 AS y, p_partkey % 97 AS p, p_partkey % 4 = 0 AS s FROM part), m AS (SELECT a.id AS a_id, b.id AS b_id, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM d a JOIN d b ON a.s AND NOT b.s AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 36),
    k AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY d2, b_id) AS n FROM m), u AS (SELECT DISTINCT a_id AS id, true AS s FROM k WHERE n <= 5 UNION ALL SELECT b_id, false FROM k WHERE n <= 5), t AS (SELECT d.p, u.s FROM u JOIN d ON u.id = d.id), """


@query("dg1_matched_source_auc", _MATCHED + _AUC.format(t="t")[5:])
def dg1_matched(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("x"), (F.floor("p_retailprice") % 60).alias("y"), (F.col("p_partkey") % 97).alias("p"), (F.col("p_partkey") % 4 == 0).alias("s"))
    return D.matched_source_auc(p, "id", "p", "s", "x", "y", 5, 6).select(F.round("auc", 12).alias("auc"))


_EDGES = " + ".join(f"(u >= {e!r}::DOUBLE)::INT" for e in (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916759850712))


@query("dg2_cluster_bootstrap", f"""WITH g AS (SELECT l_suppkey, sum(l_quantity::BIGINT)::BIGINT AS s, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT *, ('0x' || substr(sha256('3|' || l_suppkey || '|' || rep), 1, 15))::BIGINT / 1152921504606846976.0::DOUBLE AS u FROM (SELECT *, unnest(range(0, 200)) AS rep FROM g)),
    m AS (SELECT rep, sum(s * t)::BIGINT / sum(n * t)::BIGINT::DOUBLE AS m FROM (SELECT *, {_EDGES} AS t FROM r) GROUP BY 1) SELECT (SELECT sum(s)::BIGINT / sum(n)::BIGINT::DOUBLE FROM g) AS mean, round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high FROM m""")
def dg2(spark, d):
    items = table(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").cast("long").alias("q"))
    return D.cluster_bootstrap(items, "l_suppkey", "q", 200, 3).select("mean", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


_TIMES = " + ".join(f"(u >= {e!r}::DOUBLE)::INT" for e in D.POISSON)


@query("dg3_before_after", f"""WITH t AS (SELECT l_returnflag, l_orderkey || '|' || l_linenumber AS id, l_quantity::BIGINT AS b, l_quantity::BIGINT + l_linenumber AS a FROM lineitem),
    h AS (SELECT l_returnflag, a - b AS c, k * 16 AS first, sha256('3|' || id || '|' || k) AS h FROM t, range(0, 3) r(k)), d AS (SELECT l_returnflag, c, first + j AS rep, ('0x' || substr(h, 4 * j::BIGINT + 1, 4))::BIGINT / 65536.0::DOUBLE AS u FROM h, range(0, 16) x(j)),
    m AS (SELECT l_returnflag, rep, sum(c * n)::BIGINT / sum(n)::BIGINT::DOUBLE AS m FROM (SELECT *, {_TIMES} AS n FROM d) GROUP BY 1, 2), i AS (SELECT l_returnflag, round(quantile_cont(m, 0.025), 9) AS change_low, round(quantile_cont(m, 0.975), 9) AS change_high FROM m GROUP BY 1)
    SELECT t.l_returnflag, count(*) AS n, quantile_cont(b, 0.5) AS median_before, quantile_cont(a, 0.5) AS median_after, sum(a - b) / count(*)::DOUBLE AS mean_change, any_value(change_low) AS change_low, any_value(change_high) AS change_high, count_if(b > 30) AS above_before, count_if(a > 30) AS above_after FROM t JOIN i ON t.l_returnflag = i.l_returnflag GROUP BY 1""")
def dg3(spark, d):
    b = F.col("l_quantity").cast("long")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", b.alias("b"), (b + F.col("l_linenumber")).alias("a"))
    out = D.before_after(rows, ["l_returnflag"], "b", "a", 30, ["l_orderkey", "l_linenumber"], 48, 3)
    return out.withColumns({c: F.round(c, 9) for c in ("change_low", "change_high")})


@query("dg4_ablation_delta", sql("WITH a AS (SELECT l_suppkey, count_if(truth = pred) / count(*)::DOUBLE AS v FROM v_pred GROUP BY 1), b AS (SELECT l_suppkey, count_if(truth = pred) / count(*)::DOUBLE AS v FROM v_pred WHERE grp = 'O' GROUP BY 1) SELECT a.l_suppkey, a.v AS \"full\", b.v AS without, a.v - b.v AS \"drop\" FROM a JOIN b ON a.l_suppkey = b.l_suppkey", "v_pred"))
def dg4(spark, d):
    run = lambda p: p.groupBy("l_suppkey").agg((F.count_if(F.col("truth") == F.col("pred")) / F.count("*")).alias("v"))
    p = v_pred(spark, d)
    return D.ablation_delta(run(p), run(p.where("grp = 'O'")), "l_suppkey", "v")


@query("dg5_shortcut_probe")
def dg5(spark, d):
    return D.shortcut_probe(table(spark, d, "embeddings"), "embedding", "label", F.col("vec_id") % 4 != 0)


@query("dg6_cluster_two")
def dg6(spark, d):
    return D.cluster_two(table(spark, d, "embeddings"), "vec_id", "embedding")


_TAIL = " + ".join(f"({2 * (-1) ** (k - 1)}) * exp(-2.0::DOUBLE * {k * k} * l * l)" for k in range(1, 21))


@query("dg7_position_uniformity", sql(f"""WITH x AS (SELECT kind, s_ms / 86400000.0::DOUBLE AS x FROM v_spans), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY x) AS i, count(*) OVER (PARTITION BY kind) AS n FROM x),
    k AS (SELECT kind, count(*) AS n, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3, max(greatest(i / n::DOUBLE - x, x - (i - 1) / n::DOUBLE)) AS ks FROM r GROUP BY 1), l AS (SELECT *, (sqrt(n) + 0.12::DOUBLE + 0.11::DOUBLE / sqrt(n)) * ks AS l FROM k)
    SELECT kind, n, round(q1, 9) AS q1, round(q2, 9) AS q2, round(q3, 9) AS q3, round(ks, 9) AS ks, round(CASE WHEN l < 0.3 THEN 1 ELSE greatest(least({_TAIL}, 1), 0) END, 9) AS p_value FROM l""", "v_spans"))
def dg7(spark, d):
    out = D.position_uniformity(v_spans(spark, d), ["kind"], F.col("s_ms") / 86_400_000.0)
    return out.select("kind", "n", *[F.round(q, 9).alias(q) for q in ("q1", "q2", "q3", "ks", "p_value")])


@query("dg8_near_duplicate_max", "WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings) SELECT a.label, a.vec_id, round(max(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v))), 9) AS max_similarity FROM e a JOIN e b ON a.label = b.label AND b.vec_id % 5 = 0 WHERE a.vec_id % 5 > 0 GROUP BY 1, 2")
def dg8(spark, d):
    e = table(spark, d, "embeddings")
    out = D.near_duplicate_max(e.where("vec_id % 5 > 0"), e.where("vec_id % 5 = 0"), "label", "vec_id", "embedding")
    return out.select("label", "vec_id", F.round("max_similarity", 9).alias("max_similarity"))


@query("dg8_near_duplicate_lsh")
def dg8_lsh(spark, d):
    """Every vector against all whose id ends in 0 or 5, under one key: what the projections find."""
    e = table(spark, d, "embeddings").withColumn("all", F.lit("all"))
    return D.near_duplicate_lsh(e.where("vec_id % 5 > 0"), e.where("vec_id % 5 = 0"), "all", "vec_id", "embedding", bits=4).select("vec_id", F.round("max_similarity", 9).alias("max_similarity"), "compared")


@query("udf1_score_with", "SELECT vec_id, round(1 / (1 + exp(-(embedding[1]::DOUBLE * 2 - embedding[2]::DOUBLE))), 6) AS score FROM embeddings")
def udf1(spark, d):
    import numpy as np

    def scorer():
        return lambda rows: 1 / (1 + np.exp(-(2 * rows[:, 0] - rows[:, 1])))

    return table(spark, d, "embeddings").select("vec_id", F.round(U.score_with(scorer)(F.col("embedding")), 6).alias("score"))


@query("udaf1_auc_agg", sql("WITH c AS (SELECT l_suppkey, p, count_if(truth = 'R') AS a, count_if(truth <> 'R') AS b FROM v_pred GROUP BY 1, 2), r AS (SELECT *, sum(b) OVER (PARTITION BY l_suppkey ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS under FROM c) SELECT l_suppkey, round(sum(a * (2 * coalesce(under, 0) + b))::BIGINT / (2 * sum(a)::BIGINT * sum(b)::BIGINT)::DOUBLE, 9) AS auc FROM r GROUP BY 1", "v_pred"))
def udaf1(spark, d):
    return v_pred(spark, d).groupBy("l_suppkey").agg(F.round(U.auc_agg()(F.col("p"), (F.col("truth") == "R")), 9).alias("auc"))


@query("udtf1_expand_windows", "SELECT doc_id, unnest(" + _NEG_STARTS.format(L=400, H=150, T=1).replace("free_end - free_start", "n_chars").replace("free_end", "n_chars").replace("free_start", "0") + ") AS w0 FROM documents")
def udtf1(spark, d):
    U.register(spark)
    table(spark, d, "documents").select("doc_id", "n_chars").createOrReplaceTempView("__udtf_documents")
    return spark.sql("SELECT d.doc_id, w.w0 FROM __udtf_documents d, LATERAL expand_windows(0L, d.n_chars, 400L, 150L, 1L) w")


@query("udtf2_sql_functions", sql("SELECT a.span_id, least(a.e_ms, b.e_ms) - greatest(a.s_ms, b.s_ms) > 0 AS met, levenshtein(a.kind, b.kind) / greatest(length(a.kind), length(b.kind), 1)::DOUBLE AS ratio FROM v_spans a JOIN v_spans b ON a.file_id = b.file_id AND b.span_id = a.span_id + 150", "v_spans"))
def udtf2(spark, d):
    U.register(spark)
    v_spans(spark, d).createOrReplaceTempView("__udtf_spans")
    return spark.sql("SELECT a.span_id, overlaps(a.s_ms, a.e_ms, b.s_ms, b.e_ms) AS met, edit_ratio(a.kind, b.kind) AS ratio FROM __udtf_spans a JOIN __udtf_spans b ON a.file_id = b.file_id AND b.span_id = a.span_id + 150")


@query("udtf2_norm_spoken", f"SELECT o_orderkey, {_spoken_sql('said')} AS said FROM (SELECT o_orderkey, 'It''s ' || (o_orderkey % 130) || '% at ' || (o_orderkey % 12 + 1) || ':00pm, ' || o_orderpriority AS said FROM orders)")
def udtf2_spoken(spark, d):
    """Sentences with numbers, signs and clock times, by the SQL function."""
    U.register(spark)
    k = F.col("o_orderkey")
    said = F.concat(F.lit("It's "), k % 130, F.lit("% at "), k % 12 + 1, F.lit(":00pm, "), F.col("o_orderpriority"))
    table(spark, d, "orders").select("o_orderkey", said.alias("said")).createOrReplaceTempView("__spoken")
    return spark.sql("SELECT o_orderkey, norm_spoken(said) AS said FROM __spoken")
