"""Queries of the aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlab.operators import aggregates as A
from spanlab.plans.registry import query
from spanlab.plans.views import prop_k, sql, table, v_pred


@query("ag1_counts_by", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2")
def ag1(spark, d):
    return A.counts_by(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])


_ST = ("F", "O", "P")


@query("ag2_crosstab", "WITH o AS (SELECT o_orderpriority, o_orderstatus FROM orders UNION ALL SELECT 'All', o_orderstatus FROM orders) SELECT o_orderpriority, " + ", ".join(f"count_if(o_orderstatus = '{s}') AS \"{s}\"" for s in _ST) + ', count(*) AS "All" FROM o GROUP BY 1')
def ag2(spark, d):
    return A.crosstab(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", list(_ST), margins=True)


@query("ag3_distinct_per", "SELECT l_suppkey, count(DISTINCT l_partkey) AS n_distinct FROM lineitem GROUP BY 1")
def ag3(spark, d):
    return A.distinct_per(table(spark, d, "lineitem"), "l_suppkey", "l_partkey")


@query("ag4_effective_groups", """WITH g AS (SELECT l_suppkey, count(*) AS n, sum(l_quantity::BIGINT) AS w FROM lineitem GROUP BY 1) SELECT sum(n)::BIGINT * sum(n)::BIGINT / sum(n * n)::BIGINT::DOUBLE AS effective_rows,
    sum(w)::BIGINT * sum(w)::BIGINT / sum(w * w)::BIGINT::DOUBLE AS effective_weight, (SELECT l_suppkey FROM g ORDER BY w DESC, l_suppkey DESC LIMIT 1) AS top_group, max(w)::BIGINT / sum(w)::BIGINT::DOUBLE AS top_share FROM g""")
def ag4(spark, d):
    return A.effective_groups(table(spark, d, "lineitem"), "l_suppkey", F.col("l_quantity").cast("long"))


@query("ag5_share_within", "SELECT l_returnflag, l_shipyear, n, n / sum(n) OVER (PARTITION BY l_returnflag)::DOUBLE AS share FROM (SELECT l_returnflag, year(l_shipdate)::INT AS l_shipyear, count(*) AS n FROM lineitem GROUP BY 1, 2)")
def ag5(spark, d):
    return A.share_within(table(spark, d, "lineitem").withColumn("l_shipyear", F.year("l_shipdate")), ["l_returnflag", "l_shipyear"], ["l_returnflag"])


@query("ag6_quantile_summary", "SELECT l_returnflag, count(q) AS n, min(q) AS min, quantile_cont(q, 0.1) AS p10, quantile_cont(q, 0.5) AS p50, quantile_cont(q, 0.9) AS p90, max(q) AS max FROM (SELECT l_returnflag, l_quantity AS q FROM lineitem) GROUP BY 1")
def ag6(spark, d):
    return A.quantile_summary(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity")


@query("ag7_latency_summary", "SELECT event_type, count(v) AS n, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.9) AS p90, quantile_cont(v, 0.95) AS p95, avg(v) AS mean, min(v) AS min, max(v) AS max FROM (SELECT event_type, floor(value)::BIGINT AS v FROM events) GROUP BY 1")
def ag7(spark, d):
    return A.latency_summary(table(spark, d, "events").select("event_type", F.floor("value").alias("v")), ["event_type"], "v")


_RATES = "SELECT grp, truth, count(*) AS clips, count_if(pred = truth) / count(*)::DOUBLE AS correct, count_if(pred <> truth AND NOT (pred = 'unknown' AND truth <> 'unknown')) / count(*)::DOUBLE AS wrong, count_if(pred = 'unknown' AND truth <> 'unknown') / count(*)::DOUBLE AS rejected FROM v_pred GROUP BY 1, 2"


@query("ag8_macro_rates", sql(f"WITH c AS ({_RATES}) SELECT grp, count(*) AS classes, sum(clips)::BIGINT AS clips, round(avg(correct), 9) AS correct, round(avg(wrong), 9) AS wrong, round(avg(rejected), 9) AS rejected FROM c GROUP BY 1", "v_pred"))
def ag8(spark, d):
    out = A.macro_rates(v_pred(spark, d), "truth", "pred", "grp", "unknown")
    return out.select("grp", "classes", "clips", *[F.round(c, 9).alias(c) for c in ("correct", "wrong", "rejected")])


@query("ag9_group_mean_of_means", sql("SELECT round(avg(m), 9) AS mean_of_means FROM (SELECT l_suppkey, avg(CASE WHEN truth = 'unknown' AND pred <> 'unknown' THEN 1 ELSE 0 END) AS m FROM v_pred GROUP BY 1)", "v_pred"))
def ag9(spark, d):
    wrong = ((F.col("truth") == "unknown") & (F.col("pred") != "unknown")).cast("int")
    return A.mean_of_group_means(v_pred(spark, d), "l_suppkey", wrong).select(F.round("mean_of_means", 9).alias("mean_of_means"))


_LANGS = ("en", "fr", "de", "es")


@query("ag10_coverage_matrix", "SELECT source, count(*) AS clips, count(DISTINCT text) AS voices, " + ", ".join(f"count_if(lang = '{x}') AS clips_{x}, count(DISTINCT CASE WHEN lang = '{x}' THEN text END) AS voices_{x}" for x in _LANGS) + " FROM documents GROUP BY 1")
def ag10(spark, d):
    docs = table(spark, d, "documents").select("source", "lang", F.col("text").alias("voice"))
    return A.coverage_matrix(docs, "source", "lang", list(_LANGS), "voice")


@query("ag11_inventory", """WITH m AS (SELECT 'src' || i AS source, 'note ' || i AS note FROM range(0, 25) t(i)), u AS (SELECT source, count_if(s = 'train') AS train, count_if(s = 'validation') AS validation, count_if(s = 'test') AS test, count(DISTINCT lang) AS classes, count(DISTINCT doc_id % 50) AS speakers,
    CASE WHEN bool_and(r) THEN 'real' WHEN NOT bool_or(r) THEN 'synthetic' ELSE 'mixed' END AS kind FROM (SELECT *, CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'validation' ELSE 'test' END AS s, CASE WHEN source = 'src1' THEN true WHEN source = 'src2' THEN false ELSE doc_id % 3 = 0 END AS r FROM documents) GROUP BY 1)
    SELECT coalesce(u.source, m.source) AS source, train, validation, test, classes, speakers, kind, note FROM u FULL JOIN m ON u.source = m.source""")
def ag11(spark, d):
    k = F.col("doc_id")
    docs = table(spark, d, "documents").select("source", "lang", (k % 50).alias("speaker"), F.when(k % 10 < 8, "train").when(k % 10 == 8, "validation").otherwise("test").alias("split"), F.when(F.col("source") == "src1", True).when(F.col("source") == "src2", False).otherwise(k % 3 == 0).alias("real"))
    meta = spark.range(25).select(F.concat(F.lit("src"), "id").alias("source"), F.concat(F.lit("note "), "id").alias("note"))
    return A.inventory(docs, "source", "split", ["train", "validation", "test"], "lang", "speaker", "real", meta)


@query("ag12_bin_moments", "SELECT (i - 1)::INT AS pos, count(*) AS n, round(avg(x), 9) AS mean, round(stddev_pop(x), 7) AS std, count_if(x <= -0.2) / count(*)::DOUBLE AS at_floor FROM (SELECT unnest(range(1, 65)) AS i, embedding FROM embeddings) e, LATERAL (SELECT embedding[i]::DOUBLE AS x) GROUP BY i")
def ag12(spark, d):
    m = A.bin_moments(table(spark, d, "embeddings"), "embedding", 64, -0.2, F.lit(True))
    return m.select("pos", "n", F.round("mean", 9).alias("mean"), F.round("std", 7).alias("std"), "at_floor")


@query("ag13_confusions", sql("SELECT truth, pred, count(*) AS n FROM v_pred WHERE truth <> pred GROUP BY 1, 2 ORDER BY n DESC, truth, pred LIMIT 15", "v_pred"))
def ag13(spark, d):
    return A.confusions(v_pred(spark, d), "truth", "pred")


@query("ag14_set_string", "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS labels FROM orders GROUP BY 1")
def ag14(spark, d):
    return A.set_string(table(spark, d, "orders"), ["o_custkey"], "o_orderpriority")


@query("ag15_union_of_reasons", "SELECT source, reason, count(*) AS n FROM (SELECT source, 'short' AS reason FROM documents WHERE n_chars < 100 UNION ALL SELECT source, 'foreign' FROM documents WHERE lang <> 'en') GROUP BY 1, 2")
def ag15(spark, d):
    docs = table(spark, d, "documents")
    return A.union_of_reasons([docs.where("n_chars < 100").withColumn("reason", F.lit("short")), docs.where("lang <> 'en'").withColumn("reason", F.lit("foreign"))], ["source", "reason"])


@query("ag16_clip_max", "SELECT l_orderkey, max(l_extendedprice) AS score, count(*) AS windows FROM lineitem GROUP BY 1")
def ag16(spark, d):
    return A.clip_max(table(spark, d, "lineitem"), "l_orderkey", "l_extendedprice")


@query("ag17_provenance_rates", """WITH p AS (SELECT event_type, k % 2 = 0 AS gain, k % 3 = 0 AND k % 5 > 0 AS noise FROM (SELECT event_type, regexp_extract(props, '[0-9]+')::INT AS k FROM events)), b AS (SELECT * FROM p UNION ALL SELECT 'ALL', gain, noise FROM p)
    SELECT event_type, count(*) AS draws, count_if(gain) / count(*)::DOUBLE AS gain, count_if(noise) / count(*)::DOUBLE AS noise, count_if(gain OR noise) / count(*)::DOUBLE AS "any" FROM b GROUP BY 1""")
def ag17(spark, d):
    k = prop_k()
    noise = F.when(k % 3 == 0, F.when(k % 5 == 0, "skipped").otherwise("5"))
    params = F.map_filter(F.create_map(F.lit("gain"), F.when(k % 2 == 0, "3"), F.lit("noise"), noise), lambda _, v: v.isNotNull())
    return A.provenance_rates(table(spark, d, "events").select("event_type", params.alias("params")), "event_type", "params", ["gain", "noise"])


@query("ag18_quantile_outliers", "SELECT doc_id, CASE WHEN n_chars < lo THEN 'low' ELSE 'high' END AS side FROM documents, (SELECT quantile_cont(n_chars, 0.02) AS lo, quantile_cont(n_chars, 0.98) AS hi FROM documents) WHERE n_chars < lo OR n_chars > hi")
def ag18(spark, d):
    return A.quantile_outliers(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars").select("doc_id", "side")
