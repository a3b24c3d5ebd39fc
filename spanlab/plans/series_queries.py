"""Queries of window functions, rankings and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlab.operators import series as S
from spanlab.operators import triggers as D
from spanlab.plans.registry import query
from spanlab.plans.views import sql, table, v_scores, v_spans


@query("wn1_smooth", sql("SELECT event_id, round(avg(score) OVER (PARTITION BY stream_id ORDER BY t_us, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS smoothed FROM v_scores", "v_scores"))
def wn1(spark, d):
    return D.smooth(v_scores(spark, d), "stream_id", "t_us", "score", 3, "s", "event_id").select("event_id", F.round("s", 6).alias("smoothed"))


@query("wn2_k_of_n", sql("SELECT event_id, score >= 60 AND above >= 2 AS on_now FROM v_flags", "v_flags"))
def wn2(spark, d):
    return D.k_of_n(v_scores(spark, d), "stream_id", "t_us", "score", 60, 2, 3, "on_now", "event_id").select("event_id", "on_now")


@query("wn3_sessionize", sql("SELECT event_id, sum(f) OVER (PARTITION BY stream_id ORDER BY t_us, event_id)::BIGINT AS session FROM (SELECT *, CASE WHEN t_us - lag(t_us) OVER (PARTITION BY stream_id ORDER BY t_us, event_id) > 14400000000 THEN 1 ELSE 0 END AS f FROM v_scores)", "v_scores"))
def wn3(spark, d):
    return S.sessionize(v_scores(spark, d), "stream_id", "t_us", 14_400_000_000, "event_id").select("event_id", "session")


@query("wn4_head_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n <= 2")
def wn4(spark, d):
    return S.head_per_group(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 2).drop("o_orderdate")


@query("wn5_rank_avg", "SELECT doc_id, rank() OVER (ORDER BY quality) + (count(*) OVER (PARTITION BY quality) - 1) / 2.0::DOUBLE AS rank FROM labels")
def wn5(spark, d):
    return S.rank_avg(table(spark, d, "labels").select("doc_id", "quality"), [], "quality").select("doc_id", "rank")


@query("wn6_running_precision", "SELECT l_orderkey, l_linenumber, position, hits / position::DOUBLE AS precision FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS position, sum((l_returnflag = 'R')::INT) OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING)::BIGINT AS hits FROM lineitem)")
def wn6(spark, d):
    return S.running_precision(table(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", ["l_orderkey", "l_linenumber"], F.col("l_returnflag") == "R").select("l_orderkey", "l_linenumber", "position", "precision")


@query("wn7_gaps_between", sql("SELECT file_id, count(*) AS n, max(g) AS max_gap FROM (SELECT *, s_ms - lag(e_ms) OVER (PARTITION BY file_id ORDER BY s_ms, span_id) AS g FROM v_spans) GROUP BY 1", "v_spans"))
def wn7(spark, d):
    return S.gaps_between(v_spans(spark, d), "file_id", "s_ms", "e_ms", "span_id")


@query("wn8_min_spacing", sql("SELECT file_id, min(g) AS min_spacing FROM (SELECT *, s_ms - lag(s_ms) OVER (PARTITION BY file_id ORDER BY s_ms) AS g FROM v_spans) GROUP BY 1", "v_spans"))
def wn8(spark, d):
    return S.min_spacing(v_spans(spark, d), "file_id", "s_ms")


_MERGE = """SELECT file_id, min(s_ms) AS s_ms, max(e_ms) AS e_ms FROM (SELECT *, sum(f) OVER (PARTITION BY file_id ORDER BY s_ms, e_ms ROWS UNBOUNDED PRECEDING) AS i FROM (SELECT *, CASE WHEN s_ms > max(e_ms) OVER (PARTITION BY file_id ORDER BY s_ms, e_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS f FROM v_spans)) GROUP BY file_id, i"""


@query("wn9_merge_intervals", sql(_MERGE, "v_spans"))
def wn9(spark, d):
    return S.merge_intervals(v_spans(spark, d), ["file_id"], "s_ms", "e_ms").select("file_id", "s_ms", "e_ms")


@query("wn10_longest_run", sql("""WITH r AS (SELECT *, score > 60 AS o, row_number() OVER (PARTITION BY stream_id ORDER BY t_us, event_id) - row_number() OVER (PARTITION BY stream_id, score > 60 ORDER BY t_us, event_id) AS g FROM v_scores),
    n AS (SELECT stream_id, o, count(*) AS c FROM r GROUP BY stream_id, o, g) SELECT stream_id, coalesce(max(CASE WHEN o THEN c END), 0) AS longest FROM n GROUP BY 1""", "v_scores"))
def wn10(spark, d):
    return S.longest_run(v_scores(spark, d), "stream_id", ["t_us", "event_id"], F.col("score") > 60)


@query("wn11_linspace_cap", sql("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY t_us, event_id) - 1 AS i, count(*) OVER (PARTITION BY stream_id) AS c FROM v_scores)
    SELECT stream_id, event_id FROM r WHERE c <= 20 OR i IN (SELECT (2 * j * (r.c - 1) + 19) // 38 FROM range(0, 20) t(j))""", "v_scores"))
def wn11(spark, d):
    return S.linspace_cap(v_scores(spark, d), "stream_id", ["t_us", "event_id"], 20).select("stream_id", "event_id")


@query("wn12_running_balance", "SELECT l_orderkey, l_linenumber, running, running / sum(l_quantity::BIGINT) OVER (PARTITION BY l_suppkey)::DOUBLE AS share FROM (SELECT *, sum(l_quantity::BIGINT) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM lineitem)")
def wn12(spark, d):
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice", F.col("l_quantity").cast("long").alias("q"))
    return S.running_balance(items, "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], "q").select("l_orderkey", "l_linenumber", "running", "share")


@query("wn13_number_within", "SELECT doc_id, lang || '_' || lpad((row_number() OVER (PARTITION BY lang ORDER BY source, doc_id))::VARCHAR, 5, '0') AS name FROM documents")
def wn13(spark, d):
    return S.number_within(table(spark, d, "documents").select("doc_id", "lang", "source"), "lang", ["source", "doc_id"]).select("doc_id", "name")


@query("tk1_top_fraction", "SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS n, least(50, ceil(count(*) OVER (PARTITION BY l_suppkey) * 50000 / 1000000)) AS k FROM lineitem WHERE l_returnflag = 'N') WHERE n <= k")
def tk1(spark, d):
    return S.top_fraction(table(spark, d, "lineitem").where("l_returnflag = 'N'"), ["l_suppkey"], "l_extendedprice", 50_000, 50, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber")


@query("tk2_extreme_margins", "SELECT label, vec_id, side FROM (SELECT label, vec_id, 'low' AS side, row_number() OVER (PARTITION BY label ORDER BY m, vec_id) AS n FROM (SELECT label, vec_id, round(embedding[1]::DOUBLE - embedding[2]::DOUBLE, 6) AS m FROM embeddings) UNION ALL SELECT label, vec_id, 'high', row_number() OVER (PARTITION BY label ORDER BY m DESC, vec_id) FROM (SELECT label, vec_id, round(embedding[1]::DOUBLE - embedding[2]::DOUBLE, 6) AS m FROM embeddings)) WHERE n <= 3")
def tk2(spark, d):
    e = F.col("embedding")
    m = table(spark, d, "embeddings").select("label", "vec_id", F.round(e[0].cast("double") - e[1].cast("double"), 6).alias("m"))
    low, high = S.head_per_group(m, ["label"], ["m", "vec_id"], 3), S.head_per_group(m, ["label"], [F.col("m").desc(), "vec_id"], 3)
    return low.withColumn("side", F.lit("low")).unionByName(high.withColumn("side", F.lit("high"))).drop("m")


@query("tk3_priority_queue", sql("SELECT file_id, span_id, kind = 'error' AS needs_review FROM v_spans WHERE kind IN ('error', 'purchase') ORDER BY needs_review DESC, file_id, s_ms, span_id", "v_spans"))
def tk3(spark, d):
    s = v_spans(spark, d).where("kind IN ('error', 'purchase')").withColumn("needs_review", F.col("kind") == "error")
    return s.orderBy(F.col("needs_review").desc(), "file_id", "s_ms", "span_id").select("file_id", "span_id", "needs_review")


@query("tk4_worst_first", "SELECT l_suppkey, count_if(l_returnflag = 'R') / count(*)::DOUBLE AS rate FROM lineitem GROUP BY 1 ORDER BY rate DESC, l_suppkey")
def tk4(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg((F.count_if(F.col("l_returnflag") == "R") / F.count("*")).alias("rate")).orderBy(F.col("rate").desc(), "l_suppkey")


@query("st1_union_all", "SELECT c_custkey AS key, c_mktsegment AS segment, NULL::BIGINT AS size FROM customer UNION ALL SELECT p_partkey, NULL, p_size::BIGINT FROM part")
def st1(spark, d):
    return S.union_all([table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment")), table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").cast("long").alias("size"))])


@query("st2_symmetric_difference", "(SELECT DISTINCT l_partkey AS k, 'left' AS side FROM lineitem WHERE l_quantity > 49 AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 2)) UNION ALL (SELECT DISTINCT l_partkey, 'right' FROM lineitem WHERE l_quantity < 2 AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49))")
def st2(spark, d):
    items = table(spark, d, "lineitem")
    return S.symmetric_difference(items.where("l_quantity > 49").select(F.col("l_partkey").alias("k")).distinct(), items.where("l_quantity < 2").select(F.col("l_partkey").alias("k")).distinct())


@query("st3_intersect_keys", "SELECT text FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT text FROM documents WHERE doc_id % 2 = 1")
def st3(spark, d):
    docs = table(spark, d, "documents")
    return S.intersect_keys(docs.where("doc_id % 2 = 0").select("text"), docs.where("doc_id % 2 = 1").select("text"))


@query("st4_except_keys", "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def st4(spark, d):
    return S.except_keys(table(spark, d, "part").select("p_partkey"), table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey")))
