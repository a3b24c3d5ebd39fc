"""Queries of the joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlab.operators import joins as J
from spanlab.operators.triggers import detect
from spanlab.plans.registry import query
from spanlab.plans.views import sql, table, v_distractors, v_scores, v_spans, v_targets


@query("jn1_lookup_join", "SELECT l_orderkey, l_linenumber, o_custkey, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def jn1(spark, d):
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    dim = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderstatus")
    return J.lookup_join(items, dim, "l_orderkey", ["o_custkey"])


@query("jn2_inner_on_keys", sql("SELECT a.file_id, a.span_id, b.e_ms - a.e_ms AS end_change FROM v_spans a JOIN (SELECT file_id, span_id, s_ms, e_ms + span_id % 3 AS e_ms FROM v_spans WHERE span_id % 5 > 0) b ON a.file_id = b.file_id AND a.span_id = b.span_id", "v_spans"))
def jn2(spark, d):
    a = v_spans(spark, d)
    b = a.where("span_id % 5 > 0").select("file_id", "span_id", (F.col("e_ms") + F.col("span_id") % 3).alias("e2"))
    return a.join(b, ["file_id", "span_id"]).select("file_id", "span_id", (F.col("e2") - F.col("e_ms")).alias("end_change"))


@query("jn3_semi_anti", """SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders FROM customer""")
def jn3(spark, d):
    c, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").withColumn("has_orders", F.lit(True)).unionByName(c.join(o, "c_custkey", "left_anti").withColumn("has_orders", F.lit(False)))


@query("jn4_overlap_join", sql("SELECT a.file_id, a.span_id AS purchase, b.span_id AS click, least(a.e_ms, b.e_ms) - greatest(a.s_ms, b.s_ms) AS overlap_ms FROM v_spans a JOIN v_spans b ON a.file_id = b.file_id AND least(a.e_ms, b.e_ms) - greatest(a.s_ms, b.s_ms) > 0 WHERE a.kind = 'purchase' AND b.kind = 'click'", "v_spans"))
def jn4(spark, d):
    s = v_spans(spark, d)
    a = s.where("kind = 'purchase'").select("file_id", F.col("span_id").alias("purchase"), F.col("s_ms").alias("a0"), F.col("e_ms").alias("a1"))
    b = s.where("kind = 'click'").select("file_id", F.col("span_id").alias("click"), F.col("s_ms").alias("b0"), F.col("e_ms").alias("b1"))
    return J.overlap_join(a, b, ["file_id"], ("a0", "a1"), ("b0", "b1"), 3_600_000).select("file_id", "purchase", "click", (F.least("a1", "b1") - F.greatest("a0", "b0")).alias("overlap_ms"))


@query("jn5_best_overlap", sql("""WITH m AS (SELECT a.file_id, a.span_id AS t_id, b.span_id AS f_id, (least(a.e_ms, b.e_ms) - greatest(a.s_ms, b.s_ms)) / (greatest(a.e_ms, b.e_ms) - least(a.s_ms, b.s_ms))::DOUBLE AS iou, b.s_ms - a.s_ms AS start_error, b.e_ms - a.e_ms AS end_error
    FROM v_spans a JOIN v_spans b ON a.file_id = b.file_id AND least(a.e_ms, b.e_ms) > greatest(a.s_ms, b.s_ms) WHERE a.kind = 'purchase' AND b.kind = 'click'),
    k AS (SELECT *, row_number() OVER (PARTITION BY file_id, t_id ORDER BY iou DESC, f_id) AS n FROM m)
    SELECT s.file_id, s.span_id AS t_id, k.f_id, k.iou, k.start_error, k.end_error FROM v_spans s LEFT JOIN k ON s.file_id = k.file_id AND s.span_id = k.t_id AND k.n = 1 WHERE s.kind = 'purchase'""", "v_spans"))
def jn5(spark, d):
    s = v_spans(spark, d)
    t = s.where("kind = 'purchase'").select("file_id", F.col("span_id").alias("t_id"), F.col("s_ms").alias("t0"), F.col("e_ms").alias("t1"))
    f = s.where("kind = 'click'").select("file_id", F.col("span_id").alias("f_id"), F.col("s_ms").alias("f0"), F.col("e_ms").alias("f1"))
    return J.best_overlap(t, f, ["file_id"], 3_600_000)


@query("jn6_attribute", sql("""WITH m AS (SELECT t.stream_id, t.event_id AS trigger_id, e.event_id, least(t.t_us, e.e_us) - greatest(t.t_us - 3600000000, e.s_us) AS overlap, e.s_us FROM v_triggers t JOIN v_distractors e ON t.stream_id = e.stream_id
      AND least(t.t_us, e.e_us) - greatest(t.t_us - 3600000000, e.s_us) > 0), k AS (SELECT *, row_number() OVER (PARTITION BY stream_id, trigger_id ORDER BY overlap DESC, s_us, event_id) AS n FROM m)
    SELECT t.stream_id, t.event_id AS trigger_id, coalesce(k.event_id::VARCHAR, 'background') AS cause FROM v_triggers t LEFT JOIN k ON t.stream_id = k.stream_id AND t.event_id = k.trigger_id AND k.n = 1""", "v_triggers", "v_distractors"))
def jn6(spark, d):
    t = triggers(spark, d).select("stream_id", F.col("t_us").alias("t"), F.col("event_id").alias("trigger_id"))
    e = v_distractors(spark, d).select("stream_id", "event_id", F.col("s_us").alias("e0"), F.col("e_us").alias("e1"))
    return J.attribute(t, e, "stream_id", 3_600_000_000, F.lit("background")).select("stream_id", "trigger_id", "cause")


def triggers(spark, d):
    return detect(v_scores(spark, d), "stream_id", "t_us", "score", 60, 43_200_000_000, k=2, n=3, tie="event_id")


@query("jn5_detections_without_truth", sql("SELECT b.file_id, count(*) AS detections, count_if(NOT EXISTS (SELECT 1 FROM v_spans a WHERE a.kind = 'purchase' AND a.file_id = b.file_id AND least(a.e_ms, b.e_ms) > greatest(a.s_ms, b.s_ms))) AS without_truth FROM v_spans b WHERE b.kind = 'click' GROUP BY 1", "v_spans"))
def jn5_without(spark, d):
    s = v_spans(spark, d)
    t = s.where("kind = 'purchase'").select("file_id", F.col("span_id").alias("t_id"), F.col("s_ms").alias("t0"), F.col("e_ms").alias("t1"))
    f = s.where("kind = 'click'").select("file_id", F.col("span_id").alias("f_id"), F.col("s_ms").alias("f0"), F.col("e_ms").alias("f1"))
    return J.without_truth(t, f, ["file_id"], 3_600_000)


@query("jn7_knn_band_join", """WITH p AS (SELECT p_partkey, p_size::BIGINT AS x, floor(p_retailprice)::BIGINT % 60 AS y FROM part), m AS (SELECT a.p_partkey AS a_id, b.p_partkey AS b_id, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2
    FROM p a JOIN p b ON b.p_partkey % 2 = 1 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 36 WHERE a.p_partkey % 2 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY d2, b_id) AS rank FROM m)
    SELECT a_id, b_id, d2, rank FROM k WHERE rank <= 5""")
def jn7(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("long").alias("x"), (F.floor("p_retailprice") % 60).alias("y"))
    a = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = p.where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return J.knn_band_join(a, b, [], 5, 6)


@query("jn7_knn_band_join_whole", """WITH p AS (SELECT p_partkey, p_size::BIGINT AS x, floor(p_retailprice)::BIGINT % 60 AS y FROM part), m AS (SELECT a.p_partkey AS a_id, b.p_partkey AS b_id, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2
    FROM p a JOIN p b ON b.p_partkey % 4 <> 0 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 36 WHERE a.p_partkey % 4 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY d2, b_id) AS rank FROM m)
    SELECT a_id, b_id, d2, rank FROM k WHERE rank <= 5""")
def jn7_whole(spark, d):
    """jn7 with every row of part on one of the sides."""
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("long").alias("x"), (F.floor("p_retailprice") % 60).alias("y"))
    a = p.where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = p.where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return J.knn_band_join(a, b, [], 5, 6)


@query("jn9_one_to_one_match", sql("""WITH k AS (SELECT g.stream_id, g.target_id AS e_id, t.t_us AS t, t.event_id AS o_id, row_number() OVER (PARTITION BY g.stream_id, g.target_id ORDER BY t.t_us, t.event_id) AS n
    FROM v_targets g LEFT JOIN v_triggers t ON g.stream_id = t.stream_id AND t.t_us BETWEEN g.s_us AND g.e_us + 43200000000) SELECT stream_id, e_id, t, o_id FROM k WHERE n = 1""", "v_targets", "v_triggers"))
def jn9(spark, d):
    g = v_targets(spark, d).select("stream_id", F.col("target_id").alias("e_id"), F.col("s_us").alias("a"), F.col("e_us").alias("b"))
    o = triggers(spark, d).select("stream_id", F.col("t_us").alias("t"), F.col("event_id").alias("o_id"))
    return J.one_to_one_match(g, o, "stream_id", 0, 43_200_000_000)


@query("jn10_seq_join", "SELECT count_if(o.s IS NULL) AS missing, count_if(o.s = a.o_orderstatus) AS same, count_if(o.s <> a.o_orderstatus) AS changed FROM orders a LEFT JOIN (SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_custkey % 11 > 0) o ON a.o_orderkey = o.o_orderkey")
def jn10(spark, d):
    o = table(spark, d, "orders")
    other = o.where("o_custkey % 11 > 0").select("o_orderkey", F.when(F.col("o_custkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")).alias("s"))
    return J.seq_join(o, other, "o_orderkey", "o_orderstatus", "s")


@query("jn11_ban_touching", sql("SELECT file_id, span_id FROM v_spans s WHERE kind = 'purchase' AND NOT EXISTS (SELECT 1 FROM v_spans b WHERE b.kind = 'error' AND b.file_id = s.file_id AND least(s.e_ms, b.e_ms + 300000) - greatest(s.s_ms, b.s_ms - 300000) > 0)", "v_spans"))
def jn11(spark, d):
    s = v_spans(spark, d)
    a = s.where("kind = 'purchase'").select("file_id", "span_id", F.col("s_ms").alias("s"), F.col("e_ms").alias("e"))
    b = s.where("kind = 'error'").select("file_id", F.col("s_ms").alias("b0"), F.col("e_ms").alias("b1"))
    return J.ban_touching(a, b, ["file_id"], 300_000, 3_600_000).select("file_id", "span_id")


@query("jn12_lineage_split", """SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 'train' WHEN o_orderkey % 3 = 1 THEN 'test' END, CASE WHEN l_suppkey % 2 = 0 THEN 'validation' END) AS split FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def jn12(spark, d):
    o = table(spark, d, "orders").where("o_orderkey % 3 < 2").select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 3 == 0, "train").otherwise("test").alias("split"))
    s = table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("key"), F.lit("validation").alias("split"))
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return J.lineage_split(items, [(o, "l_orderkey"), (s, "l_suppkey")]).drop("l_suppkey")
