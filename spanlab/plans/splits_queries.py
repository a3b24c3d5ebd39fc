"""Queries of the splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlab.operators import splits as P
from spanlab.plans.registry import query
from spanlab.plans.views import sql, table

_M = "(('0x' || md5({x}::VARCHAR))::UHUGEINT % 100)::BIGINT"


@query("sp1_split_by_hash", f"SELECT doc_id, CASE WHEN source = 'src3' THEN 'train' WHEN m < 80 THEN 'train' WHEN m < 90 THEN 'validation' ELSE 'test' END AS split FROM (SELECT *, {_M.format(x='doc_id')} AS m FROM documents)")
def sp1(spark, d):
    return table(spark, d, "documents").select("doc_id", P.split_by_hash(F.col("doc_id"), forced=F.col("source") == "src3").alias("split"))


@query("sp2_split_by_rule", "SELECT event_id, CASE WHEN user_id <> 3 THEN 'train' WHEN strftime(ts, '%H:%M') BETWEEN '09:00' AND '17:30' THEN 'test' ELSE 'validation' END AS split FROM events")
def sp2(spark, d):
    return table(spark, d, "events").select("event_id", P.split_by_rule(F.col("user_id"), F.date_format("ts", "HH:mm"), 3, "09:00", "17:30").alias("split"))


@query("sp3_split_balanced", """WITH g AS (SELECT l_returnflag, l_orderkey, sum(l_quantity::BIGINT)::BIGINT AS w FROM lineitem GROUP BY 1, 2),
    s AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY l_returnflag ORDER BY substr(sha256('7|' || l_orderkey), 1, 16), l_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(w) OVER (PARTITION BY l_returnflag)::DOUBLE AS share FROM g)
    SELECT l_returnflag, l_orderkey, w, CASE WHEN share < 0.8 THEN 'train' WHEN share < 0.9 THEN 'validation' ELSE 'test' END AS split FROM s""")
def sp3(spark, d):
    items = table(spark, d, "lineitem").select("l_returnflag", "l_orderkey", F.col("l_quantity").cast("long").alias("w"))
    return P.split_balanced(items, "l_orderkey", "l_returnflag", "w", seed=7)


@query("sp4_split_greedy_deficit")
def sp4(spark, d):
    return P.split_greedy_deficit(table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", "l_quantity"), "l_suppkey", "l_returnflag", "l_quantity", seed=7)


@query("sp5_extend_split")
def sp5(spark, d):
    items = table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", "l_quantity")
    frozen = items.where("l_suppkey % 3 = 0").select("l_suppkey").distinct().select("l_suppkey", P.split_by_hash(F.col("l_suppkey")).alias("split"))
    return P.extend_split(items, frozen, "l_suppkey", "l_returnflag", "l_quantity", seed=7)


@query("sp6_pin_largest", "WITH g AS (SELECT source, sum(n_chars) AS w, row_number() OVER (ORDER BY sum(n_chars) DESC, source) AS n FROM documents WHERE lang = 'en' GROUP BY 1) SELECT source, CASE n WHEN 1 THEN 'test' WHEN 2 THEN 'validation' ELSE 'train' END AS split FROM g")
def sp6(spark, d):
    return P.pin_largest(table(spark, d, "documents"), "source", "n_chars", F.col("lang") == "en")


@query("sp7_inherit_split", "SELECT l_orderkey, l_linenumber, CASE WHEN o_custkey % 10 < 8 THEN 'train' ELSE 'test' END AS split FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def sp7(spark, d):
    parent = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 10 < 8, "train").otherwise("test").alias("split"))
    return P.inherit_split(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), parent, "l_orderkey", "o_orderkey")


@query("sp8_merge_lists", """WITH m AS (SELECT d.doc_id, CASE WHEN d.source IN ('src4', 'src9') THEN 'evaluation_speaker' WHEN t.text IS NOT NULL THEN 'already_in_train' WHEN l.doc_id IS NOT NULL THEN 'own_test' END AS reason FROM documents d
    LEFT JOIN (SELECT DISTINCT text FROM documents WHERE doc_id % 2 = 0) t ON d.text = t.text LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) l ON d.doc_id = l.doc_id WHERE d.doc_id % 2 = 1)
    SELECT doc_id, coalesce(reason, 'kept') AS reason FROM m UNION ALL SELECT doc_id, 'kept' FROM documents WHERE doc_id % 2 = 0""")
def sp8(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    base, more = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    speakers = spark.createDataFrame([("src4",), ("src9",)], "source string")
    rules = [("evaluation_speaker", speakers, ["source"]), ("already_in_train", base, ["text"]), ("own_test", table(spark, d, "labels").where("toxic = 1"), ["doc_id"])]
    kept, out = P.merge_lists(base, more, rules)
    return kept.select("doc_id", F.lit("kept").alias("reason")).unionByName(out.select("doc_id", "reason"))
