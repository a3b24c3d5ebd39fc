"""Queries of projections, hashes and small functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlab.functions import keys as K
from spanlab.plans.registry import query
from spanlab.plans.views import sql, table, v_clips

_KINDS = {"purchase": "target", "click": "touch", "view": "touch", "error": "distractor", "signup": "target", "search": "touch", "login": "touch", "logout": "touch"}
_KIND_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _KINDS.items())


@query("prj1_map_category", f"SELECT event_id, CASE event_type {_KIND_SQL} END AS category FROM events")
def prj1(spark, d):
    return K.map_category(table(spark, d, "events").select("event_id", "event_type"), "event_type", _KINDS, "category").drop("event_type")


@query("prj2_derive_source_group", sql("SELECT c.doc_id, coalesce(p.recording_id, c.recording_id) AS source_group FROM v_clips c LEFT JOIN v_clips p ON c.parent_filepath = p.filepath", "v_clips"))
def prj2(spark, d):
    return K.derive_source_group(v_clips(spark, d)).select("doc_id", "source_group")


@query("prj3_case_map", sql("SELECT doc_id, CASE WHEN parent_filepath IS NOT NULL THEN 'derived' WHEN speaker IN ('src0', 'src1') THEN 'owner' WHEN category = 'en' THEN 'native' ELSE 'external' END AS provenance FROM v_clips", "v_clips"))
def prj3(spark, d):
    rules = [(F.col("parent_filepath").isNotNull(), "derived"), (F.col("speaker").isin("src0", "src1"), "owner"), (F.col("category") == "en", "native")]
    return v_clips(spark, d).select("doc_id", K.case_map(rules, "external").alias("provenance"))


@query("prj4_bucketize", "SELECT l_orderkey, l_linenumber, CASE WHEN q IS NULL THEN 'unknown' WHEN q < 10 THEN '<10' WHEN q < 18 THEN '<18' ELSE '>=18' END AS bucket FROM (SELECT *, CASE WHEN l_linenumber < 7 THEN l_quantity END AS q FROM lineitem)")
def prj4(spark, d):
    q = F.when(F.col("l_linenumber") < 7, F.col("l_quantity"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", K.bucketize(q, [10, 18], "unknown").alias("bucket"))


@query("prj5_select_bank", sql("SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM (SELECT CASE WHEN NOT (category = 'en' AND doc_id % 10 < 8) THEN 'not_in_bank' WHEN weight < 100 THEN 'empty' END AS reason FROM v_clips) GROUP BY 1", "v_clips"))
def prj5(spark, d):
    kept, out = K.select_bank(v_clips(spark, d), (F.col("category") == "en") & (F.col("doc_id") % 10 < 8), F.col("weight") < 100)
    return kept.select(F.lit("kept").alias("reason")).unionByName(out.select("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("prj6_membership_kind", """WITH h AS (SELECT DISTINCT text AS k FROM benchmark), t AS (SELECT DISTINCT text AS k FROM documents WHERE doc_id % 7 = 0)
    SELECT doc_id, CASE WHEN h.k IS NOT NULL THEN 'held_out' WHEN t.k IS NOT NULL THEN 'trained' ELSE 'original' END AS kind FROM documents d LEFT JOIN h ON d.text = h.k LEFT JOIN t ON d.text = t.k""")
def prj6(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("k"))
    held = table(spark, d, "benchmark").select(F.col("text").alias("k")).distinct().withColumn("h", F.lit(True))
    trained = docs.where("doc_id % 7 = 0").select("k").distinct().withColumn("t", F.lit(True))
    return docs.join(held, "k", "left").join(trained, "k", "left").select("doc_id", F.when(F.col("h"), "held_out").when(F.col("t"), "trained").otherwise("original").alias("kind"))


@query("hsh1_stable_hash64", "SELECT l_orderkey, l_linenumber, substr(sha256(l_orderkey || '|' || l_linenumber), 1, 16) AS h FROM lineitem")
def hsh1(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", K.stable_hash64(F.col("l_orderkey"), F.col("l_linenumber")).alias("h"))


@query("hsh2_md5_mod", "SELECT doc_id, (('0x' || md5(doc_id::VARCHAR))::UHUGEINT % 100)::BIGINT AS bucket FROM documents")
def hsh2(spark, d):
    return table(spark, d, "documents").select("doc_id", K.md5_mod(F.col("doc_id"), 100).alias("bucket"))


_H60 = "('0x' || substr(sha256({x}), 1, 15))::BIGINT"


@query("hsh3_frame_fingerprint", f"SELECT count(*) AS n, sum(h % 1000000007)::BIGINT AS total, bit_xor(h) AS parity FROM (SELECT {_H60.format(x=chr(39).join(['o_orderkey || ', '|', ' || o_custkey || ', '|', ' || o_orderstatus']))} AS h FROM orders)")
def hsh3(spark, d):
    return K.frame_fingerprint(table(spark, d, "orders"), "o_orderkey", "o_custkey", "o_orderstatus")


@query("mth1_db", "SELECT l_orderkey, l_linenumber, round(20 * log10(l_quantity / 50 + 1e-9), 9) AS level FROM lineitem")
def mth1(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(K.db(F.col("l_quantity") / 50), 9).alias("level"))


@query("arr1_cosine", """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT a.vec_id, round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 9) AS cosine
    FROM e a JOIN e b ON b.vec_id = a.vec_id + 1""")
def arr1(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(after, "vec_id").select("vec_id", F.round(K.cosine(F.col("embedding"), F.col("other")), 9).alias("cosine"))


@query("jsn1_json_events", "SELECT event_id, regexp_extract(props, '[0-9]+')::BIGINT AS k FROM events")
def jsn1(spark, d):
    events = table(spark, d, "events").select("event_id", F.from_json(F.concat(F.lit("["), "props", F.lit("]")), "array<struct<k: long>>").alias("items"))
    return events.select("event_id", F.posexplode("items").alias("i", "item")).select("event_id", "item.k")
