"""Queries of the guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlab.operators import checks as C
from spanlab.operators.splits import split_by_hash
from spanlab.plans.registry import query
from spanlab.plans.splits_queries import _M
from spanlab.plans.views import sql, table, v_clips, v_spans
from spanlab.sources.shared import fresh_path

_SPLIT = f"CASE WHEN {_M.format(x='doc_id')} < 80 THEN 'train' WHEN {_M.format(x='doc_id')} < 90 THEN 'validation' ELSE 'test' END"
_LEAK = "s AS (SELECT *, " + _SPLIT + " AS split FROM v_clips)"


def _split_clips(spark, d):
    return v_clips(spark, d).withColumn("split", split_by_hash(F.col("doc_id")))


@query("gd1_assert_no_leakage", sql(f"""WITH {_LEAK}, k AS (SELECT 'recording_id' AS rule, recording_id AS value, split FROM s UNION ALL SELECT 'filepath', filepath, split FROM s UNION ALL SELECT 'speaker', speaker, split FROM s), g AS (SELECT rule, value, count(DISTINCT split) AS n FROM k GROUP BY 1, 2)
    SELECT rule, count_if(n > 1) AS violations, min(CASE WHEN n > 1 THEN value END) AS example FROM g GROUP BY 1 UNION ALL SELECT 'parent', count(*), min(c.filepath) FROM s c JOIN s p ON c.parent_filepath = p.filepath AND c.split <> p.split""", "v_clips"))
def gd1(spark, d):
    s = _split_clips(spark, d)
    family = C.parent_child_leakage(s, "filepath", "parent_filepath").agg(F.count("*").alias("violations"), F.min("filepath").alias("example")).withColumn("rule", F.lit("parent"))
    return C.leakage(s, ["recording_id", "filepath", "speaker"]).unionByName(family)


@query("gd2_split_guard", sql(f"""WITH {_LEAK}, f AS (SELECT DISTINCT speaker, CASE WHEN speaker IN ('src1', 'src2') THEN 'test' ELSE 'train' END AS frozen FROM v_clips WHERE speaker <> 'src7'), j AS (SELECT s.*, f.frozen FROM s LEFT JOIN f ON s.speaker = f.speaker)
    SELECT 'unknown_group' AS rule, count_if(frozen IS NULL) AS violations, min(CASE WHEN frozen IS NULL THEN speaker END) AS example FROM j UNION ALL SELECT 'split_changed', count_if(frozen IS NOT NULL AND split <> frozen), min(CASE WHEN frozen IS NOT NULL AND split <> frozen THEN speaker END) FROM j
    UNION ALL SELECT 'too_short', count_if(weight < 50), min(CASE WHEN weight < 50 THEN speaker END) FROM j UNION ALL SELECT 'derived_in_test', count_if(split = 'test' AND parent_filepath IS NOT NULL), min(CASE WHEN split = 'test' AND parent_filepath IS NOT NULL THEN speaker END) FROM j""", "v_clips"))
def gd2(spark, d):
    s = _split_clips(spark, d)
    frozen = s.where("speaker <> 'src7'").select("speaker").distinct().withColumn("split", F.when(F.col("speaker").isin("src1", "src2"), "test").otherwise("train"))
    return C.split_guard(s, frozen, "speaker", "split", {"too_short": F.col("weight") >= 50, "derived_in_test": (F.col("split") != "test") | F.col("parent_filepath").isNull()})


_N = "trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' ')"


@query("gd3_text_novelty", f"SELECT doc_id, CASE WHEN k THEN 'known_text' ELSE 'holds_phrase' END AS problem FROM (SELECT doc_id, n IN (SELECT {_N.format(x='text')} FROM documents WHERE doc_id % 2 = 0) AS k, n FROM (SELECT doc_id, {_N.format(x='text')} AS n FROM documents WHERE doc_id % 2 = 1)) WHERE k OR contains(' ' || n || ' ', ' all rights reserved ')")
def gd3(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return C.text_novelty(docs.where("doc_id % 2 = 1"), docs.where("doc_id % 2 = 0"), "text", "All rights reserved").select("doc_id", "problem")


@query("gd4_verify_frozen", "SELECT step, outcome, n FROM (SELECT count(*) AS n FROM orders), (VALUES ('first', 'frozen'), ('again', 'verified'), ('changed', 'refused'), ('moved', 'refused')) v(step, outcome)")
def gd4(spark, d):
    """Orders are frozen, dealt anew, changed in one row, and changed by a text that moves to the next column."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    path, first = fresh_path(spark, "frozen"), F.col("o_orderkey") == orders.agg(F.min("o_orderkey")).first()[0]
    changed = orders.withColumn("o_orderstatus", F.when(first, "X").otherwise(F.col("o_orderstatus")))
    moved = orders.withColumns({"o_orderstatus": F.when(first, F.concat("o_orderstatus", F.lit("|"), "o_orderpriority")).otherwise(F.col("o_orderstatus")), "o_orderpriority": F.when(first, "").otherwise(F.col("o_orderpriority"))})
    told = []
    for step, rows in (("first", orders), ("again", orders.repartition(5, "o_orderpriority")), ("changed", changed), ("moved", moved)):
        try:
            told.append((step, C.verify_frozen(rows, ["o_orderkey", "o_orderstatus", "o_orderpriority"], path)))
        except ValueError:
            told.append((step, "refused"))
    return orders.agg(F.count("*").alias("n")).crossJoin(F.broadcast(spark.createDataFrame(told, "step string, outcome string"))).select("step", "outcome", "n")


@query("gd5_verify_set", """WITH s AS (SELECT doc_id % 900 AS stream_id, doc_id AS path, sha256(text || CASE WHEN doc_id % 50 = 0 THEN 'x' ELSE '' END) AS h FROM documents), f AS (SELECT doc_id AS path, sha256(text) AS found FROM documents WHERE doc_id % 33 > 0), t AS (SELECT DISTINCT doc_id AS path FROM labels WHERE quality = 0)
    SELECT stream_id, CASE WHEN found IS NULL THEN 'missing_file' ELSE 'hash_differs' END AS problem FROM s LEFT JOIN f USING (path) WHERE found IS NULL OR found <> h UNION ALL SELECT stream_id, 'seen_in_training' FROM s JOIN t USING (path) UNION ALL SELECT stream_id, 'repeated_id' FROM s GROUP BY stream_id HAVING count(*) > 1""")
def gd5(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("path"), "text")
    streams = docs.select((F.col("path") % 900).alias("stream_id"), "path", F.sha2(F.concat("text", F.when(F.col("path") % 50 == 0, "x").otherwise("")), 256).alias("sha256"))
    files = docs.where("path % 33 > 0").select("path", F.sha2("text", 256).alias("sha256"))
    return C.verify_set(streams, files, table(spark, d, "labels").where("quality = 0").select(F.col("doc_id").alias("path")))


@query("gd6_run_checks", sql("""WITH b AS (SELECT 'span_has_length' AS check_name, span_id AS id, 'ends at ' || e_ms AS detail FROM v_spans WHERE e_ms <= s_ms UNION ALL SELECT 'span_inside_day', span_id, 'ends at ' || e_ms FROM v_spans WHERE e_ms > 86400000 UNION ALL SELECT 'discount_in_range', l_orderkey, 'line ' || l_linenumber FROM lineitem WHERE l_discount NOT BETWEEN 0 AND 0.09
    UNION ALL SELECT 'quantity_is_small', l_orderkey, 'quantity ' || l_quantity::BIGINT FROM lineitem WHERE l_quantity > 49 UNION ALL SELECT 'order_exists', l_orderkey, 'no order' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)), n AS (SELECT unnest(['span_has_length', 'span_inside_day', 'discount_in_range', 'quantity_is_small', 'order_exists']) AS check_name),
    i AS (SELECT check_name, id, min(detail) AS detail, row_number() OVER (PARTITION BY check_name ORDER BY id) AS k FROM b GROUP BY 1, 2), e AS (SELECT check_name, string_agg(id::VARCHAR, ',' ORDER BY k) AS examples, min(CASE WHEN k = 1 THEN detail END) AS detail FROM i WHERE k <= 5 GROUP BY 1)
    SELECT n.check_name, CASE WHEN count(id) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, count(id) AS violations, any_value(e.detail) AS detail, any_value(e.examples) AS examples FROM n LEFT JOIN b ON n.check_name = b.check_name LEFT JOIN e ON n.check_name = e.check_name GROUP BY 1""", "v_spans"))
def gd6(spark, d):
    s, items = v_spans(spark, d), table(spark, d, "lineitem")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    ends = F.concat(F.lit("ends at "), F.col("e_ms"))
    return C.run_checks([
        C.Check("span_has_length", s, F.col("e_ms") <= F.col("s_ms"), "span_id", ends), C.Check("span_inside_day", s, F.col("e_ms") > 86_400_000, "span_id", ends),
        C.Check("discount_in_range", items, ~F.col("l_discount").between(0, 0.09), "l_orderkey", F.concat(F.lit("line "), F.col("l_linenumber"))),
        C.Check("quantity_is_small", items, F.col("l_quantity") > 49, "l_orderkey", F.concat(F.lit("quantity "), F.col("l_quantity").cast("long"))),
        C.Check("order_exists", items.join(orders, "l_orderkey", "left_anti"), F.lit(True), "l_orderkey", F.lit("no order")),
    ])


@query("gd7_config_consistency", "SELECT 'p50' AS item, quantile_cont(l_quantity, 0.5) AS measured, 25.0::DOUBLE AS given, abs(quantile_cont(l_quantity, 0.5) - 25) <= 1 AS ok FROM lineitem UNION ALL SELECT 'gain', min(l_quantity), 40.0::DOUBLE, 40 BETWEEN min(l_quantity) AND max(l_quantity) FROM lineitem")
def gd7(spark, d):
    from spanlab.operators.aggregates import quantile_summary

    m = quantile_summary(table(spark, d, "lineitem").withColumn("__one", F.lit(1)), ["__one"], "l_quantity")
    return C.config_consistency(m, {"p50": 25.0}, {"gain": ("min", "max", 40.0)}, 1.0)
