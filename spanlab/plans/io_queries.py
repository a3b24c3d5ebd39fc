"""Queries of sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlab.plans.registry import query
from spanlab.plans.views import table
from spanlab.sources import tables as S
from spanlab.sources.shared import fresh_path, settled


@query("src1_repeated_keys", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def src1(spark, d):
    """The line items as tab-separated text, read with a schema and required columns."""
    path = fresh_path(spark, "lines")
    table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag").write.option("sep", "\t").option("header", True).csv(path)
    items = S.read_table(spark, path, "l_orderkey long, l_linenumber int, l_returnflag string", ["l_orderkey", "l_linenumber"], sep="\t")
    return S.repeated_keys(items, "l_orderkey")


@query("src2_json_lines", "SELECT event_id, regexp_extract(props, '[0-9]+')::BIGINT AS k FROM events")
def src2(spark, d):
    """The events as lines of JSON, read with a schema."""
    path = fresh_path(spark, "json")
    table(spark, d, "events").select("event_id", F.from_json("props", "k long").alias("props")).write.json(path)
    return S.read_json_lines(spark, path, "event_id long, props struct<k:long>").select("event_id", "props.k")


@query("src3_parquet_batches", "SELECT p_partkey, 'part' AS split FROM part")
def src3(spark, d):
    return S.read_parquet_batches(spark, f"{d}/part.parquet", r"^(part)").select("p_partkey", "split")


@query("src4_scan_new_files", "SELECT 'p_size=' || p_size AS category, CASE WHEN p_size % 3 = 0 THEN 'third' END AS label, 1::BIGINT AS files FROM (SELECT DISTINCT p_size FROM part) WHERE p_size % 2 = 1")
def src4(spark, d):
    """Files of part, one folder a size: the manifest knows those of even sizes, and a lost file of every third size."""
    root = fresh_path(spark, "scan")
    S.write_partitioned(table(spark, d, "part").select("p_partkey", "p_size"), root, ["p_size"])
    size = F.regexp_extract("category", "([0-9]+)$", 1).cast("int")
    nothing = spark.createDataFrame([], "filepath string, category string, label string")
    there = S.scan_new_files(spark, root, nothing, "part-", ["parquet"]).select(F.col("path").alias("filepath"), "category", F.when(size % 3 == 0, "third").otherwise("even").alias("label"))
    known = there.where(size % 2 == 0).unionByName(there.where(size % 3 == 0).withColumn("filepath", F.lit("gone/part-lost.parquet")))
    return S.scan_new_files(spark, root, known, "part-", ["parquet"]).groupBy("category", "label").agg(F.count("*").alias("files"))


@query("snk1_write_partitioned", "SELECT o_orderstatus, count(*) AS n, sum(o_orderkey)::BIGINT AS keys, count(DISTINCT o_orderstatus) AS folders FROM orders GROUP BY 1")
def snk1(spark, d):
    path = fresh_path(spark, "partitioned")
    S.write_partitioned(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), path, ["o_orderstatus"])
    folder = F.regexp_extract("_metadata.file_path", "o_orderstatus=([^/]*)/", 1)
    back = spark.read.parquet(path).select("o_orderstatus", "o_orderkey", folder.alias("folder"))
    return back.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"), F.count_distinct("folder").alias("folders"))


@query("src5_file_fingerprint", "SELECT doc_id AS path, sha256(text) AS sha256, doc_id % 9 > 0 AS unchanged FROM documents")
def src5(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("text").cast("binary").alias("content"))
    frozen = docs.select("path", F.when(F.col("path") % 9 > 0, F.sha2("content", 256)).otherwise("0").alias("sha256"))
    return S.file_fingerprint(docs, frozen)


_LISTS = "(SELECT l_returnflag AS list_name, l_linestatus AS split, 'part/' || l_partkey AS path FROM lineitem)"


def _lists(spark, d):
    refs = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("list_name"), F.col("l_linestatus").alias("split"), F.concat(F.lit("part/"), "l_partkey").alias("path"))
    files = table(spark, d, "part").where("p_size > 25").select(F.concat(F.lit("part/"), "p_partkey").alias("path"))
    return refs, files


_GONE = "path NOT IN (SELECT 'part/' || p_partkey FROM part WHERE p_size > 25)"


@query("src6_missing_paths", f"SELECT list_name, count(*) AS missing, min(path) AS example FROM {_LISTS} WHERE {_GONE} AND NOT regexp_matches(path, '7$') GROUP BY 1")
def src6(spark, d):
    refs, files = _lists(spark, d)
    return S.missing_paths(refs, files, "7$")


@query("src7_filter_available", f"SELECT list_name, split, CASE WHEN regexp_matches(path, '0$') THEN 'round' WHEN regexp_matches(path, '1$') THEN 'one' ELSE 'other' END AS pattern, count(*) AS left_out FROM {_LISTS} WHERE {_GONE} GROUP BY 1, 2, 3 UNION ALL SELECT list_name, split, 'kept', count(*) FROM {_LISTS} WHERE NOT ({_GONE}) GROUP BY 1, 2")
def src7(spark, d):
    refs, files = _lists(spark, d)
    kept, out = S.filter_available(refs, files, {"round": "0$", "one": "1$"})
    return out.unionByName(kept.groupBy("list_name", "split").agg(F.count("*").alias("left_out")).withColumn("pattern", F.lit("kept")))


@query("snk2_append_rows", "WITH p AS (SELECT DISTINCT l_partkey, l_returnflag FROM lineitem WHERE l_returnflag IN ('R', 'A')) SELECT 'written' AS step, l_partkey FROM p GROUP BY l_partkey UNION ALL SELECT 'second', l_partkey FROM p WHERE l_returnflag = 'A' AND l_partkey NOT IN (SELECT l_partkey FROM p WHERE l_returnflag = 'R')")
def snk2(spark, d):
    """Parts of returned items are written, those of accepted ones appended, and both once more: what the second call added, and what stands there in the end."""
    path = fresh_path(spark, "appended")
    part = lambda flag: table(spark, d, "lineitem").where(F.col("l_returnflag") == flag).select("l_partkey")
    S.append_rows(part("R"), path, "l_partkey")
    before = settled(spark.read.parquet(path), "first")
    S.append_rows(part("A"), path, "l_partkey")
    S.append_rows(part("A").unionByName(part("R")), path, "l_partkey")
    written = spark.read.parquet(path)
    second = written.join(before, "l_partkey", "left_anti")
    return written.select(F.lit("written").alias("step"), "l_partkey").unionByName(second.select(F.lit("second").alias("step"), "l_partkey"))
