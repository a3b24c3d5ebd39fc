"""The views that queries are built on, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MINUTE_MS, HALF_DAY_US = 60_000, 43_200_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a time without a zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ))")


def prop_k(props: str = "props") -> Column:
    return F.get_json_object(props, "$.k").cast("long")


def v_scores(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("stream_id"), micros("ts").alias("t_us"), F.col("value").alias("score"), "event_id")


def v_spans(spark, d) -> DataFrame:
    s = F.expr("pmod({m}, 86400000000) div 1000".format(m="timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))"))
    return table(spark, d, "events").select(
        F.col("user_id").alias("file_id"), F.col("event_id").alias("span_id"), F.col("event_type").alias("kind"), s.alias("s_ms"), (s + (prop_k() + 1) * MINUTE_MS).alias("e_ms")
    )


def v_clips(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("h", F.sha2("text", 256))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("first"))
    parent = F.when(F.col("first") < F.col("doc_id"), F.concat(F.lit("doc/"), F.col("first")))
    return docs.join(first, "h").select(
        "doc_id", F.concat(F.lit("doc/"), F.col("doc_id")).alias("filepath"), F.concat_ws("-", "source", (F.col("doc_id") % 50).cast("string")).alias("recording_id"),
        parent.alias("parent_filepath"), F.col("lang").alias("category"), F.col("source").alias("speaker"), F.col("n_chars").alias("weight"),
    )


def _truth(flag: str) -> Column:
    return F.when(F.col(flag) == "N", F.lit("unknown")).otherwise(F.col(flag))


def v_pred(spark, d) -> DataFrame:
    truth = _truth("l_returnflag")
    after = F.when(truth == "A", "R").when(truth == "R", "unknown").otherwise("A")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", truth.alias("truth"),
        F.when((31 * F.col("l_orderkey") + 17 * F.col("l_linenumber")) % 10 < 7, truth).otherwise(after).alias("pred"),
        ((7919 * F.col("l_partkey") + 104729 * F.col("l_suppkey")) % 10000 / 10000.0).alias("p"), F.col("l_linestatus").alias("grp"), "l_suppkey",
    )


def v_probs(spark, d) -> DataFrame:
    a = (31 * F.col("l_partkey") + 17 * F.col("l_orderkey")) % 1000 + 1
    r = (53 * F.col("l_suppkey") + 29 * F.col("l_orderkey")) % 1000 + 1
    u = (97 * F.col("l_partkey") + 13 * F.col("l_linenumber")) % 1000 + 1
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", _truth("l_returnflag").alias("truth"), F.col("l_linestatus").alias("grp"), a.alias("a"), r.alias("r"), u.alias("u"))
    total = F.col("a") + F.col("r") + F.col("u")
    return t.select("l_orderkey", "l_linenumber", "truth", "grp", (F.col("a") / total).alias("p_A"), (F.col("r") / total).alias("p_R"), (F.col("u") / total).alias("p_unknown"))


def v_policy(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").where("l_returnflag <> 'R'").select(
        F.concat("l_linestatus", F.lit("-"), F.floor(F.col("l_quantity") / 10).cast("string")).alias("category"), (F.col("l_suppkey") % 4).alias("subset"), F.col("l_extendedprice").alias("score")
    )


def v_targets_raw(spark, d) -> DataFrame:
    return table(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("target_id"), micros("ts").alias("s_us"), (micros("ts") + 1_800_000_000).alias("e_us"))


def v_targets(spark, d) -> DataFrame:
    w = W.partitionBy("stream_id").orderBy("s_us", "target_id")
    gap = F.col("s_us") - F.lag("s_us").over(w)
    return v_targets_raw(spark, d).withColumn("gap", gap).where(F.col("gap").isNull() | (F.col("gap") >= 13 * 3_600_000_000)).drop("gap")


def v_distractors(spark, d) -> DataFrame:
    return table(spark, d, "events").where("event_type = 'error'").select(F.col("user_id").alias("stream_id"), "event_id", micros("ts").alias("s_us"), (micros("ts") + (prop_k() + 1) * 60_000_000).alias("e_us"))


def v_streams(spark, d) -> DataFrame:
    users = table(spark, d, "events").select("user_id").distinct()
    condition = F.when(F.col("user_id") % 3 == 0, "quiet").when(F.col("user_id") % 3 == 1, "noise").otherwise("mixed")
    return users.select(F.col("user_id").alias("stream_id"), F.lit(30 * 86_400_000_000).alias("duration_us"), condition.alias("condition"), F.when(F.col("user_id") % 2 == 0, "A").otherwise("B").alias("set_name"))


_K = "regexp_extract(props, '[0-9]+')::BIGINT"
SQL = {
    "v_scores": "SELECT user_id AS stream_id, epoch_us(ts) AS t_us, value AS score, event_id FROM events",
    "v_spans": f"SELECT user_id AS file_id, event_id AS span_id, event_type AS kind, (epoch_us(ts) % 86400000000) // 1000 AS s_ms, (epoch_us(ts) % 86400000000) // 1000 + ({_K} + 1) * 60000 AS e_ms FROM events",
    "v_clips": """SELECT doc_id, 'doc/' || doc_id AS filepath, source || '-' || (doc_id % 50) AS recording_id,
        CASE WHEN min(doc_id) OVER (PARTITION BY text) < doc_id THEN 'doc/' || min(doc_id) OVER (PARTITION BY text) END AS parent_filepath,
        lang AS category, source AS speaker, n_chars AS weight FROM documents""",
    "v_pred": """SELECT l_orderkey, l_linenumber, truth, CASE WHEN (31 * l_orderkey + 17 * l_linenumber) % 10 < 7 THEN truth
        ELSE CASE truth WHEN 'A' THEN 'R' WHEN 'R' THEN 'unknown' ELSE 'A' END END AS pred, p, grp, l_suppkey
        FROM (SELECT *, CASE l_returnflag WHEN 'N' THEN 'unknown' ELSE l_returnflag END AS truth,
        ((7919 * l_partkey + 104729 * l_suppkey) % 10000) / 10000.0::DOUBLE AS p, l_linestatus AS grp FROM lineitem)""",
    "v_probs": """SELECT l_orderkey, l_linenumber, truth, grp, a / (a + r + u)::DOUBLE AS p_A, r / (a + r + u)::DOUBLE AS p_R, u / (a + r + u)::DOUBLE AS p_unknown FROM
        (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'N' THEN 'unknown' ELSE l_returnflag END AS truth, l_linestatus AS grp,
        (31 * l_partkey + 17 * l_orderkey) % 1000 + 1 AS a, (53 * l_suppkey + 29 * l_orderkey) % 1000 + 1 AS r, (97 * l_partkey + 13 * l_linenumber) % 1000 + 1 AS u FROM lineitem)""",
    "v_policy": "SELECT l_linestatus || '-' || floor(l_quantity / 10)::BIGINT AS category, l_suppkey % 4 AS subset, l_extendedprice AS score FROM lineitem WHERE l_returnflag <> 'R'",
    "v_targets_raw": "SELECT user_id AS stream_id, event_id AS target_id, epoch_us(ts) AS s_us, epoch_us(ts) + 1800000000 AS e_us FROM events WHERE event_type = 'purchase'",
    "v_targets": """SELECT stream_id, target_id, s_us, e_us FROM (SELECT *, s_us - lag(s_us) OVER (PARTITION BY stream_id ORDER BY s_us, target_id) AS gap FROM v_targets_raw)
        WHERE gap IS NULL OR gap >= 46800000000""",
    "v_distractors": f"SELECT user_id AS stream_id, event_id, epoch_us(ts) AS s_us, epoch_us(ts) + ({_K} + 1) * 60000000 AS e_us FROM events WHERE event_type = 'error'",
    "v_streams": """SELECT DISTINCT user_id AS stream_id, 2592000000000 AS duration_us, CASE user_id % 3 WHEN 0 THEN 'quiet' WHEN 1 THEN 'noise' ELSE 'mixed' END AS condition,
        CASE user_id % 2 WHEN 0 THEN 'A' ELSE 'B' END AS set_name FROM events""",
    # Triggers: 2 of 3 scores at 60 or above, then 12 hours without a further one.
    "v_flags": """SELECT *, sum((score >= 60)::INT) OVER (PARTITION BY stream_id ORDER BY t_us, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS above FROM v_scores""",
    "v_cands": "SELECT stream_id, t_us, score, event_id, row_number() OVER (PARTITION BY stream_id ORDER BY t_us, event_id) AS n FROM v_flags WHERE score >= 60 AND above >= 2",
    "v_walk": """SELECT stream_id, n, t_us, score, event_id, t_us AS last, true AS hit FROM v_cands WHERE n = 1 UNION ALL
        SELECT c.stream_id, c.n, c.t_us, c.score, c.event_id, CASE WHEN c.t_us - w.last >= 43200000000 THEN c.t_us ELSE w.last END, c.t_us - w.last >= 43200000000
        FROM v_walk w JOIN v_cands c ON c.stream_id = w.stream_id AND c.n = w.n + 1""",
    "v_triggers": "SELECT stream_id, t_us, score, event_id FROM v_walk WHERE hit",
}
_NEEDS = {"v_targets": ["v_targets_raw"], "v_flags": ["v_scores"], "v_cands": ["v_flags"], "v_walk": ["v_cands"], "v_triggers": ["v_walk"]}


def sql(body: str, *views: str) -> str:
    """``body`` under the definitions of ``views``. A body may begin with further ``name AS (...)`` parts ending in a line ``SELECT``."""
    order: list[str] = []

    def need(v: str) -> None:
        for x in _NEEDS.get(v, []):
            need(x)
        if v not in order:
            order.append(v)

    for v in views:
        need(v)
    if not order:
        return body
    head = "WITH RECURSIVE " if "v_walk" in order else "WITH "
    told = ",\n".join(f"{v} AS ({SQL[v]})" for v in order)
    body = body.strip()
    return head + told + (",\n" + body[5:] if body.upper().startswith("WITH ") else "\n" + body)
