"""Findings of round 3, each with a case that failed before."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlab.operators import diagnostics, metrics, spans, wordings
from spanlab.plans import registry
from spanlab.streaming import streams
from tests.oracle import plain


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_distances_side_by_side():
    """a text's distances to many wordings in one walk over its letters, some longer than a machine word, some letters in no wording."""
    rng = random.Random(1)
    said = lambda n, letters="abé😀 ": "".join(rng.choice(letters) for _ in range(n))
    refs = list({said(rng.randint(1, 150)) for _ in range(70)})
    far, block = wordings.distances(refs), wordings.Wordings([*refs, ""])
    for text in ("", "z", said(1), said(64), said(65), said(200, "abz "), refs[0]):
        want = [distance(text, r) for r in refs]
        assert far(text).tolist() == want
        assert block.best(text) == min([(d / max(len(text), len(r)), r) for d, r in zip(want, refs)] + [(float(text != ""), "")])


@pytest.mark.parametrize("block", [3, 512])
def test_nearest_of_few_long_wordings(spark, monkeypatch, block):
    """long texts, in several blocks and lots or in one."""
    monkeypatch.setattr(wordings, "BLOCK", block)
    monkeypatch.setattr(wordings, "TEXTS", 4)
    rng = random.Random(2)
    said = lambda n: " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 7))) for _ in range(n))
    refs = [said(30) for _ in range(11)]
    texts = [said(rng.randint(0, 60)) for _ in range(20)] + [refs[0], refs[0] + " a", ""]
    got = {r["id"]: r for r in wordings.nearest_reference(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), spark.createDataFrame([(r,) for r in refs], "ref string")).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert (got[i]["ratio"], got[i]["nearest"]) == min((distance(t, r) / max(len(t), len(r)), r) for r in refs)
    none = wordings.nearest_reference(spark.createDataFrame([(1, "a")], "id int, text string"), spark.createDataFrame([], "ref string")).first()
    assert none["nearest"] is None and none["reason"] == "too_far"


def test_large_groups_weigh_what_the_sql_says(spark, tmp_path):
    """a group of more than 10,000 rows beside a small one, and rows without a source: draws as in the SQL."""
    rows = spark.range(10_400).select(
        F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.when(F.col("id") % 900 == 0, "fr").otherwise("en").alias("lang"), F.when(F.col("id") < 10_250, "big").when(F.col("id") < 10_380, "small").alias("source"), F.lit(1).alias("n_chars")
    )
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for query in ("sm2_bucket_quota_sample", "sm9_epoch_report"):
        found = con.execute(registry.ORACLE_SQL[query])
        names = [c[0] for c in found.description]
        want = sorted(tuple(map(plain, r)) for r in found.fetchall())
        got = sorted(tuple(map(plain, r)) for r in registry.QUERIES[query](spark, str(tmp_path)).select(*names).collect())
        assert got == want and got


def test_streams_share_the_state_of_their_lot(spark, tmp_path, monkeypatch):
    """hundreds of streams in a few lots: calls of the state store grow with lots, not with streams; windows and captures as one by one."""
    monkeypatch.setattr(streams, "LOTS", 4)
    rng = random.Random(4)
    rows = sorted((1_000_000_000 + rng.randrange(4 * 10**9), f"s{k}", rng.random()) for k in range(400) for _ in range(6)) + [(90 * 10**9, "z", 0.0)]
    schema = "t_us long, k string, value double"
    for n in range(0, len(rows), 900):
        spark.createDataFrame(rows[n : n + 900], schema).withColumn("ts", F.timestamp_micros("t_us")).coalesce(1).write.parquet(f"{tmp_path}/in/{n:06}")
    stream = lambda: spark.readStream.schema(f"{schema}, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    told = lambda df: sorted((r["k"], r["w_start"], r["w_end"], r["n"], round(r["mean_value"], 9), r["max_value"]) for r in df.collect())
    ran, args = [], ("k", "ts", "20 minutes", "10 minutes", "value")
    got = told(streams.run_to_table(streams.sliding_windows(stream(), *args), "lots", query=ran))
    whole = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_micros("t_us"))
    assert got == told(streams.sliding_windows(whole, *args)) and len(got) > 400
    marks = stream().select(F.col("k").alias("stream_id"), "ts", "t_us", F.col("value").alias("score"), F.lit(1).cast("long").alias("event_id"))
    hits = streams.run_to_table(streams.stream_triggers(marks, "stream_id", "ts", 0.5, 0, 1, 1), "lots", query=ran).collect()
    assert sorted((r["stream_id"], r["t_us"]) for r in hits) == sorted((k, t) for t, k, v in rows if v >= 0.5)
    for q in ran:
        assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= 6 * 5


def test_verdict_measures_in_a_band(spark):
    """F8: verdicts by a distance in a band, and none where the target begins so; what is not there is neither complete nor cut off."""
    long = "the word " * 40
    rows = [("abcd", "abcd"), ("abcd", "abc"), ("abcd", "ab"), ("abcd", "xbcd"), ("abcd", "xycd"), ("abcd", ""), ("", ""), ("", "a"), (long, long[:300]), (long, long[:100]), (long, "x" + long), (long, "x" * 360), (None, None), ("abc", None)]
    v = spans.transcript_verdict(F.col("target"), F.col("heard"), F.lit(1.0), F.lit(2.0))
    df = spark.createDataFrame(rows, "target string, heard string").select("target", "heard", v.alias("v"))
    for r in df.collect():
        if r["target"] is None or r["heard"] is None:
            assert r["v"] == "other"
            continue
        near = distance(r["heard"], r["target"]) / max(len(r["heard"]), len(r["target"]), 1) <= 0.25
        cut = r["target"].startswith(r["heard"]) and len(r["heard"]) < len(r["target"])
        assert r["v"] == ("empty" if r["heard"] == "" else "complete" if near else "cut_off" if cut else "other")


def test_rates_need_no_order_of_scores(spark):
    """counts, mean and maximum come from sums by the columns; the exact high quantile is there for those who ask."""
    plan = registry.QUERIES["me5_rate_table"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
    df = spark.createDataFrame([(g, s, v) for g in "ab" for s in (0, 1) for v in (1.0, 2.0, 4.0, None)] + [("c", 0, None), (None, 1, 7.0)], "g string, s int, v double")
    with_p, without = (metrics.rate_table(df, ["g", "s"], F.col("v") > 1, "v", p99=p) for p in (True, False))
    assert sorted(map(repr, with_p.drop("p99").collect())) == sorted(map(repr, without.collect()))
    got = {(r["g"], r["s"], r["by_g"], r["by_s"]): r for r in with_p.collect()}
    assert len(got) == 4 + 2 + 4 + 2 and got["a", None, 1, 0]["n"] == 8 and got["a", None, 1, 0]["k"] == 4 and abs(got["a", None, 1, 0]["mean_score"] - 7 / 3) < 1e-12
    assert got["c", 0, 1, 1]["mean_score"] is None and got[None, 1, 0, 1]["max_score"] == 7.0 and abs(got["a", 0, 1, 1]["p99"] - 3.96) < 1e-9


def test_projections_deal_a_row_once_to_a_part(spark, monkeypatch):
    """the same rows and counts whether a row goes once to each part of the references or to each of its codes; the query takes the first way."""
    rng = np.random.default_rng(3)
    rows = [(k, i, rng.normal(size=6).tolist()) for i, k in enumerate(["x"] * 40 + ["y"] * 9 + ["none", None])] + [("x", 90, [0.0] * 6)]
    refs = [(k, i, rng.normal(size=6).tolist()) for i, k in enumerate(["x"] * 70 + ["y"] * 3 + [None])] + [("x", 99, rows[0][2]), ("x", 98, rows[0][2])]
    schema = "k string, id long, v array<double>"
    told = {}
    for part, few, products in ((1, 2048, 1 << 22), (65_536, 2048, 1 << 22), (11, 5, 16)):
        for name, value in (("PART", part), ("FEW", few), ("PRODUCTS", products)):
            monkeypatch.setattr(diagnostics, name, value)
        out = diagnostics.near_duplicate_lsh(spark.createDataFrame(rows, schema), spark.createDataFrame(refs, schema), "k", "id", "v", bits=4, tables=5, probes=2)
        assert ("codes" in out._jdf.queryExecution().optimizedPlan().toString()) == (part == 1)
        told[part] = sorted((r["id"], r["compared"], None if r["max_similarity"] is None else round(r["max_similarity"], 12)) for r in out.collect())
    assert told[1] == told[65_536] == told[11] and len(told[1]) == len(rows)
