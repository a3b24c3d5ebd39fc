"""Queries of array signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlab.operators import signals as G
from spanlab.operators.aggregates import bin_moments
from spanlab.plans.registry import query
from spanlab.plans.views import table

_LEVELS = "(SELECT vec_id, embedding::DOUBLE[] AS v, list_transform(range(0, 8), lambda i: round(20 * log10(sqrt(list_sum(list_transform(embedding[i * 8 + 1:i * 8 + 8], lambda x: x::DOUBLE * x::DOUBLE)) / 8) + 1e-6), 6)) AS l FROM embeddings)"


def levels(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding", G.frame_levels(F.col("embedding"), 8).alias("l"))
    return e.withColumn("l", F.transform("l", lambda x: F.round(x, 6)))


@query("sg1_frame_levels", f"SELECT vec_id, i::INT AS frame, l[i + 1] AS level FROM {_LEVELS}, range(0, 8) t(i)")
def sg1(spark, d):
    return levels(spark, d).select("vec_id", F.posexplode("l").alias("frame", "level"))


@query("sg2_level_stats", f"SELECT vec_id, round(quantile_cont(x, 0.98), 4) AS peak, round(quantile_cont(x, 0.2), 4) AS floor, len(list_filter(any_value(v), lambda y: abs(y) >= 0.3)) / 64.0::DOUBLE AS clipped, len(list_filter(any_value(v), lambda y: y <> 0)) / 64.0::DOUBLE AS non_zero FROM (SELECT vec_id, v, unnest(l) AS x FROM {_LEVELS}) GROUP BY 1")
def sg2(spark, d):
    s = G.level_stats(levels(spark, d), ["vec_id"], "l", "embedding")
    return s.select("vec_id", F.round("peak", 4).alias("peak"), F.round("floor", 4).alias("floor"), "clipped", "non_zero")


_ON = "list_filter(range(0, 8), lambda i: l[i + 1] > list_max(l) - 6)"


@query("sg3_energy_trim", f"SELECT vec_id, (list_min({_ON}) * 8)::INT AS \"start\", ((list_max({_ON}) + 1) * 8)::INT AS \"end\" FROM {_LEVELS}")
def sg3(spark, d):
    return levels(spark, d).select("vec_id", G.energy_trim(F.col("l"), 8, 6).alias("t")).select("vec_id", "t.start", "t.end")


_TH = f"(SELECT vec_id, l, greatest(list_max(l) - 6, list_sort(l)[2] + 1) AS th FROM {_LEVELS})"
_FIRST = "list_min(list_filter(range(1, 7), lambda i: l[i + 1] > th AND l[i + 2] > th))"


@query("sg4_refine_bounds", f"SELECT vec_id, a::INT AS first, CASE WHEN a IS NOT NULL THEN (coalesce(list_min(list_filter(range(0, 7), lambda i: i > a AND l[i + 1] <= th AND l[i + 2] <= th)), 8) - 1)::INT ELSE 7 END AS last FROM (SELECT *, {_FIRST} AS a FROM {_TH})")
def sg4(spark, d):
    return levels(spark, d).select("vec_id", G.refine_bounds(F.col("l"), F.lit(1), 6, 1, 2, 2).alias("b")).select("vec_id", "b.first", "b.last")


@query("sg5_normalize_bins", "WITH s AS (SELECT i, avg(embedding[i]::DOUBLE) AS m, stddev_pop(embedding[i]::DOUBLE) AS s FROM embeddings, range(1, 65) t(i) GROUP BY 1) SELECT vec_id, (i - 1)::INT AS pos, round((embedding[i]::DOUBLE - m) / greatest(s, 1e-8), 5) AS z FROM embeddings, s")
def sg5(spark, d):
    e = table(spark, d, "embeddings")
    m = bin_moments(e, "embedding", 64, -0.2, F.lit(True))
    stats = m.agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "mean"))), lambda x: x["mean"]).alias("mean"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "std"))), lambda x: x["std"]).alias("std"))
    stats = stats.withColumn("split", F.lit("train")).withColumn("config_hash", F.lit("0"))
    out = G.normalize_bins(e.select("vec_id", "embedding"), "embedding", stats).select("vec_id", F.posexplode("normalized").alias("pos", "z"))
    return out.select("vec_id", "pos", F.round("z", 5).alias("z"))


@query("sg6_peak_gain_params", f"SELECT vec_id, round(least(-20 - 20 * log10(sqrt(list_sum(list_transform(v, lambda x: x * x)) / 64) + 1e-9), 20 * log10(0.999 / (list_max(list_transform(v, lambda x: abs(x))) + 1e-9))), 6) AS gain FROM {_LEVELS}")
def sg6(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(G.peak_gain(F.col("embedding"), F.lit(-20.0)), 6).alias("gain"))


@query("sg7_speech_start")
def sg7(spark, d):
    return levels(spark, d).select("vec_id", G.speech_start(F.col("l"), 2, 3.0, 2).alias("start_frame"))
