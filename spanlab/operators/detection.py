"""Detection evaluation: matching triggers to targets, exposure, reports, sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlab.operators.intervals import union_length
from spanlab.operators.joins import HOUR_US, one_to_one_match, points_in
from spanlab.operators.ranks import looking_back
from spanlab.operators.triggers import reaching, refractory_levels


def match(triggers: DataFrame, targets: DataFrame, key: str, before: int, after: int) -> tuple[DataFrame, DataFrame]:
    """Triggers (key, t, trigger_id) with an outcome, and targets (key, target_id, s, e) with latency.

    The hit zone [s - before, e + after] is closed. A zone's first free trigger is its hit with latency t - e; further triggers inside a zone
    are duplicates, those outside all zones false accepts; a target without a hit is a miss.
    """
    pairs = one_to_one_match(targets.select(key, F.col("target_id").alias("e_id"), F.col("s").alias("a"), F.col("e").alias("b")), triggers.select(key, "t", F.col("trigger_id").alias("o_id")), key, before, after)
    pairs = pairs.select(key, F.col("e_id").alias("target_id"), F.col("t").alias("hit_t"), F.col("o_id").alias("hit_id"))
    told = targets.join(pairs, [key, "target_id"], "left").withColumn("latency", F.col("hit_t") - F.col("e"))
    hits = pairs.where("hit_id IS NOT NULL").select(key, F.col("hit_id").alias("trigger_id"), "target_id")
    zones = targets.select(key, (F.col("s") - before).alias("z0"), (F.col("e") + after).alias("z1"))
    inside = points_in(triggers, "t", zones, "z0", "z1", [key], max(before + after, HOUR_US)).select(key, "trigger_id").distinct().withColumn("inside", F.lit(True))
    out = triggers.join(hits, [key, "trigger_id"], "left").join(inside, [key, "trigger_id"], "left")
    return out.withColumn("outcome", F.when(F.col("target_id").isNotNull(), "hit").when(F.col("inside"), "duplicate").otherwise("false_accept")).drop("inside"), told


def exposure(streams: DataFrame, targets: DataFrame, key: str, window: int, before: int, after: int) -> DataFrame:
    """``exposure``: max(0, duration - window) without the union of hit zones inside [window, duration]."""
    ranges = streams.withColumn("__lo", F.lit(window).cast("long")).withColumn("__hi", F.col("duration_us"))
    zones = targets.select(key, (F.col("s") - before).alias("z0"), (F.col("e") + after).alias("z1"))
    out = union_length(ranges, zones, [key], "z0", "z1", "__lo", "__hi")
    return out.withColumn("exposure", F.greatest(F.lit(0), F.col("duration_us") - window) - F.col("covered")).drop("__lo", "__hi", "covered")


def stream_report(streams: DataFrame, triggers: DataFrame, targets: DataFrame, key: str, groups: list[str]) -> DataFrame:
    """Overall and by each of ``groups``: targets, hits, false accepts, duplicates, exposed hours, detection rate and false accepts per hour.

    ``streams`` has exposure, ``triggers`` outcome and ``targets`` hit_id; they are summed per stream first, so groups only add a few rows a stream.
    """
    a = triggers.groupBy(key).agg(F.count_if(F.col("outcome") == "false_accept").alias("false_accepts"), F.count_if(F.col("outcome") == "duplicate").alias("duplicates"))
    b = targets.groupBy(key).agg(F.count("*").alias("targets"), F.count("hit_id").alias("hits"))
    per = streams.join(a, key, "left").join(b, key, "left").na.fill(0, ["false_accepts", "duplicates", "targets", "hits"])
    dims = F.explode(F.array(F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("value")), *[F.struct(F.lit(g).alias("dimension"), F.col(g).alias("value")) for g in groups])).alias("d")
    told = per.select("*", dims).groupBy("d.dimension", "d.value").agg(*[F.sum(c).alias(c) for c in ("targets", "hits", "false_accepts", "duplicates", "exposure")])
    hours = F.col("exposure") / 3_600_000_000
    return told.withColumn("detection_rate", F.col("hits") / F.col("targets")).withColumn("fa_per_hour", F.when(F.col("exposure") > 0, F.col("false_accepts") / hours))


def sweep(scores: DataFrame, thresholds: list[float], stream: str, t: str, score: str, gap: int, k: int, n: int, tie: str) -> DataFrame:
    """Triggers for every threshold: (threshold, stream, t, score, tie).

    A score that sets off a threshold sets off the lower ones too, so each score says how many of them it does, in one window, and one walk finds the triggers of all.
    """
    ascending = sorted({float(x) for x in thresholds})
    flags = looking_back(scores, [stream], t, n - 1, lambda window: {f"__on{i}": reaching(score, x, k, n, window) for i, x in enumerate(ascending)}, [tie])
    level = sum((F.coalesce(F.col(f"__on{i}"), F.lit(False)).cast("int") for i in range(1, len(ascending))), F.coalesce(F.col("__on0"), F.lit(False)).cast("int"))
    cands = flags.select(stream, t, score, tie, level.alias("__level")).where("__level > 0")
    told = refractory_levels(cands, [stream], t, gap, [score, tie], len(ascending), tie, counted=scores)
    return told.select(F.get(F.array(*[F.lit(x) for x in ascending]), F.col("level")).alias("threshold"), *[c for c in told.columns if c != "level"])


def threshold_curve(scores: DataFrame, thresholds: list[float], streams: DataFrame, targets: DataFrame, key: str, t: str, score: str, tie: str, gap: int, k: int, n: int, before: int, after: int) -> DataFrame:
    """False accepts an hour against the miss rate: what ``stream_report`` tells of all streams (key, exposure), for each threshold, and ``miss_rate``.

    Only triggers, targets (key, target_id, s, e) and streams stand once for each threshold; scores are walked once for all of them. Thresholds without a trigger have their row too.
    """
    grid = F.explode(F.array(*[F.lit(float(x)) for x in sorted({float(x) for x in thresholds})])).alias("threshold")
    at = F.concat_ws("|", F.col("threshold").cast("string"), F.col(key).cast("string")).alias("__at")
    found = sweep(scores, thresholds, key, t, score, gap, k, n, tie).select(at, F.col(t).alias("t"), F.col(tie).alias("trigger_id"))
    wanted = targets.select("*", grid).select(at, "target_id", "s", "e")
    exposed = streams.select("*", grid).select(at, "threshold", "exposure")
    triggers, hits = match(found, wanted, "__at", before, after)
    told = stream_report(exposed.withColumn("threshold", F.col("threshold").cast("string")), triggers, hits, "__at", ["threshold"]).where("dimension = 'threshold'")
    return told.select(F.col("value").cast("double").alias("threshold"), "targets", "hits", "false_accepts", "duplicates", "exposure", "detection_rate", (1 - F.col("detection_rate")).alias("miss_rate"), "fa_per_hour")


def outcome(want: Column, got: Column, rejected: str = "unknown") -> Column:
    want, got = F.coalesce(want, F.lit("")), F.coalesce(got, F.lit(""))
    return F.when(want == got, "correct").when((want == rejected) & (got != rejected), "false_action").when(got == rejected, "asks_again").otherwise("wrong")


def duration_limits(captures: DataFrame, limits: list[int], start: str, length: str) -> DataFrame:
    """Every capture under every limit: where it is cut and whether anything is lost."""
    cut = F.least(F.col(length), F.col(start) + F.col("limit"))
    return captures.withColumn("limit", F.explode(F.array(*[F.lit(x).cast("long") for x in limits]))).withColumn("cut", cut).withColumn("is_cut", F.col("cut") < F.col(length))


def per_event_outcomes(events: DataFrame, kind: str, woke: Column, correct: Column, rejected: Column, hours: Column) -> DataFrame:
    """By kind of event: how many woke the detector and what came of it, and over the ``hours`` that the events took: wakes and actions (woken and not rejected) an hour."""
    n, acted, told = F.count_if(woke), F.count_if(woke & ~rejected), F.sum(hours)
    return events.groupBy(kind).agg(
        F.count("*").alias("events"), n.alias("woke"), (n / F.count("*")).alias("woke_rate"), F.count_if(woke & correct).alias("correct"), F.count_if(woke & rejected).alias("rejected"), F.count_if(woke & ~correct & ~rejected).alias("wrong"),
        (F.count_if(woke & correct) / F.count("*")).alias("end_to_end"), F.when(told > 0, n / told).alias("wakes_per_hour"), F.when(told > 0, acted / told).alias("actions_per_hour"),
    )
