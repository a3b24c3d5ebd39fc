"""Aggregates over sample arrays: frame levels, trimming, bounds, gains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlab.functions.binding import let


def frame_levels(samples: Column, n: int, floor: float = -120.0) -> Column:
    """RMS of each whole frame of n samples in dB; what remains behind the last is left out; no frame gives the floor alone."""
    power = lambda i: F.aggregate(F.slice(samples, i * n + 1, F.lit(n)), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) / n
    frames = F.floor(F.size(samples) / n).cast("int")
    return F.when(frames > 0, F.transform(F.sequence(F.lit(0), frames - 1), lambda i: 20 * F.log10(F.sqrt(power(i)) + 1e-6))).otherwise(F.array(F.lit(floor)))


def level_stats(df: DataFrame, keys: list[str], levels: str, samples: str) -> DataFrame:
    """Peak (98 %), floor (20 %), their difference, the shares of clipped and non-zero samples, and the RMS."""
    n = F.size(samples)
    share = lambda f: F.size(F.filter(samples, f)) / n
    rms = F.sqrt(F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) / n)
    told = df.select(*keys, F.explode(levels).alias("__l"), share(lambda x: F.abs(x) >= 0.3).alias("clipped"), share(lambda x: x != 0).alias("non_zero"), rms.alias("rms"))
    q = told.groupBy(*keys, "clipped", "non_zero", "rms").agg(F.percentile("__l", F.array(F.lit(0.98), F.lit(0.2))).alias("q"))
    return q.select(*keys, F.get("q", F.lit(0)).alias("peak"), F.get("q", F.lit(1)).alias("floor"), (F.get("q", F.lit(0)) - F.get("q", F.lit(1))).alias("difference"), "clipped", "non_zero", "rms")


def energy_trim(levels: Column, n: int, top_db: float) -> Column:
    """Samples [start, end) from the first to the last frame above the peak less top_db."""
    return let(levels, lambda v: let(F.filter(F.transform(v, lambda x, i: F.when(x > F.array_max(v) - top_db, i)), lambda i: i.isNotNull()), lambda on: F.struct((F.array_min(on) * n).alias("start"), ((F.array_max(on) + 1) * n).alias("end"))))


def refine_bounds(levels: Column, start: Column, relative: float, margin: float, silence: int, onset: int) -> Column:
    """Frames [first, last] of a span from its first onset: the threshold is max(peak - relative, floor + margin).

    The first frame begins ``onset`` loud frames in a row at or behind ``start``; the last comes before the first ``silence`` quiet ones in a row.
    """
    def walk(v: Column) -> Column:
        threshold = F.greatest(F.array_max(v) - relative, F.get(F.sort_array(v), (F.size(v) * 0.2).cast("int")) + margin)
        flags = F.transform(v, lambda x: x > threshold)
        all_of = lambda f, i, k, want: ~F.exists(F.slice(f, i + 1, F.lit(k)), lambda x: x != want) & (i + k <= F.size(f))

        def found(f: Column) -> Column:
            at = F.filter(F.transform(f, lambda _, i: F.when((i >= start) & all_of(f, i, onset, True), i)), lambda i: i.isNotNull())
            return let(F.get(at, F.lit(0)), lambda a: F.struct(a.alias("first"), (F.coalesce(F.array_min(F.filter(F.transform(f, lambda _, i: F.when((i > a) & all_of(f, i, silence, False), i)), lambda i: i.isNotNull())), F.size(f)) - 1).alias("last")))

        return let(flags, found)

    return let(levels, walk)


def normalize_bins(df: DataFrame, array: str, stats: DataFrame, eps: float = 1e-8, config: str | None = None) -> DataFrame:
    """(x - mean) / max(std, eps) by one row of ``stats`` (mean and std arrays, split, config_hash); other than training statistics of this configuration fail the job."""
    ok = (F.col("stats_split") == "train") & (F.lit(config is None) | (F.col("stats_config") == F.lit(config or "")))
    one = stats.select(F.col("mean").alias("__m"), F.col("std").alias("__s"), F.col("split").alias("stats_split"), F.col("config_hash").alias("stats_config"))
    scaled = F.zip_with(F.zip_with(F.col(array), F.col("__m"), lambda x, m: x.cast("double") - m), F.col("__s"), lambda x, s: x / F.greatest(s, F.lit(eps)))
    guarded = F.when(ok, scaled).otherwise(F.raise_error(F.lit("statistics of another split or configuration")).cast("array<double>"))
    return df.crossJoin(F.broadcast(one)).withColumn("normalized", guarded).drop("__m", "__s", "stats_split", "stats_config")


def peak_gain(samples: Column, target_db: Column, limit: float = 0.999) -> Column:
    """The gain in dB towards a level, so that the peak stays at or under the limit."""
    rms = F.sqrt(F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) / F.size(samples))
    peak = F.array_max(F.transform(samples, lambda x: F.abs(x).cast("double")))
    return F.least(target_db - 20 * F.log10(rms + 1e-9), 20 * F.log10(limit / (peak + 1e-9)))


def speech_start(levels: Column, smoothing: int, above: float, run: int, first: int = 0) -> Column:
    """The first frame, from ``first`` on, of ``run`` levels in a row that lie ``above`` the floor or higher; null without one.

    Levels in dB are averaged as powers over the last ``smoothing`` frames, silence before the first; the floor is the 20th percentile of the plain levels.
    """
    def smooth(v: Column) -> Column:
        power = lambda i: F.aggregate(F.slice(v, F.greatest(i - (smoothing - 1), F.lit(0)) + 1, F.least(i + 1, F.lit(smoothing))), F.lit(0.0), lambda a, x: a + F.pow(F.lit(10.0), x / 10))
        return F.transform(v, lambda _, i: 10 * F.log10(power(i) / smoothing + 1e-18))

    def floor(v: Column) -> Column:
        at = (F.size(v) - 1) * 0.2
        low = lambda s: F.get(s, F.floor(at).cast("int"))
        return let(F.sort_array(v), lambda s: low(s) + (F.get(s, F.ceil(at).cast("int")) - low(s)) * (at - F.floor(at)))

    def begin(v: Column) -> Column:
        on = let(floor(v), lambda least: F.transform(smooth(v), lambda x, i: (x >= least + above) & (i >= first)))
        return let(on, lambda f: F.array_min(F.filter(F.transform(f, lambda _, i: F.when((i + run <= F.size(f)) & ~F.exists(F.slice(f, i + 1, F.lit(run)), lambda x: ~x), i)), lambda i: i.isNotNull())))

    return let(levels, begin)
