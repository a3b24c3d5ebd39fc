"""Aggregations: counts, cross tables, shares, quantiles, rates, coverage, moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlab.operators.ranks import quantiles


def beside(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Two tables of one row per key side by side; null keys meet."""
    if not keys:
        return a.crossJoin(F.broadcast(b))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"__a.{k}").eqNullSafe(F.col(f"__b.{k}"))
    return a.alias("__a").join(b.alias("__b"), on, "left").select("__a.*", *[F.col(f"__b.{c}") for c in b.columns if c not in keys])


def counts_by(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def crosstab(df: DataFrame, row: str, col: str, columns: list[str], margins: bool = False) -> DataFrame:
    """Counts of rows by columns, zero where there are none; with margins a row and a column named All."""
    cells = (df.cube(row, col) if margins else df.groupBy(row, col)).agg(F.count("*").alias("n"), *([F.grouping(row).alias("gr"), F.grouping(col).alias("gc")] if margins else []))
    if margins:
        cells = cells.select(F.when(F.col("gr") == 1, "All").otherwise(F.col(row)).alias(row), F.when(F.col("gc") == 1, "All").otherwise(F.col(col)).alias(col), "n")
        columns = [*columns, "All"]
    return cells.groupBy(row).pivot(col, columns).agg(F.sum("n")).na.fill(0)


def distinct_per(df: DataFrame, key: str, col: str) -> DataFrame:
    return df.groupBy(key).agg(F.count_distinct(col).alias("n_distinct"))


def effective_groups(df: DataFrame, key: str, weight: Column) -> DataFrame:
    """One row: how many equal groups the rows' and the weights' shares amount to (1 / sum of squares), and the heaviest group with its share."""
    groups = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.sum(weight).alias("w"))
    return groups.agg(
        (F.sum("n") * F.sum("n") / F.sum(F.col("n") * F.col("n"))).alias("effective_rows"), (F.sum("w") * F.sum("w") / F.sum(F.col("w") * F.col("w"))).alias("effective_weight"),
        F.max(F.struct("w", key))[key].alias("top_group"), (F.max("w") / F.sum("w")).alias("top_share"),
    )


def share_within(df: DataFrame, keys: list[str], subset: list[str], weight: str | None = None) -> DataFrame:
    """Each group's rows and their share of its subset."""
    from pyspark.sql import Window as W

    n = df.groupBy(*keys).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(*subset)))


def quantile_summary(df: DataFrame, keys: list[str], col: str, qs: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """n, min, exact linear quantiles and max of the values that aren't null."""
    out = df.where(F.col(col).isNotNull()).groupBy(*keys).agg(F.count(col).alias("n"), F.min(col).alias("min"), F.max(col).alias("max"))
    names = {f"p{round(100 * q)}": q for q in qs}
    return beside(out, quantiles(df, keys, col, names), keys).select(*keys, "n", "min", *names, "max")


def latency_summary(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    out = df.where(F.col(col).isNotNull()).groupBy(*keys).agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.min(col).alias("min"), F.max(col).alias("max"))
    return beside(out, quantiles(df, keys, col, {"median": 0.5, "p90": 0.9, "p95": 0.95}), keys).select(*keys, "n", "median", "p90", "p95", "mean", "min", "max")


def class_rates(df: DataFrame, truth: str, pred: str, group: str, rejected: str) -> DataFrame:
    """Per group and class: clips, and the rates of correct, wrong and rejected answers."""
    ok, no = F.col(pred) == F.col(truth), (F.col(pred) == rejected) & (F.col(truth) != rejected)
    return df.groupBy(group, truth).agg(F.count("*").alias("clips"), (F.count_if(ok) / F.count("*")).alias("correct"), (F.count_if(~ok & ~no) / F.count("*")).alias("wrong"), (F.count_if(no) / F.count("*")).alias("rejected"))


def macro_rates(df: DataFrame, truth: str, pred: str, group: str, rejected: str) -> DataFrame:
    """Means of the classes' rates, so that a large class counts no more than a small one."""
    return class_rates(df, truth, pred, group, rejected).groupBy(group).agg(F.count("*").alias("classes"), F.sum("clips").alias("clips"), F.avg("correct").alias("correct"), F.avg("wrong").alias("wrong"), F.avg("rejected").alias("rejected"))


def mean_of_group_means(df: DataFrame, group: str, value: Column) -> DataFrame:
    return df.groupBy(group).agg(F.avg(value).alias("m")).agg(F.avg("m").alias("mean_of_means"))


def coverage_matrix(df: DataFrame, cls: str, family: str, families: list[str], voice: str) -> DataFrame:
    """Per class: clips and distinct voices of each family, weakest classes first."""
    picks = [x for f in families for x in (F.count_if(F.col(family) == f).alias(f"clips_{f}"), F.count_distinct(F.when(F.col(family) == f, F.col(voice))).alias(f"voices_{f}"))]
    return df.groupBy(cls).agg(F.count("*").alias("clips"), F.count_distinct(voice).alias("voices"), *picks).orderBy("clips", cls)


def inventory(df: DataFrame, dataset: str, split: str, splits: list[str], cls: str, speaker: str, real: str, meta: DataFrame) -> DataFrame:
    """One row per dataset: clips per split, classes, speakers, whether recordings are real, and the notes of ``meta``; unused datasets come with nulls."""
    kind = F.when(F.bool_and(real), "real").when(~F.bool_or(real), "synthetic").otherwise("mixed")
    used = df.groupBy(dataset).agg(*[F.count_if(F.col(split) == s).alias(s) for s in splits], F.count_distinct(cls).alias("classes"), F.count_distinct(speaker).alias("speakers"), kind.alias("kind"))
    return used.join(meta, dataset, "left").unionByName(meta.join(used.select(dataset), dataset, "left_anti"), allowMissingColumns=True)


def bin_moments(df: DataFrame, array: str, size: int, floor: float, train: Column) -> DataFrame:
    """Per position of an array: n, mean, population deviation and the share of values at the floor, in one pass. A row outside the training split fails the job."""
    guard = F.when(train, F.col(array)).otherwise(F.raise_error(F.lit("statistics take training rows only")).cast("array<double>"))
    x = lambda i: F.get("__a", F.lit(i)).cast("double")
    sums = [y for i in range(size) for y in (F.sum(x(i)).alias(f"s{i}"), F.sum(x(i) * x(i)).alias(f"q{i}"), F.count_if(x(i) <= floor).alias(f"f{i}"))]
    one = df.select(guard.alias("__a")).agg(F.count("*").alias("n"), *sums)
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.col(f"s{i}").alias("s"), F.col(f"q{i}").alias("q"), F.col(f"f{i}").alias("f")) for i in range(size)])).alias("r")
    mean = F.col("r.s") / F.col("n")
    return one.select("n", rows).select("r.pos", "n", mean.alias("mean"), F.sqrt(F.greatest(F.col("r.q") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"), (F.col("r.f") / F.col("n")).alias("at_floor"))


def confusions(df: DataFrame, truth: str, pred: str, top: int = 15) -> DataFrame:
    return df.where(F.col(truth) != F.col(pred)).groupBy(truth, pred).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), truth, pred).limit(top)


def set_string(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_set(col)), ",").alias("labels"))


def union_of_reasons(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    out = parts[0].select(*keys)
    for p in parts[1:]:
        out = out.unionByName(p.select(*keys))
    return counts_by(out, keys)


def clip_max(df: DataFrame, clip: str, score: str) -> DataFrame:
    return df.groupBy(clip).agg(F.max(score).alias("score"), F.count("*").alias("windows"))


def provenance_rates(df: DataFrame, bucket: str, params: str, names: list[str]) -> DataFrame:
    """Per bucket and over all (bucket ALL): the share of draws in which each transform ran, and in which any did. A value of "skipped" isn't a run."""
    m = F.col(params)
    ran = [F.coalesce(F.try_element_at(m, F.lit(n)) != "skipped", F.lit(False)) for n in names]
    any_ran = ran[0]
    for r in ran[1:]:
        any_ran = any_ran | r
    flags = df.select(bucket, *[r.cast("int").alias(n) for n, r in zip(names, ran)], any_ran.cast("int").alias("any"))
    told = flags.rollup(bucket).agg(F.grouping(bucket).alias("g"), F.count("*").alias("draws"), *[F.avg(n).alias(n) for n in [*names, "any"]])
    return told.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col(bucket)).alias(bucket), "draws", *names, "any")


def quantile_outliers(df: DataFrame, col: str, lo: float = 0.02, hi: float = 0.98) -> DataFrame:
    """Rows below the low or above the high quantile, with the side."""
    q = quantiles(df, [], col, {"__lo": lo, "__hi": hi})  # one row
    side = F.when(F.col(col) < F.col("__lo"), "low").when(F.col(col) > F.col("__hi"), "high")
    return df.crossJoin(F.broadcast(q)).withColumn("side", side).where("side IS NOT NULL").drop("__lo", "__hi")
