"""Window functions, rankings, top-k and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanlab.operators.ranks import cumulative, islands, looking_back


def sessionize(df: DataFrame, key: str, t: str, gap: int, tie: str) -> DataFrame:
    """``session`` from 0: a new one starts when more than ``gap`` has passed."""
    return islands(df, [key], t, F.col(t), lambda last: F.col(t) - last > gap, [tie]).drop("begins").withColumnRenamed("island", "session")


def head_per_group(df: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def rank_avg(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Ranks from 1 with ties at their mean, from counts of distinct values."""
    run = cumulative(df.groupBy(*keys, col).agg(F.count("*").alias("__c")), keys, col, ["__c"])
    return df.join(run.select(*keys, col, (F.col("before___c") + (F.col("__c") + 1) / 2).alias("rank")), [*keys, col])


def running_precision(df: DataFrame, keys: list[str], score: str, tie: list[str], positive: Column) -> DataFrame:
    """Position, positives so far and their share, in score order with an explicit tie key."""
    run = cumulative(df.withColumn("__one", F.lit(1)).withColumn("__hit", positive.cast("int")), keys, score, ["__one", "__hit"], descending=True, tie=tie)
    run = run.withColumn("position", F.col("before___one") + 1).withColumn("hits", F.col("before___hit") + F.col("__hit"))
    return run.select(*df.columns, "position", "hits", (F.col("hits") / F.col("position")).alias("precision"))


def gaps_between(df: DataFrame, key: str, start: str, end: str, tie: str) -> DataFrame:
    """Per key: rows and the largest gap between a row's end and the next one's start."""
    told = looking_back(df, [key], start, 1, lambda window: {"__g": F.col(start) - F.lag(end).over(window())}, [tie])
    return told.groupBy(key).agg(F.count("*").alias("n"), F.max("__g").alias("max_gap"))


def min_spacing(df: DataFrame, key: str, t: str) -> DataFrame:
    told = looking_back(df, [key], t, 1, lambda window: {"__g": F.col(t) - F.lag(t).over(window())})
    return told.groupBy(key).agg(F.min("__g").alias("min_spacing"))


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str, counted: DataFrame | None = None) -> DataFrame:
    """The union of intervals per key as intervals of their own; ones that touch are joined. ``counted``: a table known to hold no fewer rows of each key."""
    isles = islands(df, keys, start, F.col(end), lambda reach: reach.isNull() | (F.col(start) > reach), [end], counted)
    return isles.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island")


def longest_run(df: DataFrame, key: str, order: list[str], flag: Column) -> DataFrame:
    """``longest``: the most rows of a key that stand one behind another with the flag set. Rows of one run have as many rows without it ahead of them."""
    runs = cumulative(df.withColumn("__off", (~F.coalesce(flag, F.lit(False))).cast("int")), [key], order[0], ["__off"], tie=order[1:])
    sizes = runs.groupBy(key, "before___off").agg(F.count_if(F.col("__off") == 0).alias("__n"))
    return sizes.groupBy(key).agg(F.max("__n").alias("longest"))


def linspace_cap(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """Up to n rows of each key, evenly spaced by index with both ends, each once."""
    numbered = cumulative(df.withColumn("__one", F.lit(1)), [key], order[0], ["__one"], tie=order[1:]).drop("__one").withColumnsRenamed({"before___one": "__i", "all___one": "__c"})
    # Index i is taken when i is j * (c - 1) / (n - 1), rounded half up, of some j: of the least j that reaches i - 1/2, if it stays under i + 1/2.
    j = F.expr(f"((2 * __i - 1) * {n - 1} + 2 * (__c - 1) - 1) div (2 * greatest(__c - 1, 1))")
    taken = (F.col("__i") == 0) | ((2 * j * (F.col("__c") - 1) < (2 * F.col("__i") + 1) * (n - 1)) & (j <= n - 1))
    return numbered.where((F.col("__c") <= n) | taken).drop("__i", "__c")


def running_balance(df: DataFrame, stratum: str, order: list, weight: str) -> DataFrame:
    """Weight up to and including each row, and its share of the stratum's."""
    run = cumulative(df, [stratum], order[0], [weight], tie=order[1:])
    running = F.col(f"before_{weight}") + F.col(weight)
    return run.select(*df.columns, running.alias("running"), (running / F.col(f"all_{weight}")).alias("share"))


def number_within(df: DataFrame, key: str, order: list[str], digits: int = 5) -> DataFrame:
    """``name``: the key and the row's number in its key, from 1."""
    run = cumulative(df.withColumn("__one", F.lit(1)), [key], order[0], ["__one"], tie=order[1:])
    return run.select(*df.columns, F.concat_ws("_", F.col(key), F.lpad((F.col("before___one") + 1).cast("string"), digits, "0")).alias("name"))


def top_fraction(df: DataFrame, keys: list[str], score: str, fraction_ppm: int, cap: int, tie: list[str]) -> DataFrame:
    """The highest scores of each group: min(cap, ceil(fraction * rows)), the fraction in millionths."""
    w = W.partitionBy(*keys)
    k = F.least(F.lit(cap), F.ceil(F.count("*").over(w) * fraction_ppm / 1_000_000))
    return df.withColumn("__n", F.row_number().over(w.orderBy(F.col(score).desc(), *tie))).withColumn("__k", k).where("__n <= __k").drop("__n", "__k")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def intersect_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def except_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)
