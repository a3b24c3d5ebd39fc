"""Mixing sources to target weights by subset-sum budget fitting.

A document's size is its number of words (null text: 0). Sources in code point order, null last, weigh 5, 2, 1,
repeating, and share 150 % of all sizes; a source's target stops at twice its size and the excess is shared
again by weight. Whole passes over a source come first; what is left of its budget is fitted over counts
of documents by exact size, as near as any choice comes (bounded knapsack over all sums of the last part, or of all documents where that isn't met), and seeded hashes choose the documents of
each size. A document is taken 0, 1 or 2 times. Empty tables give empty results; documents of size 0 are never taken. Rows with a null
doc_id are documents like others; equal rows are chosen apart. Very long texts only add a size, and other columns are not read.
"""

from __future__ import annotations

from math import gcd, isqrt

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanlab.llm.common import read_table, text_of, word_array

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
SEED = 17
SALTS = 256
#: Documents of the largest size that the last part of a budget holds at most before all of its sums are tried.
NEAR = 4


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``target`` for each row of (source, source_size).

    The level rises until the targets use up the budget: sources whose cap over weight lies below the level stop at
    their cap. One row per source, so the windows over all rows stay as small as the list of sources.
    """
    order = W.orderBy(F.col("source").isNull(), "source")
    number = F.row_number().over(order)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(number - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.select("source", "source_size", weight.alias("weight")).withColumn("cap", F.col("source_size") * F.lit(most))
    s = s.withColumn("r", F.col("cap") / F.col("weight"))
    before = W.orderBy("r", "source").rowsBetween(W.unboundedPreceding, -1)
    rest = W.orderBy("r", "source").rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    # The first source, by r, whose cap lies above the level that is left for it and those behind it sets the level.
    level = F.min(F.when(F.col("r") >= F.col("level"), F.struct("r", "level"))).over(everything)["level"]
    return s.withColumn("at", level).select("source", "source_size", F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("at"))).alias("target"))


def fit_counts(sizes: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each size to take, so that their words come as near ``budget`` from below, or to it, as any choice of documents can.

    An equal share of every size comes first, then single documents, largest first, until less than NEAR of the largest are left, and all sums of what is left are tried. That meets the budget, or the
    largest multiple of the sizes' common divisor below it, wherever documents are many. Where it doesn't, all sums of all documents up to the budget are tried instead.
    """
    total = sum(s * n for s, n in zip(sizes, counts))
    if budget >= total:
        return list(counts)
    if budget <= 0:
        return [0] * len(sizes)
    take = [n * budget // total for n in counts]
    left = budget - sum(s * n for s, n in zip(sizes, take))
    order = sorted((i for i in range(len(sizes)) if sizes[i] > 0 and counts[i] > 0), key=lambda i: -sizes[i])
    step = gcd(*[sizes[i] for i in order])
    for i in order:
        more = min(counts[i] - take[i], max(0, left - NEAR * sizes[order[0]]) // sizes[i])
        take[i] += more
        left -= more * sizes[i]
    for i, k in _knapsack([(i, sizes[i], counts[i] - take[i]) for i in order], left, step):
        take[i] += k
        left -= k * sizes[i]
    if left < step:
        return take
    take = [0] * len(sizes)
    for i, k in _knapsack([(i, sizes[i], counts[i]) for i in order], budget, step):
        take[i] += k
    return take


def _knapsack(room: list[tuple[int, int, int]], most: int, step: int) -> list[tuple[int, int]]:
    """(item, number) of items (item, size, copies) whose sizes add up to the largest reachable sum up to ``most``; all sums are multiples of ``step``.

    Copies are split into powers of two, and the reachable sums are bits of one number, which each part shifts on. Every so many parts the number is kept; on the way back the
    numbers between two kept ones are made again, and a part is taken where its sum can't be reached without it. Parts are offered until ``most``, or what is next to it, is reached.
    """
    most //= step
    parts = []
    for i, size, free in room:
        k, size = 1, size // step
        while free > 0 and k * size <= most:
            k = min(k, free)
            parts.append((i, k, k * size))
            free, k = free - k, 2 * k
    every = max(1, isqrt(len(parts)))
    reach, mask, kept, used = 1, (1 << (most + 1)) - 1, [], 0
    while used < len(parts) and not reach >> most & 1:
        if used % every == 0:
            kept.append(reach)
        reach |= (reach << parts[used][2]) & mask
        used += 1
    at, out = reach.bit_length() - 1, []
    for first in range((used - 1) // every * every, -1, -every) if used else ():
        before = [kept[first // every]]
        for i, k, words in parts[first : min(first + every, used) - 1]:
            before.append(before[-1] | (before[-1] << words) & mask)
        for (i, k, words), without in zip(reversed(parts[first : min(first + every, used)]), reversed(before)):
            if not without >> at & 1:
                out.append((i, k))
                at -= words
    return out


def mix(docs: DataFrame, seed: int = SEED, weights=WEIGHTS, share: float = SHARE, most: float = MOST, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target and taken for every row of (doc_id, text, source), and the columns ``also``. Equal rows stay rows of their own."""
    size = F.size(word_array(text_of())).cast("long")
    sized = docs.select("doc_id", *also, "source", size.alias("size"))
    # Counts by exact length: the histogram that all the rest is planned on.
    salt = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), *also), F.lit(SALTS)).cast("int")
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    sized = sized.select("doc_id", *also, "source", key.alias("key"), "size", salt.alias("salt"))
    salted = sized.groupBy("source", "key", "size", "salt").agg(F.count("*").alias("n"))
    counted = salted.groupBy("source", "key", "size").agg(F.sum("n").alias("n"))
    sources = counted.groupBy("source", "key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    planned = targets(sources.select("source", "source_size"), weights, share, most).withColumn("key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))).drop("source")
    histogram = counted.select("key", "size", "n").join(planned, "key")

    def fitted(group: pd.DataFrame) -> pd.DataFrame:
        """A source's histogram: one row for each different size, so bounded by the longest text."""
        total, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
        group = group.sort_values("size")
        passes = min(int(most), int(target // total)) if total else 0
        extra = fit_counts(group["size"].tolist(), group["n"].tolist(), round(target) - passes * total) if passes < most and total else [0] * len(group)
        return pd.DataFrame({"key": group["key"], "size": group["size"], "source_size": total, "target": target, "passes": passes, "extra": extra})

    plan = histogram.groupBy("key").applyInPandas(fitted, "key string, size long, source_size long, target double, passes long, extra long")
    # The seeded choice: whole salts first, then documents by hash inside the one salt that is used in part.
    upto = F.coalesce(F.sum("n").over(W.partitionBy("key", "size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    quota = salted.select("key", "size", "salt", "n", upto.alias("upto")).join(plan, ["key", "size"])
    quota = quota.select("key", "size", "salt", "source_size", "target", "passes", F.greatest(F.lit(0), F.least(F.col("n"), F.col("extra") - F.col("upto"))).alias("quota"))
    ranked = sized.select("doc_id", *also, "key", "size", "salt", F.row_number().over(W.partitionBy("key", "size", "salt").orderBy(F.xxhash64(F.lit(seed + 1), F.col("doc_id"), *also), "doc_id", *also)).alias("rank"))
    chosen = F.col("passes") + F.when(F.col("rank") <= F.col("quota"), 1).otherwise(0)
    return ranked.join(quota, ["key", "size", "salt"]).select("doc_id", *also, "size", "source_size", "target", F.when(F.col("size") > 0, F.col("size") * chosen).otherwise(0).cast("long").alias("taken"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
