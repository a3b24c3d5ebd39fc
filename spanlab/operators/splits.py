"""Splits that keep groups whole: by hash, by rule, balanced, greedy, frozen and extended."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlab.functions.keys import md5_mod, stable_hash64
from spanlab.operators.ranks import cumulative

RATIOS = {"train": 0.8, "validation": 0.1, "test": 0.1}
#: Groups of a stratum that the greedy rule takes in one task.
GREEDY_GROUPS = 1_000_000


def split_by_hash(key: Column, train: int = 80, validation: int = 90, forced: Column | None = None) -> Column:
    bucket = md5_mod(key, 100)
    out = F.when(bucket < train, "train").when(bucket < validation, "validation").otherwise("test")
    return out if forced is None else F.when(forced, "train").otherwise(out)


def split_by_rule(speaker: Column, clock: Column, owner: str, lo: str, hi: str) -> Column:
    """Speaker and closed time of day range (HH:MM texts) give the split."""
    return F.when(speaker != owner, "train").when(clock.between(lo, hi), "test").otherwise("validation")


def split_balanced(df: DataFrame, group: str, stratum: str, weight: str, ratios: dict[str, float] = RATIOS, seed: int = 0) -> DataFrame:
    """(stratum, group, weight, split): groups in hash order; where a group's weight begins within its stratum decides.

    A split's share is off by no more than the largest group.
    """
    groups = df.where(F.col(group).isNotNull()).groupBy(stratum, group).agg(F.sum(weight).alias(weight)).withColumn("__h", stable_hash64(F.lit(seed), F.col(group)))
    run = cumulative(groups, [stratum], "__h", [weight], tie=[group]).withColumn("__share", F.col(f"before_{weight}") / F.col(f"all_{weight}"))
    edge, out, names = 0.0, F.lit(list(ratios)[-1]), list(ratios)
    edges = []
    for n in names[:-1]:
        edge += ratios[n]
        edges.append((n, edge))
    for n, e in reversed(edges):
        out = F.when(F.col("__share") < e, n).otherwise(out)
    return run.select(stratum, group, weight, out.alias("split"))


def split_greedy_deficit(df: DataFrame, group: str, stratum: str, weight: str, ratios: dict[str, float] = RATIOS, seed: int = 0, frozen: DataFrame | None = None) -> DataFrame:
    """Largest group first to the split that lacks most of its share, stratum by stratum in parallel. Equal weights and equal lacks go by the smaller hash.

    ``frozen`` (group, split) fixes groups that keep their split and count towards the totals. A stratum with more groups than
    GREEDY_GROUPS fails the job; ``split_balanced`` has no such bound.
    """
    groups = df.where(F.col(group).isNotNull()).groupBy(stratum, group).agg(F.sum(weight).cast("double").alias("weight"))
    known = groups.withColumn("split", F.lit(None).cast("string")) if frozen is None else groups.join(frozen.select(group, "split"), group, "left")
    hashed = known.withColumn("__h", stable_hash64(F.lit(seed), F.col(group))).withColumn("__hs", F.array(*[stable_hash64(F.lit(seed), F.col(group), F.lit(n)) for n in ratios]))

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) > GREEDY_GROUPS:
            raise ValueError(f"{len(rows)} groups in a stratum; split_balanced takes any number")
        given = rows.groupby("split")["weight"].sum()
        lacks = {n: share * rows["weight"].sum() - given.get(n, 0.0) for n, share in ratios.items()}
        for at in rows[rows["split"].isna()].sort_values(["weight", "__h"], ascending=[False, True]).index:
            most = max(lacks.values())
            chosen = min((h, n) for n, h in zip(ratios, rows.at[at, "__hs"]) if lacks[n] == most)[1]
            lacks[chosen] -= rows.at[at, "weight"]
            rows.at[at, "split"] = chosen
        return rows[[stratum, group, "weight", "split"]]

    kinds = dict(groups.dtypes)
    return hashed.groupBy(stratum).applyInPandas(deal, f"`{stratum}` {kinds[stratum]}, `{group}` {kinds[group]}, weight double, split string")


def extend_split(new: DataFrame, frozen: DataFrame, group: str, stratum: str, weight: str, ratios: dict[str, float] = RATIOS, seed: int = 0) -> DataFrame:
    """Known groups keep their split and count towards the totals; only unseen ones are assigned. ``method`` tells which."""
    given = split_greedy_deficit(new, group, stratum, weight, ratios, seed, frozen)
    return given.join(frozen.select(group, F.lit("frozen").alias("method")), group, "left").withColumn("method", F.coalesce("method", F.lit("extended")))


def pin_largest(df: DataFrame, group: str, weight: str, positive: Column) -> DataFrame:
    """(group, split) of positive groups: the largest goes to test, the next to validation, the others to train."""
    groups = df.where(positive).groupBy(group).agg(F.sum(weight).alias("__w"))
    top = groups.orderBy(F.col("__w").desc(), group).limit(2).agg(F.sort_array(F.collect_list(F.struct("__w", (F.col(group)).alias("g"))), asc=False).alias("t"))
    first, second = F.get("t", F.lit(0))["g"], F.get("t", F.lit(1))["g"]
    return groups.crossJoin(F.broadcast(top)).select(group, F.when(F.col(group) == first, "test").when(F.col(group) == second, "validation").otherwise("train").alias("split"))


def inherit_split(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return child.join(parent.select(F.col(parent_key).alias(child_key), "split"), child_key, "left")


def merge_lists(base: DataFrame, more: DataFrame, rules: list[tuple[str, DataFrame, list[str]]]) -> tuple[DataFrame, DataFrame]:
    """``more`` joins ``base`` unless an ordered rule (reason, keys to exclude, key columns) holds. The first reason counts; excluded rows come second."""
    found = []
    for n, (reason, keys, cols) in enumerate(rules):
        more = more.join(keys.select(*cols).distinct().withColumn(f"__r{n}", F.lit(reason)), cols, "left")
        found.append(f"__r{n}")
    told = more.withColumn("reason", F.coalesce(*found)).drop(*found)
    return base.unionByName(told.where("reason IS NULL").drop("reason"), allowMissingColumns=True), told.where("reason IS NOT NULL")
