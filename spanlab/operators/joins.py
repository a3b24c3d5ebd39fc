"""Joins: lookups with guarantees, overlaps, nearest neighbours, one-to-one matching."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from spanlab.operators.ranks import islands


def lookup_join(df: DataFrame, dim: DataFrame, key: str, required: list[str] = ()) -> DataFrame:
    """Left join on a key that must be unique in ``dim``; a missing match fails the job where ``required`` columns come out null."""
    once = dim.groupBy(key).agg(*[F.when(F.count("*") > 1, F.raise_error(F.concat(F.lit("repeated key "), F.first(key).cast("string"))).cast("string")).otherwise(F.lit(None)).alias("__twice")], *[F.first(c).alias(c) for c in dim.columns if c != key])
    out = df.join(once, key, "left").where("__twice IS NULL").drop("__twice")
    for c in required:
        out = out.withColumn(c, F.coalesce(F.col(c), F.raise_error(F.concat(F.lit(f"no {c} for "), F.col(key).cast("string"))).cast(dict(out.dtypes)[c])))
    return out


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], bounds_a: tuple[str, str], bounds_b: tuple[str, str], width: int, eps: float = 0) -> DataFrame:
    """Pairs of rows whose intervals overlap by more than ``eps`` under the same keys.

    Intervals are cut into buckets of ``width``; a pair is kept only in the bucket where the overlap begins, so a busy key
    spreads over its buckets and no pair comes twice.
    """
    cut = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width)))
    (a0, a1), (b0, b1) = bounds_a, bounds_b
    left, right = a.withColumn("__bucket", cut(a0, a1)), b.withColumn("__bucket", cut(b0, b1))
    start = F.greatest(F.col(a0), F.col(b0))
    met = left.join(right, [*keys, "__bucket"]).where((F.least(F.col(a1), F.col(b1)) - start > eps) & (F.floor(start / width) == F.col("__bucket")))
    return met.drop("__bucket")


def best_overlap(truth: DataFrame, found: DataFrame, keys: list[str], width: int) -> DataFrame:
    """The best detection of each truth span (t_id, t0, t1) by intersection over union among (f_id, f0, f1); ties go to the smaller f_id. Null where none overlaps."""
    met = overlap_join(truth, found, keys, ("t0", "t1"), ("f0", "f1"), width)
    inter = F.least("t1", "f1") - F.greatest("t0", "f0")
    iou = inter / (F.greatest("t1", "f1") - F.least("t0", "f0"))
    best = met.groupBy(*keys, "t_id").agg(F.max(F.struct(iou.alias("iou"), (-F.col("f_id")).alias("neg"), (F.col("f0") - F.col("t0")).alias("start_error"), (F.col("f1") - F.col("t1")).alias("end_error"))).alias("b"))
    return truth.join(best, [*keys, "t_id"], "left").select(*keys, "t_id", (-F.col("b.neg")).alias("f_id"), "b.iou", "b.start_error", "b.end_error")


def without_truth(truth: DataFrame, found: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Per key: detections, and those of them that overlap no truth span."""
    met = overlap_join(truth, found, keys, ("t0", "t1"), ("f0", "f1"), width).select(*keys, "f_id").distinct().withColumn("__met", F.lit(True))
    told = found.join(met, [*keys, "f_id"], "left")
    return told.groupBy(*keys).agg(F.count("*").alias("detections"), F.count_if(F.col("__met").isNull()).alias("without_truth"))


def attribute(triggers: DataFrame, events: DataFrame, key: str, window: int, otherwise: Column) -> DataFrame:
    """The event (event_id, e0, e1) that overlaps [t - window, t] most; ties go to the earlier start, then id; none gives ``otherwise``."""
    spans = triggers.withColumn("w0", F.col("t") - window)
    met = overlap_join(spans.select(key, "t", "trigger_id", "w0"), events, [key], ("w0", "t"), ("e0", "e1"), max(window, 1))
    size = F.least("t", "e1") - F.greatest("w0", "e0")
    best = met.groupBy(key, "trigger_id").agg(F.max(F.struct(size.alias("overlap"), (-F.col("e0")).alias("s"), (-F.col("event_id")).alias("e"))).alias("b"))
    return triggers.join(best, [key, "trigger_id"], "left").withColumn("cause", F.coalesce((-F.col("b.e")).cast("string"), otherwise)).drop("b")


#: Halvings of the radius that cells of ``knn_band_join`` may go through.
HALVINGS = 8


def knn_band_join(a: DataFrame, b: DataFrame, keys: list[str], k: int, radius: float) -> DataFrame:
    """Up to k nearest rows of b (b_id, bx, by) within a radius of each row of a (a_id, ax, ay); ties go by b_id. Rows without a coordinate meet nothing.

    Each distinct place of a asks once, and of the rows of b at one place only the k smallest b_id count. Cells are as wide as the radius, or half, a quarter, ... of it: a place asks
    in the smallest ones of which its own holds k rows. Those lie within 1.42 widths, so the two cells around it on each side have all that are as near. Where no cell is that full,
    a place asks the cells next to its own, as wide as the radius. So what a place is compared with follows k, not the number of rows that a radius holds,
    until more than k different places lie within 1/256 of a radius.
    """
    cell = lambda x, level: F.floor(F.col(x) / (F.lit(float(radius)) / F.pow(F.lit(2.0), level)))
    each = F.explode(F.sequence(F.lit(0), F.lit(HALVINGS))).alias("__l")
    at_a, at_b = [*keys, "ax", "ay"], [*keys, "bx", "by"]
    places = a.select(*at_a).where("ax IS NOT NULL AND ay IS NOT NULL").distinct()
    first = F.row_number().over(W.partitionBy(*at_b).orderBy("b_id"))
    rows = b.select(*at_b, "b_id").where("bx IS NOT NULL AND by IS NOT NULL").withColumn("__n", first).where(F.col("__n") <= k).drop("__n")
    posted = rows.select("*", each).withColumns({"__x": cell("bx", F.col("__l")), "__y": cell("by", F.col("__l"))})
    on = [*keys, "__l", "__x", "__y"]
    full = posted.where("__l > 0").groupBy(*on).count().where(F.col("count") >= k).drop("count")
    tried = places.select("*", each).withColumns({"__x": cell("ax", F.col("__l")), "__y": cell("ay", F.col("__l"))})
    level = tried.join(full, on, "left_semi").groupBy(*at_a).agg(F.max("__l").alias("__l"))
    # Keys may be null in a place, as everywhere: those meet nothing, here or in the join of cells.
    asked = places.join(level, at_a, "left").withColumn("__l", F.coalesce("__l", F.lit(0)))
    wide = F.when(F.col("__l") > 0, 2).otherwise(1)
    steps = lambda: F.explode(F.sequence(-wide, wide))
    asks = asked.withColumn("__i", steps()).withColumn("__j", steps()).withColumns({"__x": cell("ax", F.col("__l")) + F.col("__i"), "__y": cell("ay", F.col("__l")) + F.col("__j")}).drop("__i", "__j")
    d2 = (F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by"))
    met = asks.join(posted, on).withColumn("d2", d2).where(F.col("d2") <= radius * radius)
    near = met.withColumn("rank", F.row_number().over(W.partitionBy(*at_a).orderBy("d2", "b_id"))).where(F.col("rank") <= k)
    return a.join(near.select(*at_a, "b_id", "d2", "rank"), at_a).select(*keys, "a_id", "b_id", "d2", "rank")


def points_in(points: DataFrame, t: str, zones: DataFrame, z0: str, z1: str, keys: list[str], width: int) -> DataFrame:
    """Pairs of points and closed zones that hold them under the same keys. Zones stand in each bucket of ``width`` that they touch, so a busy key spreads over its buckets."""
    cut = zones.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(z0) / width), F.floor(F.col(z1) / width))))
    at = points.withColumn("__bucket", F.floor(F.col(t) / width))
    return at.join(cut, [*keys, "__bucket"]).where(F.col(t).between(F.col(z0), F.col(z1))).drop("__bucket")


#: Width of the buckets that points and zones meet in, where nothing else is said: an hour in microseconds.
HOUR_US = 3_600_000_000


def one_to_one_match(expected: DataFrame, observed: DataFrame, key: str, lo: int, hi: int, width: int | None = None) -> DataFrame:
    """Each expected event (e_id, a, b) takes the earliest unused observed time (o_id, t) in [a - lo, b + hi].

    Zones that overlap form islands, which are dealt to tasks apart. There, times go in order to the first zone (by start, then id) that waits for
    one; only waiting zones are in memory. One row per expected event, o_id null where it has none.
    """
    zones = expected.select(key, "e_id", (F.col("a") - lo).alias("z0"), (F.col("b") + hi).alias("z1"))
    zones = islands(zones, [key], "z0", F.col("z1"), lambda before: before.isNull() | (before < F.col("z0")), ["e_id"], counted=expected).drop("begins")
    inside = points_in(observed.select(key, "t", "o_id"), "t", zones, "z0", "z1", [key], width or max(lo + hi, HOUR_US)).select(key, "island", "t", "o_id").distinct()
    rows = zones.select(key, "island", F.col("z0").alias("at"), F.lit(0).alias("kind"), F.col("e_id").alias("id"), "z1")
    rows = rows.unionByName(inside.select(key, "island", F.col("t").alias("at"), F.lit(1).alias("kind"), F.col("o_id").alias("id"), F.lit(None).cast("long").alias("z1")))
    dealt = rows.repartition(key, "island").sortWithinPartitions(key, "island", "at", "kind", "id")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, waiting = None, deque()

        def left(out: list) -> None:
            out += [(where[0], e_id, None, None) for e_id, _ in waiting]
            waiting.clear()

        for b in batches:
            out: list[tuple] = []
            for k, island, at, kind, ident, z1 in zip(*(b.column(c).to_pylist() for c in range(6))):
                if where != (k, island):
                    left(out)
                    where = k, island
                if kind == 0:
                    waiting.append((ident, z1))
                    continue
                while waiting:
                    e_id, z1 = waiting.popleft()
                    out.append((k, e_id, at, ident) if at <= z1 else (k, e_id, None, None))
                    if at <= z1:
                        break
            yield told(out)
        if waiting:
            out = []
            left(out)
            yield told(out)

    schema = T.StructType([rows.schema[key], T.StructField("e_id", T.LongType()), T.StructField("t", T.LongType()), T.StructField("o_id", T.LongType())])
    arrow = to_arrow_schema(schema)

    def told(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(arrow.names, x)) for x in out], schema=arrow)

    return dealt.mapInArrow(walk, schema)


def seq_join(trials: DataFrame, answers: DataFrame, key: str, own: str, other: str) -> DataFrame:
    """One row: answers of another model by trial key that are the same, changed or missing."""
    j = trials.select(key, own).join(answers.select(key, other), key, "left")
    return j.agg(
        F.count_if(F.col(other).isNull()).alias("missing"), F.count_if(F.col(other) == F.col(own)).alias("same"), F.count_if(F.col(other).isNotNull() & ~F.col(other).eqNullSafe(F.col(own))).alias("changed")
    )


def ban_touching(spans: DataFrame, banned: DataFrame, keys: list[str], guard: int, width: int) -> DataFrame:
    """Spans (span_id, s, e) that touch no banned interval (b0, b1) widened by ``guard``."""
    wide = banned.select(*keys, (F.col("b0") - guard).alias("b0"), (F.col("b1") + guard).alias("b1"))
    touched = overlap_join(spans, wide, keys, ("s", "e"), ("b0", "b1"), width).select(*keys, "span_id").distinct()
    return spans.join(touched, [*keys, "span_id"], "left_anti")


def lineage_split(child: DataFrame, parents: list[tuple[DataFrame, str]], into: str = "split") -> DataFrame:
    """The split of a child's source row, looked up in several parent tables in order: (table of key and split, child's key)."""
    found = []
    for n, (table, key) in enumerate(parents):
        child = child.join(table.select(F.col("key").alias(f"__k{n}"), F.col("split").alias(f"__s{n}")), F.col(key) == F.col(f"__k{n}"), "left").drop(f"__k{n}")
        found.append(f"__s{n}")
    return child.withColumn(into, F.coalesce(*found)).drop(*found)
