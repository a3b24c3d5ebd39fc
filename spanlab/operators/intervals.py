"""Interval algebra and window generation. Times are whole milliseconds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanlab.functions.keys import uniform
from spanlab.operators.joins import overlap_join
from spanlab.operators.ranks import looking_back
from spanlab.operators.series import linspace_cap, merge_intervals


@dataclass(frozen=True)
class WindowConfig:
    """Lengths and tolerances, in milliseconds, of labelled windows."""

    length: int = 1500
    post_rolls: tuple[int, ...] = (100, 250, 400)
    most: int = 3
    spacing: int = 150
    context: int = 50
    padding_share: float = 0.6
    partial_share: float = 0.35
    partial_most: float = 0.5
    guard: int = 500
    chunk_guard: int = 200
    hop: int = 750
    tail_share: float = 0.25
    cap: int = 700


def overlaps(a0: Column, a1: Column, b0: Column, b1: Column, eps: float = 0) -> Column:
    return F.least(a1, b1) - F.greatest(a0, b0) > eps


def coverage(w0: Column, w1: Column, a0: Column, a1: Column) -> Column:
    """The part of span a that window w covers."""
    return F.greatest(F.lit(0), F.least(w1, a1) - F.greatest(w0, a0)) / (a1 - a0)


def clipped(spans: DataFrame, start: str, end: str, lo: Column, hi: Column) -> DataFrame:
    return spans.withColumns({start: F.greatest(F.col(start), lo), end: F.least(F.col(end), hi)}).where(F.col(end) > F.col(start))


def subtract(ranges: DataFrame, spans: DataFrame, keys: list[str], start: str, end: str, lo: str, hi: str) -> DataFrame:
    """The free parts (free_start, free_end) of [lo, hi] of each row of ``ranges`` (one a key), in order; keys without spans are free as a whole."""
    inside = clipped(spans.select(*keys, start, end).join(ranges.select(*keys, lo, hi), keys), start, end, F.col(lo), F.col(hi))
    merged = merge_intervals(inside.select(*keys, start, end), keys, start, end, counted=spans)
    # Marks at both ends turn every gap into the step from one row to the next.
    ends = ranges.select(*keys, F.explode(F.array(F.struct(F.col(lo).alias(start), F.col(lo).alias(end)), F.struct(F.col(hi).alias(start), F.col(hi).alias(end)))).alias("x")).select(*keys, "x.*")
    steps = looking_back(merged.select(*keys, start, end).unionByName(ends), keys, start, 1, lambda window: {"free_start": F.lag(end).over(window())}, [end], counted=spans.select(*keys).unionByName(ends.select(*keys)))
    return steps.select(*keys, "free_start", F.col(start).alias("free_end")).where("free_end > free_start")


def union_length(ranges: DataFrame, spans: DataFrame, keys: list[str], start: str, end: str, lo: str, hi: str) -> DataFrame:
    """``covered``: the length of the spans' union inside [lo, hi] of each row of ``ranges`` (one a key); 0 for keys without spans."""
    inside = clipped(spans.select(*keys, start, end).join(ranges.select(*keys, lo, hi), keys), start, end, F.col(lo), F.col(hi))
    merged = merge_intervals(inside.select(*keys, start, end), keys, start, end, counted=spans).groupBy(*keys).agg(F.sum(F.col(end) - F.col(start)).alias("covered"))
    return ranges.join(merged, keys, "left").withColumn("covered", F.coalesce("covered", F.lit(0)))


def positive_windows(spans: DataFrame, files: DataFrame, cfg: WindowConfig = WindowConfig()) -> tuple[DataFrame, DataFrame]:
    """Windows that hold a whole span (file_id, span_id, s_ms, e_ms), ended at each post-roll; and every refusal with its reason.

    The ladder: too long for a window, too little context, outside the file, too much padding, overlap with another span. Accepted
    offsets are at most ``most`` per span and ``spacing`` apart. A span without any gets one centred window if that is free.
    """
    spans = spans.join(files, "file_id")
    long_one = F.col("e_ms") - F.col("s_ms") > cfg.length - 2 * cfg.context
    offsets = F.array(*[F.lit(x) for x in (*cfg.post_rolls, -1)])
    tries = spans.select("*", F.explode(F.when(long_one, F.array(F.lit(0))).otherwise(offsets)).alias("post_ms"))
    centred = F.floor((F.col("s_ms") + F.col("e_ms") + cfg.length) / 2)
    w1 = F.when(F.col("post_ms") < 0, centred).otherwise(F.col("e_ms") + F.col("post_ms"))
    tries = tries.withColumn("w1", w1).withColumn("w0", F.col("w1") - cfg.length)
    others = spans.select("file_id", F.col("span_id").alias("other_id"), F.col("s_ms").alias("o0"), F.col("e_ms").alias("o1"))
    hit = overlap_join(tries.select("file_id", "span_id", "post_ms", "w0", "w1"), others, ["file_id"], ("w0", "w1"), ("o0", "o1"), 600_000).where("span_id <> other_id")
    hit = hit.select("file_id", "span_id", "post_ms").distinct().withColumn("hit", F.lit(True))
    told = tries.join(hit, ["file_id", "span_id", "post_ms"], "left")
    pad = F.greatest(F.lit(0), -F.col("w0")) + F.greatest(F.lit(0), F.col("w1") - F.col("duration_ms"))
    reason = (
        F.when(long_one, "occurrence_too_long_for_window").when(F.col("s_ms") - F.col("w0") < cfg.context, "too_little_context")
        .when((F.col("w1") <= 0) | (F.col("w0") >= F.col("duration_ms")), "outside_file").when(pad > cfg.padding_share * cfg.length, "too_much_padding").when(F.col("hit"), "overlaps_other_span")
    )
    told = told.withColumn("reason", reason)
    # Spacing and cap go through the few offsets of a span in order.
    rows = F.sort_array(F.collect_list(F.struct(F.when(F.col("post_ms") < 0, 1_000_000).otherwise(F.col("post_ms")).alias("rank"), "post_ms", "w0", "w1", "reason")))

    def step(state: Column, x: Column) -> Column:
        last = F.get(F.filter(state, lambda r: r["reason"].isNull()), F.size(F.filter(state, lambda r: r["reason"].isNull())) - 1)
        n = F.size(F.filter(state, lambda r: r["reason"].isNull()))
        why = F.when(x["reason"].isNotNull(), x["reason"]).when((x["post_ms"] < 0) & (n > 0), F.lit("fallback_not_needed")).when(n >= cfg.most, F.lit("enough_windows")).when(F.abs(x["w1"] - last["w1"]) < cfg.spacing, F.lit("too_close"))
        return F.array_append(state, F.struct(x["rank"].alias("rank"), x["post_ms"].alias("post_ms"), x["w0"].alias("w0"), x["w1"].alias("w1"), why.alias("reason")))

    empty = F.array().cast("array<struct<rank:int,post_ms:int,w0:bigint,w1:bigint,reason:string>>")
    per_span = told.groupBy("file_id", "span_id").agg(rows.alias("rows")).select("file_id", "span_id", F.explode(F.aggregate("rows", empty, step)).alias("x")).select("file_id", "span_id", "x.post_ms", "x.w0", "x.w1", "x.reason")
    return per_span.where("reason IS NULL").drop("reason"), per_span.where("reason IS NOT NULL AND reason <> 'fallback_not_needed'")


def partial_windows(spans: DataFrame, cfg: WindowConfig = WindowConfig(), verified: Column | None = None, allowed: Column | None = None) -> DataFrame:
    """Windows that end inside the head or begin inside the tail of a span, covering a fixed share of it. Only spans whose bounds are ``verified`` and whose source is ``allowed`` have them."""
    for rule in (verified, allowed):
        spans = spans if rule is None else spans.where(rule)
    part = F.floor((F.col("e_ms") - F.col("s_ms")) * cfg.partial_share)
    out = spans.select("file_id", "span_id", "s_ms", "e_ms", F.explode(F.array(F.lit("head"), F.lit("tail"))).alias("side"))
    w0 = F.when(F.col("side") == "head", F.col("s_ms") + part - cfg.length).otherwise(F.col("e_ms") - part)
    out = out.withColumn("w0", w0).withColumn("w1", F.col("w0") + cfg.length)
    return out.where(coverage(F.col("w0"), F.col("w1"), F.col("s_ms"), F.col("e_ms")) <= cfg.partial_most).select("file_id", "span_id", "side", "w0", "w1")


def hop_starts(lo: Column, hi: Column, length: int, hop: int, tail: int) -> Column:
    """Starts at lo, lo + hop, ... that fit whole, and one right-aligned when ``tail`` or more remains behind the last."""
    n = F.floor((hi - lo - length) / hop)
    starts = F.transform(F.sequence(F.lit(0).cast("long"), n), lambda i: lo + i * hop)
    left = hi - (lo + n * hop + length)
    return F.when(hi - lo < length, F.array().cast("array<bigint>")).otherwise(F.when((left > 0) & (left >= tail), F.array_append(starts, hi - length)).otherwise(starts))


def free_between(files: DataFrame, guards: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, free_start, free_end): what no guard covers of each file (key, duration_ms), by a sweep over the guards' borders.

    Every guard opens at its start and closes at its end; guards of all classes are counted together, so they may lie in each other or overlap. Borders at one place are added up first, and a stretch is
    free where the running depth behind a border is 0. Guards that reach over a file's ends are cut there.
    """
    inside = guards.join(files.select(key, "duration_ms"), key)
    at = lambda c: F.least(F.greatest(F.col(c), F.lit(0)), F.col("duration_ms"))
    inside = inside.select(key, at(start).alias("a"), at(end).alias("b")).where("b > a")
    mark = lambda c, by: F.struct(c.cast("long").alias("t"), F.lit(by).alias("by"))
    marks = inside.select(key, F.explode(F.array(mark(F.col("a"), 1), mark(F.col("b"), -1))).alias("m"))
    ends = files.select(key, F.explode(F.array(mark(F.lit(0), 0), mark(F.col("duration_ms"), 0))).alias("m"))
    borders = marks.unionByName(ends).groupBy(key, F.col("m.t").alias("t")).agg(F.sum("m.by").alias("by"))
    w = W.partitionBy(key).orderBy("t")
    depths = borders.withColumns({"depth": F.sum("by").over(w.rowsBetween(W.unboundedPreceding, 0)), "free_end": F.lead("t").over(w)})
    return depths.where("depth = 0 AND free_end > t").select(key, F.col("t").alias("free_start"), "free_end")


def negative_windows(files: DataFrame, spans: DataFrame, cfg: WindowConfig = WindowConfig(), held: Column | None = None, chunks: DataFrame | None = None, positive: Column | None = None, blocked: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Windows in the free regions of each file (file_id, duration_ms), and the files that give none, with the reason.

    Guards are the spans widened by ``guard`` and, in files that are ``positive``, the speech ``chunks`` (file_id, s_ms, e_ms) widened by ``chunk_guard``. A file shorter than a window gets one
    centred window if nothing is guarded in it. Files that are ``held`` or ``blocked`` (an unresolved recording flag) give a reason only.
    """
    no, yes = F.lit(False), F.lit(True)
    files = files.withColumn("reason", F.when(no if held is None else held, "held_for_review").when(no if blocked is None else blocked, "blocked_by_flag"))
    open_files = files.where("reason IS NULL")
    wide = lambda df, by: df.select("file_id", (F.col("s_ms") - by).alias("s_ms"), (F.col("e_ms") + by).alias("e_ms"))
    guards = wide(spans, cfg.guard)
    if chunks is not None:
        guards = guards.unionByName(wide(chunks.join(open_files.where(yes if positive is None else positive).select("file_id"), "file_id", "left_semi"), cfg.chunk_guard))
    free = free_between(open_files, guards, "file_id", "s_ms", "e_ms")
    starts = hop_starts(F.col("free_start"), F.col("free_end"), cfg.length, cfg.hop, int(cfg.tail_share * cfg.length))
    regions = free.select("file_id", F.explode(starts).alias("w0")).withColumn("w1", F.col("w0") + cfg.length)
    short = open_files.where(F.col("duration_ms") < cfg.length).join(guards.select("file_id").distinct(), "file_id", "left_anti")
    short = short.select("file_id", F.floor((F.col("duration_ms") - cfg.length) / 2).alias("w0")).withColumn("w1", F.col("w0") + cfg.length)
    windows = linspace_cap(regions.unionByName(short), "file_id", ["w0"], cfg.cap)
    none = open_files.select("file_id").join(windows.select("file_id").distinct(), "file_id", "left_anti").withColumn("reason", F.lit("no_free_region"))
    return windows, none.unionByName(files.where("reason IS NOT NULL").select("file_id", "reason"))


def sliding_starts(total: Column, length: int, hop: int, end_aligned: bool = False) -> Column:
    return hop_starts(F.lit(0).cast("long"), total, length, hop, 1 if end_aligned else 1 << 60)


def frame_clip(df: DataFrame, duration: str, length: int, placement: str = "center", too_long: str = "sliding", hop: int = 750) -> DataFrame:
    """One row per frame: w0 and the padding before and after a short clip; a long one slides, or fails the job with ``too_long='error'``."""
    gap = F.greatest(F.lit(0), length - F.col(duration))
    before = {"start": F.lit(0).cast("long"), "center": F.floor(gap / 2), "end": gap}[placement]
    over = F.col(duration) > length
    starts = F.when(~over, F.array(F.lit(0).cast("long")))
    starts = starts.when(F.raise_error(F.lit("clip longer than the window")).cast("boolean"), None) if too_long == "error" else starts.otherwise(sliding_starts(F.col(duration), length, hop, True))
    return df.withColumn("pad_before", before).withColumn("pad_after", gap - before).withColumn("w0", F.explode(starts))


def window_record(df: DataFrame, label: str, duration: str, length: int) -> DataFrame:
    """The window's id, the span of the file that it holds, and its padding."""
    letter = F.when(F.col(label), "p").otherwise("n")
    return df.withColumns({
        "window_id": F.concat(F.col("file_id").cast("string"), F.lit("@"), F.col("w0").cast("string"), F.lit("ms_"), letter),
        "source_start": F.greatest(F.lit(0), F.col("w0")), "source_end": F.least(F.col(duration), F.col("w0") + length),
        "pad_before": F.greatest(F.lit(0), -F.col("w0")), "pad_after": F.greatest(F.lit(0), F.col("w0") + length - F.col(duration)),
    })


def random_windows(files: DataFrame, n: int, lo: int, hi: int, seed: int) -> DataFrame:
    """n windows per file with a length in [lo, hi) and a start drawn by hash; the whole file where it is shorter."""
    out = files.select("file_id", "duration_ms", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw"))
    size = F.floor(lo + uniform(F.lit(seed), F.col("file_id"), F.col("draw"), F.lit("length")) * (hi - lo))
    out = out.withColumn("size", F.least(size, F.col("duration_ms")))
    start = F.floor(uniform(F.lit(seed), F.col("file_id"), F.col("draw"), F.lit("start")) * (F.col("duration_ms") - F.col("size") + 1))
    return out.withColumn("w0", start).withColumn("w1", F.col("w0") + F.col("size")).drop("size")


def walk_windows(files: DataFrame, banned: DataFrame, length: int, after: int, most: int) -> DataFrame:
    """Windows of one length, one after another through the parts of a file that no banned span touches, ``most`` at most."""
    ranges = files.withColumn("lo", F.lit(0).cast("long"))
    free = subtract(ranges, banned.select("file_id", "s_ms", (F.col("e_ms") + after).alias("e_ms")), ["file_id"], "s_ms", "e_ms", "lo", "duration_ms")
    rows = free.select("file_id", F.explode(hop_starts(F.col("free_start"), F.col("free_end"), length, length, 1 << 60)).alias("w0"))
    w = W.partitionBy("file_id").orderBy("w0")
    return rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")


def fixed_slices(df: DataFrame, duration: str, length: int) -> DataFrame:
    return df.withColumn("slice", F.explode(F.when(F.col(duration) >= length, F.sequence(F.lit(0).cast("long"), F.floor(F.col(duration) / length) - 1)))).withColumn("offset", F.col("slice") * length)


def placement_check(df: DataFrame, key: str, t: str, lo: Column, hi: Column) -> DataFrame:
    """Per key: the smallest spacing and the Kolmogorov-Smirnov distance of the places from uniform."""
    w = W.partitionBy(key).orderBy(t)
    n = F.count("*").over(W.partitionBy(key))
    x = (F.col(t) - lo) / (hi - lo)
    told = df.withColumn("__gap", F.col(t) - F.lag(t).over(w)).withColumn("__hi", F.cume_dist().over(w)).withColumn("__lo", (F.rank().over(w) - 1) / n).withColumn("__x", x)
    return told.groupBy(key).agg(F.min("__gap").alias("min_gap"), F.max(F.greatest(F.abs(F.col("__hi") - F.col("__x")), F.abs(F.col("__x") - F.col("__lo")))).alias("ks"))
