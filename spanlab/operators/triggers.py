"""Score streams to triggers: smoothing, k of n, refractory period."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from spanlab.operators.ranks import islands, looking_back


def smooth(df: DataFrame, stream: str, t: str, score: str, k: int, into: str, tie: str | None = None) -> DataFrame:
    """Causal mean over the last k scores, fewer at the start."""
    return looking_back(df, [stream], t, k - 1, lambda window: {into: F.avg(score).over(window(-(k - 1), 0))}, [tie] if tie else [])


def reaching(score: str, threshold: float | Column, k: int, n: int, window: Callable) -> Column:
    """True where the score reaches the threshold and at least k of the last n scores of its ``window`` do."""
    if not 1 <= k <= n:
        raise ValueError(f"1 <= k <= n expected, not k={k}, n={n}")
    reached = (F.col(score) >= threshold).cast("int")
    return (reached == 1) & (F.sum(reached).over(window(-(n - 1), 0)) >= k)


def k_of_n(df: DataFrame, stream: str, t: str, score: str, threshold: float | Column, k: int, n: int, into: str, tie: str | None = None) -> DataFrame:
    """``into``: whether the score reaches the threshold and at least k of the last n scores do."""
    return looking_back(df, [stream], t, n - 1, lambda window: {into: reaching(score, threshold, k, n, window)}, [tie] if tie else [])


def refractory(cands: DataFrame, streams: list[str], t: str, gap: int, payload: list[str], tie: str | None = None, counted: DataFrame | None = None) -> DataFrame:
    """Keep a candidate when at least ``gap`` has passed since the last one that was kept.

    A candidate that comes ``gap`` or more after the one before it is always kept, whatever happened earlier, so candidates fall into
    islands there, and islands are dealt to tasks apart. Inside an island a walk over sorted batches leaps from each kept one to the first that
    is far enough behind it: it holds one time, however long the island is.
    """
    return refractory_levels(cands.withColumn("__level", F.lit(1)), streams, t, gap, payload, 1, tie, counted).drop("level")


def refractory_levels(cands: DataFrame, streams: list[str], t: str, gap: int, payload: list[str], levels: int, tie: str | None = None, counted: DataFrame | None = None) -> DataFrame:
    """The same for ``levels`` detectors at once, of which a candidate counts for the first ``__level``: the kept ones of each, with their ``level`` from 0.

    Whoever counts for a level counts for those below it, so islands of the lowest one part all others too, and one walk holds the last kept time of every level. Candidates
    are neither copied nor moved once a level. A stream with many candidates is dealt to ranges of time before (``counted``: the rows that candidates were chosen from).
    """
    order = [x for x in (t, tie) if x]
    cols = [*streams, *order, *[c for c in payload if c not in order]]
    far = lambda last: F.coalesce(F.col(t) - last >= gap, F.lit(True))
    isles = islands(cands.select(*cols, F.col("__level").cast("int").alias("__level")), streams, t, F.col(t), far, order[1:], counted).withColumnsRenamed({"island": "__island", "begins": "__first"})
    dealt = isles.repartition(*streams, "__island").sortWithinPartitions(*streams, "__island", *order)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list = [None] * levels
        for b in batches:
            column = lambda name: b.column(b.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
            every, island, reach = column(t), np.cumsum(column("__first")), column("__level")
            kept, told = [], []
            for level in range(levels):
                mine = np.flatnonzero(reach > level)
                times, heads = every[mine], island[mine]
                # Rows before the first head (island 0) go on with the island of the batch before.
                edges = np.flatnonzero(np.diff(heads)) + 1
                for at, end in zip(np.append(0, edges), np.append(edges, len(times))):
                    if at < end and heads[at]:
                        last[level] = None
                    while at < end:
                        if last[level] is not None:
                            at += np.searchsorted(times[at:end], last[level] + gap)
                            if at >= end:
                                break
                        kept.append(mine[at])
                        told.append(level)
                        last[level] = times[at]
                        at += 1
                # An island may go on in the next batch without this level's rows in it: what was kept in an older one is over.
                if len(island) and island[-1] and (not len(heads) or heads[-1] != island[-1]):
                    last[level] = None
            out = b.take(pa.array(kept, pa.int64())).select(cols)
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(told, pa.int32())], names=[*cols, "level"])

    return dealt.mapInArrow(walk, dealt.select(*cols).schema.add("level", IntegerType()))


def detect(scores: DataFrame, stream: str, t: str, score: str, threshold: float, gap: int, k: int = 1, n: int = 1, smoothing: int = 1, tie: str | None = None) -> DataFrame:
    """Triggers of every stream: stream, t, score and the tie key."""
    used = "__smooth" if smoothing > 1 else score

    def told(window: Callable) -> dict[str, Column]:
        smoothed = {used: F.avg(score).over(window(-(smoothing - 1), 0))} if smoothing > 1 else {}
        return {**smoothed, "__on": reaching(used, threshold, k, n, window)}

    flagged = looking_back(scores, [stream], t, smoothing + n - 2, told, [tie] if tie else []).where("__on")
    return refractory(flagged.withColumn(score, F.col(used)), [stream], t, gap, [x for x in (score, tie) if x], tie, counted=scores)
