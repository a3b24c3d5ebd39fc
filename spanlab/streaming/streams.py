"""Structured Streaming forms: sliding windows, triggers, capture sessions, running counts, dedup, late data.

Event time is a timestamp column under a watermark (10 seconds late unless told otherwise). Rows that come later than that are dropped and counted
(``late_rows``). Triggers and captures depend on the order of a stream's rows, so its rows wait in state until the watermark has
passed them and are then taken in time order: results don't depend on how rows are cut into batches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import gcd

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from spanlab.sources.shared import fresh_path

LATE = "10 seconds"


#: Where stateful processors keep their state: on executors' disks, with a changelog in the checkpoint.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _timer(handle: StatefulProcessorHandle, at_ms: int, now_ms: int) -> None:
    """One timer at a time, the earliest asked for."""
    at_ms, set_ = max(at_ms, now_ms + 1), [t for t in handle.listTimers() if t > now_ms]
    if not set_ or at_ms < min(set_):
        for old in set_:
            handle.deleteTimer(old)
        handle.registerTimer(at_ms)


def _micros_since(size: str) -> int:
    """Microseconds of a length of time such as ``30 minutes``."""
    n, unit = size.split()
    return round(float(n) * {"microsecond": 1, "millisecond": 1000, "second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 86_400 * 10**6}[unit.rstrip("s")])


#: Lots that streams are dealt to by a hash. A lot keeps the state of all its streams together, as every call of a state store costs far more than a stream's work.
LOTS = 1024


def _in_lots(rows: DataFrame) -> DataFrame:
    """Rows with the lot of their ``key``, which becomes a text, so that any type and null can stand in state."""
    return rows.withColumn("lot", F.pmod(F.xxhash64("key"), F.lit(LOTS)).cast("int")).withColumn("key", F.col("key").cast("string"))


def _together(parts: list) -> list[np.ndarray]:
    """Columns of several pieces, each a tuple of (keys, numbers, ...), put end to end."""
    columns = list(zip(*parts))
    return [np.array([k for part in columns[0] for k in part], object), *[np.concatenate([np.asarray(x) for x in c]) for c in columns[1:]]]


class PaneWindows(StatefulProcessor):
    """Windows of the streams of one lot, each by its own schedule: they start at its first row and every slide from there.

    Rows wait until the watermark has passed the first of them, as an earlier one may come till then. From there on the origin stands, and a row goes into its pane: count, sum,
    maximum. A window is put together from its panes when the watermark has passed its end; panes that no later window needs go. State: a stream's panes of one window, and rows of
    the latest batches.
    """

    def __init__(self, size: int, slide: int):
        self.size, self.slide, self.pane = size, slide, gcd(size, slide)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.heads = handle.getValueState("heads", "key array<string>, origin array<long>, following array<long>")
        self.waiting = handle.getListState("waiting", "key array<string>, t array<long>, value array<double>")
        self.panes = handle.getValueState("panes", "stream array<int>, pane array<long>, n array<long>, total array<double>, top array<double>")

    def handleInputRows(self, key, rows, timerValues):
        got = pd.concat(list(rows))
        times = got["t"].to_numpy(np.int64)
        self.waiting.appendValue((got["key"].tolist(), times.tolist(), got["value"].to_numpy(float).tolist()))
        _timer(self.handle, int(times.min()) // 1000 + 1, timerValues.getCurrentWatermarkInMs())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        heads, panes = self.heads.get() or ([], [], []), self.panes.get() or ([], [], [], [], [])
        names, times, values = _together([([], np.zeros(0, np.int64), np.zeros(0)), *self.waiting.get()])
        known = len(heads[0])
        stream, named = pd.factorize(np.concatenate([np.array(list(heads[0]), object), names]), use_na_sentinel=False)
        stream = stream[known:]
        origin, following = np.full(len(named), np.iinfo(np.int64).max), np.zeros(len(named), np.int64)
        origin[:known], following[:known] = heads[1], heads[2]
        first = origin.copy()
        np.minimum.at(first, stream, times)
        begun = (np.arange(len(named)) < known) | (first // 1000 + 1 <= now)
        origin = np.where(np.arange(len(named)) < known, origin, first)
        folded = begun[stream]
        pieces = [pd.DataFrame({"s": np.array(panes[0], np.int64), "p": np.array(panes[1], np.int64), "n": np.array(panes[2], np.int64), "total": np.array(panes[3], float), "top": np.array(panes[4], float)})]
        mine = stream[folded]
        pieces.append(pd.DataFrame({"s": mine, "p": (times[folded] - origin[mine]) // self.pane, "n": 1, "total": values[folded], "top": values[folded]}))
        held = pd.concat(pieces).groupby(["s", "p"], as_index=False).agg({"n": "sum", "total": "sum", "top": "max"})
        per, step = self.size // self.pane, self.slide // self.pane
        s, p = held["s"].to_numpy(np.int64), held["p"].to_numpy(np.int64)
        done = following.copy()
        done[s] = np.maximum(following[s], (now * 1000 - self.size - origin[s]) // self.slide + 1)
        # Only windows that a pane lies in: a stream may be silent for long.
        lo = np.maximum(following[s], -(-(p - per + 1) // step))
        times_in = np.maximum(np.minimum(done[s], p // step + 1) - lo, 0)
        at = np.repeat(np.arange(len(held)), times_in)
        w = lo[at] + np.arange(len(at)) - np.repeat(np.cumsum(times_in) - times_in, times_in)
        told = held.iloc[at].assign(w=w).groupby(["s", "w"], as_index=False).agg({"n": "sum", "total": "sum", "top": "max"})
        left = held[p >= done[s] * step]
        # Streams that haven't begun stay with their rows; the others are numbered anew.
        number = np.cumsum(begun) - 1
        self.heads.update(([named[i] if isinstance(named[i], str) else None for i in np.flatnonzero(begun)], origin[begun].tolist(), done[begun].tolist()))
        ls = left["s"].to_numpy(np.int64)
        self.panes.update((number[ls].tolist(), left["p"].tolist(), left["n"].tolist(), left["total"].tolist(), left["top"].tolist()))
        wake = []
        if len(left):
            ends = origin[ls] + np.maximum(done[ls], (left["p"].to_numpy(np.int64) - per) // step) * self.slide + self.size
            wake.append(-(-int(ends.min()) // 1000))
        if folded.all():
            self.waiting.clear()
        else:
            self.waiting.put([(names[~folded].tolist(), times[~folded].tolist(), values[~folded].tolist())])
            wake.append(int(times[~folded].min()) // 1000 + 1)
        if wake:
            _timer(self.handle, min(wake), now)
        if len(told):
            who = told["s"].to_numpy(np.int64)
            start = origin[who] + told["w"].to_numpy(np.int64) * self.slide
            keys = np.where(pd.isna(named[who]), None, named[who])
            yield pd.DataFrame({"key": keys, "w_start": start, "w_end": start + self.size, "n": told["n"], "total": told["total"], "max_value": told["top"]})

    def close(self) -> None:
        pass


def sliding_windows(rows: DataFrame, key: str, ts: str, size: str, slide: str, value: str, late: str = LATE) -> DataFrame:
    """Every complete window that holds rows, once: (key, w_start, w_end, n, mean_value, max_value).

    A key's windows start at its first row and every ``slide`` from there, so none begins before it. Rows are summed into panes (the common divisor of size and slide) and
    panes into windows. A stream's window is complete when the watermark has passed its end, a table's when the table's newest row has reached it. Rows without a key, time or
    value are left out.
    """
    width, hop = _micros_since(size), _micros_since(slide)
    used = rows.where(F.col(ts).isNotNull() & F.col(key).isNotNull() & F.col(value).isNotNull())
    back = F.timestamp_micros
    if rows.isStreaming:
        marked = used.select(F.col(key).alias("key"), F.col(ts).alias("ts"), F.unix_micros(ts).alias("t"), F.col(value).cast("double").alias("value")).withWatermark("ts", late)
        kind = dict(marked.dtypes)["key"]
        out = _in_lots(marked).groupBy("lot").transformWithStateInPandas(PaneWindows(width, hop), "key string, w_start long, w_end long, n long, total double, max_value double", "append", "eventTime")
        out = out.withColumn("key", F.col("key").cast(kind))
    else:
        g = gcd(width, hop)
        per, step = width // g, hop // g
        micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(`{ts}` AS TIMESTAMP_NTZ))") if dict(rows.dtypes)[ts] == "timestamp_ntz" else F.unix_micros(ts)
        timed = used.select(F.col(key).alias("key"), micros.alias("t"), F.col(value).cast("double").alias("value"))
        back = (lambda c: F.timestamp_micros(c).cast("timestamp_ntz")) if dict(rows.dtypes)[ts] == "timestamp_ntz" else back
        origins = timed.groupBy("key").agg(F.min("t").alias("origin"))
        pane = F.floor((F.col("t") - F.col("origin")) / g)
        panes = timed.join(origins, "key").groupBy("key", "origin", pane.alias("pane")).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("max_value"))
        inside = F.sequence(F.greatest(F.ceil((F.col("pane") - (per - 1)) / step), F.lit(0)), F.floor(F.col("pane") / step))
        windows = panes.where(F.floor(F.col("pane") / step) * step + per > F.col("pane")).withColumn("w", F.explode(inside)).groupBy("key", "origin", "w").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("max_value").alias("max_value"))
        newest = timed.agg(F.max("t").alias("newest"))
        start = F.col("origin") + F.col("w") * hop
        out = windows.crossJoin(F.broadcast(newest)).where(start + width <= F.col("newest")).select("key", start.alias("w_start"), (start + width).alias("w_end"), "n", "total", "max_value")
    mean = F.col("total") / F.col("n")
    return out.select(F.col("key").alias(key), back("w_start").alias("w_start"), back("w_end").alias("w_end"), "n", mean.alias("mean_value"), "max_value")


class InOrder(StatefulProcessor):
    """The rows of each stream of one lot, in the order of time, through ``step`` once the watermark has passed them.

    A batch appends its rows to those that wait and reads none of them; when the watermark passes the first, those that it has passed go on and the rest, no more than
    the rows within the allowed lateness, is put back. What ``step`` carries on for each stream stands in arrays, one place a stream.
    """

    def __init__(self, names: list[str], kinds: list[str], step: Callable, start: Callable, kept: str, out: list[str]):
        self.names, self.kinds, self.step, self.start, self.kept, self.out = names, kinds, step, start, kept, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        kept = [x.split(" ", 1) for x in self.kept.split(", ")]
        self.own = handle.getValueState("own", ", ".join(["key array<string>", *[f"{n} array<{k}>" for n, k in kept]]))
        self.waiting = handle.getListState("waiting", ", ".join(["key array<string>", *[f"h{i} array<{k}>" for i, k in enumerate(self.kinds)]]))

    def handleInputRows(self, key, rows, timerValues):
        got = pd.concat(list(rows))
        columns = [got[n].to_numpy() for n in self.names]
        self.waiting.appendValue((got["key"].tolist(), *[c.tolist() for c in columns]))
        _timer(self.handle, int(columns[0].min()) // 1000 + 1, timerValues.getCurrentWatermarkInMs())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = timerValues.getCurrentWatermarkInMs()
        names, *held = _together(list(self.waiting.get()))
        ready = held[0] < mark * 1000
        if ready.all():
            self.waiting.clear()
        else:
            self.waiting.put([(names[~ready].tolist(), *[h[~ready].tolist() for h in held])])
            _timer(self.handle, int(held[0][~ready].min()) // 1000 + 1, mark)
        stream, named = pd.factorize(names[ready], use_na_sentinel=False)
        held = [h[ready] for h in held]
        order = np.lexsort([*held[:0:-1], held[0], stream])
        held, ends = [h[order] for h in held], np.cumsum(np.bincount(stream, minlength=len(named)))
        own = self.own.get()
        own = {k: list(mine) for k, *mine in zip(*own)} if own is not None else {}
        told = []
        for name, first, end in zip(named, [0, *ends[:-1].tolist()], ends.tolist()):
            name = name if isinstance(name, str) else None
            own[name], out = self.step(own[name] if name in own else self.start(), [h[first:end] for h in held])
            told += [(name, *x) for x in out]
        self.own.update((list(own), *[list(x) for x in zip(*own.values())]))
        if told:
            yield pd.DataFrame(told, columns=["key", *self.out])

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, key: str, ts: str, t: str, cols: dict[str, str], late: str, step: Callable, start: Callable, kept: str, out: str) -> DataFrame:
    """``step`` over the rows of each key in the order of ``t`` (microseconds of ``ts``), once the watermark has passed them.

    ``step(state, columns)`` gets numpy columns of (t, *cols), sorted, and returns the new state and output rows; ``start()`` is the first state. ``kept`` is the
    state's schema and ``out`` that of the output behind the key. The query needs the state store of STORE, which ``run_to_table`` sets.
    """
    names = [c.split()[0] for c in out.split(", ")]
    kind = dict(rows.dtypes)[key]
    marked = rows.select(F.col(key).alias("key"), F.col(ts).alias("__ts"), t, *[F.col(c).cast(k).alias(c) for c, k in cols.items()]).withWatermark("__ts", late)
    processor = InOrder([t, *cols], ["long", *cols.values()], step, start, kept, names)
    return _in_lots(marked).groupBy("lot").transformWithStateInPandas(processor, f"key string, {out}", "append", "eventTime").select(F.col("key").cast(kind).alias(key), *names)


def stream_triggers(rows: DataFrame, stream: str, ts: str, threshold: float, gap_us: int, k: int, n: int, late: str = LATE) -> DataFrame:
    """k-of-n triggers with a refractory period over rows of (stream, ts, t_us, score, event_id), continuously. State: the last n flags and the last trigger."""

    def step(own: list, columns: list) -> tuple[list, list]:
        flags, last = own
        t, score, event = columns
        at, flags = _reached(flags, score >= threshold, k, n)
        out = []
        for i in at.tolist():
            if last is None or t[i] - last >= gap_us:
                last = int(t[i])
                out.append((last, float(score[i]), int(event[i])))
        return [flags, last], out

    return in_order(rows, stream, ts, "t_us", {"score": "double", "event_id": "long"}, late, step, lambda: ["", None], "flags string, last long", "t_us long, score double, event_id long")


def _reached(flags: str, on: np.ndarray, k: int, n: int) -> tuple[np.ndarray, str]:
    """Rows that are on with at least k of the last n on, behind ``flags`` of the rows before, and the flags for the next ones."""
    before = np.frombuffer(flags.encode(), np.uint8) == ord("1")
    every = np.concatenate([before, on]).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(every)])
    end = np.arange(len(before), len(every)) + 1
    among = total[end] - total[np.maximum(end - n, 0)]
    return np.flatnonzero(on & (among >= k)), "".join("1" if x else "0" for x in every[len(every) - min(n, len(every)) :])


@dataclass(frozen=True)
class CaptureConfig:
    """Rules of a capture; times in microseconds, levels in dB. The values given here are fixed ones, as are QUIETEST and SHARE."""

    ignore_us: int = 300_000
    smooth_rows: int = 5
    start_margin: float = 10.0
    continue_margin: float = 5.0
    speech_rows: int = 8
    silence_us: int = 800_000
    longest_us: int = 8_000_000
    wait_us: int = 4_000_000
    cooldown_us: int = 1_000_000
    background_us: int = 10_000_000
    background_rows: int = 25
    quiet: float = -60.0


#: The power added before a logarithm, and the per cent point of levels that is the background.
QUIETEST, SHARE = 1e-18, 20

CAPTURE_STATE = "floor_t array<long>, floor_db array<double>, powers array<double>, opened long, started long, spoken long, speech int, cooled long, flags string"


class Captures:
    """One stream's phases over sorted columns of (t, level, *marks): listening up to the row that opens a capture, and the capture up to the row that ends it.

    While listening, levels of the last ``background_us`` are kept; their SHARE per cent point is the background of the next capture (``quiet`` under
    ``background_rows`` of them). ``opens(captures, t, marks)`` finds the row behind the cooldown that opens one. In a capture, levels are averaged as powers over
    ``smooth_rows``; a row is speech from ``start_margin`` above the background on, and from ``continue_margin`` once ``speech_rows`` of them have started the command. The first
    ``ignore_us`` don't count. A capture ends after ``silence_us`` without speech, at ``longest_us`` from its start, or where nothing started for ``wait_us``; then the cooldown begins.
    Each phase is found at once in arrays, not row by row.
    """

    def __init__(self, own: list, cfg: CaptureConfig, opens: Callable):
        floor_t, floor_db, powers, self.opened, self.started, self.spoken, self.speech, self.cooled, self.flags = own
        self.floor_t, self.floor_db, self.powers = np.array(floor_t, np.int64), np.array(floor_db, float), np.array(powers, float)
        self.cfg, self.opens, self.out = cfg, opens, []

    def own(self) -> list:
        return [self.floor_t.tolist(), self.floor_db.tolist(), self.powers.tolist(), self.opened, self.started, self.spoken, self.speech, self.cooled, self.flags]

    def walk(self, columns: list) -> None:
        while len(columns[0]):
            used = self._listen(*columns) if self.opened is None else self._capture(*columns[:2])
            columns = [c[used:] for c in columns]

    def _listen(self, t: np.ndarray, level: np.ndarray, *marks: np.ndarray) -> int:
        at = self.opens(self, t, marks)
        used = len(t) if at is None else at + 1
        heard = np.concatenate([self.floor_t, t[:used]])
        old = np.searchsorted(heard, heard[-1] - self.cfg.background_us, "right")
        self.floor_t, self.floor_db = heard[old:], np.concatenate([self.floor_db, level[:used]])[old:]
        if at is not None:
            self.opened, self.started, self.spoken, self.speech, self.powers = int(t[at]), None, None, 0, np.zeros(0)
        return used

    def _smooth(self, level: np.ndarray) -> np.ndarray:
        """Levels averaged as powers over the last rows of this capture."""
        rows, before = self.cfg.smooth_rows, len(self.powers)
        power = np.concatenate([self.powers, 10 ** (level / 10)])
        total, seen = np.zeros(len(level)), np.minimum(np.arange(before, len(power)) + 1, rows)
        for back in range(rows - 1, -1, -1):
            from_ = np.arange(before, len(power)) - back
            total = total + np.where(from_ >= 0, power[np.maximum(from_, 0)], 0.0)
        self.powers = power[len(power) - min(rows, len(power)) :]
        return 10 * np.log10(total / seen + QUIETEST)

    def _capture(self, t: np.ndarray, level: np.ndarray) -> int:
        cfg = self.cfg
        # It ends no later than this, so rows behind it are not looked at.
        far = int(np.searchsorted(t, self.opened + cfg.wait_us + cfg.longest_us, "left")) + 1
        t, smooth = t[:far], self._smooth(level[:far])
        background = float(np.percentile(self.floor_db, SHARE)) if len(self.floor_db) >= cfg.background_rows else cfg.quiet
        loud = lambda margin: (t - self.opened >= cfg.ignore_us) & (smooth >= background + margin)
        start = 0
        if self.started is None:
            speech = loud(cfg.start_margin)
            count = self.speech + np.cumsum(speech)
            begun, waited = np.flatnonzero(speech & (count >= cfg.speech_rows)), np.flatnonzero(t - self.opened >= cfg.wait_us)
            if not len(begun) or len(waited) and waited[0] < begun[0]:
                if len(waited):
                    return self._end(t, int(waited[0]), "no_speech")
                self.speech = int(count[-1])
                return len(t)
            start = int(begun[0])
            self.started = self.spoken = int(t[start])
        said = loud(cfg.continue_margin)
        said[:start] = False
        spoken = np.maximum.accumulate(np.where(said, t, self.spoken))[start:]
        silent, long = t[start:] - spoken >= cfg.silence_us, t[start:] - self.started >= cfg.longest_us
        over = np.flatnonzero(silent | long)
        if len(over):
            return self._end(t, start + int(over[0]), "end_of_speech" if silent[over[0]] else "max_length")
        self.spoken = int(spoken[-1])
        return len(t)

    def _end(self, t: np.ndarray, at: int, reason: str) -> int:
        self.out.append((self.opened, int(t[at]), reason))
        self.opened, self.cooled, self.powers, self.flags = None, int(t[at]) + self.cfg.cooldown_us, np.zeros(0), ""
        return at + 1


def _captured(rows: DataFrame, stream: str, ts: str, marks: dict[str, str], cfg: CaptureConfig, opens: Callable, late: str) -> DataFrame:
    def step(own: list, columns: list) -> tuple[list, list]:
        c = Captures(own, cfg, opens)
        c.walk(columns)
        return c.own(), c.out

    return in_order(rows, stream, ts, "t_us", {"level": "double", **marks}, late, step, lambda: [[], [], [], None, None, None, 0, 0, ""], CAPTURE_STATE, "start_t long, end_t long, reason string")


def capture_sessions(rows: DataFrame, stream: str, ts: str, cfg: CaptureConfig = CaptureConfig(), late: str = LATE) -> DataFrame:
    """Captures after trigger rows: (stream, start_t, end_t, reason) from rows of (stream, ts, t_us, level, is_trigger); rules in ``Captures``."""

    def opens(c: Captures, t: np.ndarray, marks: list) -> int | None:
        found = np.flatnonzero(marks[0].astype(bool) & (t >= c.cooled))
        return int(found[0]) if len(found) else None

    return _captured(rows, stream, ts, {"is_trigger": "boolean"}, cfg, opens, late)


def device_sessions(rows: DataFrame, stream: str, ts: str, threshold: float, k: int, n: int, cfg: CaptureConfig = CaptureConfig(), late: str = LATE) -> DataFrame:
    """Triggers and captures in one state, as a device has them: (stream, start_t, end_t, reason) from rows of (stream, ts, t_us, level, score).

    A capture opens at a score that reaches the threshold with at least k of the last n scores doing so. Scores of a capture and its cooldown are not
    among them, as the device doesn't score then, and those from before it are forgotten.
    """

    def opens(c: Captures, t: np.ndarray, marks: list) -> int | None:
        first = int(np.searchsorted(t, c.cooled, "left"))
        on = marks[0][first:] >= threshold
        found, after = _reached(c.flags, on, k, n)
        if not len(found):
            c.flags = after
            return None
        c.flags = _reached(c.flags, on[: found[0] + 1], k, n)[1]
        return first + int(found[0])

    return _captured(rows, stream, ts, {"score": "double"}, cfg, opens, late)


def running_metrics(rows: DataFrame, key: str, false_accept: Column, hours: Column) -> DataFrame:
    """Counts and false accepts per hour so far, in update mode."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.count_if(false_accept).alias("false_accepts"), F.max(hours).alias("hours")).withColumn("fa_per_hour", F.when(F.col("hours") > 0, F.col("false_accepts") / F.col("hours")))


def dedupe_by_seq(rows: DataFrame, key: str, ts: str, late: str = LATE) -> DataFrame:
    """The first answer of each key within the watermark."""
    if rows.isStreaming:
        return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
    return rows.dropDuplicates([key])


def late_rows(query: StreamingQuery) -> int:
    """Rows that a query dropped because the watermark had passed them, over the batches that its progress still tells of (100 unless configured otherwise)."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def run_to_table(stream: DataFrame, name: str, mode: str = "append", query: list | None = None) -> DataFrame:
    """Run a stream over what its source has now, into files of the shared folder, and read them.

    In append mode they are a parquet sink's; in complete mode every batch writes its whole result beside the others and the last one counts. Only executors
    touch rows. ``query`` gets the finished StreamingQuery.
    """
    spark = stream.sparkSession
    path = fresh_path(spark, name)
    spark.conf.set(*STORE)
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", fresh_path(spark, f"{name}-checkpoint"))
    if mode == "append":
        q = writer.format("parquet").start(path)
    else:
        q = writer.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")).start()
    q.awaitTermination()
    if query is not None:
        query.append(q)
    try:
        out = spark.read.schema(stream.schema).parquet(path) if mode == "append" else spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], stream.schema)
    if mode == "append":
        return out
    last = out.agg(F.max("batch")).first()[0]  # one number, from the folders' names
    return out.where(F.col("batch") == last).drop("batch")
