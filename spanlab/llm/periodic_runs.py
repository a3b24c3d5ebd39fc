"""Periodic runs of words, by branching tandem repeats in an enhanced suffix array.

A run is a stretch of words with smallest period q and at least max(SHORTEST, COPIES * q) words that no neighbouring word extends. Texts are numbered word by
word, several in one array with a separator behind each, whose words differ from all others, so that nothing reaches from one text into another.

1. The suffix array comes from prefix doubling: only groups of suffixes that are still equal are sorted again. LCP values come from the ranks of the doublings.
2. Bounds of LCP intervals are the nearest smaller values on both sides, found for all places at once; no tree is built. An interval with fewer
   than COPIES suffixes holds no run.
3. In each interval of depth q, every suffix i of a child other than the largest asks the inverse suffix array whether i + q and i - q stand in the interval but
   in another child. If so, a square of period q starts there that the next word ends (a branching tandem repeat). Two and more periods
   ahead of it the same question tells whether COPIES copies stand there.
4. Squares are rotated to the left while the word ahead agrees, which gives the run's start. Squares of a multiple of the period have the same start and end
   and are merged with it.

Every text is a row of its own and is taken whole: one task needs memory for its longest text only. Null and empty texts have no words and no
run. Ties for the strongest run go to the smallest start, then period. Equal rows get equal results; other columns are not read; an empty table gives an
empty result. A null doc_id plants nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from spanlab.llm.common import read_table

#: Least words of a run, and least number of periods.
SHORTEST, COPIES = 6, 4
#: Words that share one suffix array; a longer text has one of its own.
TOGETHER = 1 << 18


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, rank, lcp) of the suffixes of ``ids`` that begin with a number that occurs twice; others come out in some order too, each alone. ``lcp[j]`` is that of order[j - 1] and order[j]. No number that ends a text may occur twice."""
    n = len(ids)
    order = np.argsort(ids, kind="stable").astype(np.int32)
    # A group's rank is the place where it begins.
    new = np.r_[True, ids[order[1:]] != ids[order[:-1]]] if n else np.empty(0, bool)
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0)) if n else 0
    levels, h = [rank.copy()], 1
    while True:
        alone = new & np.r_[new[1:], True]
        at = np.flatnonzero(~alone)
        if not len(at):
            break
        some = order[at]
        # Suffixes of one group agree in h words, none of which ends a text: the suffix h further on exists.
        key = rank[some].astype(np.int64) * (n + 1) + rank[some + h]
        by = np.argsort(key, kind="stable")
        order[at], key = some[by], key[by]
        new[at] = np.r_[True, key[1:] != key[:-1]]
        rank[order[at]] = np.maximum.accumulate(np.where(new[at], at, 0)).astype(np.int32)
        levels.append(rank.copy())
        h *= 2
    lcp = np.zeros(n, np.int32)
    j = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    a, b, common = order[j - 1].copy(), order[j].copy(), np.zeros(len(j), np.int32)
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][a] == levels[k][b]
        step = same.astype(np.int32) << k
        a, b, common = a + step, b + step, common + step
    lcp[j] = common
    return order, rank, lcp


def _next_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the next one with a smaller value. All places look ahead at once, each by the place that the one it meets has reached. The last value must be smaller than all others."""
    ahead = np.minimum(np.arange(1, len(values) + 1), len(values) - 1)
    open_ = np.arange(len(values) - 1)
    while len(open_):
        open_ = open_[values[ahead[open_]] >= values[open_]]
        ahead[open_] = ahead[ahead[open_]]
    return ahead


def _intervals(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places between children of LCP intervals of COPIES suffixes or more, with the intervals' first and last suffix, in the order of intervals."""
    at = np.flatnonzero(lcp > 0)
    # Whole stretches of positive values stand together, each between zeros.
    gap = np.flatnonzero(np.r_[True, at[1:] != at[:-1] + 1]) if len(at) else at
    flat = np.insert(lcp[at], gap, 0)
    place = np.insert(at, gap, at[gap] - 1)
    flat, place = np.r_[flat, 0, -1], np.r_[place, 0, 0]
    m = len(flat)
    right = _next_smaller(flat)
    back = np.r_[flat[:-1][::-1], -1]
    left = (m - 2) - _next_smaller(back)[: m - 1][::-1]
    inner = np.flatnonzero(flat[:-1] > 0)
    width = right[inner] - left[inner]
    inner = inner[width >= COPIES]
    j = place[inner]
    first, last = j - (inner - left[inner]), j + (right[inner] - inner) - 1
    by = np.lexsort((j, last, first))
    return j[by], first[by], last[by]


def squares(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of the branching squares with COPIES - 2 more copies right ahead of them."""
    order, rank, lcp = suffix_array(ids)
    j, first, last = _intervals(lcp)
    if not len(j):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    depth = lcp[j].astype(np.int64)
    opens = np.r_[True, (first[1:] != first[:-1]) | (last[1:] != last[:-1])]
    # Children of an interval: from its first suffix to the first place, from place to place, and to its last suffix.
    lo = np.concatenate([first[opens], j])
    hi = np.concatenate([j[opens], np.where(np.r_[opens[1:], True], last + 1, np.r_[j[1:], 0])])
    number = np.cumsum(opens) - 1
    own = np.concatenate([np.arange(opens.sum()), number])
    f, l, d = first[opens], last[opens], depth[opens]
    size = hi - lo
    largest = np.lexsort((-size, own))
    largest = largest[np.r_[True, own[largest][1:] != own[largest][:-1]]]
    small = np.ones(len(lo), bool)
    small[largest] = False
    lo, hi, own, size = lo[small], hi[small], own[small], size[small]
    # Every suffix of the smaller children, with its child and interval.
    child = np.repeat(np.arange(len(lo)), size)
    i = order[np.repeat(lo - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())].astype(np.int64)
    q, a, b = d[own][child], f[own][child], l[own][child]
    n = len(ids)

    def inside(x: np.ndarray, at: slice | np.ndarray) -> np.ndarray:
        r = rank[np.clip(x, 0, n - 1)]
        return (x >= 0) & (x < n) & (r >= a[at]) & (r <= b[at])

    found = []
    for other, start in ((i + q, i), (i - q, i - q)):
        r = rank[np.clip(other, 0, n - 1)]
        hit = np.flatnonzero(inside(other, slice(None)) & ((r < lo[child]) | (r >= hi[child])))
        for k in range(1, COPIES - 1):
            hit = hit[inside(start[hit] - k * q[hit], hit)]
        found.append(np.stack([start[hit], q[hit]]))
    both = np.unique(np.concatenate(found, axis=1), axis=1)
    return both[0], both[1]


def _rotated(ids: np.ndarray, x: int, q: int) -> int:
    """The start of the run that a square at ``x`` ends."""
    step = 64
    while x > 0:
        k = min(step, x)
        same = ids[x - k : x] == ids[x - k + q : x + q]
        if not same.all():
            return x - int(np.argmin(same[::-1]))
        x, step = x - k, 2 * step
    return x


def runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    x, q = squares(ids)
    by = np.lexsort((q, x + 2 * q))
    least: dict[tuple[int, int], int] = {}
    end, held = -1, []
    for x, q in zip(x[by].tolist(), q[by].tolist()):
        if x + 2 * q != end:
            end, held = x + 2 * q, []
        # A multiple of a period whose run holds the whole square adds nothing.
        if not any(s <= x and q % p == 0 for s, p in held):
            start = _rotated(ids, x, q)
            held.append((start, q))
            least.setdefault((start, end), q)
    return sorted((s, e - s, q) for (s, e), q in least.items() if e - s >= max(SHORTEST, COPIES * q))


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with a periodic stretch written into one document of ten, by a checksum of its number."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[: n - a]


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds behind its first period."""
    if not found:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for s, length, q in found:
        gone[s + q] += 1
        gone[s + length] -= 1
    return [w for w, g in zip(words, np.cumsum(gone)) if not g]


def runs_of_texts(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, by one suffix array for all of them."""
    numbers: list[int] = [0]
    begins = []
    top = 1
    for words in texts:
        begins.append(len(numbers))
        known: dict[bytes, int] = {}
        numbers += [known.setdefault(w, top + len(known)) for w in words]
        top += len(known)
        numbers.append(top)
        top += 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    found = runs(np.array(numbers, np.int64))
    for (s, length, q), k in zip(found, np.searchsorted(begins, [r[0] for r in found], "right") - 1):
        out[k].append((s - begins[k], length, q))
    return out


def _strongest(found: list[tuple[int, int, int]]) -> tuple:
    best = None
    for s, length, q in found:
        if best is None or length * best[2] > best[1] * q:
            best = (s, length, q)
    return (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])


def _row(doc_id, words: list[bytes], found: list[tuple[int, int, int]]) -> tuple:
    told = "".join(f"{s},{length},{q}\n" for s, length, q in found).encode()
    return (doc_id, len(found), *_strongest(found), sha256(told).hexdigest(), sha256(b" ".join(collapsed(words, found))).hexdigest(), found)


NAMES = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs"]
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>"


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """One row for each row of (doc_id, text): number of runs, the strongest, all of them, and digests of them and of the words left."""

    def table(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=NAMES)
        out[NAMES[0]] = out[NAMES[0]].astype("Int64")
        out["runs"] = [[dict(zip(("start", "length", "period"), r)) for r in f] for f in out["runs"]]
        return out.astype({c: "Int64" for c in NAMES[2:6]})

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, texts, held = [], [], 0
            for doc_id, text in zip(b["id"], b["text"]):
                number = int(doc_id) if doc_id else None
                words = (text or "").encode().split()
                words = planted(words, number) if plant else words
                ids.append(number)
                texts.append(words)
                held += len(words)
                if held >= TOGETHER:
                    yield table([_row(*x) for x in zip(ids, texts, runs_of_texts(texts))])
                    ids, texts, held = [], [], 0
            if ids:
                yield table([_row(*x) for x in zip(ids, texts, runs_of_texts(texts))])

    # Numbers go to Python as text: a column with nulls would become one of floats there.
    return docs.selectExpr("cast(cast(doc_id AS long) AS string) AS id", "text").mapInPandas(each, SCHEMA)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(read_table(spark, sf_dir, "documents"), plant=True).drop("runs")
