"""The closest of many reference wordings, by edit ratio."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlab.functions.text import norm_spoken, number_list, words_array
from spanlab.sources.shared import settled

#: Wordings of one block, where all of them must be looked at, and texts that meet it at once.
BLOCK, TEXTS = 512, 128
#: Wordings whose distances to a text are worked out side by side.
BESIDE = 64
#: Letters of a gram.
Q = 2


def _grams(texts: DataFrame) -> DataFrame:
    """(id, gram): the grams of each text with a mark at each end, numbered where they repeat. An edit takes Q of them at most."""
    marked = F.concat(F.lit("^"), F.col("said"), F.lit("$"))
    cut = texts.select("id", marked.alias("marked")).select("id", F.explode(F.transform(F.sequence(F.lit(1), F.length("marked") - (Q - 1)), lambda i: F.substring(F.col("marked"), i, F.lit(Q)))).alias("g"))
    times = cut.groupBy("id", "g").agg(F.count("*").alias("n"))
    return times.select("id", "g", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("k")).select("id", F.concat("g", F.col("k").cast("string")).alias("gram"))


def _prefixes(texts: DataFrame, order: DataFrame, worst: float) -> DataFrame:
    """(id, size, gram): the rarest grams of each text, so many that it shares one with every text within ``worst``."""
    edits = F.floor(F.lit(worst) * F.floor(F.col("size") / (1 - worst)))
    at = _grams(texts).join(order, "gram", "left")
    listed = at.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "gram"))).alias("g"))
    sized = texts.select("id", F.length("said").alias("size"))
    return listed.join(sized, "id").select("id", "size", F.explode(F.slice("g", 1, (Q * edits + 1).cast("int"))).alias("x")).select("id", "size", "x.gram")


def _distance(a: Column, b: Column, most: Column) -> Column:
    """Edit distance in the band of ``most``, null beyond it."""
    d = F.call_function("levenshtein", a, b, most.cast("int"))
    return F.when(d >= 0, d)


def distances(refs: list[str]):
    """A function from a text to its edit distances to all of ``refs``, none of them empty.

    The columns of all their tables are bits of one number, a free bit behind each wording, and one letter of the text is one step of some twenty operations on it (Myers 1999, Hyyro 2003).
    """
    sizes = np.array([len(r) for r in refs])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    bits = np.concatenate([np.array([ord(c) for c in r + "\0"], np.int64) for r in refs])
    free = np.zeros(len(bits), bool)
    free[starts + sizes] = True
    number = lambda on: int.from_bytes(np.packbits(on, bitorder="little").tobytes(), "little")
    equal = {chr(c): number((bits == c) & ~free) for c in np.unique(bits[~free])}
    every, first = number(~free), 0
    for s in starts.tolist():
        first |= 1 << s
    wide = -(-len(bits) // 8)
    ones = lambda x: np.add.reduceat(np.unpackbits(np.frombuffer(x.to_bytes(wide, "little"), np.uint8), bitorder="little", count=len(bits)).astype(np.int64), starts)

    def told(text: str) -> np.ndarray:
        up, down = every, 0
        for c in text:
            e = equal.get(c, 0)
            across = ((((e & up) + up) ^ up) | e) & every
            plus = (((down | every ^ (across | up)) << 1) & every) | first
            minus = ((up & across) << 1) & every
            e |= down
            up, down = minus | every ^ (e | plus), plus & e
        return len(text) + ones(up) - ones(down)

    return told


class Wordings:
    """One block of wordings: the best (ratio, wording) of a text among them, all of them looked at but those whose length or letters alone put them behind the best so far."""

    def __init__(self, refs: list[str]):
        self.empty, refs = "" in refs, sorted((r for r in refs if r), key=len)
        self.letters = {c: i for i, c in enumerate(sorted({c for r in refs for c in r}))}
        self.parts = []
        for i in range(0, len(refs), BESIDE):
            mine = refs[i : i + BESIDE]
            self.parts.append((mine, np.array([len(r) for r in mine]), np.stack([self._counts(r) for r in mine]), distances(mine)))

    def _counts(self, text: str) -> np.ndarray:
        counts = np.zeros(len(self.letters), np.int64)
        for c in text:
            if c in self.letters:
                counts[self.letters[c]] += 1
        return counts

    def best(self, text: str) -> tuple[float, str] | None:
        found = (float(len(text) > 0), "") if self.empty else None
        counts = self._counts(text)
        ways = []
        for k, (_, sizes, letters, _) in enumerate(self.parts):
            whole = np.maximum(sizes, len(text))
            ways.append((float(((whole - np.minimum(letters, counts).sum(axis=1)) / whole).min()), k))
        for least, k in sorted(ways):
            if found is not None and least > found[0]:
                break
            refs, sizes, _, far = self.parts[k]
            ratios = far(text) / np.maximum(sizes, len(text))
            low = float(ratios.min())
            if found is None or low <= found[0]:
                here = (low, min(refs[i] for i in np.flatnonzero(ratios == low)))
                found = here if found is None else min(found, here)
        return found


def _looked_up(texts: DataFrame, listed: DataFrame, wordings: int) -> DataFrame:
    """(id, best): the best wording of each text (id, said) among all of ``listed`` (said). Every block of wordings meets every lot of texts once; a task holds one block."""
    blocks = -(-wordings // BLOCK)
    if not blocks:
        return texts.select("id", F.lit(None).cast("struct<ratio: double, ref: string>").alias("best")).where("false")
    lots = max(1, -(-texts.count() // TEXTS))
    spread = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = texts.select(dealt("said", lots).alias("lot"), spread(blocks, "block"), F.lit(1).alias("side"), "id", "said")
    right = listed.select(dealt("said", blocks).alias("block"), "said", spread(lots, "lot")).select("lot", "block", F.lit(0).alias("side"), F.lit(None).cast("long").alias("id"), "said")
    met = left.unionByName(right).repartition(max(1, lots * blocks // 4), "block", "lot").sortWithinPartitions("block", "lot", "side").select("block", "lot", "side", "id", "said")

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, refs, block, known = None, [], None, {}
        for b in batches:
            out = []
            for k, lot, side, i, said in zip(b["block"].tolist(), b["lot"].tolist(), b["side"].tolist(), b["id"].tolist(), b["said"]):
                if (k, lot) != where:
                    where, refs, block = (k, lot), [], None
                if side == 0:
                    refs.append(said)
                    continue
                if block is None:
                    # A block comes with each of its lots; one compiled form is kept.
                    known = known if known.get("k") == k else {"k": k, "made": Wordings(refs)}
                    block = known["made"]
                if refs:
                    out.append((int(i), *block.best(said)))
            yield pd.DataFrame(out, columns=["id", "ratio", "ref"]).astype({"id": "int64", "ratio": "float64"})

    return met.mapInPandas(look, "id long, ratio double, ref string").groupBy("id").agg(F.min(F.struct("ratio", "ref")).alias("best"))


def nearest_reference(texts: DataFrame, refs: DataFrame, text: str = "text", ref: str = "ref", worst: float = 0.25) -> DataFrame:
    """The closest reference wording of each text by edit ratio (ties: first wording), under the numbers guard, and why or why not: nearest, ratio and reason.

    Equal texts are compared once. With more wordings than a block holds, texts with one within ``worst`` (under 0.5) find it by an inverted index of ids: two texts within it share a gram
    among the rarest of both (Q grams an edit, and one more), lengths that lie too far apart are skipped, and what meets is measured in a band. Texts without one, and all of them where one block
    holds the wordings, are looked up block by block in bits. Null texts count as empty. Without wordings, nearest and ratio are null.
    """
    if not 0 <= worst < 0.5:
        raise ValueError("0 <= worst < 0.5 expected")
    named = lambda df: df.distinct().withColumn("id", F.monotonically_increasing_id())
    heard = settled(named(texts.select(F.coalesce(norm_spoken(F.col(text)), F.lit("")).alias("said"))), "heard")
    listed = settled(named(refs.where(F.col(ref).isNotNull()).select(F.col(ref).alias("said"))), "wordings")
    wordings = listed.count()
    if wordings > BLOCK:
        order = _grams(listed).groupBy("gram").agg(F.count("*").alias("often"))
        a = _prefixes(heard, order, worst)
        b = _prefixes(listed, order, worst).toDF("ref_id", "ref_size", "gram")
        close = F.abs(F.col("size") - F.col("ref_size")) <= worst * F.greatest("size", "ref_size", F.lit(1))
        pairs = a.join(b, "gram").where(close).select("id", "ref_id").distinct()
        pairs = pairs.join(heard, "id").join(listed.select(F.col("id").alias("ref_id"), F.col("said").alias("ref")), "ref_id")
        whole = F.greatest(F.length("said"), F.length("ref"), F.lit(1))
        measured = pairs.withColumn("d", _distance(F.col("said"), F.col("ref"), F.floor(worst * whole))).where(F.col("d") <= worst * whole)
        found = settled(measured.groupBy("id").agg(F.min(F.struct((F.col("d") / whole).alias("ratio"), "ref")).alias("best")), "near")
        told = found.unionByName(_looked_up(heard.join(found, "id", "left_anti").select("said", "id"), listed, wordings))
    else:
        told = _looked_up(heard, listed, wordings)
    told = heard.join(told, "id").select(F.col("said").alias("__said"), F.col("best").alias("__best"))
    alike = number_list(words_array(F.col("__said"))).eqNullSafe(number_list(words_array(F.col("__best.ref"))))
    out = texts.withColumn("__said", F.coalesce(norm_spoken(F.col(text)), F.lit(""))).join(told, "__said", "left")
    reason = F.when(F.col("__said") == "", "empty").when(F.col("__best.ratio").isNull() | (F.col("__best.ratio") > worst), "too_far").when(~alike, "other_number").otherwise("match")
    return out.select(*texts.columns, F.col("__best.ref").alias("nearest"), F.col("__best.ratio").alias("ratio"), reason.alias("reason"))
