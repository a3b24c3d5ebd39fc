"""Diagnostics: confounds, bootstraps, ablations, shortcut probes, clusters, near-duplicates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanlab.functions.keys import cosine, hash60, vec_dot, vec_normalize
from spanlab.operators.aggregates import beside
from spanlab.operators.joins import knn_band_join
from spanlab.operators.metrics import roc_auc
from spanlab.operators.ranks import cumulative, quantiles
from spanlab.sources.shared import settled


def source_auc(df: DataFrame, score: str, is_source: Column) -> DataFrame:
    """How well the score alone tells the source of negatives."""
    return roc_auc(df, score, is_source)


def matched_source_auc(df: DataFrame, ident: str, score: str, source: str, x: str, y: str, k: int, radius: float) -> DataFrame:
    """The same after each source row (``source`` true) is matched with its k nearest others in level (x, y): matched others stand once for each match."""
    a = df.where(source).select(F.col(ident).alias("a_id"), F.col(x).alias("ax"), F.col(y).alias("ay"), F.col(score).alias("sa"))
    b = df.where(f"NOT {source}").select(F.col(ident).alias("b_id"), F.col(x).alias("bx"), F.col(y).alias("by"))
    met = knn_band_join(a, b, [], k, radius)
    ours = met.select("a_id").distinct().withColumnRenamed("a_id", ident).withColumn("__own", F.lit(True))
    theirs = met.select(F.col("b_id").alias(ident)).withColumn("__own", F.lit(False))
    rows = ours.unionByName(theirs).join(df.select(ident, score), ident)
    return roc_auc(rows, score, F.col("__own"))


def cluster_bootstrap(df: DataFrame, group: str, value: str, reps: int, seed: int) -> DataFrame:
    """Mean of ``value`` with its 2.5 and 97.5 per cent points over resampled groups: a ratio of sums, groups drawn by hash.

    Each group is drawn a hash-given number of times (Poisson with mean one), so replicates are sums over groups alone and no draw needs a shuffle of rows.
    """
    sums = df.groupBy(group).agg(F.sum(value).alias("s"), F.count("*").alias("n"))
    u = hash60(F.lit(seed), F.col(group), F.col("rep")) / float(1 << 60)
    edges = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916759850712]
    times = sum(((u >= e).cast("int") for e in edges[1:]), (u >= edges[0]).cast("int"))
    drawn = sums.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("times", times)
    means = drawn.groupBy("rep").agg((F.sum(F.col("s") * F.col("times")) / F.sum(F.col("n") * F.col("times"))).alias("m"))
    q = means.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return sums.agg((F.sum("s") / F.sum("n")).alias("mean")).crossJoin(q).select("mean", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"))


#: Draws that one hash gives: four hexadecimal digits each.
DRAWS = 16
#: The shares of a Poisson number of mean one that lie under 1, 2, ... 8.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916759850712, 0.9999897508033253)


def poisson_bootstrap(df: DataFrame, keys: list[str], value: Column, ident: list[str], reps: int, seed: int) -> DataFrame:
    """(keys, low, high): the 2.5 and 97.5 per cent points of the mean of ``value`` over ``reps`` replicates, interpolated.

    Each row (named by ``ident``) stands in a replicate a Poisson number of times, by a hash. Replicates are sums that each task adds up for itself before they meet, so rows
    are neither copied nor moved, whatever the number of replicates or the size of a key. Null values are left out; a replicate without rows doesn't count.
    """
    hashes = [F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in ident], F.lit(str(k))), 256) for k in range(-(-reps // DRAWS))]
    rows = df.where(value.isNotNull()).select(*keys, value.alias("__v"), F.array(*hashes).alias("__h"))
    each = []
    for r in range(reps):
        u = F.conv(F.substring(F.get("__h", F.lit(r // DRAWS)), 4 * (r % DRAWS) + 1, 4), 16, 10).cast("long") / 65536.0
        times = sum(((u >= e).cast("int") for e in POISSON[1:]), (u >= POISSON[0]).cast("int"))
        each += [F.sum(F.col("__v") * times).alias(f"__s{r}"), F.sum(times).alias(f"__n{r}")]
    means = F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"__n{r}") > 0, F.col(f"__s{r}") / F.col(f"__n{r}")) for r in range(reps)])))

    def point(share: float) -> Column:
        at = (F.size("__m") - 1) * F.lit(share)
        low, high = F.get("__m", F.floor(at).cast("int")), F.get("__m", F.ceil(at).cast("int"))
        return low + (high - low) * (at - F.floor(at))

    return rows.groupBy(*keys).agg(*each).select(*keys, means.alias("__m")).select(*keys, point(0.025).alias("low"), point(0.975).alias("high"))


def before_after(df: DataFrame, keys: list[str], before: str, after: str, threshold: float, ident: list[str], reps: int = 96, seed: int = 0) -> DataFrame:
    """Medians before and after, the mean change with its 95 per cent interval over resampled rows, and how many lie above the threshold."""
    change = F.col(after) - F.col(before)
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(change).alias("mean_change"), F.count_if(F.col(before) > threshold).alias("above_before"), F.count_if(F.col(after) > threshold).alias("above_after"))
    for c, name in ((before, "median_before"), (after, "median_after")):
        out = beside(out, quantiles(df, keys, c, {name: 0.5}), keys)
    out = beside(out, poisson_bootstrap(df, keys, change, ident, reps, seed).withColumnsRenamed({"low": "change_low", "high": "change_high"}), keys)
    return out.select(*keys, "n", "median_before", "median_after", "mean_change", "change_low", "change_high", "above_before", "above_after")


def ablation_delta(full: DataFrame, without: DataFrame, key: str, value: str) -> DataFrame:
    j = full.select(key, F.col(value).alias("full")).join(without.select(key, F.col(value).alias("without")), key)
    return j.withColumn("drop", F.col("full") - F.col("without")).orderBy(F.col("drop").desc(), key)


def shortcut_probe(df: DataFrame, vector: str, label: str, train: Column, seed: int = 0, iterations: int = 50) -> DataFrame:
    """Can nuisance features tell the class? (class, clips, correct) on the held-out rows, by a standardised logistic model fitted on the others."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector

    rows = df.select(array_to_vector(F.transform(F.col(vector), lambda x: x.cast("double"))).alias("raw"), F.col(label).cast("double").alias("label"), train.alias("__train"))
    weights = rows.where("__train").groupBy("label").agg((F.lit(1.0) / F.count("*")).alias("weight"))
    fit = rows.where("__train").join(weights, "label")
    model = Pipeline(stages=[StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(maxIter=iterations, regParam=0.01, weightCol="weight")]).fit(fit)
    told = model.transform(rows.where("NOT __train"))
    return told.groupBy(F.col("label").cast("int").alias("class")).agg(F.count("*").alias("clips"), (F.count_if(F.col("prediction") == F.col("label")) / F.count("*")).alias("correct"))


def cluster_two(df: DataFrame, ident: str, vector: str, k: int = 2, seed: int = 1) -> DataFrame:
    """(id, cluster, margin): bisecting k-means by cosine; the margin is the similarity to the own centroid less the best other."""
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.select(ident, F.transform(F.col(vector), lambda x: x.cast("double")).alias("__v")).withColumn("features", array_to_vector("__v"))
    model = BisectingKMeans(k=k, seed=seed, distanceMeasure="cosine").fit(rows)
    centres = [F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()]
    sims = F.array(*[cosine(F.col("__v"), c) for c in centres])
    told = model.transform(rows).withColumn("__s", sims).withColumn("cluster", F.col("prediction"))
    other = F.array_max(F.filter("__s", lambda x, i: i != F.col("cluster")))
    return told.select(ident, "cluster", (F.get("__s", F.col("cluster")) - other).alias("margin"))


def position_uniformity(df: DataFrame, keys: list[str], x: Column) -> DataFrame:
    """Rows, quartiles of relative positions, and the Kolmogorov-Smirnov test of them against the uniform distribution on [0, 1], per key.

    ``ks`` is the largest distance of the two distribution functions and ``p_value`` its asymptotic probability (1 where the scaled distance is under 0.3). Null positions count in ``n`` only.
    """
    at = df.withColumn("__x", x.cast("double")).select(*keys, "__x")
    run = cumulative(at.where("__x IS NOT NULL").withColumn("__one", F.lit(1)), keys, "__x", ["__one"])
    before, n = F.col("before___one"), F.col("all___one")
    inside = F.greatest(F.least(F.col("__x"), F.lit(1.0)), F.lit(0.0))
    ks = run.groupBy(*keys).agg(F.max(F.greatest((before + 1) / n - inside, inside - before / n)).alias("ks"), F.max(n).alias("__m"))
    root = F.sqrt("__m")
    scaled = (root + 0.12 + 0.11 / root) * F.col("ks")
    tail = sum((F.lit(2.0 * (-1) ** (k - 1)) * F.exp(-2.0 * k * k * scaled * scaled) for k in range(1, 21)), F.lit(0.0))
    ks = ks.select(*keys, "ks", F.when(scaled < 0.3, 1.0).otherwise(F.greatest(F.least(tail, F.lit(1.0)), F.lit(0.0))).alias("p_value"))
    out = beside(at.groupBy(*keys).agg(F.count("*").alias("n")), quantiles(at, keys, "__x", {"q1": 0.25, "q2": 0.5, "q3": 0.75}), keys)
    return beside(out, ks, keys)


#: References and rows of one block of a comparison.
BLOCK, ROWS = 4096, 65_536
#: References of a key that others are dealt by.
PIVOTS = 32
#: References that projections are looked up in at once, blocks of rows at least where there are rows for them, rows of one at least, and products at a time.
PART, LOTS, FEW, PRODUCTS = 65_536, 24, 2048, 1 << 22


def _all_products(matrix: np.ndarray) -> Callable:
    return lambda mine: ((mine @ matrix.T).max(axis=1), np.full(len(mine), len(matrix)))


def _compared(rows: DataFrame, refs: DataFrame, ident: str, meet: Callable = _all_products, block: int | None = None, lot: int | None = None) -> DataFrame:
    """(ident, max_similarity, compared) of rows (k, ident, v) against references (k, v) of their k, unit vectors all: the largest product, and how many were made.

    References are dealt to blocks of about ``block`` (BLOCK) and rows to blocks of about ``lot`` (ROWS) of a k; a pair of blocks is one matrix product for each batch of rows, or what ``meet`` makes
    of the references: a function from rows to their largest products and how many. A row may stand under several k.
    """
    blocks = refs.groupBy("k").agg(F.ceil(F.count("*") / (block or BLOCK)).cast("int").alias("__n")).join(rows.groupBy("k").agg(F.ceil(F.count("*") / (lot or ROWS)).cast("int").alias("__m")), "k")
    kinds = dict(rows.dtypes)
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = rows.join(blocks, "k").select("k", each("__n").alias("__block"), F.lit(1).alias("__side"), F.col(ident).alias("__id"), "v", F.pmod(F.xxhash64(ident), F.col("__m")).cast("int").alias("__salt"))
    right = refs.join(blocks, "k").select("k", F.pmod(F.xxhash64("v"), F.col("__n")).cast("int").alias("__block"), F.lit(0).alias("__side"), F.lit(None).cast(kinds[ident]).alias("__id"), "v", each("__m").alias("__salt"))
    dealt = left.unionByName(right).repartition("k", "__block", "__salt").sortWithinPartitions("k", "__block", "__salt", "__side")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, held, met = None, [], None
        for b in batches:
            at = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(5).to_pylist()))
            sides, vectors = b.column(2).to_pylist(), b.column(4)
            kept, best, made, i = [], [], [], 0
            while i < len(at):
                j = i
                while j < len(at) and at[j] == at[i] and sides[j] == sides[i]:
                    j += 1
                mine = vectors.slice(i, j - i).flatten().to_numpy(zero_copy_only=False).reshape(j - i, -1)
                if at[i] != where:
                    where, held, met = at[i], [], None
                if sides[i] == 0:
                    held, met = [*held, mine], None
                elif held:
                    met = meet(np.concatenate(held)) if met is None else met
                    most, times = met(mine)
                    some = np.flatnonzero(times)
                    kept += (i + some).tolist()
                    best.append(most[some])
                    made += times[some].tolist()
                i = j
            told = b.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([told.column(3), pa.array(np.concatenate(best) if best else np.zeros(0)), pa.array(made, pa.int64())], names=[ident, "s", "c"])

    met = dealt.mapInArrow(compare, f"`{ident}` {kinds[ident]}, s double, c long")
    return met.groupBy(ident).agg(F.max("s").alias("max_similarity"), F.sum("c").alias("compared"))


def near_duplicate_max(a: DataFrame, refs: DataFrame, key: str, ident: str, vector: str) -> DataFrame:
    """The largest cosine similarity of each row to any reference under the same key, null where the key has none, and the number of references it was compared with.

    Exact, by the triangle inequality on angles. A key's references are dealt to the nearest of up to PIVOTS of them; a cell knows its widest angle. A row is compared with the cell of its own nearest
    pivot first. A cell whose best possible similarity, that of the angle to the pivot less the cell's widest, lies under what was found is left out, and the row goes to the others. Equal
    references are one.
    """
    unit = refs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), vec_normalize(F.col(vector)).alias("v")).distinct()
    unit = settled(unit, "references")
    first = F.row_number().over(W.partitionBy("key").orderBy(F.xxhash64("v"), "v"))
    pivots = unit.withColumn("__n", first).where(F.col("__n") <= PIVOTS).groupBy("key").agg(F.array_sort(F.collect_list("v")).alias("pivots"))
    products = F.transform("pivots", lambda p: vec_dot(F.col("v"), p))
    near = lambda products: F.array_max(F.transform(products, lambda s, i: F.struct(s.alias("s"), i.alias("cell"))))
    celled = unit.join(pivots, "key").select("key", "v", near(products).alias("at")).select("key", "v", "at.cell", "at.s")
    celled = settled(celled, "cells")
    cells = celled.groupBy("key", "cell").agg(F.min("s").alias("low")).groupBy("key").agg(F.collect_list(F.struct("cell", "low")).alias("cells"))
    rows = a.select(F.col(key).alias("key"), F.col(ident).alias(ident), vec_normalize(F.col(vector)).alias("v"))
    seen = rows.join(pivots.join(cells, "key"), "key").withColumn("s", products)
    told = F.transform("cells", lambda c: F.struct(F.get(F.col("s"), c["cell"]).alias("s"), c["cell"].alias("cell"), c["low"].alias("low")))
    seen = settled(seen.select("key", ident, "v", told.alias("cells")).withColumn("own", F.array_max("cells")["cell"]), "rows")
    k = lambda cell: F.concat_ws(":", F.col("key").cast("string"), cell.cast("string")).alias("k")
    dealt = celled.select(k(F.col("cell")), "v")
    found = settled(_compared(seen.select(k(F.col("own")), ident, "v"), dealt, ident), "own")
    angle = lambda s: F.acos(F.greatest(F.least(s, F.lit(1.0)), F.lit(-1.0)))
    # A vector of zeros has the product 0 with all, so no bound lies under 0.
    most = lambda c: F.greatest(F.cos(F.greatest(angle(c["s"]) - angle(c["low"]), F.lit(0.0))), F.lit(0.0)) + 1e-9
    more = seen.join(found, ident).withColumn("cell", F.explode(F.filter("cells", lambda c: (c["cell"] != F.col("own")) & (most(c) > F.col("max_similarity")))))
    others = _compared(more.select(k(F.col("cell.cell")), ident, "v"), dealt, ident)
    best = found.unionByName(others).groupBy(ident).agg(F.max("max_similarity").alias("max_similarity"), F.sum("compared").alias("compared"))
    return a.select(key, ident).join(best, ident, "left").select(key, ident, "max_similarity", F.coalesce("compared", F.lit(0)).alias("compared"))


def near_duplicate_lsh(a: DataFrame, refs: DataFrame, key: str, ident: str, vector: str, bits: int = 12, tables: int = 12, probes: int = 4, seed: int = 5) -> DataFrame:
    """As ``near_duplicate_max``, among references whose signed random projections agree: what is found is never too high, and null where none is met.

    A vector has ``bits`` signs of random projections in each of ``tables``. A row looks under its own signs and under those with one of its ``probes`` least certain ones turned round. A
    reference at an angle of 20 degrees (0.94) has all 12 signs, or all but a probed one, in half of the tables, so 12 tables miss one of some thousands.

    A row goes once to each PART of its key's references, where the codes are worked out, and not once to each code. Only where a key has more parts than a row has codes is it dealt by code.
    """

    def signs(matrix: np.ndarray, asks: bool) -> np.ndarray:
        """The codes of each vector in each table: its own, and where it asks those with a sign turned round."""
        planes = np.random.default_rng(seed).normal(size=(matrix.shape[1], tables * bits))
        said = (matrix @ planes).reshape(len(matrix), tables, bits)
        weight = np.int64(1) << np.arange(bits, dtype=np.int64)
        own = ((said >= 0) * weight).sum(axis=2)
        if not asks:
            return own[:, :, None]
        return np.concatenate([own[:, :, None], own[:, :, None] ^ weight[np.argsort(np.abs(said), axis=2)[:, :, :probes]]], axis=2)

    def probed(matrix: np.ndarray) -> Callable:
        """References in the order of their codes, by table; rows meet those under the codes that they ask for."""
        codes = signs(matrix, False)[:, :, 0]
        order = np.argsort(codes, axis=0, kind="stable")

        def met(mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            asked = signs(mine, True)
            most, made = np.full(len(mine), -np.inf), np.zeros(len(mine), np.int64)
            for t in range(tables):
                wanted = asked[:, t].ravel()
                by, here = np.argsort(wanted, kind="stable"), codes[order[:, t], t]
                code, first = np.unique(wanted[by], return_index=True)
                ends, lo, hi = [*first[1:].tolist(), len(by)], np.searchsorted(here, code, "left"), np.searchsorted(here, code, "right")
                for c in np.flatnonzero(hi > lo).tolist():
                    rows, refs = by[first[c] : ends[c]] // asked.shape[2], matrix[order[lo[c] : hi[c], t]]
                    for k in range(0, len(rows), step := max(1, PRODUCTS // len(refs))):
                        few = rows[k : k + step]
                        most[few] = np.maximum(most[few], (mine[few] @ refs.T).max(axis=1))
                    made[rows] += len(refs)
            return most, made

        return met

    @F.pandas_udf("array<array<long>>")
    def codes(vectors: pd.Series, asks: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        return pd.Series([e.tolist() if ask else e[:, :1].tolist() for e, ask in zip(signs(np.stack(vectors.to_numpy()), True), asks)])

    def dealt(df: DataFrame, *cols: str, asks: bool) -> DataFrame:
        coded = df.select("key", *cols, "v", F.posexplode(codes("v", F.lit(asks))).alias("table", "codes"))
        coded = coded.select("key", "table", *cols, "v", F.explode("codes").alias("code"))
        return coded.select(F.concat_ws(":", F.col("key").cast("string"), "table", F.col("code").cast("string")).alias("k"), *cols, "v")

    unit = lambda df, *cols: df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), *cols, vec_normalize(F.col(vector)).alias("v"))
    largest = lambda df: df.groupBy(key).count().where(F.col(key).isNotNull()).agg(F.max("count")).first()[0] or 0
    rows, others = unit(a, ident), unit(refs).distinct()
    if -(-largest(refs) // PART) < tables * (1 + probes):
        lot = max(FEW, min(ROWS, -(-largest(a) // LOTS)))
        best = _compared(rows.withColumnRenamed("key", "k"), others.withColumnRenamed("key", "k"), ident, probed, PART, lot)
    else:
        best = _compared(dealt(rows, ident, asks=True), dealt(others, asks=False), ident)
    return a.select(key, ident).join(best, ident, "left").select(key, ident, "max_similarity", F.coalesce("compared", F.lit(0)).alias("compared"))
