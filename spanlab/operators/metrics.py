"""Metrics: rank statistics, thresholds, intervals, class reports, comparisons."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanlab.operators.aggregates import macro_rates
from spanlab.operators.ranks import cumulative, place, quantiles
from spanlab.operators.series import running_precision

Z95 = 1.959963984540054


def roc_auc(df: DataFrame, score: str, positive: Column, keys: list[str] = ()) -> DataFrame:
    """Mann-Whitney with ties at half; NaN where a class is missing. Distinct scores are counted first, then summed in order."""
    keys = list(keys)
    frame = df if keys else df.withColumn("__all", F.lit(1))
    by = keys or ["__all"]
    counts = frame.groupBy(*by, score).agg(F.count_if(positive).alias("__hit"), F.count_if(~positive).alias("__miss"))
    run = cumulative(counts, by, score, ["__miss"])
    out = run.groupBy(*by).agg(F.sum("__hit").alias("hits"), F.sum("__miss").alias("misses"), F.sum(F.col("__hit") * (2 * F.col("before___miss") + F.col("__miss"))).alias("twice"))
    return out.select(*keys, F.when((F.col("hits") > 0) & (F.col("misses") > 0), F.col("twice") / (2 * F.col("hits") * F.col("misses"))).otherwise(F.lit(float("nan"))).alias("auc"))


def average_precision(df: DataFrame, keys: list[str], score: str, positive: Column, tie: list[str]) -> DataFrame:
    """Mean of the precision at each positive, in score order with an explicit tie key."""
    p = running_precision(df.withColumn("__p", positive.cast("int")), keys, score, tie, F.col("__p") == 1)
    return p.groupBy(*keys).agg((F.sum(F.when(F.col("__p") == 1, F.col("precision")).otherwise(0.0)) / F.greatest(F.lit(1), F.sum("__p"))).alias("ap"))


def threshold_at_fpr(df: DataFrame, keys: list[str], score: str, target: float) -> DataFrame:
    """(boundary, strict): accept scores above the (k + 1)-th largest negative, k = floor(target * n); with k >= n, from the smallest on."""
    run = cumulative(df.groupBy(*keys, score).agg(F.count("*").alias("c")), keys, score, ["c"], descending=True)
    k = F.floor(F.col("all_c") * target)
    at = (F.col("before_c") <= k) & (F.col("before_c") + F.col("c") > k)
    return run.groupBy(*keys).agg(F.max("all_c").alias("n"), F.coalesce(F.max(F.when(at, F.col(score))), F.min(score)).alias("boundary"), F.coalesce(F.bool_or(at), F.lit(False)).alias("strict"))


def choose_threshold(df: DataFrame, category: str, subset: str, excluded: list, score: str, target: float, min_n: int) -> DataFrame:
    """Boundaries per category and for the pool of small ones; ``operating`` is the largest of them. One row per pool, so the window over them is small."""
    rows = df.where(~F.col(subset).isin(*excluded))
    n = rows.groupBy(category).agg(F.count("*").alias("__n"))
    pooled = rows.join(n, category).select(F.when(F.col("__n") < min_n, "pooled").otherwise(F.col(category)).alias("pool"), score)
    return threshold_at_fpr(pooled, ["pool"], score, target).withColumn("operating", F.max("boundary").over(W.partitionBy()))


def rate_table(df: DataFrame, groups: list[str], hit: Column, score: str, p99: bool = True) -> DataFrame:
    """n, k (hits), rate with its 95 per cent interval (Wilson's) and score statistics by each column and their combination; a column that isn't grouped by shows null and its flag 0.

    Rows are summed by the columns in each task before any set of them is made, so counts, mean and maximum need no memory that grows with the scores; ``p99``, the exact one, counts distinct scores.
    """
    flags = [f"by_{g}" for g in groups]
    sets = F.explode(F.array(*[F.struct(*[F.lit(mask >> i & 1).alias(f) for i, f in enumerate(flags)]) for mask in range(1, 1 << len(groups))])).alias("by")
    wide = lambda cells, *cols: cells.select(*cols, *groups, sets).select(*cols, "by.*", *[F.when(F.col(f"by.{f}") == 1, F.col(g)).alias(g) for g, f in zip(groups, flags)])
    keys = [*groups, *flags]
    sums = df.groupBy(*groups).agg(F.count("*").alias("__n"), F.count_if(hit).alias("__k"), F.count(score).alias("__m"), F.sum(score).alias("__s"), F.max(score).alias("__top"))
    told = wide(sums, "__n", "__k", "__m", "__s", "__top").groupBy(*keys).agg(F.sum("__n").alias("n"), F.sum("__k").alias("k"), (F.sum("__k") / F.sum("__n")).alias("rate"), F.try_divide(F.sum("__s"), F.sum("__m")).alias("mean_score"), F.max("__top").alias("max_score"))
    told = told.withColumn("__ci", wilson_ci(F.col("k"), F.col("n"))).withColumns({"low": F.col("__ci.low"), "high": F.col("__ci.high")}).drop("__ci")
    cols = [*groups, *flags, "n", "k", "rate", "low", "high", "mean_score", "max_score"]
    if not p99:
        return told.select(*cols)
    cells = df.groupBy(*groups, score).agg(F.count("*").alias("__n"))
    high = quantiles(wide(cells, score, "__n"), keys, score, {"p99": 0.99}, "__n").withColumnsRenamed({k: f"__{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return told.join(high, on, "left").select(*cols, "p99")


_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    return _lgamma(x).astype(float)


def _fraction(terms, x: np.ndarray) -> np.ndarray:
    """A continued fraction b0 + a1 / (b1 + a2 / (b2 + ...)) by Lentz's method; ``terms(j)`` gives (a_j, b_j). Arrays go on until the last has settled."""
    tiny = 1e-300
    f = np.where((b := terms(0)[1]) == 0, tiny, b) * np.ones_like(x)
    c, d = f.copy(), np.zeros_like(x)
    for j in range(1, 200_000):
        a, b = terms(j)
        d, c = b + a * d, b + a / c
        d, c = 1 / np.where(d == 0, tiny, d), np.where(c == 0, tiny, c)
        f = f * (step := c * d)
        if np.all(np.abs(step - 1) < 1e-14):
            break
    return f


def beta_share(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function: the chance of a or more hits in a + b - 1 trials at x."""
    flip = x > (a + 1) / (a + b + 2)
    y, p, q = np.where(flip, 1 - x, x), np.where(flip, b, a), np.where(flip, a, b)

    def terms(j: int) -> tuple:
        m = j // 2
        if j == 0:
            return 0.0, np.ones_like(y)
        return (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)) if j % 2 == 0 else -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))), 1.0

    with np.errstate(divide="ignore"):
        front = np.exp(p * np.log(y) + q * np.log1p(-y) - (_log_gamma(p) + _log_gamma(q) - _log_gamma(p + q))) / p
    part = np.where((y <= 0) | (y >= 1), (y >= 1).astype(float), front / _fraction(terms, y))
    return np.where(flip, 1 - part, part)


def gamma_share(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The regularised lower incomplete gamma function: the chance of a or more events at mean x."""
    with np.errstate(divide="ignore"):
        front = np.exp(a * np.log(x) - x - _log_gamma(a))
    low = x < a + 1
    y, total, term, n = np.where(low, x, 0.0), 1 / a, 1 / a, a.copy()
    for _ in range(200_000):
        n = n + 1
        term = term * y / n
        total = total + term
        if np.all(term < total * 1e-15):
            break
    z = np.where(low, a + 2, x)
    upper = front / _fraction(lambda j: (-j * (j - a), z + 2 * j + 1 - a), z)
    return np.where(x <= 0, 0.0, np.where(low, front * total, 1 - upper))


def _crossing(f, lo: np.ndarray, hi: np.ndarray, start: np.ndarray, slope) -> np.ndarray:
    """Where each rising f crosses 0 in [lo, hi]: Newton steps that fall back to the middle where they leave the interval."""
    x = np.clip(start, lo, hi)
    for _ in range(100):
        v = f(x)
        lo, hi = np.where(v < 0, x, lo), np.where(v < 0, hi, x)
        with np.errstate(divide="ignore", invalid="ignore"):
            new = x - v / slope(x)
        new = np.where((new > lo) & (new < hi), new, (lo + hi) / 2)
        if np.all(np.abs(new - x) <= 1e-13 * np.maximum(np.abs(x), 1e-300)):
            return new
        x = new
    return x


def clopper_pearson_rows(k: np.ndarray, n: np.ndarray, alpha: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.asarray(k, float), np.asarray(n, float)
    low, high = np.where(n > 0, 0.0, np.nan), np.where(n > 0, 1.0, np.nan)

    def bound(on: np.ndarray, a: np.ndarray, b: np.ndarray, level: float) -> np.ndarray:
        norm = _log_gamma(a + b) - _log_gamma(a) - _log_gamma(b)
        density = lambda x: np.exp(norm + (a - 1) * np.log(x) + (b - 1) * np.log1p(-x))
        mid = a / (a + b)
        near = mid + np.sign(level - 0.5) * 2 * np.sqrt(mid * (1 - mid) / (a + b + 1))
        return _crossing(lambda x: beta_share(x, a, b) - level, np.full(len(a), 1e-300), np.full(len(a), 1 - 1e-16), np.clip(near, 1e-12, 1 - 1e-12), density)

    on = (n > 0) & (k > 0)
    if on.any():
        low[on] = bound(on, k[on], n[on] - k[on] + 1, alpha / 2)
    on = (n > 0) & (k < n)
    if on.any():
        high[on] = bound(on, k[on] + 1, n[on] - k[on], 1 - alpha / 2)
    return low, high


def garwood_rows(k: np.ndarray, hours: np.ndarray, alpha: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    k, hours = np.asarray(k, float), np.asarray(hours, float)
    known = hours > 0
    low, high = np.where(known, 0.0, np.nan), np.full(len(k), np.nan)

    def bound(a: np.ndarray, level: float) -> np.ndarray:
        norm = _log_gamma(a)
        near = np.maximum(a + np.sign(level - 0.5) * 2 * np.sqrt(a), 1e-3)
        return _crossing(lambda x: gamma_share(x, a) - level, np.full(len(a), 1e-300), a + 20 * np.sqrt(a) + 50, near, lambda x: np.exp((a - 1) * np.log(x) - x - norm))

    on = known & (k > 0)
    if on.any():
        low[on] = bound(k[on], alpha / 2) / hours[on]
    if known.any():
        high[known] = bound(k[known] + 1, 1 - alpha / 2) / hours[known]
    return low, high


def clopper_pearson(k: int, n: int, alpha: float = 0.05) -> tuple[float, float]:
    low, high = clopper_pearson_rows([k], [n], alpha)
    return float(low[0]), float(high[0])


def garwood(k: int, hours: float, alpha: float = 0.05) -> tuple[float, float]:
    low, high = garwood_rows([k], [hours], alpha)
    return float(low[0]), float(high[0])


def proportion_ci(k: Column, n: Column) -> Column:
    """Exact interval of a proportion, for rows that are already aggregated."""

    @F.pandas_udf("low double, high double")
    def ci(ks: pd.Series, ns: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("low", "high"), clopper_pearson_rows(ks, ns))))

    return ci(k.cast("long"), n.cast("long"))


def poisson_rate_ci(k: Column, hours: Column) -> Column:
    """Exact interval of a rate, for rows that are already aggregated."""

    @F.pandas_udf("low double, high double")
    def ci(ks: pd.Series, hs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("low", "high"), garwood_rows(ks, hs))))

    return ci(k.cast("long"), hours.cast("double"))


def wilson_ci(k: Column, n: Column, z: float = Z95) -> Column:
    p, zz = k / n, z * z
    mid, half = p + zz / (2 * n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    return F.when(n > 0, F.struct(((mid - half) / (1 + zz / n)).alias("low"), ((mid + half) / (1 + zz / n)).alias("high")))


def sweep_roc(df: DataFrame, score: str, positive: Column, points: int) -> DataFrame:
    """Detection rate and false positive rate at each of the distinct quantiles of the score, by one pass over rows placed on that grid. The driver holds the grid."""
    found = quantiles(df, [], score, {f"q{i}": i / (points - 1) for i in range(points)}).first()
    grid = sorted({x for x in found if x is not None})
    hist = df.select(positive.alias("hit"), place(F.col(score), grid).alias("m")).groupBy("m").agg(F.count_if("hit").alias("p"), F.count_if(~F.col("hit")).alias("n"))
    reach = hist.select(F.explode(F.slice(F.array(*[F.lit(x) for x in grid]), F.lit(1), F.col("m"))).alias("threshold"), "p", "n")
    whole = hist.agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"))
    return reach.groupBy("threshold").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).crossJoin(F.broadcast(whole)).select("threshold", (F.col("p") / F.col("positives")).alias("detection_rate"), (F.col("n") / F.col("negatives")).alias("fpr"))


def decide(probabilities: dict[str, Column], cutoff: float, unknown: str) -> Column:
    """The likeliest class (ties: the first named); below the cutoff the unknown class."""
    best = F.array_max(F.array(*[F.struct(p.alias("p"), F.lit(-i).alias("i"), F.lit(c).alias("c")) for i, (c, p) in enumerate(probabilities.items())]))
    return F.when(best["p"] < cutoff, unknown).otherwise(best["c"])


def choose_cutoff(df: DataFrame, group: str, p: str, wrong: Column, target: float, steps: int = 200) -> DataFrame:
    """The smallest cutoff on a grid of 1/steps at which the mean of the groups' wrong-action rates is at most ``target``; else 1.

    ``wrong``: the row acts wrongly when its p reaches the cutoff. Each row is placed on the grid once, and one reverse running sum gives every rate.
    """
    g = F.least(F.floor(F.col(p) * steps), F.lit(steps))
    # The product may round over a grid point, so its neighbours are looked at too.
    up, down = (g + 1) / F.lit(float(steps)) <= F.col(p), g / F.lit(float(steps)) > F.col(p)
    at = df.withColumn("__g", F.greatest(F.when(up & (g < steps), g + 1).when(down, g - 1).otherwise(g), F.lit(-1)).cast("int"))
    total = df.groupBy(group).agg(F.count("*").alias("n"))
    hist = at.where(wrong).groupBy(group, "__g").agg(F.count("*").alias("c"))
    full = total.withColumn("__g", F.explode(F.sequence(F.lit(0), F.lit(steps)))).join(hist, [group, "__g"], "left")
    w = W.partitionBy(group).orderBy(F.col("__g").desc()).rowsBetween(W.unboundedPreceding, 0)
    rates = full.select(group, "__g", (F.sum(F.coalesce("c", F.lit(0))).over(w) / F.col("n")).alias("r")).groupBy("__g").agg(F.avg("r").alias("rate"))
    return rates.agg((F.coalesce(F.min(F.when(F.col("rate") <= target, F.col("__g"))), F.lit(steps)) / steps).alias("cutoff"))


def classification_report(df: DataFrame, truth: str, pred: str, group: str, unknown: str) -> DataFrame:
    """Per class, overall (group ALL) and by group: support, precision, recall, F1 and F2."""
    base = df.select(truth, pred, F.explode(F.array(F.lit("ALL"), F.col(group))).alias("grp"))
    cells = base.groupBy("grp", truth, pred).agg(F.count("*").alias("n"))
    side = F.explode(F.array(F.struct(F.col(truth).alias("cls"), F.lit("t").alias("s")), F.struct(F.col(pred).alias("cls"), F.lit("p").alias("s")))).alias("x")
    n = cells.select("grp", side, "n", (F.col(truth) == F.col(pred)).alias("ok")).groupBy("grp", "x.cls").agg(F.sum(F.when(F.col("x.s") == "t", F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(F.col("x.s") == "p", F.col("n")).otherwise(0)).alias("predicted"), F.sum(F.when(F.coalesce("ok", F.lit(False)) & (F.col("x.s") == "t"), F.col("n")).otherwise(0)).alias("tp"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp = F.col("tp")
    return n.select("grp", "cls", "support", safe(tp, F.col("predicted")).alias("precision"), safe(tp, F.col("support")).alias("recall"), safe(2 * tp, F.col("support") + F.col("predicted")).alias("f1"), safe(5 * tp, 4 * F.col("support") + F.col("predicted")).alias("f2"))


def macro_report(df: DataFrame, truth: str, pred: str, group: str, unknown: str) -> DataFrame:
    """Overall (ALL) and by group: n, accuracy, balanced accuracy, macro precision, recall, F1 and F2, and rows without a response.

    Classes count alike. Balanced accuracy is the mean recall of the classes that occur; macro figures are means over the classes that occur or are predicted. A null prediction is no
    response: a wrong row, and no class.
    """
    classes = classification_report(df, truth, pred, group, unknown).where("cls IS NOT NULL")
    mean = lambda c: F.avg(c).alias(f"macro_{c}")
    macro = classes.groupBy("grp").agg(F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"), *[mean(c) for c in ("precision", "recall", "f1", "f2")])
    base = df.select(truth, pred, F.explode(F.array(F.lit("ALL"), F.col(group))).alias("grp"))
    rows = base.groupBy("grp").agg(F.count("*").alias("n"), (F.count_if(F.col(truth) == F.col(pred)) / F.count("*")).alias("accuracy"), F.count_if(F.col(pred).isNull()).alias("no_response"))
    return rows.join(macro, "grp")


def error_summary(df: DataFrame, truth: str, pred: str, group: str, unknown: str) -> DataFrame:
    """Overall (ALL) and by group: accuracy, false accept, false reject and misfire rates."""
    base = df.select(truth, pred, F.explode(F.array(F.lit("ALL"), F.col(group))).alias("grp"))
    t, p = F.col(truth), F.col(pred)
    over = lambda a, b: F.count_if(a & b) / F.count_if(b)
    return base.groupBy("grp").agg(F.count("*").alias("n"), (F.count_if(t == p) / F.count("*")).alias("accuracy"), over(p != unknown, t == unknown).alias("false_accept"), over(p == unknown, t != unknown).alias("false_reject"), over((p != unknown) & (p != t), t != unknown).alias("misfire"))


def slot_errors(df: DataFrame, want: Column, got: Column, want_minutes: Column, got_minutes: Column) -> DataFrame:
    """One row: exact rate, mean absolute and circular (24 h) error in minutes, mean character distance, and the share that sounds alike (soundex)."""
    d = F.abs(want_minutes - got_minutes)
    return df.agg((F.count_if(want == got) / F.count("*")).alias("exact"), F.avg(d).alias("l1"), F.avg(F.least(d, 1440 - d)).alias("circular"), F.avg(F.levenshtein(want, got)).alias("char_distance"), (F.count_if(F.soundex(want) == F.soundex(got)) / F.count("*")).alias("sounds_alike"))


def unseen_report(pred: DataFrame, train: DataFrame, speaker: str, truth: str, guess: str, group: str, unknown: str) -> DataFrame:
    return macro_rates(pred.join(train.select(speaker).distinct(), speaker, "left_anti"), truth, guess, group, unknown)


def select_model(metrics: DataFrame, name: str, size: str, score: Column, margin: float) -> DataFrame:
    """One row: the smallest model whose score no larger model beats by more than ``margin``."""
    m = metrics.select(name, size, score.alias("score"))
    best = m.agg(F.max("score").alias("__b"))
    return m.crossJoin(F.broadcast(best)).where(F.col("score") >= F.col("__b") - margin).agg(F.min_by(F.struct(name, "score"), F.struct(size, name)).alias("m")).select("m.*")


def compare_runs(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    j = a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key, "full_outer")
    return j.withColumn("difference", F.col("b") - F.col("a")).withColumn("state", F.when(F.col("a").isNull() | F.col("b").isNull(), "not_run").otherwise("compared"))


def paired_disagreement(df: DataFrame, group: str, right_a: Column, right_b: Column) -> DataFrame:
    return df.groupBy(group).agg(F.count("*").alias("n"), F.count_if(right_a & ~right_b).alias("only_a"), F.count_if(~right_a & right_b).alias("only_b"), F.count_if(right_a & right_b).alias("both"))


def condition_report(df: DataFrame, conditions: dict[str, Column], right: Column) -> DataFrame:
    """Groups that may overlap: a row counts in every named condition that it meets."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()]))
    return df.select(F.explode(names).alias("condition"), right.alias("__r")).groupBy("condition").agg(F.count("*").alias("n"), (F.count_if("__r") / F.count("*")).alias("correct"))
