"""Quality classifier by co-training of a text view and a page-metadata view.

The text view has hashed words and word pairs, as shares of all of them, and a few statistics; the metadata view has language, source and length. A logistic
model of each view is fitted on a bounded sample of labelled documents; over ROUNDS rounds each model gives the unlabelled documents
that it is most sure of to the other as pseudo-labels. Both are calibrated on held-out labels, combined on
others, and every document is scored.

Views of all documents are written once. In a round both models score every unlabelled row; a histogram of their log-odds gives the cuts behind which the surest
GIVEN of all unlabelled rows lie, and rows behind a cut are labelled, equally sure ones alike. What a row was given in earlier rounds follows from the models and cuts
of those rounds, so nothing is kept for a row. Bounds: only what a fit takes is bounded, by SAMPLE labelled rows and FITTED pseudo-labelled ones for each view, both by a hash
of doc_id and text. The driver holds a matrix of 4 bytes for each of these rows and features, and histograms of BINS numbers, whatever the size of the table. Texts may be very long.

Documents with several label rows take the largest
label; labels other than 0 and 1, or null, are left out. Without labels of both kinds every score is 1, and an empty table has none.
Null texts are empty, a null language or source is a value of its own, a null n_chars is the text's length. Equal rows get equal scores; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlab.llm.common import let, read_table, saved, text_of, word_array
from spanlab.llm.quality_rules import text_statistics

SAMPLE, FITTED = 20_000, 40_000
ROUNDS = 3
#: Share of all unlabelled rows that a model labels with each kind in a round, and how sure it must be.
GIVEN, SURE = 0.05, 0.95
#: Features of hashed words and word pairs.
HASHED = 256
THRESHOLD = 0.5
PARTS = 1_000_000
#: Log-odds up to REACH either way are counted in bins of 1/64.
REACH = 35
BINS = 2 * REACH * 64 + 1
# The languages with a feature of their own.
LANGUAGES = ("en", "fr", "de", "es")
BUCKETS = 8


def _ratio(a: Column, b: Column) -> Column:
    return a / F.greatest(b, F.lit(1))


STATISTICS = 8
CHUNK = 4096


def text_view(text: Column) -> Column:
    """A struct of stats (numbers) and grams (the hashed feature of every word and every pair of neighbours)."""

    def of_words(words: Column) -> Column:
        return F.struct(text_statistics(text, words).alias("s"), let(F.transform(words, lambda w: F.xxhash64(w)), grams).alias("g"))

    def grams(h: Column) -> Column:
        pairs = F.transform(F.slice(h, 2, F.size(h)), lambda x, i: F.xxhash64(F.get(h, i), x))
        return F.transform(F.concat(h, pairs), lambda x: F.pmod(x, F.lit(HASHED)).cast("int"))

    def numbers(s: Column) -> Column:
        return F.array(
            F.log1p(s["n_words"]),
            _ratio(s["word_chars"], s["n_words"]),
            F.log1p(100 * _ratio(s["n_symbols"], s["n_words"])),
            F.log1p(100 * _ratio(s["n_marks"], s["n_words"])),
            _ratio(s["n_stop"], s["n_words"]),
            _ratio(s["n_repeat_words"], s["n_words"]),
            _ratio(s["n_dup_lines"], s["n_lines"]),
            (s["n_words"] < 20).cast("double"),
        )

    return let(let(word_array(text), of_words), lambda v: F.struct(numbers(v["s"]).alias("stats"), v["g"].alias("grams")))


def page_view(lang: Column, source: Column, n_chars: Column) -> Column:
    bucket = F.pmod(F.xxhash64(F.coalesce(source, F.lit("\0"))), F.lit(BUCKETS))
    n = F.log1p(F.greatest(n_chars, F.lit(0)).cast("double"))
    flags = [F.coalesce(lang == x, F.lit(False)) for x in LANGUAGES] + [bucket == b for b in range(BUCKETS)]
    return F.array(n, n * n, *[f.cast("double") for f in flags])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30, start: np.ndarray | None = None) -> np.ndarray:
    """Weights and, last, the intercept, by damped Newton steps over CHUNK rows at a time."""
    keep = np.append(np.full(x.shape[1], ridge * len(x)), 1e-6)
    w = np.zeros(len(keep)) if start is None else start.copy()
    for _ in range(steps):
        slope, bend = keep * w, np.diag(keep + 1e-9)
        for at in range(0, len(x), CHUNK):
            part = np.append(x[at : at + CHUNK], np.ones((len(x[at : at + CHUNK]), 1)), axis=1).astype(float)
            p = sigmoid(part @ w)
            slope += part.T @ (p - y[at : at + CHUNK])
            bend += (part * (p * (1 - p))[:, None]).T @ part
        step = np.linalg.solve(bend, slope)
        w -= step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-4:
            break
    return w


@dataclass
class Model:
    """A calibrated linear model of each view and the weights that combine their log-odds."""

    weights: list[np.ndarray] = field(default_factory=list)
    calibration: list[np.ndarray] = field(default_factory=list)
    combination: np.ndarray | None = None

    def logit(self, k: int, view: Column, grams: Column | None = None) -> Column:
        """The calibrated log-odds of view ``k``, its numbers in ``view``; ``grams`` add the mean weight of their features."""
        w, (slope, shift) = self.weights[k], self.calibration[k]
        n = len(w) - 1 - (HASHED if grams is not None else 0)
        told = sum((F.get(view, i) * float(v * slope) for i, v in enumerate(w[:n])), F.lit(float(w[-1] * slope + shift)))
        if grams is None:
            return told
        named = F.array(*[F.lit(float(v * slope)) for v in w[n:-1]])
        return told + F.aggregate(grams, F.lit(0.0), lambda a, x: a + F.get(named, x)) / F.greatest(F.size(grams), F.lit(1))


def _raw(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


@dataclass
class Round:
    """Scaled weights of both views, and the bins of log-odds from which on (up to which) each gives label 1 (0) to the other."""

    weights: list[np.ndarray]
    high: list[int] = field(default_factory=list)
    low: list[int] = field(default_factory=list)


def _bins(raw: np.ndarray) -> np.ndarray:
    return np.floor((np.clip(raw, -REACH, REACH) + REACH) * 64).astype(int)


def pseudo_labels(views: list[np.ndarray], rounds: list[Round]) -> list[np.ndarray]:
    """What unlabelled rows were given in these rounds, for each view: 1, 0, or -1 where nothing."""
    own = [np.full(len(v), -1) for v in views]
    for turn in rounds:
        for k, (x, w) in enumerate(zip(views, turn.weights)):
            at, free = _bins(_raw(w, x)), own[1 - k] < 0
            own[1 - k][free & (at >= turn.high[k])] = 1
            own[1 - k][free & (at <= turn.low[k])] = 0
    return own


def cuts(counts: np.ndarray, given: int) -> tuple[int, int]:
    """(high, low): bins behind which the ``given`` surest rows of each kind lie, none less sure than SURE."""
    sure = int(_bins(np.array([np.log(SURE / (1 - SURE))]))[0]) + 1
    up, down = np.cumsum(counts[::-1]), np.cumsum(counts)
    high = BINS - 1 - int(np.searchsorted(up, given)) if up[-1] >= given else 0
    low = int(np.searchsorted(down, given)) if down[-1] >= given else BINS - 1
    return max(high, sure), min(low, BINS - 1 - sure)


def views(docs: DataFrame) -> DataFrame:
    """doc_id, part (of PARTS, by hash), text and page: both views of each row, as arrays."""
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")

    @F.pandas_udf("array<float>")
    def joined(stats: pd.Series, grams: pd.Series) -> pd.Series:
        return pd.Series([np.append(s, np.bincount(g, minlength=HASHED) / max(1, len(g))).astype(np.float32) for s, g in zip(stats, grams)])

    page = page_view(F.col("lang"), F.col("source"), F.coalesce("n_chars", F.length(text_of())))
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(PARTS))
    told = docs.select("doc_id", part.alias("part"), text_view(text_of()).alias("v"), page.cast("array<float>").alias("page"))
    return told.select("doc_id", "part", joined("v.stats", "v.grams").alias("text"), "page")


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 1), np.float32)


def _fetched(rows: DataFrame, *also: str) -> pd.DataFrame:
    """A bounded draw of rows on the driver, in an order of its own, so that reruns fit the same matrix."""
    found = rows.select("doc_id", "text", "page", *also).toArrow().to_pandas(integer_object_nulls=True)
    order = sorted(found.index, key=lambda i: (found["doc_id"][i] or 0, found["text"][i].tobytes(), found["page"][i].tobytes()))
    return found.iloc[order].reset_index(drop=True)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "quality", fitted: int = FITTED, rounds: int = ROUNDS, viewed: DataFrame | None = None) -> Model | None:
    """Fit both views. ``viewed``: the written ``views`` of ``docs``, where there are some."""
    viewed = saved(views(docs), "views") if viewed is None else viewed
    clean = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    cut = min(PARTS, PARTS * sample // max(1, clean.count()))
    held = F.pmod(F.xxhash64(F.lit(3), F.col("doc_id")), F.lit(6))
    found = _fetched(viewed.where(F.col("part") < cut).join(clean, "doc_id").withColumn("held", F.when(held < 2, held + 1).otherwise(0).cast("int")), "label", "held")
    held, given_labels = found["held"].to_numpy(), found["label"].to_numpy()
    known, check, both = (held == k for k in range(3))
    if any(len(set(given_labels[x])) < 2 for x in (known, check, both)):
        return None
    raw = [_matrix(found["text"]), _matrix(found["page"])]
    spread = [v.std(axis=0, dtype=float) for v in raw]
    scale = [(v.mean(axis=0, dtype=float), np.where(s > 1e-9, s, 1.0)) for v, s in zip(raw, spread)]
    scaled = [(v - m) / s for v, (m, s) in zip(raw, scale)]
    free = viewed.join(clean.select("doc_id"), "doc_id", "left_anti")
    if rounds:
        free = saved(free, "unlabelled")

    def counted(done: list[Round], weights: list[np.ndarray]) -> np.ndarray:
        """For each view, how many rows that it may still give stand in each bin."""

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((2, BINS), int)
            for b in batches:
                if len(b):
                    x = [(_matrix(b[c]) - m) / s for c, (m, s) in zip(("text", "page"), scale)]
                    own = pseudo_labels(x, done)
                    for k in range(2):
                        total[k] += np.bincount(_bins(_raw(weights[k], x[k]))[own[1 - k] < 0], minlength=BINS)
            at = np.nonzero(total)
            yield pd.DataFrame({"k": at[0], "bin": at[1], "n": total[at]})

        out = np.zeros((2, BINS), int)
        for r in free.select("text", "page").mapInPandas(count, "k long, bin long, n long").groupBy("k", "bin").agg(F.sum("n").alias("n")).collect():  # 2 * BINS at most
            out[r["k"], r["bin"]] = r["n"]
        return out

    def taught(done: list[Round], share: int) -> DataFrame:
        """The rows of a draw by hash that have pseudo-labels, with those for each view."""

        def give(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    own = pseudo_labels([(_matrix(b[c]) - m) / s for c, (m, s) in zip(("text", "page"), scale)], done)
                    b = b.assign(own0=own[0], own1=own[1])
                    yield b[(own[0] >= 0) | (own[1] >= 0)]

        drawn = free.where(F.col("part") < share).select("doc_id", "text", "page")
        return drawn.mapInPandas(give, "doc_id long, text array<float>, page array<float>, own0 long, own1 long")

    done: list[Round] = []
    weights: list = [None, None]
    more: pd.DataFrame | None = None
    stood = 0  # pseudo-labels of both views
    for turn in range(rounds + 1):
        for k in range(2):
            x, y = scaled[k][known], given_labels[known]
            if more is not None and len(more):
                own = more[f"own{k}"].to_numpy()
                m, s = scale[k]
                x = np.vstack([x, ((_matrix(more[("text", "page")[k]]) - m) / s)[own >= 0]])
                y = np.append(y, own[own >= 0])
            weights[k] = fit_logistic(x, y, start=weights[k])
        if turn == rounds:
            break
        counts = counted(done, weights)
        if turn == 0:
            given = max(1, int(GIVEN * counts[0].sum()))
        limits = [cuts(c, given) for c in counts]
        done.append(Round([w.copy() for w in weights], [x[0] for x in limits], [x[1] for x in limits]))
        stood += int(sum(c[high:].sum() + c[: low + 1].sum() for c, (high, low) in zip(counts, limits)))
        more = _fetched(taught(done, min(PARTS, PARTS * fitted // max(1, stood))), "own0", "own1")
    model, logits = Model(), []
    for x, w, (m, s) in zip(scaled, weights, scale):
        model.calibration.append(fit_logistic(_raw(w, x[check])[:, None], given_labels[check], ridge=1e-4))
        model.weights.append(np.append(w[:-1] / s, w[-1] - (w[:-1] * m / s).sum()))
        logits.append(_raw(w, x[both]) * model.calibration[-1][0] + model.calibration[-1][1])
    model.combination = fit_logistic(np.stack(logits, axis=1), given_labels[both], ridge=1e-4)
    return model


def score_views(viewed: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """What ``score_documents`` gives, from written views, so texts are not read once more."""

    @F.pandas_udf("text_score double, page_score double, score double")
    def scored(text: pd.Series, page: pd.Series) -> pd.DataFrame:
        odds = [_raw(w, _matrix(v)) * c[0] + c[1] for v, w, c in zip((text, page), model.weights, model.calibration)]
        a, b, c = model.combination
        return pd.DataFrame({"text_score": sigmoid(odds[0]), "page_score": sigmoid(odds[1]), "score": sigmoid(odds[0] * a + odds[1] * b + c)})

    return viewed.select("doc_id", scored("text", "page").alias("s")).select("doc_id", "s.*", (F.col("s.score") >= threshold).alias("kept"))


def score_documents(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_score, page_score, score and kept for every row of ``docs``."""
    if model is None:
        one = F.lit(1.0)
        return docs.select("doc_id", one.alias("text_score"), one.alias("page_score"), one.alias("score"), F.lit(True).alias("kept"))
    text = let(text_view(text_of()), lambda v: model.logit(0, v["stats"], v["grams"]))
    page = let(page_view(F.col("lang"), F.col("source"), F.coalesce("n_chars", F.length(text_of()))), lambda v: model.logit(1, v))
    a, b, c = map(float, model.combination)
    odds = let(F.struct(text.alias("t"), page.alias("p")), lambda s: F.struct(s["t"].alias("t"), s["p"].alias("p"), (s["t"] * a + s["p"] * b + c).alias("all")))
    chance = lambda x: 1 / (1 + F.exp(-x))
    told = docs.select("doc_id", let(odds, lambda s: F.struct(chance(s["t"]).alias("t"), chance(s["p"]).alias("p"), chance(s["all"]).alias("all"))).alias("s"))
    return told.select("doc_id", F.col("s.t").alias("text_score"), F.col("s.p").alias("page_score"), F.col("s.all").alias("score"), (F.col("s.all") >= threshold).alias("kept"))


def op8_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    viewed = saved(views(docs), "views")
    model = train(docs, read_table(spark, sf_dir, "labels"), viewed=viewed)
    return score_documents(docs, None) if model is None else score_views(viewed, model)
