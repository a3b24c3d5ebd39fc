"""User callables and SQL registration."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from spanlab.functions.text import spoken_sql


def score_with(make: Callable[[], Callable[[np.ndarray], np.ndarray]]):
    """A column function from feature arrays to scores. ``make`` loads the user's scorer once in each worker; the scorer takes a matrix."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = make()
        for b in batches:
            known = b.notna()
            out = pd.Series(np.nan, index=b.index, dtype="float64")
            if known.any():
                out[known] = scorer(np.stack(b[known].to_list()).astype(float))
            yield out

    return score


def auc_agg():
    """Area under the curve of one group's scores and positives, for groups that fit in a task; ``roc_auc`` takes any size."""

    @F.pandas_udf("double")
    def auc(score: pd.Series, positive: pd.Series) -> float:
        p = positive.astype(bool)
        n_pos, n_neg = int(p.sum()), int((~p).sum())
        if not n_pos or not n_neg:
            return float("nan")
        return float((score.rank()[p].sum() - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg))

    return auc


class ExpandWindows:
    """Window starts in [lo, hi]: hops that fit whole, and a right-aligned one when ``tail`` or more remains."""

    def eval(self, lo: int, hi: int, length: int, hop: int, tail: int):
        if lo is None or hi is None or hi - lo < length:
            return
        n = (hi - lo - length) // hop
        for i in range(n + 1):
            yield (lo + i * hop,)
        left = hi - (lo + n * hop + length)
        if left > 0 and left >= tail:
            yield (hi - length,)


def register(spark: SparkSession) -> None:
    """Make ``overlaps``, ``edit_ratio``, ``norm_basic``, ``norm_spoken`` and the table function ``expand_windows`` known to SQL."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION overlaps(a0 BIGINT, a1 BIGINT, b0 BIGINT, b1 BIGINT) RETURNS BOOLEAN RETURN least(a1, b1) - greatest(a0, b0) > 0")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION edit_ratio(a STRING, b STRING) RETURNS DOUBLE RETURN levenshtein(coalesce(a, ''), coalesce(b, '')) / greatest(length(coalesce(a, '')), length(coalesce(b, '')), 1)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION norm_basic(a STRING) RETURNS STRING RETURN trim(regexp_replace(lower(a), '[^a-z0-9]+', ' '))")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION norm_spoken(a STRING) RETURNS STRING RETURN {spoken_sql('a')}")
    spark.udtf.register("expand_windows", F.udtf(ExpandWindows, returnType="w0: bigint"))
