"""Running totals, islands, looks back and exact quantiles that one key with many rows doesn't hold in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import DateType, NumericType, TimestampType

from spanlab.sources.shared import settled

#: Rows of a key that one task puts in order; a table with a larger key is dealt to ranges, of which there are CHUNKS at most.
ROWS, CHUNKS = 1 << 20, 256
#: Values that borders of a column without a numeric order are chosen from.
SEEN = 2048


def ranged(df: DataFrame, keys: list[str], order: str, counted: DataFrame | None = None) -> tuple[DataFrame, list | None]:
    """The rows, and ascending borders that cut ``order`` into ranges; None for borders where no key has more than ROWS rows, so that a plain window does.

    Rows are counted per key by one aggregation over the keys alone (of ``counted``, where another table is known to hold no fewer rows of each key). Only with a larger key are the
    rows written once, to the shared folder, from which borders, totals and windows all read; the driver gets the borders.
    """
    most, n = (counted or df).groupBy(*keys).count().agg(F.max("count"), F.sum("count")).first()
    if (most or 0) <= ROWS:
        return df, None
    df, chunks = settled(df, "ranged"), min(CHUNKS, -(-n // ROWS))
    kind = df.schema[order].dataType
    if isinstance(kind, (NumericType, DateType, TimestampType)):
        cuts = df.agg(F.percentile_approx(order, [i / chunks for i in range(1, chunks)], 10_000)).first()[0] or []
    else:
        seen = sorted(r[0] for r in df.select(order).where(F.col(order).isNotNull()).orderBy(F.rand(7)).limit(SEEN).collect())
        cuts = [seen[len(seen) * i // chunks] for i in range(1, chunks)] if seen else []
    return df, sorted(set(cuts))


def place(value: Column, cuts: list) -> Column:
    """How many of the ascending ``cuts`` lie at or below a value, by a tree of comparisons. NaN is beyond them all."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value < F.lit(cuts[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(cuts))


def _dealt(df: DataFrame, order: str, cuts: list, descending: bool = False) -> DataFrame:
    """``__part``: the range that a row falls into, ascending in the asked direction. Rows that are equal in ``order`` share one; nulls come first, or last where it is descending."""
    part = F.when(F.col(order).isNull(), F.lit(-1)).otherwise(place(F.col(order), cuts))
    return df.withColumn("__part", -part if descending else part)


def _carried(cut: DataFrame, keys: list[str], totals: dict[str, Column], ahead: dict[str, Column], every: dict[str, Column] | None = None) -> DataFrame:
    """Each row with what the ranges ahead of its own hold: ``totals`` per key and range, put together over the ranges ahead (``ahead``) or over all of them (``every``)."""
    total = cut.groupBy(*keys, "__part").agg(*[c.alias(n) for n, c in totals.items()])
    before, whole = W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*keys)
    # Keys may be null, so the totals' are renamed and compared with care for that.
    names = {k: f"__k_{i}" for i, k in enumerate([*keys, "__part"])}
    told = total.select(*[F.col(k).alias(n) for k, n in names.items()], *[c.over(before).alias(n) for n, c in ahead.items()], *[c.over(whole).alias(n) for n, c in (every or {}).items()])
    on = F.col("__part") == F.col(names["__part"])
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(names[k]))
    return cut.join(told, on).drop(*names.values())


def cumulative(df: DataFrame, keys: list[str], order: str, sums: list[str], descending: bool = False, tie: list = ()) -> DataFrame:
    """``before_<c>``: totals of the key's rows ahead in ``order`` (then ``tie``), and ``all_<c>``: those of all its rows.

    With a key of more than ROWS rows, rows are dealt to ranges of ``order``, summed per range, and only then summed in a window inside each range. Nulls come first, or last where it
    is descending.
    """
    rows, cuts = ranged(df, keys, order)
    return _running(rows, cuts, keys, order, sums, descending, tie)


def _running(df: DataFrame, cuts: list | None, keys: list[str], order: str, sums: list[str], descending: bool = False, tie: list = ()) -> DataFrame:
    by = [F.col(order).desc() if descending else F.col(order), *tie]
    inside = lambda c, *part: F.coalesce(F.sum(c).over(W.partitionBy(*keys, *part).orderBy(*by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    if cuts is None:
        return df.select("*", *[x for c in sums for x in (inside(c).alias(f"before_{c}"), F.sum(c).over(W.partitionBy(*keys)).alias(f"all_{c}"))])
    totals = {f"__t_{c}": F.sum(c) for c in sums}
    cut = _carried(_dealt(df, order, cuts, descending), keys, totals, {f"__a_{c}": F.sum(f"__t_{c}") for c in sums}, {f"all_{c}": F.sum(f"__t_{c}") for c in sums})
    return cut.select(*df.columns, *[x for c in sums for x in ((F.coalesce(f"__a_{c}", F.lit(0)) + inside(c, "__part")).alias(f"before_{c}"), F.col(f"all_{c}"))])


def islands(df: DataFrame, keys: list[str], order: str, reach: Column, fresh: Callable[[Column], Column], tie: list = (), counted: DataFrame | None = None) -> DataFrame:
    """``begins``: 1 where a row begins anew, which ``fresh`` tells from the largest ``reach`` ahead of it (null without one); ``island``: how many rows up to it do, in ``order`` (then ``tie``) of its key.

    With a key of more than ROWS rows, ranges of ``order`` hand on their largest reach, and then their number of beginnings.
    """
    cols = df.columns
    df, cuts = ranged(df.withColumn("__reach", reach), keys, order, counted)
    if cuts is None:
        w = W.partitionBy(*keys).orderBy(order, *tie)
        flagged = df.withColumn("begins", F.coalesce(fresh(F.max("__reach").over(w.rowsBetween(W.unboundedPreceding, -1))).cast("int"), F.lit(0)))
        return flagged.select(*cols, "begins", F.sum("begins").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("island"))
    w = W.partitionBy(*keys, "__part").orderBy(order, *tie)
    cut = _carried(_dealt(df, order, cuts), keys, {"__top": F.max("__reach")}, {"__ahead": F.max("__top")})
    before = F.greatest("__ahead", F.max("__reach").over(w.rowsBetween(W.unboundedPreceding, -1)))
    flagged = cut.withColumn("begins", F.coalesce(fresh(before).cast("int"), F.lit(0))).drop("__ahead", "__reach")
    numbered = _carried(flagged, keys, {"__begun": F.sum("begins")}, {"__ahead": F.sum("__begun")})
    return numbered.select(*cols, "begins", (F.coalesce("__ahead", F.lit(0)) + F.sum("begins").over(w.rowsBetween(W.unboundedPreceding, 0))).alias("island"))


def looking_back(df: DataFrame, keys: list[str], order: str, back: int, told: Callable[[Callable], dict[str, Column]], tie: list = (), counted: DataFrame | None = None) -> DataFrame:
    """Rows with the columns that ``told`` makes from windows over the ``back`` rows ahead of each at most; ``told`` gets a function from frame bounds (none: whole order) to a window.

    With a key of more than ROWS rows, rows are numbered within their key and cut into pieces of ROWS; each piece gets the ``back`` rows ahead of it too, which go again afterwards. Columns that build on
    one another look back by the sum of their frames.
    """
    cols = df.columns
    df, cuts = ranged(df, keys, order, counted)
    part, by = keys, [order, *tie]
    if cuts is not None:
        if back >= ROWS:
            raise ValueError(f"a look back over {back} rows is more than a piece of {ROWS}")
        at, last = F.col("before___one"), F.lit(ROWS - back)
        df = _running(df.withColumn("__one", F.lit(1)), cuts, keys, order, ["__one"], tie=tie)
        df = df.withColumn("__home", F.floor(at / ROWS)).withColumn("__piece", F.explode(F.when(at % ROWS >= last, F.array("__home", F.col("__home") + 1)).otherwise(F.array("__home"))))
        part, by = [*keys, "__piece"], ["before___one"]

    def window(*bounds: int) -> W:
        w = W.partitionBy(*part).orderBy(*by)
        return w.rowsBetween(*bounds) if bounds else w

    made = told(window)
    for name, c in made.items():
        df = df.withColumn(name, c)
    return (df if cuts is None else df.where("__home = __piece")).select(*[c for c in cols if c not in made], *made)


def quantiles(df: DataFrame, keys: list[str], col: str, qs: dict[str, float], weight: str | None = None) -> DataFrame:
    """Exact linear quantiles (name -> share) of a column's values that aren't null, per key. Distinct values are counted first; ``weight`` counts rows that stand for several."""
    counts = df.where(F.col(col).isNotNull()).groupBy(*keys, col).agg((F.sum(weight) if weight else F.count("*")).alias("__c"))
    run = cumulative(counts, keys, col, ["__c"])
    at = {n: (F.col("all___c") - 1) * q for n, q in qs.items()}
    holds = lambda rank: F.when((F.col("before___c") <= rank) & (rank < F.col("before___c") + F.col("__c")), F.col(col).cast("double"))
    found = run.groupBy(*keys).agg(*[x for n, p in at.items() for x in (F.max(holds(F.floor(p))).alias(f"__lo_{n}"), F.max(holds(F.ceil(p))).alias(f"__hi_{n}"), F.max(p).alias(f"__at_{n}"))])

    def between(n: str) -> Column:
        p, lo, hi = F.col(f"__at_{n}"), F.col(f"__lo_{n}"), F.col(f"__hi_{n}")
        return F.when(F.floor(p) == F.ceil(p), lo).otherwise((F.ceil(p) - p) * lo + (p - F.floor(p)) * hi)

    return found.select(*keys, *[between(n).alias(n) for n in qs])
