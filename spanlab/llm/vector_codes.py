"""Vectors as codes of four codebook entries, fitted and assigned exactly with LAESA pivots.

Components become integers floor(1024 * x). A vector is cut into PARTS equal consecutive parts, and each part position has a codebook of up to ENTRIES entries, at
first the parts of the smallest vec_ids. A round assigns every part to its nearest entry (squared Euclidean distance, ties to the lower index) and puts the
componentwise floored mean of its parts in place of each used entry.

LAESA: a part position's PIVOTS are initial entries that lie far apart. They stay, so the distances of every part to them are computed once and
written with the vectors. In each round the distances of pivots and entries are known too, and |d(part, pivot) - d(entry, pivot)| is a lower bound of d(part, entry). A part looks
at the entries in the order of that bound and evaluates exactly, on integers, until the bound passes the best distance found; so the result is that of trying them all.

Rows with a null vector, or a null or non-finite component, are dropped. The length of the vector with the smallest vec_id (then smallest components) holds: rows of
another length stay with null code and error, as do all rows where every vec_id is null. Where the length isn't a multiple of PARTS, the last part is filled up with zeros. Rows
with a null vec_id never start an entry but are assigned and count in means; equal rows are rows of their own. Components are held within +-2**29 / sqrt(width of
a part), rounded down to a power of two, so that distances fit in 64 bits (for 64 components: beyond +-131,072 before the scaling). A sum of errors beyond 64 bits is null. Other columns are
not read, and an empty table gives an empty result. The driver holds codebooks only: PARTS * ENTRIES entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlab.llm.common import discard, hot_keys, read_table, salted_join, saved

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
PIVOTS = 8
#: Parts that are looked at together, and entries that each evaluates between two looks at its bound.
TOGETHER, STEP = 2048, 4
#: Share of its terms by which a bound is lowered: far more than floating point can be off.
SLACK = 1e-9


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row of ``a`` to every row of ``b``."""
    return np.stack([((a - y) ** 2).sum(axis=1) for y in b], axis=1) if len(b) else np.empty((len(a), 0), np.int64)


def choose_pivots(book: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Up to ``most`` entries that lie far apart: each next one is farthest from those before it (ties to the lower index)."""
    chosen, away = [0], distances(book, book[:1])[:, 0]
    while len(chosen) < most and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, distances(book, book[chosen[-1:]])[:, 0])
    return book[chosen]


def nearest(parts: np.ndarray, near: np.ndarray, book: np.ndarray, bars: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(entry, squared distance) of each part and the number of exact evaluations. ``near`` and ``bars``: distances of parts and of entries to the pivots."""
    m, k = len(parts), len(book)
    bound = np.zeros((m, k))
    for p in range(bars.shape[1]):
        x, y = near[:, p, None], bars[None, :, p]
        np.maximum(bound, np.abs(x - y) - SLACK * (x + y), out=bound)
    order = np.argsort(bound, axis=1, kind="stable")
    bound = np.take_along_axis(bound, order, axis=1) ** 2 * (1 - SLACK)
    best, who, tried = np.full(m, np.iinfo(np.int64).max), np.full(m, k), 0
    active = np.arange(m)
    for at in range(0, k, STEP):
        active = active[bound[active, at] <= best[active]]
        if not len(active):
            break
        entries = order[active, at : at + STEP]
        found = ((book[entries] - parts[active, None, :]) ** 2).sum(axis=2)
        tried += found.size
        least = found.min(axis=1)
        first = np.where(found == least[:, None], entries, k).min(axis=1)
        better = (least < best[active]) | ((least == best[active]) & (first < who[active]))
        best[active[better]], who[active[better]] = least[better], first[better]
    return who, best, tried


class Codebooks:
    """The codebooks of all part positions and their fixed pivots: what tasks need to assign parts."""

    def __init__(self, books: np.ndarray, pivots: list[np.ndarray]):
        self.books, self.pivots = books, pivots
        self.bars = [np.sqrt(distances(b, p)) for b, p in zip(books, pivots)]
        self.at = np.cumsum([0] + [len(p) for p in pivots])

    def near(self, vectors: np.ndarray) -> np.ndarray:
        """Distances of each vector's parts to their pivots, side by side."""
        w = self.books.shape[2]
        return np.concatenate([np.sqrt(distances(vectors[:, k * w : (k + 1) * w], p)) for k, p in enumerate(self.pivots)], axis=1)

    def assign(self, vectors: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entries, squared distances) of each vector's parts."""
        w = self.books.shape[2]
        codes, errors = np.empty((2, len(vectors), PARTS), np.int64)
        for lo in range(0, len(vectors), TOGETHER):
            rows = slice(lo, lo + TOGETHER)
            for k in range(PARTS):
                codes[rows, k], errors[rows, k], _ = nearest(vectors[rows, k * w : (k + 1) * w], near[rows, self.at[k] : self.at[k + 1]], self.books[k], self.bars[k])
        return codes, errors


def limit(width: int) -> int:
    """The largest component that is told apart in parts of ``width``."""
    return 1 << int(29 - np.ceil(np.log2(max(width, 1)) / 2))


def _matrix(column: pd.Series, kind) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(kind) if len(column) else np.empty((0, 0), kind)


def _integers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label and components of the rows that are kept."""
    whole = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    held = lambda x: F.greatest(F.least(F.floor(x.cast("double") * SCALE), F.lit(2**30)), F.lit(-(2**30))).cast("int")
    rows = vectors.where(F.col(vector_col).isNotNull() & whole)
    return rows.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.transform(vector_col, held).alias("components"))


def _means(measured: DataFrame, codebooks: Codebooks) -> np.ndarray:
    """The codebooks of the next round: sums and counts are added up in each task first, then by key."""
    width = codebooks.books.shape[2]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((*codebooks.books.shape[:2], width + 1), np.int64)
        for b in batches:
            vectors = _matrix(b["components"], np.int64)
            codes, _ = codebooks.assign(vectors, _matrix(b["near"], float))
            for k in range(PARTS):
                part = np.concatenate([vectors[:, k * width : (k + 1) * width], np.ones((len(b), 1), np.int64)], axis=1)
                np.add.at(total[k], codes[:, k], part)
        used = np.argwhere(total[:, :, width] > 0)
        part, entry = np.repeat(used, width + 1, axis=0).T
        place = np.tile(np.arange(width + 1), len(used))
        yield pd.DataFrame({"part": part, "entry": entry, "place": place, "total": total[part, entry, place]})

    told = measured.mapInPandas(sums, "part int, entry int, place int, total long").groupBy("part", "entry", "place").agg(F.sum("total").alias("total"))
    total = np.zeros((*codebooks.books.shape[:2], width + 1), np.int64)
    for r in told.collect():
        total[r["part"], r["entry"], r["place"]] = r["total"]
    counts = total[:, :, width:]
    return np.where(counts > 0, total[:, :, :width] // np.maximum(counts, 1), codebooks.books)


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) for each kept row, with the codebooks by part, entry and component."""
    rows = saved(_integers(vectors, id_col, vector_col, label_col), "vectors")
    told = "vec_id {0}, label {1}, code string, error long".format(rows.schema["vec_id"].dataType.simpleString(), rows.schema["label"].dataType.simpleString())
    named = rows.where("vec_id IS NOT NULL")
    first = named.orderBy("vec_id", "components").first()
    length = len(first["components"]) if first else -1
    width = -(-max(length, 0) // PARTS)
    empty = rows.where(F.size("components") != length).selectExpr("vec_id", "label", "cast(null AS string) AS code", "cast(null AS long) AS error")
    if first is None:
        return empty, np.zeros((PARTS, 0, width), np.int64)
    filled = F.concat("components", F.array_repeat(F.lit(0), PARTS * width - length))
    most = limit(width)
    clipped = F.transform(filled, lambda x: F.greatest(F.least(x, F.lit(most)), F.lit(-most)))
    same = rows.where(F.size("components") == length).select("vec_id", "label", clipped.alias("components"))
    start = same.where("vec_id IS NOT NULL").orderBy("vec_id", "components").limit(ENTRIES).collect()
    books = np.array([r["components"] for r in start], np.int64).reshape(len(start), PARTS, width).swapaxes(0, 1)
    codebooks = Codebooks(books, [choose_pivots(b) for b in books])

    @F.pandas_udf("array<double>")
    def near(components: pd.Series) -> pd.Series:
        return pd.Series(list(codebooks.near(_matrix(components, np.int64)))) if len(components) else pd.Series([], dtype=object)

    measured = saved(same.withColumn("near", near("components")), "measured")
    for _ in range(rounds):
        codebooks = Codebooks(_means(measured, codebooks), codebooks.pivots)

    @F.pandas_udf("code string, error long")
    def coded(components: pd.Series, near: pd.Series) -> pd.DataFrame:
        if not len(components):
            return pd.DataFrame({"code": pd.Series([], dtype=str), "error": pd.Series([], dtype="int64")})
        codes, errors = codebooks.assign(_matrix(components, np.int64), _matrix(near, float))
        return pd.DataFrame({"code": ["".join(f"{c:02x}" for c in row) for row in codes.tolist()], "error": errors.sum(axis=1)})

    out = saved(measured.select("vec_id", "label", coded("components", "near").alias("c")).select("vec_id", "label", "c.code", "c.error").unionByName(empty), "codes")
    for old in (rows, measured):
        discard(old)
    return out.select(*[F.col(f.split()[0]) for f in told.split(", ")]), codebooks.books


def label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with label_error: errors summed over equal labels, nulls together. Labels with many rows are dealt to salts."""
    keys = ["__null", "__label"]
    label = F.col("label")
    blank = F.coalesce(label.cast("string"), F.lit(""))
    rows = codes.withColumns({"__null": label.isNull(), "__label": blank})
    sums = rows.groupBy(*keys).agg(F.try_sum("error").alias("label_error"), F.count("*").alias("__n"))
    total = codes.count()
    return salted_join(rows, sums.drop("__n"), keys, hot_keys(sums, keys, "__n", total), ["vec_id", "code"]).drop(*keys)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes(read_table(spark, sf_dir, "embeddings"))
    digest = sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return label_errors(codes).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def sql() -> str:
    """The same rows for DuckDB: every part against every entry, on whole numbers in doubles, which are exact here."""
    near = lambda r: f"""
a{r} AS MATERIALIZED (SELECT n, part, any_value(x) AS x, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
  SELECT p.n, p.part, p.x, entry, list_inner_product(x, x) + list_inner_product(b, b) - 2 * list_inner_product(x, b) AS d FROM p JOIN b{r} ON p.part = b{r}.part) GROUP BY n, part),"""  # noqa: E731
    rounds = "".join(
        f"""{near(r)}
m{r} AS (SELECT part, entry, list(m ORDER BY i) AS m FROM (SELECT part, entry, i, floor(sum(x[i]) / count(*)) AS m FROM (SELECT part, entry, x, unnest(range(1, len(x) + 1)) AS i FROM a{r}) GROUP BY part, entry, i) GROUP BY part, entry),
b{r + 1} AS MATERIALIZED (SELECT b{r}.part, b{r}.entry, coalesce(m, b) AS b FROM b{r} LEFT JOIN m{r} ON b{r}.part = m{r}.part AND b{r}.entry = m{r}.entry),"""
        for r in range(ROUNDS)
    )
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id, label, list_transform(embedding, lambda y: floor(CAST(y AS DOUBLE) * {SCALE})) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
p AS MATERIALIZED (SELECT n, k AS part, v[k * len(v) // {PARTS} + 1 : (k + 1) * len(v) // {PARTS}] AS x FROM v, range({PARTS}) t(k)),
b0 AS MATERIALIZED (SELECT part, n - 1 AS entry, x AS b FROM p WHERE n <= {ENTRIES}),{rounds}{near(ROUNDS)}
h AS (SELECT sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(b) AS y, unnest(range(1, len(b) + 1)) AS i FROM b{ROUNDS})),
c AS (SELECT n, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY n)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN c USING (n), h"""
