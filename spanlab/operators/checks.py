"""Guards: leakage, frozen sets, constraint suites. Violations come as rows; ``require`` makes them an error."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlab.functions.keys import frame_fingerprint
from spanlab.functions.text import norm_basic


def leakage(df: DataFrame, keys: list[str], split: str = "split") -> DataFrame:
    """(rule, violations, example): keys that stand in more than one split. Null keys don't count."""
    key = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).cast("string").alias("value")) for k in keys])).alias("k")
    seen = df.select(split, key).where("k.value IS NOT NULL").groupBy("k.rule", "k.value").agg(F.count_distinct(split).alias("n"))
    told = seen.groupBy("rule").agg(F.count_if(F.col("n") > 1).alias("violations"), F.min(F.when(F.col("n") > 1, F.col("value"))).alias("example"))
    return told


def parent_child_leakage(df: DataFrame, key: str, parent: str, split: str = "split") -> DataFrame:
    """Children that stand in another split than their parent."""
    up = df.select(F.col(key).alias(parent), F.col(split).alias("parent_split"))
    return df.join(up, parent).where(F.col(split) != F.col("parent_split"))


def split_guard(windows: DataFrame, frozen: DataFrame, group: str, split: str, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations, example) of rows against a frozen split, in one pass: unknown group, changed split, and further rules on columns.

    ``rules`` are conditions that must hold, over the windows' columns and ``frozen_split``.
    """
    j = windows.join(frozen.select(group, F.col("split").alias("frozen_split")), group, "left")
    all_rules = {"unknown_group": F.col("frozen_split").isNotNull(), "split_changed": F.col("frozen_split").isNull() | F.col(split).eqNullSafe(F.col("frozen_split")), **rules}
    bad = {name: ~F.coalesce(ok, F.lit(False)) for name, ok in all_rules.items()}
    one = j.agg(*[x for n, b in bad.items() for x in (F.count_if(b).alias(f"n_{n}"), F.min(F.when(b, F.col(group).cast("string"))).alias(f"e_{n}"))])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"n_{n}").alias("violations"), F.col(f"e_{n}").alias("example")) for n in bad])).alias("r")).select("r.*")


def text_novelty(texts: DataFrame, train: DataFrame, text: str, phrase: str) -> DataFrame:
    """Evaluation texts that a training text equals once normalised, or that hold the target phrase."""
    t = texts.withColumn("__n", norm_basic(F.col(text)))
    known = train.select(norm_basic(F.col(text)).alias("__n")).distinct().withColumn("__k", F.lit(True))
    told = t.join(known, "__n", "left").withColumn("problem", F.when(F.col("__k"), "known_text").when(F.concat(F.lit(" "), "__n", F.lit(" ")).contains(f" {norm_phrase(phrase)} "), "holds_phrase"))
    return told.where("problem IS NOT NULL").drop("__n", "__k")


def norm_phrase(phrase: str) -> str:
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in phrase.lower()).split())


def verify_frozen(df: DataFrame, cols: list[str], path: str) -> str:
    """Freeze a table's fingerprint at ``path`` on first use; later runs compare and raise where it differs."""
    from pyspark.errors import AnalysisException

    spark = df.sparkSession
    now = frame_fingerprint(df, *cols)
    try:
        before = spark.read.parquet(path).collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        now.coalesce(1).write.parquet(path)
        return "frozen"
    if before != now.collect():
        raise ValueError(f"the set differs from the one frozen at {path}")
    return "verified"


def verify_set(streams: DataFrame, files: DataFrame, training: DataFrame) -> DataFrame:
    """(stream_id, problem): streams (stream_id, path, sha256) whose file is missing or differs, repeated ids, and paths seen in training."""
    hashed = files.select("path", F.col("sha256").alias("found"))
    seen = training.select("path").distinct().withColumn("trained", F.lit(True))
    j = streams.join(hashed, "path", "left").join(seen, "path", "left")
    twice = streams.groupBy("stream_id").agg(F.count("*").alias("n")).where("n > 1").select("stream_id", F.lit("repeated_id").alias("problem"))
    problems = F.array_compact(F.array(F.when(F.col("found").isNull(), "missing_file").when(F.col("found") != F.col("sha256"), "hash_differs"), F.when(F.col("trained"), "seen_in_training")))
    return j.select("stream_id", F.explode(problems).alias("problem")).unionByName(twice)


@dataclass(frozen=True)
class Check:
    """Rows of ``table`` where ``violates`` holds are violations, named by ``ident``; ``detail`` tells more of one."""

    name: str
    table: DataFrame
    violates: Column
    ident: str
    detail: Column


def run_checks(checks: list[Check], examples: int = 5) -> DataFrame:
    """A suite as one job: (check_name, status, violations, detail, examples), the examples being the smallest ids (shorter ones first), comma-joined, and the detail that of the first.

    All predicates of a table are one projection of one scan, out of which only violations go on. Each task keeps a count and the ``examples`` smallest different ids of each check,
    and those buffers are merged, so a check that every row violates costs no more memory than one that few do. A predicate that is null is no violation.
    """
    smallest = lambda told: sorted(told.items(), key=lambda x: (len(x[0]), x[0]))[:examples]

    def buffer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, int] = {}
        kept: dict[str, dict[str, str]] = {}
        for b in batches:
            for name, rows in b.groupby("check_name"):
                counts[name] = counts.get(name, 0) + len(rows)
                mine = kept.setdefault(name, {})
                rows = rows.assign(size=rows["id"].str.len()).sort_values(["size", "id", "detail"]).drop_duplicates("id").head(examples)
                for i, d in zip(rows["id"], rows["detail"]):
                    mine[i] = min(d, mine.get(i, d))
                kept[name] = dict(smallest(mine))
        yield pd.DataFrame([(n, c, [i for i, _ in smallest(kept[n])], [d for _, d in smallest(kept[n])]) for n, c in counts.items()], columns=["check_name", "n", "ids", "details"])

    parts = []
    for source in {id(c.table): c.table for c in checks}.values():
        mine = [c for c in checks if c.table is source]
        failed = F.array_compact(F.array(*[F.when(c.violates, F.struct(F.lit(c.name).alias("check_name"), F.coalesce(F.col(c.ident).cast("string"), F.lit("")).alias("id"), F.coalesce(c.detail.cast("string"), F.lit("")).alias("detail"))) for c in mine]))
        parts.append(source.select(F.explode(failed).alias("f")).select("f.*").mapInPandas(buffer, "check_name string, n long, ids array<string>, details array<string>"))
    all_parts = reduce(DataFrame.unionByName, parts)
    each = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform(F.arrays_zip("ids", "details"), lambda x: F.struct(F.length(x["ids"]).alias("size"), x["ids"].alias("id"), x["details"].alias("detail")))))))
    told = all_parts.groupBy("check_name").agg(F.sum("n").alias("violations"), each.alias("kept"))
    names = checks[0].table.sparkSession.createDataFrame([(c.name,) for c in checks], "check_name string")
    ids = F.slice(F.array_distinct(F.transform("kept", lambda x: x["id"])), 1, examples)
    n = F.coalesce("violations", F.lit(0))
    return names.join(told, "check_name", "left").select("check_name", F.when(n == 0, "PASS").otherwise("FAIL").alias("status"), n.alias("violations"), F.get("kept", F.lit(0))["detail"].alias("detail"), F.array_join(ids, ",").alias("examples"))


def config_consistency(measured: DataFrame, cited: dict[str, float], inside: dict[str, tuple[str, str, float]], tolerance: float) -> DataFrame:
    """One measured row against cited statistics, and parameters (low column, high column, value) inside measured ranges."""
    rows = [F.struct(F.lit(c).alias("item"), F.col(c).cast("double").alias("measured"), F.lit(float(v)).alias("given"), (F.abs(F.col(c) - v) <= tolerance).alias("ok")) for c, v in cited.items()]
    rows += [F.struct(F.lit(n).alias("item"), F.col(lo).cast("double").alias("measured"), F.lit(float(v)).alias("given"), F.lit(v).between(F.col(lo), F.col(hi)).alias("ok")) for n, (lo, hi, v) in inside.items()]
    return measured.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
