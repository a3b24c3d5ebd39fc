"""Hash keys, fingerprints, mappings and small numeric helpers."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stable_hash64(*cols: Column) -> Column:
    """Sixteen hex digits: the first eight bytes of sha256 over the texts joined by |. Their order is that of unsigned numbers."""
    return F.substring(F.sha2(F.concat_ws("|", *[c.cast("string") for c in cols]), 256), 1, 16)


def hash60(*cols: Column) -> Column:
    """The first 60 bits of ``stable_hash64`` as a number."""
    return F.conv(F.substring(stable_hash64(*cols), 1, 15), 16, 10).cast("long")


def uniform(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the keys alone, whatever the partitioning: 48 bits of the hash."""
    return F.conv(F.substring(stable_hash64(*cols), 1, 12), 16, 10).cast("long") / float(1 << 48)


def md5_mod(c: Column, m: int) -> Column:
    """The whole 128-bit md5 modulo m, folded over four 32-bit pieces."""
    h = F.md5(c.cast("string"))
    out = F.lit(0).cast("long")
    for k in range(4):
        out = (out * 4294967296 + F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long")) % m
    return out


def config_hash(config: dict) -> str:
    """Twelve hex digits of a configuration, whatever the order of its keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:12]


def frame_fingerprint(df: DataFrame, *cols: str) -> DataFrame:
    """One row: count, sum and xor of the rows' 60-bit hashes; the order of rows doesn't matter, repeated rows do. Separators inside values are escaped, so none moves across columns."""
    plain = lambda c: F.regexp_replace(F.col(c).cast("string"), r"([\\|])", r"\\$1")
    h = hash60(*[F.coalesce(plain(c), F.lit("\0")) for c in cols])
    return df.select(h.alias("h")).agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)") % 1_000_000_007).cast("long").alias("total"), F.bit_xor("h").alias("parity"))


def map_category(df: DataFrame, col: str, mapping: dict[str, str], into: str) -> DataFrame:
    """A closed vocabulary: a value without a mapping fails the job and is named."""
    named = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(into, F.coalesce(F.try_element_at(named, F.col(col)), F.when(F.col(col).isNotNull(), F.raise_error(F.concat(F.lit("no mapping for "), F.col(col))).cast("string"))))


def derive_source_group(clips: DataFrame) -> DataFrame:
    """``source_group``: the parent's recording_id where there is a parent, else the row's own."""
    parents = clips.select(F.col("filepath").alias("parent_filepath"), F.col("recording_id").alias("parent_recording"))
    return clips.join(parents, "parent_filepath", "left").withColumn("source_group", F.coalesce("parent_recording", "recording_id")).drop("parent_recording")


def case_map(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for condition, value in reversed(rules):
        out = F.when(condition, value).otherwise(out)
    return out


def bucketize(c: Column, cuts: list[float], null_label: str) -> Column:
    """``<cut`` of the first cut above the value, ``>=last`` beyond all, a label of its own for null."""
    out = F.lit(f">={cuts[-1]:g}")
    for cut in reversed(cuts):
        out = F.when(c < cut, f"<{cut:g}").otherwise(out)
    return F.when(c.isNull(), null_label).otherwise(out)


def select_bank(rows: DataFrame, keep: Column, empty: Column) -> tuple[DataFrame, DataFrame]:
    """Reusable rows, and the excluded ones with the reason."""
    reason = F.when(~keep, "not_in_bank").when(empty, "empty")
    told = rows.withColumn("reason", reason)
    return told.where("reason IS NULL").drop("reason"), told.where("reason IS NOT NULL")


def db(rms: Column, eps: float = 1e-9) -> Column:
    return 20 * F.log10(rms + eps)


def vec_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vec_normalize(a: Column) -> Column:
    norm = F.sqrt(vec_dot(a, a))
    return F.transform(a, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))


def cosine(a: Column, b: Column) -> Column:
    return vec_dot(a, b) / F.sqrt(vec_dot(a, a) * vec_dot(b, b))
