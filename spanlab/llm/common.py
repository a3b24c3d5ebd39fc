"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlab.sources.shared import fresh_path

#: Java regular expression of the white space between words.
SPACE = r"[\x20\x09-\x0D]"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it any number of times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of ``df`` is called so, in whatever case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def word_array(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, in order."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != F.lit(""))


#: Paths that ``saved`` has written and nobody has discarded.
_made: list[str] = []


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._spanlab_path = path
    _made.append(path)
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``saved`` wrote, once nothing reads it any more."""
    path = getattr(df, "_spanlab_path", None)
    if path:
        _delete(df.sparkSession, path)


def saved_alone(make, name: str) -> DataFrame:
    """``saved(make(), name)``, after which what was written on the way is deleted."""
    before = set(_made)
    out = saved(make(), name)
    for path in [p for p in _made if p not in before and p != out._spanlab_path]:
        _delete(out.sparkSession, path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if path in _made:
        _made.remove(path)


#: A key with more than this share (one over it) of all rows is hot.
HOT = 256


def hot_keys(counted: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """(keys, salts) of the hot keys among rows that are one per key with their numbers ``n``. There are fewer than HOT of them, so they are broadcast."""
    rows = counted.where(F.col(n) * HOT > total).select(*keys, F.ceil(F.col(n) * HOT / max(total, 1)).cast("int").alias("__salts"))
    return F.broadcast(rows)


def salted_join(rows: DataFrame, once: DataFrame, keys: list[str], hot: DataFrame, by: list[str]) -> DataFrame:
    """Inner join with a table of one row per key. Rows of a hot key are dealt to salts by ``by``, and its one row stands once for each salt."""
    salt = F.coalesce(F.pmod(F.xxhash64(*by), F.col("__salts")), F.lit(0)).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))
    left = rows.join(hot, keys, "left").withColumn("__salt", salt).drop("__salts")
    right = once.join(hot, keys, "left").withColumn("__salt", each).drop("__salts")
    return left.join(right, [*keys, "__salt"]).drop("__salt")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
