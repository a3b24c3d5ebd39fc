"""Sources and sinks: typed tables, nested lines, file scans, availability, partitioned and append-only writes."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def read_table(spark: SparkSession, path: str, schema: T.StructType | str, required: list[str] = (), key: str | None = None, sep: str = ",", header: bool = True, quote: str = '"') -> DataFrame:
    """CSV or TSV with a declared schema. A required column that is missing, or a repeated key, is an error."""
    head = spark.read.csv(path, sep=sep, header=header, quote=quote)
    if header:
        require_columns(head, list(required))
        wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        kinds = {f.name: f.dataType for f in wanted.fields}
        df = head.select(*[F.col(c).cast(kinds.get(c, T.StringType())).alias(c) for c in head.columns])
    else:
        df = spark.read.csv(path, schema=schema, sep=sep, quote=quote)
        require_columns(df, list(required))
    if key is not None:
        twice = repeated_keys(df, key).limit(1).collect()
        if twice:
            raise ValueError(f"{key} {twice[0][key]!r} comes {twice[0]['n']} times")
    return df


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_parquet_batches(spark: SparkSession, path: str, pattern: str = r"([a-z]+)-[0-9]+", into: str = "split") -> DataFrame:
    """A parquet corpus with its split taken from the file name; empty where the pattern doesn't match."""
    df = spark.read.parquet(path)
    return df.withColumn(into, F.regexp_extract(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), pattern, 1))


def scan_new_files(spark: SparkSession, root: str, manifest: DataFrame, prefix: str, extensions: list[str]) -> DataFrame:
    """Files under category folders that the manifest (filepath, category, label) lacks, with the label its category has there."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    files = found.select("path", "length", F.element_at(parts, -2).alias("category"), name.alias("name"))
    files = files.where(F.col("name").startswith(prefix) & F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)).isin(*[e.lstrip(".").lower() for e in extensions]))
    labels = manifest.groupBy("category").agg(F.min("label").alias("label"))
    known = manifest.select(F.element_at(F.split("filepath", "/"), -1).alias("name"), "category")
    return files.join(known, ["category", "name"], "left_anti").join(labels, "category", "left")


def file_fingerprint(files: DataFrame, frozen: DataFrame | None = None) -> DataFrame:
    """(path, sha256) of ``binaryFile`` rows, and whether a frozen value still holds."""
    out = files.select("path", F.sha2("content", 256).alias("sha256"))
    return out if frozen is None else out.join(frozen.select("path", F.col("sha256").alias("__f")), "path", "left").withColumn("unchanged", F.col("sha256").eqNullSafe(F.col("__f"))).drop("__f")


def missing_paths(refs: DataFrame, files: DataFrame, allowed: str | None = None) -> DataFrame:
    """Per list: references (list_name, path) to files that aren't there and match no allowed pattern, with the first example."""
    gone = refs.join(files.select("path").distinct(), "path", "left_anti")
    if allowed is not None:
        gone = gone.where(~F.col("path").rlike(allowed))
    return gone.groupBy("list_name").agg(F.count("*").alias("missing"), F.min("path").alias("example"))


def filter_available(rows: DataFrame, files: DataFrame, patterns: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose path exists, and what is left out by list, split and named pattern (``other`` for the rest)."""
    there = files.select("path").distinct()
    kind = F.lit("other")
    for name, pattern in reversed(patterns.items()):
        kind = F.when(F.col("path").rlike(pattern), name).otherwise(kind)
    out = rows.join(there, "path", "left_anti").withColumn("pattern", kind)
    return rows.join(there, "path", "left_semi"), out.groupBy("list_name", "split", "pattern").agg(F.count("*").alias("left_out"))


def write_partitioned(df: DataFrame, path: str, by: list[str], mode: str = "errorifexists") -> None:
    """One folder per key; rows are gathered by the key first, and a large key still fills several files."""
    df.repartition(*by).write.mode(mode).partitionBy(*by).option("maxRecordsPerFile", 5_000_000).parquet(path)


def append_rows(df: DataFrame, path: str, key: str) -> DataFrame:
    """Append rows whose key isn't at ``path`` yet, one for each key, and return them."""
    spark = df.sparkSession
    new = df.dropDuplicates([key])
    try:
        new = new.join(spark.read.parquet(path).select(key), key, "left_anti")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new = new.select(*df.columns)
    new.write.mode("append").parquet(path)
    return new


def new_rows(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """What ``append_rows`` would add to a table."""
    return df.dropDuplicates([key]).join(table.select(key), key, "left_anti")
