"""Line dedup by distinct-site spread.

A line (split at line ends, trimmed of white space) is boilerplate when it stands on at least as many distinct
sites as SPREAD asks for its number of words. HyperLogLog sketches per line merge by aggregation; lines whose
estimate lies near the threshold are counted exactly. The first place of a boilerplate line (smallest doc_id, then
position) stays, so one document keeps a passage that many repeat; every other place goes.

Lines of fewer than three words stay. A null site counts as one site of its own, a null text as empty. Rows with a
null doc_id stay as they are. Equal rows are treated alike; rows that share a doc_id with another text are kept apart. An empty table
gives an empty result; columns of ``docs`` other than doc_id, text and the site pass through whatever their names, but for ``into``.
Texts may be as long as a row can be: time is linear in their lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlab.llm.common import free_names, hot_keys, let, read_table, salted_join, saved, text_of, word_array

#: (least number of words, distinct sites): the last row that fits holds.
SPREAD = ((3, 5), (10, 3), (50, 2))
LG_K = 12
#: Estimates within this share of the threshold (one site at least) are counted exactly. Twelve index bits give 1.6 % error.
BAND = 0.1
BLANK = " \t\n\x0b\x0c\r"
#: What names a line: two hashes of its text, 96 bits together.
KEY = ["line", "proof"]
#: Places from which on a line of one site is counted too, as it may be hot.
FREQUENT = 1000
#: Characters that three words take at least.
SHORTEST = 5


def _threshold(words: Column, spread) -> Column:
    out = F.lit(None).cast("int")
    for least, sites in spread:
        out = F.when(words >= least, F.lit(sites)).otherwise(out)
    return out


def _lines(docs: DataFrame, site: str) -> DataFrame:
    """doc_id, text_hash, site, pos, the line's two hashes and the trimmed line, for every line that can hold three words."""
    text = text_of()
    cut = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.coalesce(F.col(site), F.lit("\0")).alias("site"), F.posexplode(F.split(text, "\n")).alias("pos", "raw"))
    cut = cut.select("doc_id", "text_hash", "site", "pos", F.btrim("raw", F.lit(BLANK)).alias("trimmed")).where((F.length("trimmed") >= SHORTEST) & F.col("doc_id").isNotNull())
    return cut.select("doc_id", "text_hash", "site", "pos", F.xxhash64("trimmed").alias("line"), F.hash("trimmed").alias("proof"), "trimmed")


def boilerplate(docs: DataFrame, site: str = "source", spread=SPREAD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The boilerplate lines with their first places, every place of lines on two sites or more, and the hot lines."""
    lines = _lines(docs, site)
    counted = lines.groupBy(*KEY).agg(F.min("site").alias("a"), F.max("site").alias("b"), F.count("*").alias("n"), F.max(F.size(word_array(F.col("trimmed")))).alias("words"))
    counted = saved(counted.where((F.col("a") != F.col("b")) | (F.col("n") >= FREQUENT)), "counted")
    hot = hot_keys(counted, KEY, "n", counted.agg(F.sum("n")).first()[0] or 0)
    shared = counted.where((F.col("a") != F.col("b")) & (F.col("words") >= spread[0][0])).select(*KEY, "words")
    places = saved(salted_join(lines.drop("trimmed"), shared, KEY, hot, ["doc_id", "pos"]), "lines")
    first = F.min(F.struct("doc_id", "pos")).alias("first")
    sketched = places.groupBy(*KEY).agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), first, F.max("words").alias("words"))
    sketched = sketched.select(*KEY, F.hll_sketch_estimate("sketch").alias("sites"), _threshold(F.col("words"), spread).alias("least"), "first")
    sketched = saved(sketched, "sketched")
    band = F.greatest(F.lit(1.0), F.col("least") * BAND)
    near = F.abs(F.col("sites") - F.col("least")) <= band
    clear = sketched.where(~near & (F.col("sites") >= F.col("least"))).select(*KEY, "first")
    exact = salted_join(places, sketched.where(near).select(*KEY, "least", "first"), KEY, hot, ["doc_id", "pos"]).groupBy(*KEY, "least", "first", "site").agg(F.count("*").alias("n"))
    exact = exact.groupBy(*KEY, "least", "first").agg(F.count("*").alias("sites")).where("sites >= least").select(*KEY, "first")
    return clear.unionByName(exact), places, hot


def line_dedup(docs: DataFrame, site: str = "source", spread=SPREAD, into: str = "lines") -> DataFrame:
    """``docs`` with text cleaned and a struct ``into`` of n_lines, n_removed, removed_words and left (any words left)."""
    lines, places, hot = boilerplate(docs, site, spread)
    again = salted_join(places, lines, KEY, hot, ["doc_id", "pos"]).where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("pos") != F.col("first.pos")))
    ident, hashed, at, held = free_names(docs, "__id", "__hash", "__gone", "__places")
    gone = again.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias(at), F.collect_set(F.struct("pos", "words")).alias(held))
    gone = gone.select(F.col("doc_id").alias(ident), F.col("text_hash").alias(hashed), at, held)
    text = text_of()
    out = docs.join(gone, (docs["doc_id"] == F.col(ident)) & (F.xxhash64(text) == F.col(hashed)), "left").drop(ident, hashed)
    # array_except goes through a hash set, so a text with many lines of which many go takes linear time.
    left = lambda ls: F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col(at)), lambda i: F.get(ls, i))
    kept = F.when(F.col(at).isNull(), F.col("text")).otherwise(let(F.split(text, "\n"), lambda ls: F.array_join(left(ls), "\n")))
    told = F.struct(
        F.size(F.split(text, "\n")).cast("long").alias("n_lines"),
        F.coalesce(F.size(at), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.aggregate(held, F.lit(0).cast("long"), lambda a, x: a + x["words"]), F.lit(0)).cast("long").alias("removed_words"),
        (F.length(F.translate(F.coalesce(kept, F.lit("")), BLANK, "")) > 0).alias("left"),
    )
    return out.withColumns({into: told, "text": kept}).drop(at, held)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup(docs, into="__l").select("doc_id", "__l.n_lines", "__l.n_removed", "__l.removed_words", "text")


def sql(spread=SPREAD) -> str:
    """The same rows for DuckDB, with exact counts."""
    least = "CASE " + " ".join(f"WHEN words >= {w} THEN {s}" for w, s in reversed(spread)) + " END"
    blank = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS site, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
p AS (SELECT doc_id, site, ls, unnest(range(1, len(ls) + 1)) AS i FROM d),
l AS (SELECT doc_id, site, i, trim(ls[i], {blank}) AS line FROM p),
w AS (SELECT *, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words FROM l),
b AS (SELECT line, words, count(DISTINCT site) AS sites, min((doc_id, i)) AS first FROM w WHERE words >= {spread[0][0]} GROUP BY line, words),
g AS (SELECT w.doc_id, w.i, w.words FROM w JOIN b ON w.line = b.line AND w.words = b.words WHERE sites >= {least.replace('words', 'b.words')} AND (w.doc_id, w.i) <> first),
k AS (SELECT doc_id, list(i) AS gone, count(*) AS n_removed, sum(words) AS removed_words FROM g GROUP BY doc_id),
j AS (SELECT d.doc_id, len(ls)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed_words, 0)::BIGINT AS removed_words,
  d.text AS old, ls, gone FROM d LEFT JOIN k ON d.doc_id = k.doc_id)
SELECT doc_id, n_lines, n_removed, removed_words,
  CASE WHEN n_removed = 0 THEN old ELSE array_to_string(list_filter(ls, lambda x, i: NOT list_contains(gone, i)), chr(10)) END AS text
FROM j"""
