"""Quality rules: a threshold table compiled into one native projection.

Null and empty texts have no words, so they fail the base rule; long ones are read whole; equal rows get equal results and an empty table none. Ratios are compared as
integers (100 * part against bound * whole), so every engine decides ties alike.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlab.llm.common import let, read_table, text_of, word_array

SYMBOLS = "#*$%&|<>"
WINDOW = 8
# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a and are as at be by for from in is it of on or that the this to was with "
    "au aux de des du en est et la le les ne pas par pour que qui se sur un une "
    "das dem den der des die ein eine für im in ist mit nicht sich und von zu "
    "al con de del el en es la las lo los no para por que se su un una y"
).split()


@dataclass(frozen=True)
class Rule:
    """Fails when 100 * part / whole leaves [low, high], for texts of ``min_words`` or more."""

    name: str
    part: str
    whole: str
    low: int | None = None
    high: int | None = None
    min_words: int = 0


#: The production table. Bounds are per cent.
RULES = (
    Rule("word_length", "word_chars", "n_words", low=200, high=1500),
    Rule("symbols_per_word", "n_symbols", "n_words", high=20),
    Rule("marks_per_word", "n_marks", "n_words", high=50),
    Rule("stop_words", "n_stop", "n_words", low=2, min_words=50),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=50),
)


def _repeat_words(words: Column) -> Column:
    """Words inside 8-word windows that occur twice or more in the text."""

    def covered(hashes: Column) -> Column:
        def flagged(s: Column) -> Column:
            near = F.filter(s, lambda e, i: F.coalesce(e["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(e["h"] == F.get(s, i + 1)["h"], F.lit(False)))
            starts = F.sort_array(F.transform(near, lambda e: e["i"]))
            return let(starts, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x))

        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(pairs, flagged))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(hashed, lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW))))
    return F.when(F.size(words) > WINDOW, let(windows, covered)).otherwise(F.lit(0).cast("long"))


def text_statistics(text: Column, words: Column | None = None) -> Column:
    """A struct of the counts that the rules name. ``words``: the text's word array, where the caller has it."""

    def without(chars: str) -> Column:
        return F.length(text) - F.length(F.translate(text, chars, ""))

    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    stop = [F.lit(w) for w in dict.fromkeys(STOP_WORDS)]
    of_words = let(word_array(text) if words is None else words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        _repeat_words(w).alias("n_repeat_words"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(*stop))).cast("long").alias("n_stop"),
    ))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return let(F.struct(of_words.alias("w"), of_lines.alias("l")), lambda s: F.struct(
        s["w"]["n_words"].alias("n_words"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        without(SYMBOLS).cast("long").alias("n_symbols"),
        without("!").cast("long").alias("n_marks"),
        s["w"]["n_stop"].alias("n_stop"),
        s["l"]["n_lines"].alias("n_lines"),
        s["l"]["n_dup_lines"].alias("n_dup_lines"),
        s["w"]["n_repeat_words"].alias("n_repeat_words"),
    ))


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < 20) | (100 * stats["n_repeat_words"] > 30 * stats["n_words"])


def rule_failures(stats: Column, rules=RULES) -> Column:
    """Names of the rules that a text breaks."""

    def fails(r: Rule) -> Column:
        part, whole = 100 * stats[r.part], stats[r.whole]
        out = [part < r.low * whole] if r.low is not None else []
        out += [part > r.high * whole] if r.high is not None else []
        return reduce(Column.__or__, out) & (stats["n_words"] >= r.min_words)

    return F.array_compact(F.array(*[F.when(fails(r), F.lit(r.name)) for r in rules]))


def quality_rules(docs: DataFrame, text: str = "text", into: str = "quality", rules=RULES) -> DataFrame:
    """``docs`` with a struct column ``into``: the counts, base_failed, failed rule names and kept.

    A column that already has the name ``into`` is replaced; all others stay as they are.
    """
    s = let(text_statistics(text_of(text)), lambda x: F.struct(x.alias("s"), base_failed(x).alias("b"), rule_failures(x, rules).alias("f")))
    out = let(s, lambda x: F.struct(
        x["s"].alias("stats"), x["b"].alias("base_failed"), x["f"].alias("failed"), (~x["b"] & (F.size(x["f"]) == 0)).alias("kept"),
    ))
    return docs.withColumn(into, out)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality_rules(read_table(spark, sf_dir, "documents").select("doc_id", "text"), into="__q")
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return q.select("doc_id", *[F.col(f"__q.stats.{c}").alias(c) for c in cols], F.col("__q.base_failed").alias("base_failed"), F.col("__q.kept").alias("kept"))


def sql(rules=RULES) -> str:
    """The same rows for DuckDB."""
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    checks = []
    for r in rules:
        parts = [f"100 * {r.part} < {r.low} * {r.whole}"] if r.low is not None else []
        parts += [f"100 * {r.part} > {r.high} * {r.whole}"] if r.high is not None else []
        checks.append(f"(({' OR '.join(parts)}) AND n_words >= {r.min_words})")
    space = r"[^\x20\x09-\x0D]+"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{space}') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
p AS (SELECT doc_id, unnest(range(1, greatest(len(ws) - 6, 1))) AS i, ws FROM w),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS k FROM p),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g) x WHERE c > 1),
c AS (SELECT doc_id, sum(least(8, coalesce(n - i, 8))) AS n_repeat_words FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM r) x GROUP BY doc_id),
s AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols, (length(t) - length(replace(t, '!', '')))::BIGINT AS n_marks,
  len(list_filter(ws, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop, len(ls)::BIGINT AS n_lines,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({' OR '.join(checks)}) AS kept
FROM b"""
