"""Text normalisation and comparison as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Number words.
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
CONTRACTIONS = {"what's": "what is", "it's": "it is", "i'm": "i am", "let's": "let us"}
NUMBERS = tuple(ONES) + tuple(TENS) + ("hundred",)


def norm_basic(c: Column) -> Column:
    """Lower case; anything but letters and digits becomes one space."""
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "), F.lit(" "))


def norm_token(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def number_words(n: int) -> str:
    if n < 20:
        return ONES[n]
    if n == 100:
        return "one hundred"
    return TENS[n // 10 - 2] + (f" {ONES[n % 10]}" if n % 10 else "")


# What is said otherwise than written, as (pattern, replacement) in the order that they are put in.
SAID = (("%", " percent "), ("°", " degrees "), ("([0-9])([a-z])", "$1 $2"), (r"\b([0-9]{1,2}):00\b", "$1"), (r"\b([0-9]{1,2}):([0-9]{2})\b", "$1 $2"), (r"\b(a|p)\.?\s?m\.?\b", "$1 m"))
PIECES = "([0-9A-Za-z_]+|[^0-9A-Za-z_]+)"


def norm_spoken(c: Column) -> Column:
    """A text as it is said: signs, clock times, and whole numbers up to 100 as words; letters only.

    A digit parts from a letter behind it; ``am`` and ``pm`` are said letter by letter wherever they stand.
    """
    c = F.lower(c)
    for pattern, said in SAID:
        c = F.regexp_replace(c, pattern, said)
    named = F.create_map(*[F.lit(x) for n in range(101) for x in (str(n), number_words(n))])
    # Words and what lies between them, so that a number is told by its borders alone.
    pieces = F.regexp_extract_all(c, F.lit(PIECES), F.lit(1))
    c = F.array_join(F.transform(pieces, lambda w: F.when(w.rlike("^[0-9]+$"), F.coalesce(F.try_element_at(named, F.regexp_replace(w, "^0+(?=.)", "")), w)).otherwise(w)), "")
    for short, full in CONTRACTIONS.items():
        c = F.replace(c, F.lit(short), F.lit(full))
    return F.btrim(F.regexp_replace(c, "[^a-z]+", " "), F.lit(" "))


def spoken_sql(c: str) -> str:
    """``norm_spoken`` of a column as a text of Spark's SQL."""
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    c = f"lower({c})"
    for pattern, said in SAID:
        c = f"regexp_replace({c}, {quoted(pattern)}, {quoted(said)})"
    named = ", ".join(f"'{n}', '{number_words(n)}'" for n in range(101))
    number = f"coalesce(try_element_at(map({named}), regexp_replace(w, '^0+(?=.)', '')), w)"
    c = f"array_join(transform(regexp_extract_all({c}, {quoted(PIECES)}, 1), w -> CASE WHEN w RLIKE '^[0-9]+$' THEN {number} ELSE w END), '')"
    for short, full in CONTRACTIONS.items():
        c = f"replace({c}, {quoted(short)}, {quoted(full)})"
    return f"trim(regexp_replace({c}, '[^a-z]+', ' '))"


def edit_ratio(a: Column, b: Column, mode: str = "max") -> Column:
    """Levenshtein distance over the longer text's length (``max``) or the second's (``ref``), 1 at least."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    whole = F.greatest(F.length(a), F.length(b), F.lit(1)) if mode == "max" else F.greatest(F.length(b), F.lit(1))
    return F.levenshtein(a, b) / whole


def words_array(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: w != "")


def adjacent_pairs(words: DataFrame, keys: list[str], first: str, second: str) -> DataFrame:
    """Positions i where word i is ``first`` and word i + 1 is ``second``, for rows of (keys, words array)."""
    at = words.select(*keys, "words", F.posexplode(F.col("words")).alias("i", "w"))
    return at.where((F.col("w") == first) & (F.get("words", F.col("i") + 1) == second)).select(*keys, "i")


def number_list(words: Column) -> Column:
    return F.filter(words, lambda w: w.isin(*NUMBERS, "a", "p"))


def numbers_guard(a: Column, b: Column) -> Column:
    """Both texts name the same numbers in the same order."""
    return number_list(a) == number_list(b)


def strip_prefix(c: Column, pattern: str) -> Column:
    return F.regexp_replace(c, f"^(?:{pattern})[ ,]*", "")


def value_slug(c: Column) -> Column:
    clock = F.regexp_extract(c, "^([0-9]+):00 (AM|PM)$", 0)
    return (
        F.when(clock != "", F.concat(F.regexp_extract(c, "^([0-9]+)", 1), F.regexp_extract(c, "(AM|PM)$", 1)))
        .when(c.rlike("^[0-9]+ seconds$"), F.concat(F.regexp_extract(c, "^([0-9]+)", 1), F.lit("S")))
        .when(c.rlike("^[0-9]+ degrees$"), F.regexp_extract(c, "^([0-9]+)", 1))
        .otherwise(F.regexp_replace(F.upper(c), "[^A-Z0-9]+", "_"))
    )


def expand_template(df: DataFrame, template: str, values: list[str], slot: str = "{slot}") -> DataFrame:
    """One row per value column: value_index, value and the template with the slot filled."""
    pairs = F.posexplode(F.array(*values)).alias("value_index", "value")
    rest = [c for c in df.columns if c not in values]
    return df.select(*rest, pairs).where(F.col("value").isNotNull()).withColumn("wording", F.replace(F.col(template), F.lit(slot), F.col("value")))


def regex_route(c: Column, rules: list[tuple[str, str, int]], reason: str) -> Column:
    """The first rule (name, pattern, group) that matches the whole text: a struct of rule and captured value, or the reason."""
    out = F.struct(F.lit(reason).alias("rule"), F.lit(None).cast("string").alias("value"))
    for name, pattern, group in reversed(rules):
        out = F.when(c.rlike(f"^(?:{pattern})$"), F.struct(F.lit(name).alias("rule"), F.regexp_extract(c, f"^(?:{pattern})$", group).alias("value"))).otherwise(out)
    return out


def explode_composite(df: DataFrame, col: str, sep: str = "|") -> DataFrame:
    return df.withColumn(col, F.explode(F.split(F.col(col), "\\" + sep)))
