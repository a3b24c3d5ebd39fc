"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlab.functions import text as T
from spanlab.operators.wordings import nearest_reference
from spanlab.plans.registry import query
from spanlab.plans.views import table

SPACE_TRIM = "trim({x}, ' ')"
_BASIC = "trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' ')"


@query("txt1_norm_basic", f"SELECT doc_id, {_BASIC} AS norm FROM documents")
def txt1(spark, d):
    return table(spark, d, "documents").select("doc_id", T.norm_basic(F.col("text")).alias("norm"))


@query("txt2_norm_token", "SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS norm FROM documents")
def txt2(spark, d):
    return table(spark, d, "documents").select("doc_id", T.norm_token(F.col("text")).alias("norm"))


_SAID = """list_transform(regexp_extract_all({x}, '([0-9A-Za-z_]+|[^0-9A-Za-z_]+)'), lambda w: CASE WHEN regexp_matches(w, '^[0-9]+$') AND length(ltrim(w, '0')) <= 3 AND ('0' || ltrim(w, '0'))::INT <= 100
    THEN CASE WHEN w::INT = 100 THEN 'one hundred' WHEN w::INT < 20 THEN ['zero', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten', 'eleven', 'twelve', 'thirteen', 'fourteen', 'fifteen', 'sixteen', 'seventeen', 'eighteen', 'nineteen'][w::INT + 1]
    ELSE ['twenty', 'thirty', 'forty', 'fifty', 'sixty', 'seventy', 'eighty', 'ninety'][w::INT // 10 - 1] || CASE WHEN w::INT % 10 > 0 THEN ' ' || ['one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine'][w::INT % 10] ELSE '' END END ELSE w END)"""


def _spoken_sql(x: str) -> str:
    """Spoken forms with constants of their own, so that the engine's can be wrong."""
    x = f"replace(replace(lower({x}), '%', ' percent '), '°', ' degrees ')"
    x = f"regexp_replace({x}, '([0-9])([a-z])', '\\1 \\2', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '\\b([0-9]{{1,2}}):00\\b', '\\1', 'g'), '\\b([0-9]{{1,2}}):([0-9]{{2}})\\b', '\\1 \\2', 'g')"
    x = f"regexp_replace({x}, '\\b(a|p)\\.?\\s?m\\.?\\b', '\\1 m', 'g')"
    x = f"array_to_string({_SAID.format(x=x)}, '')"
    x = f"replace(replace(replace(replace({x}, 'what''s', 'what is'), 'it''s', 'it is'), 'i''m', 'i am'), 'let''s', 'let us')"
    return f"trim(regexp_replace({x}, '[^a-z]+', ' ', 'g'), ' ')"


@query("txt3_norm_spoken", f"SELECT conv_id, turn, {_spoken_sql('text')} AS spoken FROM conversations")
def txt3(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.norm_spoken(F.col("text")).alias("spoken"))


@query("txt4_edit_ratio", f"""WITH b AS (SELECT item_id, {_BASIC} AS text FROM benchmark) SELECT a.item_id, n.item_id AS other_id,
    levenshtein(a.text, n.text) / greatest(length(a.text), length(n.text), 1)::DOUBLE AS ratio_max, levenshtein(a.text, n.text) / greatest(length(n.text), 1)::DOUBLE AS ratio_ref
    FROM b a JOIN b n ON n.item_id BETWEEN a.item_id + 1 AND a.item_id + 3""")
def txt4(spark, d):
    b = table(spark, d, "benchmark").select("item_id", T.norm_basic(F.col("text")).alias("text"))
    near = b.select("item_id", "text", F.explode(F.sequence(F.col("item_id") + 1, F.col("item_id") + 3)).alias("other_id"))
    both = near.join(b.select(F.col("item_id").alias("other_id"), F.col("text").alias("other")), "other_id")
    return both.select("item_id", "other_id", T.edit_ratio(F.col("text"), F.col("other")).alias("ratio_max"), T.edit_ratio(F.col("text"), F.col("other"), "ref").alias("ratio_ref"))


_W = f"list_filter(string_split({_BASIC}, ' '), lambda w: w <> '')"


@query("txt5_adjacent_pair", f"""WITH w AS (SELECT conv_id, turn, {_W} AS ws FROM conversations), p AS (SELECT conv_id, turn, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)
    SELECT conv_id, turn, (i - 1)::INT AS i FROM p WHERE ws[i] = 'the' AND ws[i + 1] = 'and'""")
def txt5(spark, d):
    words = table(spark, d, "conversations").select("conv_id", "turn", T.words_array(T.norm_basic(F.col("text"))).alias("words"))
    return T.adjacent_pairs(words, ["conv_id", "turn"], "the", "and")


_NUM = ", ".join(f"'{x}'" for x in (*T.NUMBERS, "a", "p"))


@query("txt6_numbers_guard", f"""WITH w AS (SELECT conv_id, turn, list_filter({_W}, lambda w: w IN ({_NUM})) AS n FROM conversations)
    SELECT a.conv_id, a.turn, a.n = b.n AS same_numbers, len(a.n)::INT AS n_numbers FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def txt6(spark, d):
    w = table(spark, d, "conversations").select("conv_id", "turn", T.words_array(T.norm_basic(F.col("text"))).alias("w"))
    after = w.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("w2"))
    return w.join(after, ["conv_id", "turn"]).select("conv_id", "turn", T.numbers_guard(F.col("w"), F.col("w2")).alias("same_numbers"), F.size(T.number_list(F.col("w"))).alias("n_numbers"))


@query("txt7_strip_prefix", "SELECT doc_id, regexp_replace(text, '^(?:The and|Is and|Of)[ ,]*', '') AS stripped FROM documents")
def txt7(spark, d):
    return table(spark, d, "documents").select("doc_id", T.strip_prefix(F.col("text"), "The and|Is and|Of").alias("stripped"))


_VALUE = "CASE (o_orderkey % 4)::INT WHEN 0 THEN (o_orderkey % 12 + 1) || ':00 AM' WHEN 1 THEN (o_orderkey % 60) || ' seconds' WHEN 2 THEN (o_orderkey % 30) || ' degrees' ELSE o_orderpriority END"


@query("txt8_value_slug", f"""WITH v AS (SELECT o_orderkey, {_VALUE} AS value FROM orders) SELECT o_orderkey, CASE WHEN regexp_matches(value, '^[0-9]+:00 (AM|PM)$') THEN replace(replace(value, ':00', ''), ' ', '')
    WHEN regexp_matches(value, '^[0-9]+ seconds$') THEN replace(value, ' seconds', 'S') WHEN regexp_matches(value, '^[0-9]+ degrees$') THEN replace(value, ' degrees', '')
    ELSE regexp_replace(upper(value), '[^A-Z0-9]+', '_', 'g') END AS slug FROM v""")
def txt8(spark, d):
    k = F.col("o_orderkey")
    value = F.when(k % 4 == 0, F.concat(k % 12 + 1, F.lit(":00 AM"))).when(k % 4 == 1, F.concat(k % 60, F.lit(" seconds"))).when(k % 4 == 2, F.concat(k % 30, F.lit(" degrees"))).otherwise(F.col("o_orderpriority"))
    return table(spark, d, "orders").select("o_orderkey", T.value_slug(value).alias("slug"))


@query("txt9_expand_template", """SELECT o_orderkey, i - 1 AS value_index, [o_orderstatus, o_orderpriority, o_custkey::VARCHAR][i] AS value,
    replace('set {slot} now', '{slot}', [o_orderstatus, o_orderpriority, o_custkey::VARCHAR][i]) AS wording FROM (SELECT *, unnest([1, 2, 3]) AS i FROM orders)""")
def txt9(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.lit("set {slot} now").alias("template"), F.col("o_orderstatus").alias("v1"), F.col("o_orderpriority").alias("v2"), F.col("o_custkey").cast("string").alias("v3"))
    return T.expand_template(o, "template", ["v1", "v2", "v3"]).drop("template")


@query("txt10_regex_route", r"""SELECT page_id, CASE WHEN regexp_matches(url, '^https?://m\.[^?]*/[0-9]+$') THEN 'mobile' WHEN regexp_matches(url, '^https?://[^?]*/([0-9]+)\.html$') THEN 'file'
    WHEN regexp_matches(url, '^https?://[^?]*\?.*$') THEN 'query' ELSE 'no_rule' END AS rule,
    CASE WHEN regexp_matches(url, '^https?://m\.[^?]*/[0-9]+$') THEN regexp_extract(url, '^https?://m\.[^?]*/([0-9]+)$', 1) WHEN regexp_matches(url, '^https?://[^?]*/([0-9]+)\.html$') THEN regexp_extract(url, '^https?://[^?]*/([0-9]+)\.html$', 1)
    WHEN regexp_matches(url, '^https?://[^?]*\?.*$') THEN regexp_extract(url, '^https?://[^?]*\?(.*)$', 1) END AS value FROM pages""")
def txt10(spark, d):
    rules = [("mobile", r"https?://m\.[^?]*/([0-9]+)", 1), ("file", r"https?://[^?]*/([0-9]+)\.html", 1), ("query", r"https?://[^?]*\?(.*)", 1)]
    return table(spark, d, "pages").select("page_id", T.regex_route(F.col("url"), rules, "no_rule").alias("r")).select("page_id", "r.rule", "r.value")


@query("txt11_parse_id", r"SELECT page_id, regexp_extract(url, '^https?://([^/]+)/', 1) AS host, regexp_extract(url, '/([a-z][a-z])/([0-9]+)', 1) AS lang, regexp_extract(url, '/([a-z][a-z])/([0-9]+)', 2)::INT * 5 AS offset_sec FROM pages")
def txt11(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", F.regexp_extract(u, "^https?://([^/]+)/", 1).alias("host"), F.regexp_extract(u, "/([a-z][a-z])/([0-9]+)", 1).alias("lang"), (F.regexp_extract(u, "/([a-z][a-z])/([0-9]+)", 2).cast("int") * 5).alias("offset_sec"))


@query("txt12_explode_composite", "SELECT l_orderkey, unnest(string_split(l_orderkey || '|' || l_partkey || '|' || l_suppkey, '|')) AS id FROM lineitem")
def txt12(spark, d):
    ids = table(spark, d, "lineitem").select("l_orderkey", F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey").alias("id"))
    return T.explode_composite(ids, "id")


@query("jn8_nearest_reference", f"""WITH refs AS (SELECT DISTINCT replace(p_name, 'a', 'e') AS ref FROM part), t AS (SELECT p_partkey, {_spoken_sql('p_name')} AS n FROM part),
    s AS (SELECT p_partkey, n, ref, levenshtein(n, ref) / greatest(length(n), length(ref), 1)::DOUBLE AS ratio, list_filter(string_split(n, ' '), lambda w: w IN ({_NUM})) = list_filter(string_split(ref, ' '), lambda w: w IN ({_NUM})) AS ok FROM t, refs),
    b AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY ratio, ref) AS k FROM s)
    SELECT p_partkey, ref AS nearest, ratio, CASE WHEN n = '' THEN 'empty' WHEN ratio > 0.25 THEN 'too_far' WHEN NOT ok THEN 'other_number' ELSE 'match' END AS reason FROM b WHERE k = 1""")
def jn8(spark, d):
    part = table(spark, d, "part")
    refs = part.select(F.replace(F.col("p_name"), F.lit("a"), F.lit("e")).alias("ref"))
    return nearest_reference(part.select("p_partkey", F.col("p_name").alias("text")), refs).drop("text")


@query("jn8_nearest_reference_turns")
def jn8_turns(spark, d):
    """Whole texts of conversations against whole benchmark items."""
    refs = table(spark, d, "benchmark").select(T.norm_spoken(F.col("text")).alias("ref"))
    return nearest_reference(table(spark, d, "conversations").select("conv_id", "turn", "text"), refs).drop("text")
