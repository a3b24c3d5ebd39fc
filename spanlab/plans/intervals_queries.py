"""Queries of interval algebra and window generation."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlab.operators import intervals as I
from spanlab.plans.registry import query
from spanlab.plans.series_queries import _MERGE
from spanlab.plans.views import sql, table, v_spans

DAY = 86_400_000


def files(spark, d):
    return v_spans(spark, d).select("file_id").distinct().select("file_id", F.lit(DAY).cast("long").alias("duration_ms"))


def ranges(spark, d):
    return files(spark, d).select("file_id", F.lit(21_600_000).cast("long").alias("lo"), F.lit(64_800_000).cast("long").alias("hi"))


@query("iv1_overlaps", sql("SELECT a.span_id, least(a.e_ms, b.e_ms) - greatest(a.s_ms, b.s_ms) > 0 AS overlaps FROM v_spans a JOIN v_spans b ON a.file_id = b.file_id AND b.span_id = a.span_id + 150", "v_spans"))
def iv1(spark, d):
    s = v_spans(spark, d)
    b = s.select("file_id", (F.col("span_id") - 150).alias("span_id"), F.col("s_ms").alias("b0"), F.col("e_ms").alias("b1"))
    return s.join(b, ["file_id", "span_id"]).select("span_id", I.overlaps(F.col("s_ms"), F.col("e_ms"), F.col("b0"), F.col("b1")).alias("overlaps"))


_CLIP = "v_in AS (SELECT file_id, greatest(s_ms, {lo}) AS s_ms, least(e_ms, {hi}) AS e_ms FROM v_spans WHERE least(e_ms, {hi}) > greatest(s_ms, {lo}))"
_UNION = "u AS (" + _MERGE.replace("v_spans", "v_in") + ")"


def _free(where: str, lo: str, hi: str, guard: int = 0) -> str:
    return f"g AS (SELECT file_id, s_ms - {guard} AS s_ms, e_ms + {guard} AS e_ms FROM v_spans WHERE {where}), {_free_of(lo, hi)}"


def _free_of(lo: str, hi: str) -> str:
    """What the spans of g leave free."""
    clip = _CLIP.format(lo=lo, hi=hi).replace("FROM v_spans", "FROM g")
    return f"{clip}, {_UNION}, m AS (SELECT file_id, s_ms, e_ms FROM u UNION ALL SELECT DISTINCT file_id, {lo}, {lo} FROM v_spans UNION ALL SELECT DISTINCT file_id, {hi}, {hi} FROM v_spans), f AS (SELECT file_id, e_ms AS free_start, lead(s_ms) OVER (PARTITION BY file_id ORDER BY s_ms, e_ms) AS free_end FROM m)"


@query("iv2_subtract", sql(f"WITH {_free('true', '21600000', '64800000')} SELECT * FROM f WHERE free_end > free_start", "v_spans"))
def iv2(spark, d):
    return I.subtract(ranges(spark, d), v_spans(spark, d), ["file_id"], "s_ms", "e_ms", "lo", "hi")


@query("iv3_union_length", sql(f"WITH {_CLIP.format(lo='21600000', hi='64800000')}, {_UNION} SELECT f.file_id, coalesce(sum(e_ms - s_ms), 0)::BIGINT AS covered FROM (SELECT DISTINCT file_id FROM v_spans) f LEFT JOIN u ON f.file_id = u.file_id GROUP BY 1", "v_spans"))
def iv3(spark, d):
    return I.union_length(ranges(spark, d), v_spans(spark, d), ["file_id"], "s_ms", "e_ms", "lo", "hi").select("file_id", "covered")


@query("iv4_coverage", sql("SELECT span_id, greatest(0, least(e_ms, s_ms + 1500000) - s_ms) / (e_ms - s_ms)::DOUBLE AS covered FROM v_spans", "v_spans"))
def iv4(spark, d):
    s, e = F.col("s_ms"), F.col("e_ms")
    return v_spans(spark, d).select("span_id", I.coverage(s, s + 1_500_000, s, e).alias("covered"))


#: Spans of half a second to two and a half: the minutes of v_spans as hundredths of a second.
_SHORT = "v_s AS (SELECT file_id, span_id, s_ms, s_ms + 500 + (e_ms - s_ms) // 3000 AS e_ms FROM v_spans WHERE kind = 'purchase')"


def short_spans(spark, d):
    s = v_spans(spark, d).where("kind = 'purchase'")
    return s.select("file_id", "span_id", "s_ms", (F.col("s_ms") + 500 + F.floor((F.col("e_ms") - F.col("s_ms")) / 3000)).alias("e_ms"))


_POSITIVE = f"""WITH {_SHORT}, t AS (SELECT *, unnest(CASE WHEN e_ms - s_ms > 1400 THEN [0] ELSE [100, 250, 400, -1] END) AS post_ms FROM v_s),
 w AS (SELECT *, CASE WHEN post_ms < 0 THEN (s_ms + e_ms + 1500) // 2 ELSE e_ms + post_ms END AS w1 FROM t), x AS (SELECT *, w1 - 1500 AS w0 FROM w),
 h AS (SELECT x.*, EXISTS (SELECT 1 FROM v_s o WHERE o.file_id = x.file_id AND o.span_id <> x.span_id AND least(o.e_ms, x.w1) > greatest(o.s_ms, x.w0)) AS hit FROM x),
 r AS (SELECT *, CASE WHEN e_ms - s_ms > 1400 THEN 'occurrence_too_long_for_window' WHEN s_ms - w0 < 50 THEN 'too_little_context' WHEN w1 <= 0 OR w0 >= 86400000 THEN 'outside_file'
   WHEN greatest(0, -w0) + greatest(0, w1 - 86400000) > 900 THEN 'too_much_padding' WHEN hit THEN 'overlaps_other_span' END AS reason FROM h),
 k AS (SELECT *, count_if(reason IS NULL AND post_ms >= 0) OVER (PARTITION BY file_id, span_id) AS fine FROM r)
"""


# Post-rolls are at least 150 ms apart and three at most, so spacing and cap never refuse one.
@query("wg1_positive_windows", sql(_POSITIVE + "SELECT file_id, span_id, post_ms, w0, w1, reason FROM k WHERE NOT (post_ms < 0 AND fine > 0 AND reason IS NULL)", "v_spans"))
def wg1(spark, d):
    good, refused = I.positive_windows(short_spans(spark, d), files(spark, d))
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(refused)


@query("wg2_partial_windows", sql(f"WITH {_SHORT}, t AS (SELECT *, unnest(['head', 'tail']) AS side FROM v_s), w AS (SELECT *, CASE side WHEN 'head' THEN s_ms + floor((e_ms - s_ms) * 0.35::DOUBLE)::BIGINT - 1500 ELSE e_ms - floor((e_ms - s_ms) * 0.35::DOUBLE)::BIGINT END AS w0 FROM t) SELECT file_id, span_id, side, w0, w0 + 1500 AS w1 FROM w WHERE greatest(0, least(w0 + 1500, e_ms) - greatest(w0, s_ms)) / (e_ms - s_ms)::DOUBLE <= 0.5", "v_spans"))
def wg2(spark, d):
    return I.partial_windows(short_spans(spark, d))


@query("wg2_partial_windows_verified", sql(f"WITH {_SHORT}, t AS (SELECT *, unnest(['head', 'tail']) AS side FROM v_s WHERE e_ms - s_ms < 1400 AND file_id % 4 <> 1), w AS (SELECT *, CASE side WHEN 'head' THEN s_ms + floor((e_ms - s_ms) * 0.35::DOUBLE)::BIGINT - 1500 ELSE e_ms - floor((e_ms - s_ms) * 0.35::DOUBLE)::BIGINT END AS w0 FROM t) SELECT file_id, span_id, side, w0, w0 + 1500 AS w1 FROM w WHERE greatest(0, least(w0 + 1500, e_ms) - greatest(w0, s_ms)) / (e_ms - s_ms)::DOUBLE <= 0.5", "v_spans"))
def wg2_verified(spark, d):
    """Short spans count as verified, and three files of four as allowed sources."""
    return I.partial_windows(short_spans(spark, d), verified=F.col("e_ms") - F.col("s_ms") < 1400, allowed=F.col("file_id") % 4 != 1)


_NEG_STARTS = "CASE WHEN free_end - free_start < {L} THEN [] ELSE list_concat(list_transform(range(0, (free_end - free_start - {L}) // {H} + 1), lambda i: free_start + i * {H}), CASE WHEN (free_end - free_start - {L}) % {H} > 0 AND (free_end - free_start - {L}) % {H} >= {T} THEN [free_end - {L}] ELSE [] END) END"


@query("wg3_negative_windows", sql(f"""WITH {_free("kind = 'purchase'", '0', '86400000', 300000)}, s AS (SELECT file_id, unnest({_NEG_STARTS.format(L=600000, H=300000, T=150000)}) AS w0 FROM f WHERE free_end > free_start AND file_id % 10 > 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY w0) - 1 AS i, count(*) OVER (PARTITION BY file_id) AS c FROM s)
    SELECT file_id, w0, NULL AS reason FROM r WHERE c <= 100 OR i IN (SELECT (2 * j * (r.c - 1) + 99) // 198 FROM range(0, 100) t(j)) UNION ALL SELECT DISTINCT file_id, NULL, 'held_for_review' FROM v_spans WHERE file_id % 10 = 0""", "v_spans"))
def wg3(spark, d):
    cfg = I.WindowConfig(length=600_000, guard=300_000, hop=300_000, tail_share=0.25, cap=100)
    windows, refused = I.negative_windows(files(spark, d), v_spans(spark, d).where("kind = 'purchase'"), cfg, held=F.col("file_id") % 10 == 0)
    return windows.select("file_id", "w0", F.lit(None).cast("string").alias("reason")).unionByName(refused.select("file_id", F.lit(None).cast("long").alias("w0"), "reason"))


_GUARDS = "g AS (SELECT file_id, s_ms - 300000 AS s_ms, e_ms + 300000 AS e_ms FROM v_spans WHERE kind = 'purchase' UNION ALL SELECT file_id, s_ms - 60000, e_ms + 60000 FROM v_spans WHERE kind = 'view' AND file_id % 3 = 0)"


@query("wg3_negative_windows_guarded", sql(f"""WITH {_GUARDS}, {_free_of('0', '86400000')}, s AS (SELECT file_id, unnest({_NEG_STARTS.format(L=600000, H=300000, T=150000)}) AS w0 FROM f WHERE free_end > free_start AND file_id % 10 > 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY w0) - 1 AS i, count(*) OVER (PARTITION BY file_id) AS c FROM s)
    SELECT file_id, w0, NULL AS reason FROM r WHERE c <= 100 OR i IN (SELECT (2 * j * (r.c - 1) + 99) // 198 FROM range(0, 100) t(j)) UNION ALL SELECT DISTINCT file_id, NULL, CASE WHEN file_id % 10 = 0 THEN 'held_for_review' ELSE 'blocked_by_flag' END FROM v_spans WHERE file_id % 10 < 2
    UNION ALL SELECT DISTINCT file_id, NULL, 'no_free_region' FROM v_spans WHERE file_id % 10 > 1 AND file_id NOT IN (SELECT file_id FROM s)""", "v_spans"))
def wg3_guarded(spark, d):
    """Spans and, in every third file, speech chunks are guarded; a tenth of the files is held and another blocked."""
    cfg = I.WindowConfig(length=600_000, guard=300_000, chunk_guard=60_000, hop=300_000, tail_share=0.25, cap=100)
    spans, last = v_spans(spark, d), F.col("file_id") % 10
    windows, refused = I.negative_windows(files(spark, d), spans.where("kind = 'purchase'"), cfg, last == 0, spans.where("kind = 'view'"), F.col("file_id") % 3 == 0, last == 1)
    return windows.select("file_id", "w0", F.lit(None).cast("string").alias("reason")).unionByName(refused.select("file_id", F.lit(None).cast("long").alias("w0"), "reason"))


@query("wg4_sliding_starts", "SELECT doc_id, unnest(" + _NEG_STARTS.format(L=400, H=150, T=1).replace("free_end - free_start", "n_chars").replace("free_end", "n_chars").replace("free_start", "0") + ") AS w0 FROM documents")
def wg4(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(I.sliding_starts(F.col("n_chars"), 400, 150, True)).alias("w0"))


@query("wg5_frame_clip", "SELECT doc_id, CASE WHEN n_chars < 1500 THEN (1500 - n_chars) // 2 ELSE 0 END AS pad_before, CASE WHEN n_chars < 1500 THEN 1500 - n_chars - (1500 - n_chars) // 2 ELSE 0 END AS pad_after, unnest(CASE WHEN n_chars <= 1500 THEN [0::BIGINT] ELSE " + _NEG_STARTS.format(L=1500, H=750, T=1).replace("free_end - free_start", "n_chars").replace("free_end", "n_chars").replace("free_start", "0") + " END) AS w0 FROM documents")
def wg5(spark, d):
    return I.frame_clip(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", 1500).drop("n_chars")


@query("wg6_window_record", sql("SELECT file_id || '@' || (s_ms - 700) || 'ms_' || CASE WHEN kind = 'purchase' THEN 'p' ELSE 'n' END AS window_id, greatest(0, s_ms - 700) AS source_start, least(86400000, s_ms + 800) AS source_end, greatest(0, 700 - s_ms) AS pad_before, greatest(0, s_ms + 800 - 86400000) AS pad_after FROM v_spans", "v_spans"))
def wg6(spark, d):
    s = v_spans(spark, d).select("file_id", (F.col("s_ms") - 700).alias("w0"), (F.col("kind") == "purchase").alias("label"), F.lit(DAY).cast("long").alias("duration_ms"))
    return I.window_record(s, "label", "duration_ms", 1500).select("window_id", "source_start", "source_end", "pad_before", "pad_after")


_U = "(('0x' || substr(sha256({x}), 1, 12))::BIGINT / 281474976710656.0::DOUBLE)"


@query("wg7_random_windows", f"""WITH t AS (SELECT doc_id, n_chars, unnest([0, 1, 2]) AS draw FROM documents), s AS (SELECT *, least(floor(100 + {_U.format(x="'5|' || doc_id || '|' || draw || '|length'")} * 400)::BIGINT, n_chars) AS size FROM t),
    w AS (SELECT *, floor({_U.format(x="'5|' || doc_id || '|' || draw || '|start'")} * (n_chars - size + 1))::BIGINT AS w0 FROM s) SELECT doc_id AS file_id, draw, w0, w0 + size AS w1 FROM w""")
def wg7(spark, d):
    f = table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.col("n_chars").alias("duration_ms"))
    return I.random_windows(f, 3, 100, 500, 5).drop("duration_ms")


@query("wg8_walk_windows", sql(f"""WITH g AS (SELECT file_id, s_ms, e_ms + 50 AS e_ms FROM v_spans WHERE kind = 'error'), {_CLIP.format(lo='0', hi='86400000').replace('FROM v_spans', 'FROM g')}, {_UNION}, m AS (SELECT file_id, s_ms, e_ms FROM u UNION ALL SELECT DISTINCT file_id, 0, 0 FROM v_spans UNION ALL SELECT DISTINCT file_id, 86400000, 86400000 FROM v_spans),
    f AS (SELECT file_id, e_ms AS free_start, lead(s_ms) OVER (PARTITION BY file_id ORDER BY s_ms, e_ms) AS free_end FROM m), s AS (SELECT file_id, unnest(list_transform(range(0, (free_end - free_start) // 600000), lambda i: free_start + i * 600000)) AS w0 FROM f WHERE free_end - free_start >= 600000)
    SELECT file_id, w0 FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY w0) AS n FROM s) WHERE n <= 60""", "v_spans"))
def wg8(spark, d):
    return I.walk_windows(files(spark, d), v_spans(spark, d).where("kind = 'error'"), 600_000, 50, 60)


@query("wg9_fixed_slices", "SELECT doc_id, i AS slice, i * 500 AS \"offset\" FROM (SELECT doc_id, unnest(range(0, n_chars // 500)) AS i FROM documents)")
def wg9(spark, d):
    return I.fixed_slices(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", 500).drop("n_chars")


@query("wg10_placement_check", sql("""WITH x AS (SELECT file_id, s_ms, s_ms - lag(s_ms) OVER w AS gap, cume_dist() OVER w AS hi, (rank() OVER w - 1) / count(*) OVER (PARTITION BY file_id)::DOUBLE AS lo, s_ms / 86400000.0::DOUBLE AS x FROM v_spans WINDOW w AS (PARTITION BY file_id ORDER BY s_ms))
    SELECT file_id, min(gap) AS min_gap, round(max(greatest(abs(hi - x), abs(x - lo))), 9) AS ks FROM x GROUP BY 1""", "v_spans"))
def wg10(spark, d):
    return I.placement_check(v_spans(spark, d), "file_id", "s_ms", F.lit(0), F.lit(DAY)).select("file_id", "min_gap", F.round("ks", 9).alias("ks"))
