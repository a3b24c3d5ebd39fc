"""Queries of span annotation."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlab.functions import text as T
from spanlab.operators import spans as S
from spanlab.plans.registry import query
from spanlab.plans.text_queries import _BASIC, _W
from spanlab.plans.views import prop_k, sql, table, v_spans

CFG = S.SpanConfig(first="the", second="and", fuzzy_pair=0.3, fuzzy_word=0.4, shortest=0.2, longest=0.5)


def chunks(spark, d):
    """Turns as chunks: word i lies at i * 0.25 to i * 0.25 + 0.2 seconds, with a probability from its length."""
    w = T.words_array(T.norm_basic(F.col("text")))
    words = F.transform(w, lambda x, i: F.struct(x.alias("word"), (i * 0.25).cast("double").alias("start"), (i * 0.25 + 0.2).cast("double").alias("end"), (F.length(x) / 20.0).cast("double").alias("probability")))
    n = F.size(w)
    return table(spark, d, "conversations").select("conv_id", "turn", (F.col("role") == "user").alias("positive"), words.alias("words"), F.lit(0.1).alias("c0"), (n * 0.25 - 0.1).cast("double").alias("c1"))


def detected(spark, d):
    return S.status_of(S.quality_gates(S.detect_spans(chunks(spark, d), ["conv_id", "turn"], CFG, "positive", ("c0", "c1")), CFG))


_PAIRS = f"w AS (SELECT conv_id, turn, role = 'user' AS positive, {_W} AS ws FROM conversations), p AS (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM w), e AS (SELECT *, (i - 1)::INT AS first_word FROM p WHERE ws[i] = 'the' AND ws[i + 1] = 'and')"


@query("an1_detect_spans", f"WITH {_PAIRS} SELECT conv_id, turn, first_word FROM e")
def an1(spark, d):
    return S.detect_spans(chunks(spark, d), ["conv_id", "turn"], CFG, "positive").where("match_type = 'complete'").select("conv_id", "turn", "first_word")


def _near(a: str, b: str) -> str:
    return f"levenshtein({a}, '{b}') / greatest(length({a}), {len(b)})::DOUBLE"


#: The scan as a walk over positions; phrase and bounds are written out.
_SCAN = f"""WITH RECURSIVE w AS (SELECT conv_id, turn, role = 'user' AS positive, {_W} AS ws FROM conversations), p AS (SELECT conv_id, turn, i - 1 AS i, ws[i] AS a, ws[i + 1] AS b FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM w)),
    k AS (SELECT *, CASE WHEN a = 'the' AND b = 'and' THEN 'complete' WHEN b IS NOT NULL AND {_near("(a || ' ' || b)", 'the and')} <= 0.3 THEN 'fuzzy' WHEN a = 'and' OR {_near('a', 'and')} <= 0.4 THEN 'partial' WHEN a = 'the' THEN 'partial' END AS kind FROM p),
    s AS (SELECT conv_id, turn, i, kind FROM k WHERE i = 0 UNION ALL SELECT k.conv_id, k.turn, k.i, k.kind FROM s JOIN k ON k.conv_id = s.conv_id AND k.turn = s.turn AND k.i = s.i + CASE WHEN s.kind IN ('complete', 'fuzzy') THEN 2 ELSE 1 END),
    f AS (SELECT conv_id, turn, kind AS match_type, i AS first_word, i + CASE WHEN kind IN ('complete', 'fuzzy') THEN 1 ELSE 0 END AS last_word FROM s WHERE kind IS NOT NULL),
    c AS (SELECT w.*, array_to_string(ws, ' ') AS text, (SELECT count(*) FROM f WHERE f.conv_id = w.conv_id AND f.turn = w.turn) AS n, (SELECT count(*) FROM f WHERE f.conv_id = w.conv_id AND f.turn = w.turn AND match_type <> 'partial') AS whole FROM w),
    h AS (SELECT conv_id, turn, positive, ws, text, n, whole, n = 0 AND text <> '' AND {_near('text', 'the and')} <= 0.3 AS fallback FROM c)"""


@query("an1_detect_all", f"""{_SCAN}, a AS (SELECT f.conv_id, f.turn, match_type, first_word, last_word, greatest(first_word * 0.25::DOUBLE, 0.1::DOUBLE) AS start_sec, least(last_word * 0.25::DOUBLE + 0.2::DOUBLE, len(ws) * 0.25::DOUBLE - 0.1::DOUBLE) AS end_sec FROM f JOIN w ON w.conv_id = f.conv_id AND w.turn = f.turn
    UNION ALL SELECT conv_id, turn, 'fuzzy', 0, len(ws) - 1, 0.1::DOUBLE, len(ws) * 0.25::DOUBLE - 0.1::DOUBLE FROM h WHERE fallback UNION ALL SELECT conv_id, turn, 'unmatched', CASE WHEN len(ws) > 0 THEN 0 END, CASE WHEN len(ws) > 0 THEN len(ws) - 1 END, 0.1::DOUBLE, len(ws) * 0.25::DOUBLE - 0.1::DOUBLE FROM h WHERE positive AND whole = 0 AND NOT fallback)
    SELECT conv_id, turn, match_type, first_word::INT AS first_word, last_word::INT AS last_word, start_sec, end_sec FROM a""")
def an1_all(spark, d):
    return S.detect_spans(chunks(spark, d), ["conv_id", "turn"], CFG, "positive", ("c0", "c1")).select("conv_id", "turn", "match_type", "first_word", "last_word", "start_sec", "end_sec")


_GATES = f"WITH {_PAIRS}, r AS (SELECT *, array_to_string(list_filter(['low_probability', CASE WHEN NOT positive THEN 'found_in_negative_file' END], lambda x: x IS NOT NULL), ',') AS reasons FROM e)"


@query("an2_quality_gates", f"{_GATES} SELECT conv_id, turn, first_word, reasons FROM r")
def an2(spark, d):
    return detected(spark, d).where("match_type = 'complete'").select("conv_id", "turn", "first_word", F.array_join("reasons", ",").alias("reasons"))


@query("an3_status_of", f"{_GATES} SELECT conv_id, turn, first_word, 'needs_review' AS status FROM r")
def an3(spark, d):
    return detected(spark, d).where("match_type = 'complete'").select("conv_id", "turn", "first_word", "status")


@query("an4_recording_flags", f"WITH {_PAIRS}, c AS (SELECT conv_id, turn, count(*) AS n FROM e GROUP BY 1, 2) SELECT w.conv_id, w.turn, coalesce(n, 0) AS complete, CASE WHEN positive AND n IS NULL THEN 'no_complete_match' END AS flag FROM w LEFT JOIN c ON w.conv_id = c.conv_id AND w.turn = c.turn")
def an4(spark, d):
    c = chunks(spark, d).withColumn("file_id", F.concat_ws("/", "conv_id", "turn"))
    s = detected(spark, d).withColumn("file_id", F.concat_ws("/", "conv_id", "turn"))
    return S.recording_flags(c.select("file_id", "conv_id", "turn", "positive"), s, "file_id").select("conv_id", "turn", "complete", "flag")


#: Edits derived from every ninth event: an ordered log with errors in it.
_LOG = """l AS (SELECT event_id AS pos, ['accept', 'reject', 'correct_bounds', 'set_type', 'remove', 'add', 'note', 'bogus', 'correct_bounds'][(event_id // 9 % 9 + 1)::INT] AS action, 'ann/' || (event_id * 7 % 12000) AS target, user_id AS file_id,
    CASE WHEN event_id // 9 % 9 IN (2, 5) THEN (event_id * 10)::VARCHAR WHEN event_id // 9 % 9 = 8 AND event_id % 2 = 0 THEN 'soon' END AS new_start, CASE WHEN event_id // 9 % 9 IN (2, 5, 8) THEN (event_id * 10 + 900)::VARCHAR END AS new_end, CASE WHEN event_id // 9 % 9 = 3 THEN 'partial' END AS new_type FROM events WHERE event_id % 9 = 0)"""
_ANN = "a AS (SELECT 'ann/' || span_id AS annotation_id, file_id, CASE WHEN kind = 'error' THEN 'ground_truth' ELSE 'detected' END AS origin, 'complete' AS match_type, 'candidate' AS status, s_ms AS start_ms, e_ms AS end_ms FROM v_spans)"


def override_log(spark, d):
    k = F.floor(F.col("event_id") / 9) % 9
    e = F.col("event_id")
    actions = F.array(*[F.lit(x) for x in ("accept", "reject", "correct_bounds", "set_type", "remove", "add", "note", "bogus", "correct_bounds")])
    return table(spark, d, "events").where("event_id % 9 = 0").select(
        e.alias("pos"), F.get(actions, k.cast("int")).alias("action"), F.concat(F.lit("ann/"), e * 7 % 12000).alias("target"), F.col("user_id").alias("file_id"),
        F.when(k.isin(2, 5), (e * 10).cast("string")).when((k == 8) & (e % 2 == 0), "soon").alias("new_start"), F.when(k.isin(2, 5, 8), (e * 10 + 900).cast("string")).alias("new_end"), F.when(k == 3, "partial").alias("new_type"),
    )


def annotations(spark, d):
    return v_spans(spark, d).select(F.concat(F.lit("ann/"), "span_id").alias("annotation_id"), "file_id", F.when(F.col("kind") == "error", "ground_truth").otherwise("detected").alias("origin"), F.lit("complete").alias("match_type"), F.lit("candidate").alias("status"), F.col("s_ms").alias("start_ms"), F.col("e_ms").alias("end_ms"))


_VALID = f"""{_LOG}, {_ANN}, m AS (SELECT 'override/' || pos AS annotation_id, file_id, 'manual' AS origin, coalesce(new_type, 'complete') AS match_type, 'accepted' AS status, new_start::BIGINT AS start_ms, new_end::BIGINT AS end_ms FROM l WHERE action = 'add'),
    b AS (SELECT * FROM a UNION ALL SELECT * FROM m), t AS (SELECT l.*, CASE WHEN action = 'bogus' THEN 'unknown_action' WHEN new_start = 'soon' THEN 'bad_bounds' WHEN b.annotation_id IS NULL THEN 'no_such_annotation' WHEN b.origin = 'ground_truth' AND action <> 'remove' THEN 'ground_truth_is_fixed' END AS error
    FROM l LEFT JOIN b ON l.target = b.annotation_id WHERE action <> 'add')"""


@query("an5_apply_overrides", sql(f"""WITH {_VALID}, f AS (SELECT target, arg_max(new_start::BIGINT, pos) FILTER (WHERE action = 'correct_bounds' AND new_start IS NOT NULL) AS s, arg_max(new_end::BIGINT, pos) FILTER (WHERE action = 'correct_bounds' AND new_end IS NOT NULL) AS e,
    arg_max(new_type, pos) FILTER (WHERE action = 'set_type') AS ty, arg_max(CASE action WHEN 'accept' THEN 'accepted' WHEN 'reject' THEN 'rejected' ELSE 'removed' END, pos) FILTER (WHERE action IN ('accept', 'reject', 'remove')) AS st, count(*) AS edits FROM t WHERE error IS NULL GROUP BY 1)
    SELECT annotation_id, file_id, origin, coalesce(ty, match_type) AS match_type, coalesce(st, status) AS status, coalesce(s, start_ms) AS start_ms, coalesce(e, end_ms) AS end_ms, coalesce(edits, 0) AS edits FROM b LEFT JOIN f ON b.annotation_id = f.target""", "v_spans"))
def an5(spark, d):
    return S.apply_overrides(annotations(spark, d), override_log(spark, d), table(spark, d, "events").select(F.col("user_id").alias("file_id")))[0]


@query("an5_override_errors", sql(f"WITH {_VALID} SELECT pos, action, target, error FROM t WHERE error IS NOT NULL", "v_spans"))
def an5_errors(spark, d):
    return S.apply_overrides(annotations(spark, d), override_log(spark, d), table(spark, d, "events").select(F.col("user_id").alias("file_id")))[1]


@query("an6_relabel", """WITH o AS (SELECT doc_id AS file_id, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS new_label, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'plain' END AS new_category FROM labels WHERE NOT (quality = 1 AND toxic = 1))
    SELECT doc_id AS file_id, coalesce(new_label, source) AS label, coalesce(new_category, lang) AS category, source AS manifest_label FROM documents LEFT JOIN o ON doc_id = file_id""")
def an6(spark, d):
    inv = table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.col("source").alias("label"), F.col("lang").alias("category"))
    over = table(spark, d, "labels").select(F.col("doc_id").alias("file_id"), F.when(F.col("quality") == 1, "good").otherwise("bad").alias("new_label"), F.when(F.col("toxic") == 1, "toxic").otherwise("plain").alias("new_category"))
    return S.relabel(inv, over, {"good": ["plain"], "bad": ["plain", "toxic"]})[0].select("file_id", "label", "category", "manifest_label")


@query("an7_finalize", sql("SELECT span_id, CASE WHEN edits > 0 THEN 'verified' WHEN refined THEN 'refined' ELSE 'raw' END AS label_source, kind = 'purchase' AND (edits > 0 OR file_id % 2 = 0) AS eligible, CASE WHEN edits > 0 THEN 50 WHEN refined THEN 150 ELSE 400 END AS tolerance_pre, CASE WHEN edits > 0 THEN 60 WHEN refined THEN 160 ELSE 410 END AS tolerance_post FROM (SELECT *, CASE WHEN span_id % 5 = 0 THEN 1 ELSE 0 END AS edits, span_id % 3 = 0 AS refined FROM v_spans)", "v_spans"))
def an7(spark, d):
    s = v_spans(spark, d).withColumns({"edits": F.when(F.col("span_id") % 5 == 0, 1).otherwise(0), "refined": F.col("span_id") % 3 == 0, "match_type": F.when(F.col("kind") == "purchase", "complete").otherwise("partial"), "status": F.lit("candidate")})
    return S.finalize(s, F.col("file_id") % 2 == 0, {"verified": (50, 60), "refined": (150, 160), "raw": (400, 410)}).select("span_id", "label_source", "eligible", "tolerance_pre", "tolerance_post")


@query("an8_bulk_confirm", sql("SELECT 'owner-' || s.span_id AS override_id, CASE WHEN s.file_id % 7 = 0 THEN 'hand_timed' ELSE 'short_clip' END AS note FROM v_spans s WHERE kind = 'purchase' AND (s.file_id % 7 = 0 OR e_ms - s_ms < 600000) UNION ALL SELECT 'review-' || span_id, 'kept' FROM v_spans WHERE span_id % 100 = 1", "v_spans"))
def an8(spark, d):
    s = v_spans(spark, d)
    spans = s.where("kind = 'purchase'").select(F.col("span_id").alias("annotation_id"), "file_id", (F.col("e_ms") - F.col("s_ms")).alias("length"))
    old = s.where("span_id % 100 < 2").select(F.concat(F.when(F.col("span_id") % 100 == 0, "owner-").otherwise("review-"), "span_id").alias("override_id"), F.lit("accept").alias("action"), F.col("span_id").cast("string").alias("target"), F.lit("kept").alias("note"))
    rules = [("hand_timed", F.col("file_id") % 7 == 0), ("short_clip", F.col("length") < 600_000)]
    return S.bulk_confirm(s.select("file_id").distinct(), spans, old, rules).select("override_id", "note")


@query("an9_calibrate", sql("""WITH m AS (SELECT a.file_id, a.span_id AS t_id, b.span_id AS f_id, (least(a.e_ms, b.e_ms) - greatest(a.s_ms, b.s_ms)) / (greatest(a.e_ms, b.e_ms) - least(a.s_ms, b.s_ms))::DOUBLE AS iou, b.s_ms - a.s_ms AS start_error, b.e_ms - a.e_ms AS end_error
    FROM v_spans a JOIN v_spans b ON a.file_id = b.file_id AND least(a.e_ms, b.e_ms) > greatest(a.s_ms, b.s_ms) WHERE a.kind = 'purchase' AND b.kind = 'click'), k AS (SELECT *, row_number() OVER (PARTITION BY file_id, t_id ORDER BY iou DESC, f_id) AS n FROM m),
    j AS (SELECT s.file_id % 4 AS mode, k.start_error, k.end_error FROM v_spans s LEFT JOIN k ON s.file_id = k.file_id AND s.span_id = k.t_id AND k.n = 1 WHERE s.kind = 'purchase')
    SELECT mode, count(*) AS n, count(start_error) / count(*)::DOUBLE AS recall, greatest(0, max(start_error)) AS required_pre, greatest(0, -min(end_error)) AS required_post, quantile_cont(start_error, 0.05) AS start_p5, quantile_cont(start_error, 0.5) AS start_p50, quantile_cont(start_error, 0.95) AS start_p95 FROM j GROUP BY 1""", "v_spans"))
def an9(spark, d):
    from spanlab.plans.joins_queries import jn5

    return S.calibrate(jn5(spark, d).withColumn("mode", F.col("file_id") % 4), ["mode"])


_HEARD = "substr(t, 1, CASE turn % 3 WHEN 0 THEN length(t) WHEN 1 THEN length(t) // 2 ELSE 0 END::INT)"


@query("an10_transcript_verdict", f"WITH x AS (SELECT conv_id, turn, {_BASIC} AS t FROM conversations), y AS (SELECT *, {_HEARD} AS heard FROM x) SELECT conv_id, turn, CASE WHEN heard = '' THEN 'empty' WHEN levenshtein(heard, t) / greatest(length(heard), length(t), 1)::DOUBLE <= 0.25 THEN 'complete' WHEN starts_with(t, heard) AND length(heard) < length(t) THEN 'cut_off' ELSE 'other' END AS verdict FROM y")
def an10(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", T.norm_basic(F.col("text")).alias("t"))
    n = F.when(F.col("turn") % 3 == 0, F.length("t")).when(F.col("turn") % 3 == 1, F.floor(F.length("t") / 2)).otherwise(0).cast("int")
    t = t.withColumn("heard", F.substring(F.col("t"), F.lit(1), n))
    return t.select("conv_id", "turn", S.transcript_verdict(F.col("t"), F.col("heard"), F.lit(1.0), F.lit(2.0)).alias("verdict"))


@query("an11_best_subspan", f"""WITH w AS (SELECT item_id, {_W} AS ws FROM benchmark), a AS (SELECT item_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w), b AS (SELECT item_id, ws, i, unnest(range(i, least(i + 11, len(ws)) + 1)) AS j FROM a),
    r AS (SELECT item_id, i, j, levenshtein(array_to_string(ws[i:j], ' '), 'the and of it') / greatest(length(array_to_string(ws[i:j], ' ')), 13)::DOUBLE AS ratio FROM b), k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY ratio, i, j) AS n FROM r)
    SELECT item_id, (i - 1)::INT AS i, (j - 1)::INT AS j, ratio FROM k WHERE n = 1 AND ratio <= 0.5""")
def an11(spark, d):
    w = table(spark, d, "benchmark").select("item_id", T.words_array(T.norm_basic(F.col("text"))).alias("words"))
    return S.best_subspan(w, ["item_id"], F.lit("the and of it"), worst=0.5)


@query("an12_cut_before", f"""WITH w AS (SELECT conv_id, turn, {_W} AS ws FROM conversations), p AS (SELECT conv_id, turn, unnest(range(1, len(ws) + 1)) AS i, ws FROM w), x AS (SELECT conv_id, turn, i - 1 AS i, ws[i] AS word, (i - 1) * 250 AS ms FROM p),
    k AS (SELECT *, min(CASE WHEN word NOT IN ('and', 'of', 'the', 'is') THEN i END) OVER (PARTITION BY conv_id, turn) AS k, min(CASE WHEN word NOT IN ('the', 'is') THEN ms END) OVER (PARTITION BY conv_id, turn) AS start_ms FROM x)
    SELECT conv_id, turn, start_ms, min(ms) - 30 AS cut_ms FROM k WHERE word IN ('and', 'of') AND i > k GROUP BY 1, 2, 3 HAVING min(ms) - 30 - start_ms >= 400""")
def an12(spark, d):
    words = F.transform(T.words_array(T.norm_basic(F.col("text"))), lambda w, i: F.struct(w.alias("word"), (i * 250).cast("long").alias("start_ms")))
    return S.cut_before(table(spark, d, "conversations").select("conv_id", "turn", words.alias("words")), ["conv_id", "turn"], ["and", "of"], ["the", "is"], 400)


@query("an13_asr_keep", "SELECT l_orderkey, l_linenumber, l_suppkey, CASE l_returnflag WHEN 'R' THEN l_quantity > 25 WHEN 'A' THEN NOT l_quantity > 25 ELSE l_discount <= 0.02 OR l_tax <= 0.01 END AS keep FROM lineitem")
def an13(spark, d):
    kind = F.when(F.col("l_returnflag") == "R", "positive").when(F.col("l_returnflag") == "A", "near_miss").otherwise("other")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", S.asr_keep(kind, F.col("l_quantity") > 25, (F.col("l_discount"), 0.02), (F.col("l_tax"), 0.01)).alias("keep"))


@query("an14_relabel_ladder", f"""WITH x AS (SELECT conv_id, turn, role, {_BASIC} AS n FROM conversations) SELECT conv_id, turn, CASE WHEN conv_id % 10 = 3 THEN 'prompt' WHEN role = 'system' THEN 'role' WHEN starts_with(n, 'the') THEN 'wording' ELSE 'default' END AS rule,
    CASE WHEN conv_id % 10 = 3 THEN 'P' || turn WHEN role = 'system' THEN 'SYSTEM' WHEN starts_with(n, 'the') THEN 'THE' ELSE 'unknown' END AS label FROM x WHERE length(n) >= 20""")
def an14(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", T.norm_basic(F.col("text")).alias("n"))
    rules = [("prompt", F.when(F.col("conv_id") % 10 == 3, F.concat(F.lit("P"), "turn"))), ("role", F.when(F.col("role") == "system", "SYSTEM")), ("wording", F.when(F.col("n").startswith("the"), "THE"))]
    return S.relabel_ladder(c, rules, [("ambiguous", F.length("n") < 20)])[0].select("conv_id", "turn", "rule", "label")


@query("an15_slots_to_label", "SELECT event_id, CASE WHEN event_type = 'view' AND user_id % 2 = 0 AND k % 12 IN (1, 5, 10) THEN 'TIMER_' || (k % 12) || 'M' WHEN event_type = 'click' AND k % 7 = 0 AND user_id % 2 = 0 AND k % 12 IN (6, 7) THEN 'ALARM_' || (k % 12) || 'AM' WHEN event_type = 'click' AND k % 7 = 0 AND user_id % 2 = 1 AND k % 12 = 9 THEN 'ALARM_9PM' ELSE 'unknown' END AS label FROM (SELECT *, regexp_extract(props, '[0-9]+')::BIGINT AS k FROM events)")
def an15(spark, d):
    """Views set timers and clicks set alarms: their semantics as JSON texts, read back."""
    k, odd = prop_k(), F.col("user_id") % 2
    slots = F.struct(F.when(odd == 1, odd).alias("hours"), F.when(F.col("event_type") == "view", k % 12).alias("minutes"), F.when(odd == 0, "AM").otherwise("PM").alias("am_or_pm"), (k % 12).alias("alarm_hour"), (k % 7).alias("alarm_minute"))
    said = F.to_json(F.struct(F.when(F.col("event_type") == "view", "SetTimer").when(F.col("event_type") == "click", "SetAlarm").alias("intent"), slots.alias("slots")))
    return table(spark, d, "events").select("event_id", said.alias("said")).select("event_id", S.slots_to_label(F.from_json("said", S.SEMANTICS)).alias("label"))


@query("an16_label_from_command_slot", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'P' WHEN lower(o_orderpriority) = '1-urgent' THEN o_orderstatus || '_URGENT' WHEN lower(o_orderpriority) = '5-low' AND o_orderstatus = 'F' THEN 'F_LOW' ELSE 'unknown' END AS label FROM orders")
def an16(spark, d):
    m = spark.createDataFrame([("F", "1-Urgent", "F_URGENT"), ("O", "1-URGENT", "O_URGENT"), ("F", "5-low", "F_LOW")], "command string, value string, label string")
    return S.label_from_command_slot(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), m, "o_orderstatus", "o_orderpriority", ["P"]).select("o_orderkey", "label")
