"""Span annotation: detection in transcripts, quality gates, overrides, eligibility."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanlab.functions.binding import let
from spanlab.functions.text import edit_ratio, norm_token


@dataclass(frozen=True)
class SpanConfig:
    """The phrase looked for and the bounds of its quality gates."""

    first: str
    second: str
    fuzzy_pair: float = 0.34
    fuzzy_word: float = 0.34
    flag_unmatched: bool = True
    probability: float = 0.3
    gap: float = 0.35
    collapsed: float = 0.02
    shortest: float = 0.3
    longest: float = 2.5


WORD = "struct<word:string,start:double,end:double,probability:double>"


def detect_spans(chunks: DataFrame, keys: list[str], cfg: SpanConfig, positive: str | None = None, bounds: tuple[str, str] | None = None) -> DataFrame:
    """Spans of the phrase in word arrays (keys, words): match_type, why, first and last word positions, and times.

    Words that normalise to nothing are left out first. Then a left-to-right scan: the exact pair is complete and uses two words; a pair that lies within
    ``fuzzy_pair`` of the phrase, with the space, is fuzzy and uses two; a lone word like the second, within ``fuzzy_word``, or equal to the first is partial.
    Where the scan finds nothing at all, the whole chunk may be a fuzzy phrase. Where there is no complete or fuzzy span, a chunk of a ``positive``
    file is reported as unmatched speech too. ``bounds`` are the chunk's start and end columns, which clip spans; raw times stay beside them.
    Chunks are short, so the scan folds over one chunk's array.
    """
    target = f"{cfg.first} {cfg.second}"
    said = F.transform(F.col("words"), lambda w, i: F.struct(i.cast("int").alias("at"), norm_token(F.coalesce(w["word"], F.lit(""))).alias("n")))
    at = chunks.withColumn("__n", F.filter(said, lambda x: x["n"] != "")).withColumn("__text", F.array_join(F.transform("__n", lambda x: x["n"]), " "))

    def kind(n: Column, x: Column, i: Column) -> Column:
        w, after = x["n"], F.get(n, i + 1)["n"]
        pair = edit_ratio(F.concat_ws(" ", w, after), F.lit(target))
        of = lambda name, why, ratio, size: F.struct(F.lit(name).alias("match_type"), F.lit(why).alias("why"), ratio.cast("double").alias("edit_ratio"), F.lit(size).alias("size"))
        word = edit_ratio(w, F.lit(cfg.second))
        return (
            F.when((w == cfg.first) & (after == cfg.second), of("complete", "exact_pair", F.lit(0.0), 2)).when(after.isNotNull() & (pair <= cfg.fuzzy_pair), of("fuzzy", "fuzzy_text_match", pair, 2))
            .when((w == cfg.second) | (word <= cfg.fuzzy_word), of("partial", "isolated_second_token", word, 1)).when(w == cfg.first, of("partial", "isolated_first_token", F.lit(0.0), 1))
        )

    kinds = let(F.col("__n"), lambda n: F.transform(n, lambda x, i: F.struct(i.cast("int").alias("i"), kind(n, x, i).alias("k"))))
    found = "struct<i:int,j:int,match_type:string,why:string,edit_ratio:double>"
    start = F.struct(F.array().cast(f"array<{found}>").alias("out"), F.lit(0).alias("next"))
    span = lambda i, j, name, why, ratio: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), name.alias("match_type"), why.alias("why"), ratio.cast("double").alias("edit_ratio"))

    def step(s: Column, x: Column) -> Column:
        k = x["k"]
        one = span(x["i"], x["i"] + k["size"] - 1, k["match_type"], k["why"], k["edit_ratio"])
        return F.when(x["i"] < s["next"], s).otherwise(F.struct(F.array_append(s["out"], one).alias("out"), (x["i"] + k["size"]).cast("int").alias("next")))

    scanned = F.aggregate(F.filter(kinds, lambda x: x["k"].isNotNull()), start, step, lambda s: s["out"])
    whole = lambda name, why, ratio: F.array(span(F.lit(0), F.size("__n") - 1, F.lit(name), F.lit(why), ratio).cast(found))
    ratio = F.when(F.col("__text") == "", 1.0).otherwise(edit_ratio(F.col("__text"), F.lit(target)))
    tried = let(scanned, lambda x: F.when((F.size(x) == 0) & (F.col("__text") != "") & (ratio <= cfg.fuzzy_pair), whole("fuzzy", "fuzzy_chunk_text_match", ratio)).otherwise(x))
    if positive is not None and cfg.flag_unmatched:
        missed = lambda x: F.col(positive) & ~F.exists(x, lambda s: s["match_type"].isin("complete", "fuzzy"))
        tried = let(tried, lambda x: F.when(missed(x), F.concat(x, whole("unmatched", "no_phrase_in_positive_file", ratio))).otherwise(x))
    limits = [F.col(b).cast("double") for b in bounds] if bounds else [F.array_min(F.transform("words", lambda w: w["start"])), F.array_max(F.transform("words", lambda w: w["end"]))]
    kept = [*keys, *([positive] if positive else [])]
    out = at.select(*kept, "words", "__n", limits[0].alias("__c0"), limits[1].alias("__c1"), F.explode(tried).alias("s"))
    used = F.transform(F.slice("__n", F.col("s.i") + 1, F.greatest(F.col("s.j") - F.col("s.i") + 1, F.lit(0))), lambda x: F.get("words", x["at"]))
    out = out.withColumn("__w", used).withColumn("__whole", F.col("s.why").isin("fuzzy_chunk_text_match", "no_phrase_in_positive_file"))
    raw = [F.when(F.col("__whole"), F.col("__c0")).otherwise(F.array_min(F.transform("__w", lambda w: w["start"]))), F.when(F.col("__whole"), F.col("__c1")).otherwise(F.array_max(F.transform("__w", lambda w: w["end"])))]
    pair = ~F.col("__whole") & (F.size("__w") == 2)
    place = lambda c: F.get("__n", F.col(c))["at"]
    return out.select(
        *kept, "s.match_type", "s.why", "s.edit_ratio", place("s.i").alias("first_word"), F.when(F.size("__n") > 0, place("s.j")).alias("last_word"), F.greatest(raw[0], F.col("__c0")).alias("start_sec"), F.least(raw[1], F.col("__c1")).alias("end_sec"),
        raw[0].alias("raw_start_sec"), raw[1].alias("raw_end_sec"), F.array_min(F.transform("__w", lambda w: w["probability"])).alias("min_probability"), F.when(pair, F.get("__w", F.lit(1))["start"] - F.get("__w", F.lit(0))["end"]).alias("gap_sec"),
        F.array_min(F.transform("__w", lambda w: w["end"] - w["start"])).alias("shortest_word"),
    )


def quality_gates(spans: DataFrame, cfg: SpanConfig, positive: str = "positive") -> DataFrame:
    """``reasons``: everything that speaks against a span."""
    d = F.col("end_sec") - F.col("start_sec")
    return spans.withColumn("reasons", F.array_compact(F.array(
        F.when(F.col("min_probability") < cfg.probability, "low_probability"), F.when(F.col("gap_sec") > cfg.gap, "wide_gap"), F.when(F.col("shortest_word") <= cfg.collapsed, "collapsed_word"),
        F.when(~d.between(cfg.shortest, cfg.longest), "implausible_duration"), F.when(~F.col(positive), "found_in_negative_file"),
    )))


def status_of(spans: DataFrame, positive: str = "positive") -> DataFrame:
    doubt = ((F.col("match_type") == "complete") & (F.size("reasons") > 0)) | F.col("match_type").isin("fuzzy", "unmatched") | ((F.col("match_type") == "partial") & F.col(positive))
    return spans.withColumn("status", F.when(doubt, "needs_review").otherwise("candidate"))


def recording_flags(files: DataFrame, spans: DataFrame, key: str, positive: str = "positive") -> DataFrame:
    told = spans.groupBy(key).agg(F.count("*").alias("spans"), F.count_if(F.col("match_type") == "complete").alias("complete"), F.count_if(F.col("status") == "needs_review").alias("to_review"))
    j = files.join(told, key, "left").na.fill(0, ["spans", "complete", "to_review"])
    return j.withColumn("flag", F.when(F.col(positive) & (F.col("complete") == 0), "no_complete_match"))


ACTIONS = ("accept", "reject", "correct_bounds", "set_type", "remove", "add", "clip_level_positive", "note")


def apply_overrides(spans: DataFrame, log: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spans (annotation_id, file_id, origin, match_type, status, start_ms, end_ms) after an ordered edit log, and its error rows.

    The log has pos, action, target, file_id, new_start, new_end (texts) and new_type. Per field the last valid edit wins; a corrected bound
    that is missing keeps the old one. Adds come as ``override/<pos>``, and later edits may name them. An unknown action or file, a target
    that does not exist yet, bounds that are no numbers, and edits of ground truth other than remove are errors; the rest is applied.
    """
    number = r"^-?[0-9]+$"
    new = log.withColumn("a", F.when(F.col("new_start").rlike(number), F.col("new_start").cast("long"))).withColumn("b", F.when(F.col("new_end").rlike(number), F.col("new_end").cast("long")))
    wrong_number = (F.col("new_start").isNotNull() & F.col("a").isNull()) | (F.col("new_end").isNotNull() & F.col("b").isNull())
    creates = F.col("action").isin("add", "clip_level_positive")
    known = new.join(files.select(F.col("file_id"), F.lit(True).alias("file_known")).distinct(), "file_id", "left")
    made_error = F.when(~F.col("action").isin(*ACTIONS), "unknown_action").when(creates & F.col("file_known").isNull(), "unknown_file").when(wrong_number, "bad_bounds").when((F.col("action") == "add") & (F.col("a").isNull() | F.col("b").isNull()), "bad_bounds")
    known = known.withColumn("error", made_error)
    added = known.where(creates & F.col("error").isNull()).select(
        F.concat(F.lit("override/"), F.col("pos").cast("string")).alias("annotation_id"), "file_id", F.lit("manual").alias("origin"), F.when(F.col("action") == "add", F.coalesce("new_type", F.lit("complete"))).otherwise("clip_level").alias("match_type"),
        F.lit("accepted").alias("status"), F.col("a").alias("start_ms"), F.col("b").alias("end_ms"), F.col("pos").alias("born"),
    )
    base = spans.withColumn("born", F.lit(-1).cast("long")).unionByName(added.withColumn("born", F.col("born").cast("long")))
    targets = base.select(F.col("annotation_id").alias("target"), "born", F.col("origin").alias("target_origin"))
    edits = known.where(~creates | F.col("error").isNotNull()).join(targets, "target", "left")
    late = F.coalesce("error", F.when(F.col("born").isNull() | (F.col("born") >= F.col("pos")), "no_such_annotation").when((F.col("target_origin") == "ground_truth") & (F.col("action") != "remove"), "ground_truth_is_fixed"))
    edits = edits.withColumn("error", late)
    valid = edits.where("error IS NULL")
    last = lambda c, on: F.max_by(F.when(on, c), F.when(on, F.col("pos")))
    act = F.col("action")
    fields = valid.groupBy(F.col("target").alias("annotation_id")).agg(
        last(F.col("a"), (act == "correct_bounds") & F.col("a").isNotNull()).alias("a"), last(F.col("b"), (act == "correct_bounds") & F.col("b").isNotNull()).alias("b"), last(F.col("new_type"), (act == "set_type") & F.col("new_type").isNotNull()).alias("t"),
        last(F.when(act == "accept", "accepted").when(act == "reject", "rejected").when(act == "remove", "removed"), act.isin("accept", "reject", "remove")).alias("st"), F.count("*").alias("edits"),
    )
    out = base.join(fields, "annotation_id", "left").select(
        "annotation_id", "file_id", "origin", F.coalesce("t", "match_type").alias("match_type"), F.coalesce("st", "status").alias("status"), F.coalesce("a", "start_ms").alias("start_ms"), F.coalesce("b", "end_ms").alias("end_ms"), F.coalesce("edits", F.lit(0)).alias("edits")
    )
    return out, edits.where("error IS NOT NULL").select("pos", "action", "target", "error")


def relabel(inventory: DataFrame, overrides: DataFrame, allowed: dict[str, list[str]]) -> tuple[DataFrame, DataFrame]:
    """New labels and categories by file; the manifest's stay beside them. Unknown files and categories that contradict the label come second, as errors."""
    fits = F.create_map(*[F.lit(x) for label, cats in allowed.items() for x in (label, "|" + "|".join(cats) + "|")])
    ok = F.coalesce(F.instr(F.try_element_at(fits, F.col("new_label")), F.concat(F.lit("|"), F.col("new_category"), F.lit("|"))) > 0, F.lit(False))
    seen = overrides.join(inventory.select("file_id", F.lit(True).alias("known")), "file_id", "left")
    told = seen.withColumn("error", F.when(F.col("known").isNull(), "unknown_file").when(~ok, "label_contradicts_category"))
    good = told.where("error IS NULL").select("file_id", "new_label", "new_category")
    out = inventory.join(good, "file_id", "left").withColumn("manifest_label", F.col("label")).withColumn("manifest_category", F.col("category"))
    return out.withColumns({"label": F.coalesce("new_label", "label"), "category": F.coalesce("new_category", "category")}).drop("new_label", "new_category"), told.where("error IS NOT NULL").select("file_id", "error")


def finalize(spans: DataFrame, policy_allows: Column, tolerance: dict[str, tuple[int, int]]) -> DataFrame:
    """label_source, eligibility, and the tolerance before and after (ms) by how the bounds were found."""
    source = F.when(F.col("edits") > 0, "verified").when(F.col("refined"), "refined").otherwise("raw")
    pick = lambda k: F.when(source == "verified", tolerance["verified"][k]).when(source == "refined", tolerance["refined"][k]).otherwise(tolerance["raw"][k])
    eligible = (F.col("match_type") == "complete") & F.col("status").isin("candidate", "accepted") & ((F.col("edits") > 0) | policy_allows)
    return spans.withColumns({"label_source": source, "eligible": eligible, "tolerance_pre": pick(0), "tolerance_post": pick(1)})


def bulk_confirm(inventory: DataFrame, spans: DataFrame, existing: DataFrame, rules: list[tuple[str, Column]], owner: str = "owner") -> DataFrame:
    """An owner's assertion as override rows: the first rule that holds for a span's file accepts it. A rerun replaces only its own rows of ``existing``."""
    why = F.lit(None).cast("string")
    for name, condition in reversed(rules):
        why = F.when(condition, name).otherwise(why)
    j = spans.join(inventory, "file_id").withColumn("note", why).where("note IS NOT NULL")
    made = j.select(F.concat(F.lit(f"{owner}-"), F.col("annotation_id").cast("string")).alias("override_id"), F.lit("accept").alias("action"), F.col("annotation_id").cast("string").alias("target"), "note")
    return existing.where(~F.col("override_id").startswith(f"{owner}-")).unionByName(made)


def calibrate(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """How much earlier starts and later ends must be allowed for: worst errors and their quantiles, and recall. A null start_error is a miss."""
    q = F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))
    out = pairs.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count("start_error").alias("found"), F.greatest(F.lit(0), F.max("start_error")).alias("required_pre"), F.greatest(F.lit(0), -F.min("end_error")).alias("required_post"),
        F.percentile("start_error", q).alias("q"),
    )
    return out.select(*keys, "n", (F.col("found") / F.col("n")).alias("recall"), "required_pre", "required_post", *[F.get("q", F.lit(i)).alias(f"start_p{p}") for i, p in enumerate((5, 50, 95))])


def transcript_verdict(target: Column, heard: Column, end: Column, duration: Column, worst: float = 0.25, edge: float = 0.15) -> Column:
    """``empty``, ``complete`` within an edit ratio of ``worst``, ``cut_off`` where the target goes on or the clip ends, else ``other``.

    What is heard as the target begins lies as far from it as their lengths do, and texts further apart in length than ``worst`` allows can't be within it; only the others are measured, in the
    band that it allows.
    """
    begins, apart = target.startswith(heard), F.abs(F.length(heard) - F.length(target))
    whole = F.greatest(F.length(heard), F.length(target), F.lit(1))
    most = F.floor(worst * whole).cast("int")
    d = F.when(begins | (apart > most), apart).otherwise(F.call_function("levenshtein", heard, target, most))
    within = F.coalesce((d >= 0) & (d <= most) & (d / whole <= worst), F.lit(False))
    cut = begins & (F.length(heard) < F.length(target)) | (duration - end < edge)
    return F.when(heard == "", "empty").when(within, "complete").when(cut, "cut_off").otherwise("other")


def best_subspan(words: DataFrame, keys: list[str], target: Column, longest: int = 12, worst: float = 0.2) -> DataFrame:
    """The run of up to ``longest`` words closest to the target (ties: earliest, shortest), where it is close enough.

    A text stays one row: its runs are told by their borders, those whose length is too far from the target's are skipped, and the others are measured in the band that ``worst`` allows.
    Texts without words give no row.
    """
    goal = F.length(target)

    def run(ends: Column, i: Column, j: Column) -> Column:
        long = F.get(ends, j) - F.coalesce(F.get(ends, i - 1), F.lit(0)) - 1
        whole = F.greatest(long, goal, F.lit(1))
        said = F.array_join(F.slice("words", i + 1, j - i + 1), " ")
        d = F.when(F.abs(long - goal) <= worst * whole, F.call_function("levenshtein", said, target, F.floor(worst * whole).cast("int")))
        return F.when((d >= 0) & (d <= worst * whole), F.struct((d / whole).alias("ratio"), i.alias("i"), j.alias("j")))

    # Where each word ends, counting a space behind it.
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends"))
    ends = F.aggregate("words", start, lambda s, w: F.struct((s["at"] + F.length(w) + 1).alias("at"), F.concat(s["ends"], F.array(s["at"] + F.length(w) + 1)).alias("ends")))["ends"]
    last = F.size("words") - 1
    each = lambda e: F.transform(F.sequence(F.lit(0), last), lambda i: F.array_min(F.transform(F.sequence(i, F.least(i + (longest - 1), last)), lambda j: run(e, i, j))))
    best = words.where(F.size("words") > 0).withColumn("b", let(ends, lambda e: F.array_min(each(e)))).where("b IS NOT NULL")
    return best.select(*keys, "b.i", "b.j", "b.ratio")


def cut_before(words: DataFrame, keys: list[str], deciders: list[str], fillers: list[str], shortest: int, lead: int = 30) -> DataFrame:
    """Where to cut (ms): ``lead`` before the first deciding word that follows a kept word; leading fillers don't count as kept. Short rests are left out."""
    at = words.select(*keys, F.posexplode("words").alias("i", "w"))
    kept = F.min(F.when(~F.col("w.word").isin(*deciders, *fillers), F.col("i"))).over(W.partitionBy(*keys))
    start = F.min(F.when(~F.col("w.word").isin(*fillers), F.col("w.start_ms"))).over(W.partitionBy(*keys))
    found = at.withColumn("__k", kept).withColumn("start_ms", start).where(F.col("w.word").isin(*deciders) & (F.col("i") > F.col("__k")))
    cut = found.groupBy(*keys, "start_ms").agg((F.min("w.start_ms") - lead).alias("cut_ms"))
    return cut.where(F.col("cut_ms") - F.col("start_ms") >= shortest)


def asr_keep(kind: Column, exact: Column, *ratios: tuple[Column, float]) -> Column:
    """Positives only where heard exactly, near-misses only where not; other kinds where the best pass lies within its bound."""
    near = F.lit(False)
    for r, most in ratios:
        near = near | F.coalesce(r <= most, F.lit(False))
    return F.when(kind == "positive", exact).when(kind == "near_miss", ~exact).otherwise(near)


def relabel_ladder(clips: DataFrame, rules: list[tuple[str, Column]], drop: list[tuple[str, Column]] = (), otherwise: str = "unknown") -> tuple[DataFrame, DataFrame]:
    """Ordered rules (name, label or null): the first that gives a label counts and is told; ``drop`` rules come first and their rows second."""
    gone = F.coalesce(*[F.when(c, n) for n, c in drop], F.lit(None).cast("string"))
    hit = F.coalesce(*[F.when(label.isNotNull(), F.struct(F.lit(n).alias("rule"), label.alias("label"))) for n, label in rules], F.struct(F.lit("default").alias("rule"), F.lit(otherwise).alias("label")))
    told = clips.withColumn("dropped", gone).withColumn("__h", hit).withColumns({"rule": F.col("__h.rule"), "label": F.col("__h.label")}).drop("__h")
    return told.where("dropped IS NULL").drop("dropped"), told.where("dropped IS NOT NULL").drop("rule", "label")


#: Minutes of timers and (half of the day, hour, minute) of alarms that have labels.
TIMERS = (1, 5, 10)
ALARMS = (("AM", 6, 0), ("AM", 7, 0), ("PM", 9, 0))


def slots_to_label(semantics: Column) -> Column:
    """The label of parsed semantics (intent, slots of hours, minutes, seconds, am_or_pm, alarm_hour and alarm_minute): a timer of whole minutes or an alarm that has one, else ``unknown``. A null slot is 0 or not given."""
    s = semantics["slots"]
    none = lambda c: F.coalesce(c, F.lit(0)) == 0
    timer = (semantics["intent"] == "SetTimer") & none(s["hours"]) & none(s["seconds"]) & s["minutes"].isin(*TIMERS)
    out = F.when(timer, F.concat(F.lit("TIMER_"), s["minutes"].cast("string"), F.lit("M")))
    for half, hour, minute in ALARMS:
        out = out.when((semantics["intent"] == "SetAlarm") & (s["am_or_pm"] == half) & (s["alarm_hour"] == hour) & (s["alarm_minute"] == minute), f"ALARM_{hour}{half}")
    return out.otherwise("unknown")


#: The schema of such semantics, for JSON texts.
SEMANTICS = "intent string, slots struct<hours:long,minutes:long,seconds:long,am_or_pm:string,alarm_hour:long,alarm_minute:long>"


def label_from_command_slot(df: DataFrame, label_map: DataFrame, command: str, slot: str, fixed: list[str]) -> DataFrame:
    """A fixed command is its own label; (command, lower-case slot) is looked up in ``label_map`` (command, value, label); anything else is unknown."""
    m = label_map.select(F.col("command").alias(command), F.lower("value").alias("__v"), "label").dropDuplicates([command, "__v"])
    j = df.withColumn("__v", F.lower(F.col(slot))).join(m, [command, "__v"], "left").drop("__v")
    return j.withColumn("label", F.when(F.col(command).isin(*fixed), F.col(command)).otherwise(F.coalesce("label", F.lit("unknown"))))
