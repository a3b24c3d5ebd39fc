"""Golden cases of triggers, matching, intervals, metrics, annotation and streams, and properties of splits and sampling."""

import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from spanlab.functions import keys, text, udfs
from spanlab.operators import checks, detection, intervals, joins, metrics, sampling, series, spans, splits, triggers
from spanlab.plans import registry, streams_queries
from spanlab.plans.views import micros, prop_k
from spanlab.sources import tables
from spanlab.streaming import streams


def scores(spark, values, step=100):
    return spark.createDataFrame([("s", i * step, float(v), i) for i, v in enumerate(values)], "stream string, t long, score double, id long")


def trigger_times(df):
    return sorted(r["t"] for r in df.collect())


def test_threshold_and_smoothing(spark):
    v = [0.0] * 60
    v[20], v[35] = 0.9, 0.9
    df = scores(spark, v)
    assert trigger_times(triggers.detect(df, "stream", "t", "score", 0.5, 1000, tie="id")) == [2000, 3500]
    v[20:23] = [0.6, 0.6, 0.6]
    v[35] = 0.9
    got = triggers.detect(scores(spark, v), "stream", "t", "score", 0.5, 1000, smoothing=3, tie="id").collect()
    assert [r["t"] for r in got] == [2200] and abs(got[0]["score"] - 0.6) < 1e-9


def test_k_of_n(spark):
    v = [0.0] * 40
    for i in (15, 17, 30, 31):
        v[i] = 0.9
    assert trigger_times(triggers.detect(scores(spark, v), "stream", "t", "score", 0.5, 500, k=2, n=3, tie="id")) == [1700, 3100]
    with pytest.raises(ValueError):
        triggers.detect(scores(spark, v), "stream", "t", "score", 0.5, 500, k=4, n=3)


def test_score_at_the_threshold_counts(spark):
    v = [0.0, 0.5, 0.5, 0.0]
    assert trigger_times(triggers.detect(scores(spark, v), "stream", "t", "score", 0.5, 1000, tie="id")) == [100]
    assert [r["on"] for r in triggers.k_of_n(scores(spark, v), "stream", "t", "score", 0.5, 2, 3, "on", "id").orderBy("t").collect()] == [False, False, True, False]
    both = detection.sweep(scores(spark, v), [0.5, 0.51], "stream", "t", "score", 1000, 1, 1, "id").collect()
    assert [(r["threshold"], r["t"]) for r in both] == [(0.5, 100)]


def test_refractory_over_batches(spark):
    """One island over many batches, null and large keys, and payloads that stay whole."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(s, i * 3, 2**60 + i) for s in (None, 2**60 + 1) for i in range(200)]
        got = triggers.refractory(spark.createDataFrame(rows, "stream long, t long, id long"), ["stream"], "t", 10, ["id"], "id").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((str(r["stream"]), r["t"], r["id"]) for r in got) == sorted((str(s), i * 3, 2**60 + i) for s in (None, 2**60 + 1) for i in range(0, 200, 4))


def test_refractory_equals_a_plain_walk(spark):
    random.seed(3)
    rows = [(s, t, 1.0, i) for s in "abc" for i, t in enumerate(sorted(random.randrange(5000) for _ in range(200)))]
    df = spark.createDataFrame(rows, "stream string, t long, score double, id long")
    got = sorted((r["stream"], r["t"]) for r in triggers.refractory(df, ["stream"], "t", 37, ["score"], "id").collect())
    want, last = [], {}
    for s, t, _, _ in rows:
        if s not in last or t - last[s] >= 37:
            last[s] = t
            want.append((s, t))
    assert got == sorted(want)


def test_matching_and_exposure(spark):
    t = spark.createDataFrame([("s", 5000, 1), ("s", 21200, 2), ("s", 22300, 3), ("s", 40000, 4)], "stream string, t long, trigger_id long")
    g = spark.createDataFrame([("s", 9, 20000, 21000)], "stream string, target_id long, s long, e long")
    out, told = detection.match(t, g, "stream", 0, 1500)
    assert {r["t"]: r["outcome"] for r in out.collect()} == {5000: "false_accept", 21200: "hit", 22300: "duplicate", 40000: "false_accept"}
    assert told.first()["latency"] == 200
    s = spark.createDataFrame([("s", 60000)], "stream string, duration_us long")
    assert detection.exposure(s, g, "stream", 1500, 0, 1500).first()["exposure"] == 56000


def test_overlapping_zones_take_triggers_in_order(spark):
    e = spark.createDataFrame([("s", 1, 0, 10), ("s", 2, 5, 15), ("s", 3, 100, 110)], "k string, e_id long, a long, b long")
    o = spark.createDataFrame([("s", 7, 1), ("s", 8, 2), ("s", 300, 3)], "k string, t long, o_id long")
    assert {r["e_id"]: r["o_id"] for r in joins.one_to_one_match(e, o, "k", 0, 0).collect()} == {1: 1, 2: 2, 3: None}


def test_one_to_one_equals_brute_force(spark):
    """Zones that overlap in long islands, several times per zone and ties, against the plain greedy rule."""
    random.seed(11)
    events = [(k, i, a, a + random.randrange(40)) for k in "ab" for i in range(60) for a in [random.randrange(600)]]
    times = [(k, random.randrange(650), i) for k in "ab" for i in range(90)]
    e, o = spark.createDataFrame(events, "k string, e_id long, a long, b long"), spark.createDataFrame(times, "k string, t long, o_id long")
    got = {(r["k"], r["e_id"]): r["o_id"] for r in joins.one_to_one_match(e, o, "k", 3, 5, width=50).collect()}
    want = {}
    for k in "ab":
        free = sorted((t, i) for q, t, i in times if q == k)
        for a, i, b in sorted((a - 3, i, b + 5) for q, i, a, b in events if q == k):
            hit = next(((t, x) for t, x in free if a <= t <= b), None)
            want[k, i] = hit[1] if hit else None
            free = [x for x in free if x != hit]
    assert got == want


def test_attribution(spark):
    t = spark.createDataFrame([("s", 11200, 1), ("s", 30900, 2), ("s", 50000, 3)], "k string, t long, trigger_id long")
    e = spark.createDataFrame([("s", 10, 10000, 11000), ("s", 11, 30000, 31000)], "k string, event_id long, e0 long, e1 long")
    got = joins.attribute(t, e, "k", 1500, F.lit("background")).collect()
    assert {r["trigger_id"]: r["cause"] for r in got} == {1: "10", 2: "11", 3: "background"}


def test_intervals_of_rates():
    assert abs(metrics.garwood(0, 1.0)[1] - 3.689) < 1e-3 and abs(metrics.clopper_pearson(0, 10)[1] - 0.3085) < 1e-4
    assert all(math.isnan(x) for x in (*metrics.garwood(3, 0.0), *metrics.clopper_pearson(0, 0)))
    lo, hi = metrics.clopper_pearson(171, 202)
    assert 0.78 < lo < 171 / 202 < hi < 0.9


def test_auc_and_precision(spark):
    df = spark.createDataFrame([(0.9, True, 1), (0.8, True, 2), (0.2, False, 3), (0.1, False, 4)], "score double, p boolean, id int").withColumn("g", F.lit(1))
    assert metrics.roc_auc(df, "score", F.col("p")).first()["auc"] == 1.0
    assert metrics.roc_auc(df.withColumn("score", F.lit(0.5)), "score", F.col("p")).first()["auc"] == 0.5
    assert math.isnan(metrics.roc_auc(df.where("p"), "score", F.col("p")).first()["auc"])
    assert metrics.average_precision(df, ["g"], "score", F.col("p"), ["id"]).first()["ap"] == 1.0


def test_category_policy(spark):
    random.seed(0)
    rows = [("a", "x", random.random()) for _ in range(400)] + [("b", "x", random.random() * 0.5) for _ in range(400)] + [("c", "x", random.random()) for _ in range(30)] + [("d", "out", 2.0) for _ in range(3000)]
    df = spark.createDataFrame(rows, "category string, subset string, score double")
    t = metrics.choose_threshold(df, "category", "subset", ["out"], "score", 0.01, 100).collect()
    assert {r["pool"] for r in t} == {"a", "b", "pooled"} and {r["operating"] for r in t} == {max(r["boundary"] for r in t)}
    for name in "ab":
        mine = [s for c, _, s in rows if c == name]
        assert sum(s > t[0]["operating"] for s in mine) / len(mine) <= 0.01


PHRASE = spans.SpanConfig("ola", "mango")


def chunk(spark, said, positive):
    w = [{"word": x, "start": 0.4 * i, "end": 0.4 * i + 0.35, "probability": 0.9} for i, x in enumerate(said.split())]
    df = spark.createDataFrame([(1, positive, w)], f"id int, positive boolean, words array<{spans.WORD}>")
    return [r["match_type"] for r in spans.status_of(spans.quality_gates(spans.detect_spans(df, ["id"], PHRASE, positive="positive"), PHRASE)).collect()]


def test_span_kinds(spark):
    assert chunk(spark, "Ola Mango!", True) == ["complete"] and chunk(spark, "Ola Mano!", True) == ["fuzzy"] and chunk(spark, "Mango", True) == ["partial", "unmatched"] and chunk(spark, "Mango", False) == ["partial"]
    assert chunk(spark, "He built that.", True) == ["unmatched"] and chunk(spark, "Thank you.", False) == []
    assert chunk(spark, "ola - mango", True) == ["complete"], "words without letters are left out first"
    assert chunk(spark, "Olamango", False) == ["fuzzy"], "every chunk is tried as a whole"
    assert chunk(spark, "ola there", True) == ["partial", "unmatched"], "partial spans don't hide unmatched speech"
    assert chunk(spark, "...", True) == ["unmatched"] and chunk(spark, "...", False) == []
    assert chunk(spark, "ola mango ola mango mango", True) == ["complete", "complete", "partial"]


def plain_scan(words, positive, pair, word):
    """The scan by its rules, word by word."""

    def ratio(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1] / max(len(a), len(b), 1)

    kept = [(i, "".join(c for c in w.lower() if c.isascii() and c.isalnum())) for i, w in enumerate(words)]
    kept = [x for x in kept if x[1]]
    out, i = [], 0
    while i < len(kept):
        (at, a), (end, b) = kept[i], kept[i + 1] if i + 1 < len(kept) else (None, None)
        if b is not None and (a, b) == ("ola", "mango") or b is not None and ratio(f"{a} {b}", "ola mango") <= pair:
            out.append(("complete" if (a, b) == ("ola", "mango") else "fuzzy", at, end))
            i += 2
            continue
        if ratio(a, "mango") <= word or a == "ola":
            out.append(("partial", at, at))
        i += 1
    said = " ".join(w for _, w in kept)
    ends = (kept[0][0], kept[-1][0]) if kept else (None, None)
    if not out and said and ratio(said, "ola mango") <= pair:
        out.append(("fuzzy", *ends))
    if positive and all(k == "partial" for k, _, _ in out):
        out.append(("unmatched", *ends))
    return out


def test_spans_equal_a_plain_scan(spark):
    random.seed(4)
    pool = ["ola", "Ola,", "mango", "Mango!", "magno", "ala", "olamango", "-", "the", "tango", "ola-mango", "ma", "ngo", "?"]
    rows = []
    for n in range(300):
        words = [random.choice(pool) for _ in range(random.randrange(6))]
        rows.append((n, n % 2 == 0, [{"word": w, "start": 0.4 * i, "end": 0.4 * i + 0.35, "probability": 0.9} for i, w in enumerate(words)], 0.1, 1.5))
    df = spark.createDataFrame(rows, f"id int, positive boolean, words array<{spans.WORD}>, c0 double, c1 double")
    cfg = spans.SpanConfig("ola", "mango", fuzzy_pair=0.3, fuzzy_word=0.4)
    got = {}
    for r in spans.detect_spans(df, ["id"], cfg, "positive", ("c0", "c1")).collect():
        got.setdefault(r["id"], []).append((r["match_type"], r["first_word"], r["last_word"]))
        assert r["start_sec"] >= 0.1 and r["end_sec"] <= 1.5
    want = {n: x for n, p, w, _, _ in rows if (x := plain_scan([y["word"] for y in w], p, 0.3, 0.4))}
    assert got == want and len({k for x in want.values() for k, _, _ in x}) == 4


def test_span_too_long_for_a_window(spark):
    s = spark.createDataFrame([(1, 1, 1000, 2500)], "file_id int, span_id int, s_ms long, e_ms long")
    good, refused = intervals.positive_windows(s, spark.createDataFrame([(1, 10_000)], "file_id int, duration_ms long"))
    assert good.count() == 0 and [r["reason"] for r in refused.collect()] == ["occurrence_too_long_for_window"]


def test_splits_keep_groups_whole(spark):
    random.seed(1)
    rows = [(f"g{random.randrange(80)}", "st", random.randrange(1, 20)) for _ in range(1000)]
    df = spark.createDataFrame(rows, "g string, st string, w long")
    out = splits.split_balanced(df, "g", "st", "w").collect()
    total, largest = sum(r["w"] for r in out), max(r["w"] for r in out)
    assert len({r["g"] for r in out}) == len(out)
    for name, ratio in splits.RATIOS.items():
        assert abs(sum(r["w"] for r in out if r["split"] == name) - ratio * total) <= largest
    greedy = splits.split_greedy_deficit(df, "g", "st", "w")
    frozen = greedy.where("split <> 'train'").select("g", "split")
    known = {r["g"]: r["split"] for r in frozen.collect()}
    later = splits.extend_split(df.unionByName(spark.createDataFrame([("new", "st", 5)], df.schema)), frozen, "g", "st", "w").collect()
    assert all(r["split"] == known[r["g"]] and r["method"] == "frozen" for r in later if r["g"] in known) and any(r["g"] == "new" for r in later)


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 3).alias("b"), (F.col("id") % 7).alias("g"))
    q = spark.createDataFrame([(0, 40), (1, 25), (2, 0)], "b long, quota long")
    draw = lambda n, epoch: sorted(map(tuple, sampling.bucket_quota_sample(df.repartition(n), q, "b", "id", "g", epoch, 1).collect()))
    assert draw(1, 0) == draw(4, 0) == draw(50, 0) != draw(4, 1) and len(draw(1, 0)) == 65
    shares = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "n string, s double")
    assert {r["n"]: r["quota"] for r in sampling.largest_remainder(shares, "n", "s", 10).collect()} == {"a": 4, "b": 3, "c": 3}
    far = sampling.farthest_point(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "i long, v array<double>"), "i", "v", 2).collect()
    assert [r["i"] for r in far] == [1, 3]


def test_closed_vocabulary_and_lookups_fail_loudly(spark):
    df = spark.createDataFrame([("a",), ("z",)], "c string")
    with pytest.raises(PySparkException, match="no mapping for z"):
        keys.map_category(df, "c", {"a": "A"}, "m").collect()
    dim = spark.createDataFrame([("a", 1), ("a", 2)], "c string, v int")
    with pytest.raises(PySparkException, match="repeated key a"):
        joins.lookup_join(df, dim, "c").collect()
    with pytest.raises(PySparkException, match="no v for z"):
        joins.lookup_join(df, dim.limit(1), "c", ["v"]).collect()


def test_spoken_numbers():
    assert text.number_words(42) == "forty two" and text.number_words(100) == "one hundred"


@pytest.mark.parametrize("said, spoken", [
    ("let's go 20kg", "let us go twenty kg"), ("wake me at 6:05pm", "wake me at six five p m"), ("7:00 a.m.", "seven a m"), ("I'm 100% sure it's 21°", "i am one hundred percent sure it is twenty one degrees"),
    ("don't take 007 or 101", "don t take seven or"), ("What's x5 and 3.5", "what is x and three five"), ("I am here at 12:45", "i a m here at twelve forty five"),
])
def test_spoken_forms(spark, said, spoken):
    assert spark.createDataFrame([(said,)], "t string").select(text.norm_spoken(F.col("t")).alias("s")).first()["s"] == spoken


def test_normal_forms(spark):
    df = spark.createDataFrame([("Set it to 6am, 50% at 10:30!",)], "t string")
    r = df.select(text.norm_spoken(F.col("t")).alias("s"), text.norm_basic(F.col("t")).alias("b"), text.norm_token(F.col("t")).alias("k")).first()
    assert r["s"] == "set it to six a m fifty percent at ten thirty" and r["b"] == "set it to 6am 50 at 10 30" and r["k"] == "setitto6am50at1030"


def test_sources(spark, tmp_path):
    f = tmp_path / "m.csv"
    f.write_text("a,b\n1,x\n2,y\n2,z\n")
    assert tables.read_table(spark, str(f), "a int, b string", ["a"]).count() == 3
    with pytest.raises(ValueError, match="missing columns: c, d"):
        tables.read_table(spark, str(f), "a int, b string", ["d", "c"])
    with pytest.raises(ValueError, match="comes 2 times"):
        tables.read_table(spark, str(f), "a int, b string", key="a")
    new = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k int, v string")
    assert tables.append_rows(new, str(tmp_path / "t"), "k").count() == 2
    assert tables.append_rows(new.unionByName(spark.createDataFrame([(3, "w")], new.schema)), str(tmp_path / "t"), "k").count() <= 1
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3
    tables.write_partitioned(new, str(tmp_path / "p"), ["v"])
    assert sorted(x.name for x in (tmp_path / "p").iterdir() if x.is_dir()) == ["v=x", "v=y"]
    (tmp_path / "root" / "rain").mkdir(parents=True)
    for n in ("rec_1.wav", "rec_2.WAV", "other.wav", "rec_3.txt"):
        (tmp_path / "root" / "rain" / n).write_text(n)
    manifest = spark.createDataFrame([("rain/rec_1.wav", "rain", "noise")], "filepath string, category string, label string")
    assert [(r["name"], r["label"]) for r in tables.scan_new_files(spark, str(tmp_path / "root"), manifest, "rec_", ["wav"]).collect()] == [("rec_2.WAV", "noise")]


def test_frozen_sets(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    path = str(tmp_path / "frozen")
    assert checks.verify_frozen(df, ["k", "v"], path) == "frozen" and checks.verify_frozen(df.repartition(3), ["k", "v"], path) == "verified"
    with pytest.raises(ValueError):
        checks.verify_frozen(df.limit(1), ["k", "v"], path)


def staged(spark, tmp_path, name, rows, schema, size):
    """``rows`` as a stream of batches of ``size``."""
    for k in range(0, len(rows), size):
        spark.createDataFrame(rows[k : k + size], schema).coalesce(1).write.parquet(str(tmp_path / name / f"b{k:05d}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/*").withColumn("ts", F.timestamp_micros("t_us"))


@pytest.mark.parametrize("size", [300, 90, 37])
def test_stream_triggers_equal_batch_under_any_chunking(spark, tmp_path, size):
    """Rows up to ten seconds out of order, and streams that end under the watermark."""
    random.seed(9)
    rows = [(random.choice("ab"), (1000 + i) * 1_000_000, float(random.choice([60, random.random() * 100])), i) for i in range(300)] + [("z", 1_400_000_000, 0.0, 300)]
    rows.sort(key=lambda r: r[1] + random.Random(r[3]).randrange(9_000_000))
    schema = "stream_id string, t_us long, score double, event_id long"
    batch = triggers.detect(spark.createDataFrame(rows, schema), "stream_id", "t_us", "score", 60, 15_000_000, k=2, n=3, tie="event_id")
    want = sorted((r["stream_id"], r["t_us"]) for r in batch.collect())
    got = streams.run_to_table(streams.stream_triggers(staged(spark, tmp_path, "in", rows, schema, size), "stream_id", "ts", 60, 15_000_000, 2, 3), "chunks").collect()
    assert sorted((r["stream_id"], r["t_us"]) for r in got) == want and len(want) > 10


def plain_captures(rows, c):
    """Captures of one stream by their rules, with the whole past in lists."""
    out, state, quiet_until, heard = [], None, 0, []
    for t, level, trigger in rows:
        if state is None:
            heard.append((t, level))
            if trigger and t >= quiet_until:
                state = {"t": t, "levels": [], "speech": [], "start": None}
            continue
        state["levels"].append(level)
        last = state["levels"][-c.smooth_rows :]
        smooth = 10 * math.log10(sum(10 ** (x / 10) for x in last) / len(last) + 1e-18)
        near = sorted(x for u, x in heard if u > heard[-1][0] - c.background_us)
        at = 0.2 * (len(near) - 1)
        floor = near[int(at)] + (near[min(int(at) + 1, len(near) - 1)] - near[int(at)]) * (at - int(at)) if len(near) >= c.background_rows else c.quiet
        if t - state["t"] >= c.ignore_us and smooth >= floor + (c.start_margin if state["start"] is None else c.continue_margin):
            state["speech"].append(t)
            if state["start"] is None and len(state["speech"]) >= c.speech_rows:
                state["start"] = t
        why = None
        if state["start"] is None:
            why = "no_speech" if t - state["t"] >= c.wait_us else None
        elif t - state["speech"][-1] >= c.silence_us:
            why = "end_of_speech"
        elif t - state["start"] >= c.longest_us:
            why = "max_length"
        if why:
            out.append((state["t"], t, why))
            state, quiet_until = None, t + c.cooldown_us
    return out


def test_captures_equal_brute_force(spark, tmp_path):
    rng = random.Random(3)
    config = streams.CaptureConfig(ignore_us=100_000, smooth_rows=3, speech_rows=3, silence_us=400_000, longest_us=2_000_000, wait_us=1_000_000, cooldown_us=300_000, background_us=3_000_000, background_rows=10)
    rows, loud = [], 0
    for i in range(3000):
        loud = max(0, loud - 1) if loud else (rng.choice([5, 20, 60, 150]) if rng.random() < 0.03 else 0)
        rows.append((rng.choice("ab"), i * 20_000, (-25.0 if loud else -55.0) + rng.random() * 8, rng.random() < 0.05))
    rows.append(("z", 200_000_000, -50.0, False))
    schema = "stream string, t_us long, level double, is_trigger boolean"
    want = sorted((s, *x) for s in "ab" for x in plain_captures([r[1:] for r in rows if r[0] == s], config))
    got = streams.run_to_table(streams.capture_sessions(staged(spark, tmp_path, "captures", rows, schema, 800), "stream", "ts", config), "captures").collect()
    assert sorted(map(tuple, got)) == want and {x[3] for x in want} == {"no_speech", "end_of_speech", "max_length"}


def test_captures_of_events_equal_brute_force(spark):
    d = "/root/testdata/sf0.001"
    got = sorted(map(tuple, registry.QUERIES["stm3_capture_sessions"](spark, d).collect()))
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id"), micros("ts").alias("t"), "value", (prop_k() < 20).alias("on"), "event_id").orderBy("t", "value", "on").collect()
    mark = (max(r["t"] for r in rows) // 1000 - 10_000) * 1000
    want = sorted((u, *x) for u in {r["user_id"] for r in rows} for x in plain_captures([(r["t"], r["value"], r["on"]) for r in rows if r["user_id"] == u and r["t"] < mark], streams_queries.CAPTURE))
    assert got == want and got


def plain_device(rows, threshold, k, n, c):
    """Scores and captures of one stream, row by row."""
    out, flags, at, marked = [], [], 0, []
    while at < len(rows):
        t, level, score = rows[at]
        marked.append((t, level, False))
        at += 1
        if out and t < out[-1][1] + c.cooldown_us:
            continue
        flags.append(score >= threshold)
        if flags[-1] and sum(flags[-n:]) >= k:
            marked[-1] = (t, level, True)
            # The capture runs to its end whatever the scores say.
            ends = [x for x in plain_captures(marked + [(u, v, False) for u, v, _ in rows[at:]], c) if x[0] == t]
            if not ends:
                break
            out += ends
            held = [(u, v, False) for u, v, _ in rows[at:] if u <= ends[0][1]]
            marked, at, flags = marked + held, at + len(held), []
    return out


@pytest.mark.parametrize("size", [3000, 700, 400])
def test_device_sessions_equal_a_plain_walk(spark, tmp_path, size):
    rng = random.Random(6)
    config = streams.CaptureConfig(ignore_us=100_000, smooth_rows=3, speech_rows=3, silence_us=400_000, longest_us=2_000_000, wait_us=1_000_000, cooldown_us=300_000, background_us=3_000_000, background_rows=10)
    rows, loud = [], 0
    for i in range(2400):
        loud = max(0, loud - 1) if loud else (rng.choice([5, 20, 60, 150]) if rng.random() < 0.03 else 0)
        rows.append((rng.choice("ab"), i * 20_000, (-25.0 if loud else -55.0) + rng.random() * 8, rng.random()))
    rows.append(("z", 200_000_000, -50.0, 0.0))
    schema, ran = "stream string, t_us long, level double, score double", []
    want = sorted((s, *x) for s in "ab" for x in plain_device([r[1:] for r in rows if r[0] == s], 0.8, 2, 4, config))
    got = streams.run_to_table(streams.device_sessions(staged(spark, tmp_path, "device", rows, schema, size), "stream", "ts", 0.8, 2, 4, config), "device", query=ran).collect()
    assert sorted(map(tuple, got)) == want and len({x[3] for x in want}) > 1 and len(want) > 20
    # What is held doesn't grow with the batches: each stream's own state and timer, and the rows that the watermark hasn't passed.
    assert ran[0].lastProgress["stateOperators"][0]["numRowsTotal"] <= 12


@pytest.mark.parametrize(("size", "slide"), [(30, 10), (25, 10), (10, 15)])
def test_windows_by_a_streams_own_schedule(spark, tmp_path, size, slide):
    """Rows up to nine seconds out of order and silent stretches: the same windows under three chunkings, none before the first row, and those of the table."""
    rng = random.Random(size)
    rows = [(k, 5_000_000_000 + int(t * 1e6), rng.random()) for k in "abc" for t in sorted(rng.choice([0, 400, 3000]) + rng.random() * 150 for _ in range(120))]
    rows = sorted(rows, key=lambda r: r[1] + random.Random(r[1]).randrange(9_000_000)) + [("z", 9_000_000_000, 0.0)]
    want = {}
    for k in "abc":
        mine = [(t, v) for key, t, v in rows if key == k]
        first = min(t for t, _ in mine)
        for w in range(0, 4000 // slide):
            lo = first + w * slide * 1_000_000
            held = [v for t, v in mine if lo <= t < lo + size * 1_000_000]
            if held:
                want[k, lo] = (len(held), round(sum(held) / len(held), 9), max(held))
    told = lambda df: {(r["k"], r["at"]): (r["n"], round(r["mean_value"], 9), r["max_value"]) for r in df.withColumn("at", F.unix_micros("w_start")).collect()}
    table = spark.createDataFrame(rows, "k string, t_us long, value double").withColumn("ts", F.timestamp_micros("t_us"))
    assert told(streams.sliding_windows(table, "k", "ts", f"{size} seconds", f"{slide} seconds", "value")) == want
    for chunk_size in (400, 111, 60):
        stream = staged(spark, tmp_path, f"w{chunk_size}", rows, "k string, t_us long, value double", chunk_size)
        got = streams.run_to_table(streams.sliding_windows(stream, "k", "ts", f"{size} seconds", f"{slide} seconds", "value"), "windows")
        assert told(got) == want and got.count() == len(want)


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    schema = "k string, ts timestamp, value double"
    for n, rows in enumerate(["('a', timestamp'2024-01-01 00:00:05', 1D), ('a', timestamp'2024-01-01 00:05:00', 2D)", "('a', timestamp'2024-01-01 00:10:00', 3D)", "('a', timestamp'2024-01-01 00:00:06', 9D), ('a', timestamp'2024-01-01 00:20:00', 3D)"]):
        spark.sql(f"SELECT * FROM VALUES {rows} AS t(k, ts, value)").coalesce(1).write.mode("append").parquet(str(tmp_path / "late" / f"b{n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/late/*")
    ran = []
    got = streams.run_to_table(streams.sliding_windows(stream, "k", "ts", "1 minute", "1 minute", "value"), "late_rows", query=ran).collect()
    assert {r["w_start"].minute: r["max_value"] for r in got}[0] == 1.0 and streams.late_rows(ran[0]) == 1


def test_merge_and_runs(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 9, 10), (1, 1, 2)], "k int, s long, e long")
    assert sorted((r["s"], r["e"]) for r in series.merge_intervals(df, ["k"], "s", "e").collect()) == [(0, 7), (9, 10)]


def test_window_udtf():
    assert [x for (x,) in udfs.ExpandWindows().eval(0, 1000, 400, 150, 1)] == [0, 150, 300, 450, 600] and list(udfs.ExpandWindows().eval(0, 300, 400, 150, 1)) == []
