"""Registered queries without SQL against plain Python over the given tables, and properties of the two that fit models."""

import hashlib
import itertools
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlab.operators import aggregates, checks, detection, diagnostics, intervals, joins, metrics, ranks, sampling, series, signals, splits, triggers, wordings
from spanlab.plans import registry, sampling_queries
from spanlab.plans.signals_queries import levels

SF = "/root/testdata/sf0.001"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def digest(*parts):
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()


def binomial(k, n, p):
    """P(X >= k)"""
    return math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k, n + 1))


def poisson(k, m):
    """P(X < k)"""
    return math.fsum(math.exp(i * math.log(m) - m - math.lgamma(i + 1)) for i in range(k))


def check_share(k, n, low, high):
    assert low == 0 if k == 0 else math.isclose(binomial(k, n, low), 0.025, rel_tol=1e-7)
    assert high == 1 if k == n else math.isclose(1 - binomial(k + 1, n, high), 0.025, rel_tol=1e-7)


def check_rate(k, hours, low, high):
    assert low == 0 if k == 0 else math.isclose(1 - poisson(k, low * hours), 0.025, rel_tol=1e-7)
    assert math.isclose(poisson(k + 1, high * hours), 0.025, rel_tol=1e-7)


def test_exact_intervals(spark):
    for r in registry.QUERIES["me6_proportion_ci"](spark, SF).collect():
        check_share(r["k"], r["n"], r["low"], r["high"])
    for r in registry.QUERIES["me7_poisson_rate_ci"](spark, SF).collect():
        check_rate(r["k"], 720.0, r["low"], r["high"])
    rows = registry.QUERIES["udf2_exact_ci"](spark, SF).collect()
    assert rows
    for r in rows:
        check_share(r["k"], r["n"], r["share_low"], r["share_high"])
        check_rate(r["k"], r["n"], r["rate_low"], r["rate_high"])


@pytest.mark.parametrize("k, n", [(0, 1), (1, 1), (1, 2), (0, 400), (399, 400), (3, 10), (200, 1000)])
def test_exact_intervals_at_the_edges(k, n):
    check_share(k, n, *metrics.clopper_pearson(k, n))
    check_rate(k, 2.5, *metrics.garwood(k, 2.5))


def test_exact_intervals_of_many_trials():
    """A hundred million trials take no longer than a few, and lie near the normal interval."""
    low, high = metrics.clopper_pearson(30_000_000, 100_000_000)
    half = 1.959964 * math.sqrt(0.21 / 1e8)
    assert abs(low - (0.3 - half)) < 1e-7 and abs(high - (0.3 + half)) < 1e-7
    low, high = metrics.garwood(50_000_000, 1.0)
    assert abs(low - (5e7 - 1.959964 * math.sqrt(5e7))) < 5 and abs(high - (5e7 + 1.959964 * math.sqrt(5e7))) < 5


def greedy(groups, frozen, ratios, seed):
    """(stratum, group) -> split by the rule: the largest group first, to the split that lacks most; smaller hashes first among equals."""
    out = {}
    for stratum in {s for s, _ in groups}:
        weight = {g: w for (s, g), w in groups.items() if s == stratum}
        have = {n: sum(w for g, w in weight.items() if frozen.get(g) == n) for n in ratios}
        out |= {(stratum, g): frozen[g] for g in weight if g in frozen}
        for g in sorted((g for g in weight if g not in frozen), key=lambda g: (-weight[g], digest(seed, g)[:16])):
            best = min(ratios, key=lambda n: (have[n] - ratios[n] * sum(weight.values()), digest(seed, g, n)[:16]))
            have[best] += weight[g]
            out[stratum, g] = best
    return out


def test_greedy_splits(spark):
    groups = {(r[0], r[1]): r[2] for r in table(spark, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.sum("l_quantity")).collect()}
    got = {(r["l_returnflag"], r["l_suppkey"]): r["split"] for r in registry.QUERIES["sp4_split_greedy_deficit"](spark, SF).collect()}
    assert got == greedy(groups, {}, splits.RATIOS, 7)
    frozen = {s: "train" if m < 80 else "validation" if m < 90 else "test" for s in {s for _, s in groups} if s % 3 == 0 for m in [int(hashlib.md5(str(s).encode()).hexdigest(), 16) % 100]}
    rows = registry.QUERIES["sp5_extend_split"](spark, SF).collect()
    assert {(r["l_returnflag"], r["l_suppkey"]): r["split"] for r in rows} == greedy(groups, frozen, splits.RATIOS, 7)
    assert all((r["method"] == "frozen") == (r["l_suppkey"] in frozen) for r in rows)


def test_greedy_ties_go_by_the_smaller_hash(spark):
    rows = [(f"g{i}", "s", 1) for i in range(12)]
    got = {("s", r["g"]): r["split"] for r in splits.split_greedy_deficit(spark.createDataFrame(rows, "g string, st string, w long"), "g", "st", "w", {"a": 1 / 3, "b": 1 / 3, "c": 1 / 3}, 5).collect()}
    assert got == greedy({("s", g): 1.0 for g, _, _ in rows}, {}, {"a": 1 / 3, "b": 1 / 3, "c": 1 / 3}, 5)


def test_class_source_draws(spark):
    docs = table(spark, "documents").select("lang", "source", "doc_id").collect()
    pool = {}
    for r in docs:
        pool.setdefault(r["lang"], {}).setdefault(r["source"], []).append(r["doc_id"])

    def pick(named, u):
        """The name whose share of the summed weights holds u."""
        total, at = sum(w for _, w in named), 0
        for name, w in named:
            at += w
            if u < at / total:
                return name

    want = {}
    for draw in range(1, 2001):
        u = lambda k: int(digest(5, 1, draw, k)[:12], 16) / (1 << 48)  # noqa: B023, E731
        cls = "es" if u("unknown") * 100 < 20 else pick([(c, 1) for c in sorted(pool) if c != "es"], u("class"))
        source = pick([(s, sampling_queries._CLS.get(s, 1)) for s in sorted(pool[cls])], u("source"))
        want[draw] = cls, source, pick([(i, 1) for i in sorted(pool[cls][source])], u("row"))
    got = {r["draw"]: (r["lang"], r["source"], r["doc_id"]) for r in registry.QUERIES["sm3_class_source_draws"](spark, SF).collect()}
    assert got == want


def test_farthest_points(spark):
    rows = sorted((r["vec_id"], np.array(r["embedding"], float)) for r in table(spark, "embeddings").collect())
    ids, unit = [i for i, _ in rows], np.stack([v / np.linalg.norm(v) for _, v in rows])
    for k in (6, 20):
        taken, least = [0], 1 - unit @ unit[0]
        while len(taken) < k:
            least[taken] = -1
            taken.append(int(np.argmax(least)))
            least = np.minimum(least, 1 - unit @ unit[taken[-1]])
        got = sampling.farthest_point(table(spark, "embeddings"), "vec_id", "embedding", k).orderBy("round").collect()
        assert [r["vec_id"] for r in got] == [ids[i] for i in taken]
    assert [r["vec_id"] for r in registry.QUERIES["sm8_farthest_point"](spark, SF).orderBy("round").collect()] == [ids[i] for i in taken[:6]]
    assert sampling.farthest_point(table(spark, "embeddings").limit(0), "vec_id", "embedding", 3).count() == 0


def plain_start(v, smoothing, above, run, first=0):
    s = sorted(v)
    at = 0.2 * (len(s) - 1)
    floor = s[int(at)] + (s[min(int(at) + 1, len(s) - 1)] - s[int(at)]) * (at - int(at))
    on = [i >= first and 10 * math.log10(sum(10 ** (x / 10) for x in v[max(0, i - smoothing + 1) : i + 1]) / smoothing + 1e-18) >= floor + above for i in range(len(v))]
    return next((i for i in range(len(v) - run + 1) if all(on[i : i + run])), None)


def test_speech_start(spark):
    want = {r["vec_id"]: plain_start(r["l"], 2, 3.0, 2) for r in levels(spark, SF).collect()}
    got = {r["vec_id"]: r["start_frame"] for r in registry.QUERIES["sg7_speech_start"](spark, SF).collect()}
    assert got == want and len(set(want.values())) > 2
    rng = random.Random(2)
    rows = [(i, [rng.choice([-60.0, -58.5, -30.0, -20.0]) for _ in range(40)]) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, v array<double>").select("i", signals.speech_start(F.col("v"), 5, 6.0, 3, 8).alias("s"))
    assert {r["i"]: r["s"] for r in df.collect()} == {i: plain_start(v, 5, 6.0, 3, 8) for i, v in rows}


def cos(x, y):
    n = np.linalg.norm(x) * np.linalg.norm(y)
    return float(np.dot(x, y) / n) if n else 0.0


@pytest.mark.parametrize(("block", "rows", "pivots"), [(3, 7, 4), (4096, 65_536, 32)])
def test_near_duplicate_maximum(spark, monkeypatch, block, rows, pivots):
    for name, value in (("BLOCK", block), ("ROWS", rows), ("PIVOTS", pivots)):
        monkeypatch.setattr(diagnostics, name, value)
    rng = np.random.default_rng(1)
    a = [(k, i, rng.normal(size=4).tolist()) for i, k in enumerate([0] * 30 + [1] * 5 + [2])] + [(0, 36, [0.0] * 4), (None, 37, [1.0] * 4)]
    refs = [(k, 100 + i, rng.normal(size=4).tolist()) for i, k in enumerate([0] * 20 + [1] * 2)] + [(0, 130, [0.0] * 4), (0, 131, [0.0] * 4), (None, 132, [1.0] * 4)]
    schema = "k int, id long, v array<double>"
    got = {r["id"]: r["max_similarity"] for r in diagnostics.near_duplicate_max(spark.createDataFrame(a, schema), spark.createDataFrame(refs, schema), "k", "id", "v").collect()}
    assert set(got) == set(range(38)) and got[35] is None and got[37] is None
    for k, i, v in a[:35] + a[36:37]:
        assert math.isclose(got[i], max(cos(v, w) for q, _, w in refs if q == k), abs_tol=1e-12)


def test_pivots_leave_cells_out_and_projections_find_near_ones(spark):
    """Rows around 40 centres: exact with a fraction of all comparisons; projections with fewer still, never too high, and at least 0.9 of the near ones."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 24))
    schema = "k string, id long, v array<double>"
    refs = [("x", 10_000 + i, (centres[i % 40] + 0.1 * rng.normal(size=24)).tolist()) for i in range(800)]
    a = [("x", i, (centres[i % 40] + 0.1 * rng.normal(size=24)).tolist()) for i in range(400)]
    rows, other = spark.createDataFrame(a, schema), spark.createDataFrame(refs, schema)
    best = {i: max(cos(v, w) for _, _, w in refs) for _, i, v in a}
    exact = {r["id"]: r for r in diagnostics.near_duplicate_max(rows, other, "k", "id", "v").collect()}
    assert all(math.isclose(exact[i]["max_similarity"], best[i], abs_tol=1e-12) for i in best)
    quick = {r["id"]: r for r in diagnostics.near_duplicate_lsh(rows, other, "k", "id", "v").collect()}
    made = lambda told: sum(r["compared"] for r in told.values())
    assert made(exact) < 0.4 * 400 * 800 and min(best.values()) > 0.9
    found = [quick[i]["max_similarity"] for i in best]
    assert all(f is None or f <= best[i] + 1e-12 for i, f in zip(best, found))
    assert sum(f is not None and math.isclose(f, best[i], abs_tol=1e-9) for i, f in zip(best, found)) >= 0.9 * len(best)


def test_projections_on_the_given_vectors(spark):
    """Recall on the embeddings, which are spread wide: 4 bits, 12 tables."""
    e = [(r["vec_id"], r["embedding"]) for r in table(spark, "embeddings").collect()]
    refs = np.array([v for i, v in e if i % 5 == 0])
    refs /= np.linalg.norm(refs, axis=1)[:, None]
    best = {i: float((refs @ np.array(v)).max() / np.linalg.norm(v)) for i, v in e if i % 5}
    got = {r["vec_id"]: r for r in registry.QUERIES["dg8_near_duplicate_lsh"](spark, SF).collect()}
    assert set(got) == set(best) and sum(abs((got[i]["max_similarity"] or -1) - b) < 1e-6 for i, b in best.items()) >= 0.9 * len(best)


def test_sweep_walks_all_thresholds_at_once(spark):
    """Each threshold's triggers are those of a detector of its own, with islands that go on over small batches."""
    rng = random.Random(5)
    rows = [(s, i * 7 + rng.randrange(5), rng.choice([0.2, 0.5, 0.51, 0.8, 0.95, None]), i) for s in "ab" for i in range(700)] + [("c", 3, 0.4, 1)]
    df = spark.createDataFrame(rows, "s string, t long, p double, i long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = {tuple(r) for r in detection.sweep(df, [0.8, 0.5, 0.9, 2.0], "s", "t", "p", 40, 2, 4, "i").select("threshold", "s", "t", "i").collect()}
        want = {(x, *tuple(r)) for x in (0.5, 0.8, 0.9, 2.0) for r in triggers.detect(df, "s", "t", "p", x, 40, 2, 4, tie="i").select("s", "t", "i").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plain = set()
    for x in (0.5, 0.8, 0.9, 2.0):
        for s in "abc":
            mine, last = sorted((t, i, p) for k, t, p, i in rows if k == s), None
            for at, (t, i, p) in enumerate(mine):
                near = [q for _, _, q in mine[max(0, at - 3) : at + 1]]
                if p is not None and p >= x and sum(q is not None and q >= x for q in near) >= 2 and (last is None or t - last >= 40):
                    plain.add((x, s, t, i))
                    last = t
    assert got == want == plain and len({r[0] for r in got}) == 3


def test_owner_buckets_refuse_overlap_and_gaps(spark):
    pool = spark.createDataFrame([("a", "x", 1), ("b", None, 2)], "kind string, source string, id int")
    owners = [("a", "x", "one"), ("b", None, "two"), ("a", "x", "one"), ("c", "x", "two")]
    frame = lambda rows: spark.createDataFrame(rows, "kind string, source string, bucket string")
    assert {r["id"]: r["bucket"] for r in sampling.owner_buckets(pool, frame(owners), ["kind", "source"]).collect()} == {1: "one", 2: "two"}
    with pytest.raises(ValueError, match="several"):
        sampling.owner_buckets(pool, frame([*owners, ("a", "x", "two")]), ["kind", "source"])
    with pytest.raises(ValueError, match="no bucket"):
        sampling.owner_buckets(pool, frame(owners[:1]), ["kind", "source"])


def test_draws_without_replacement_take_the_smallest_keys(spark):
    rows = [(i % 3 if i % 7 else None, i, float(i % 11)) for i in range(3000)]
    df = spark.createDataFrame(rows, "b int, id long, w double")
    quotas = spark.createDataFrame([(0, 100), (1, 5000), (2, 0)], "b int, quota long")
    got = {}
    for r in sampling.without_replacement(df, quotas, "b", "id", F.col("w"), 2, 5).collect():
        got.setdefault(r["b"], set()).add(r["id"])
    key = lambda i, w: -math.log(max(int(digest(5, 2, i)[:12], 16) / 2**48, 2.0**-49)) / w
    ranked = lambda b: [i for _, i in sorted((key(i, w), i) for x, i, w in rows if x == b and w > 0)]
    assert got == {0: set(ranked(0)[:100]), 1: set(ranked(1))}


def test_check_suite_merges_small_buffers(spark):
    rows = [(i % 700, i, "d%03d" % (i % 9)) for i in range(5000)]
    df = spark.createDataFrame(rows, "id long, v long, d string").repartition(7)
    told = {r["check_name"]: r for r in checks.run_checks([
        checks.Check("all", df, F.lit(True), "id", F.col("d")), checks.Check("none", df, F.lit(False), "id", F.col("d")), checks.Check("few", df, F.col("v") > 4996, "id", F.col("d")),
        checks.Check("unknown", df, F.lit(None).cast("boolean"), "id", F.col("d")), checks.Check("other", df.where("v < 20"), F.col("v") > 8, "v", F.lit(None)),
    ]).collect()}
    assert (told["all"]["violations"], told["all"]["examples"], told["all"]["detail"]) == (5000, "0,1,2,3,4", min(d for i, _, d in rows if i == 0))
    assert (told["none"]["status"], told["unknown"]["status"], told["none"]["examples"]) == ("PASS", "PASS", None)
    assert (told["few"]["violations"], told["few"]["examples"]) == (3, "97,98,99") and (told["other"]["examples"], told["other"]["detail"]) == ("9,10,11,12,13", "")


def test_suite_scans_a_table_once(spark):
    df = spark.read.parquet(f"{SF}/lineitem.parquet")
    suite = [checks.Check(f"c{k}", df, F.col("l_quantity") > k, "l_orderkey", F.lit("x")) for k in range(6)]
    assert checks.run_checks(suite)._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1


def test_nearest_of_many_wordings(spark):
    """Thousands of wordings, some within reach of a text and some texts out of reach of all, ties and nulls among them."""
    rng = random.Random(12)
    said = lambda: " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 4)))
    refs = sorted({said() for _ in range(1800)})
    texts = [None, "", "a", "ab"] + [said() if rng.random() < 0.4 else "".join(c for c in rng.choice(refs) if rng.random() > 0.08) for _ in range(60)]
    got = {r["id"]: r for r in wordings.nearest_reference(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), spark.createDataFrame([(r,) for r in refs], "ref string")).collect()}

    def ratio(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1] / max(len(a), len(b), 1)

    reasons = set()
    for i, t in enumerate(texts):
        n = " ".join((t or "").split())
        best, ref = min((ratio(n, r), r) for r in refs)
        assert (got[i]["nearest"], got[i]["ratio"]) == (ref, best)
        assert got[i]["reason"] == ("empty" if n == "" else "too_far" if best > 0.25 else got[i]["reason"])
        reasons.add(got[i]["reason"])
    assert {"empty", "too_far", "match"} <= reasons


def test_shortcut_probe_tells_separable_classes(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i // 7 % 2, (rng.normal(size=5) + (4 if i // 7 % 2 else -4)).tolist(), int(rng.integers(2))) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, label int, v array<double>, noise int")
    told = {r["class"]: r for r in diagnostics.shortcut_probe(df, "v", "label", F.col("id") % 4 != 0).collect()}
    assert set(told) == {0, 1} and sum(r["clips"] for r in told.values()) == 150 and all(r["correct"] == 1.0 for r in told.values())
    random_one = diagnostics.shortcut_probe(df, "v", "noise", F.col("id") % 4 != 0).collect()
    assert 0.25 < sum(r["clips"] * r["correct"] for r in random_one) / 150 < 0.75
    assert sum(r["clips"] for r in registry.QUERIES["dg5_shortcut_probe"](spark, SF).collect()) == table(spark, "embeddings").where("vec_id % 4 = 0").count()


def test_two_clusters(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=3) * 0.1 + ([1, 0, 0] if i % 2 else [0, 1, 0])).tolist()) for i in range(200)]
    got = {r["id"]: r for r in diagnostics.cluster_two(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v").collect()}
    assert len({(i % 2, r["cluster"]) for i, r in got.items()}) == 2
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    centres = [np.mean([unit[i] for i in unit if i % 2 == k], axis=0) for k in range(2)]
    centres = [c / np.linalg.norm(c) for c in centres]
    assert all(math.isclose(got[i]["margin"], float(unit[i] @ centres[i % 2] - unit[i] @ centres[1 - i % 2]), abs_tol=1e-6) for i in unit)
    asked = registry.QUERIES["dg6_cluster_two"](spark, SF).collect()
    assert len(asked) == table(spark, "embeddings").count() and {r["cluster"] for r in asked} == {0, 1} and sum(r["margin"] >= 0 for r in asked) > 0.9 * len(asked)


def test_running_totals_over_ranges(spark, monkeypatch):
    """Null keys, ties and few values, with many small ranges."""
    monkeypatch.setattr(ranks, "CHUNKS", 9)
    monkeypatch.setattr(ranks, "ROWS", 20)
    rng = random.Random(8)
    rows = [(rng.choice([None, "a", "b"]), rng.choice([1.5, 2.5, None, rng.random() * 9]), i, rng.randrange(5)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, x double, id long, w long")
    for down in (False, True):
        got = {r["id"]: (r["before_w"], r["all_w"]) for r in ranks.cumulative(df, ["k"], "x", ["w"], down, ["id"]).collect()}
        key = lambda r: ((r[1] is None) == down, (-r[1] if down else r[1]) if r[1] is not None else 0, r[2])  # noqa: B023, E731
        assert got == {r[2]: (sum(s[3] for s in rows if s[0] == r[0] and key(s) < key(r)), sum(s[3] for s in rows if s[0] == r[0])) for r in rows}
    told = {r["k"]: r for r in aggregates.quantile_summary(df, ["k"], "x", (0.1, 0.5)).collect()}
    for k in (None, "a", "b"):
        mine = [r[1] for r in rows if r[0] == k and r[1] is not None]
        assert math.isclose(told[k]["p50"], statistics.median(mine)) and math.isclose(told[k]["p10"], float(np.percentile(mine, 10))) and told[k]["n"] == len(mine)


@pytest.mark.parametrize("most", [7, 1 << 20])
def test_one_busy_key_in_ranges(spark, monkeypatch, most):
    """Sessions, runs, rolling columns, merged intervals, free parts and triggers of a key that holds most rows, dealt to ranges and pieces or not."""
    monkeypatch.setattr(ranks, "ROWS", most)
    rng = random.Random(5)
    rows = sorted({(rng.choice([None, "a", "b", "b", "b", "b"]), rng.randrange(900), i) for i in range(220)}, key=lambda r: (r[0] or "", r[1], r[2]))
    rows = [(k, t, i, rng.randrange(10) / 8, t + rng.randrange(1, 9)) for k, t, i in rows]
    df = spark.createDataFrame(rows, "k string, t long, id long, x double, e long")
    by_key = {k: [r for r in rows if r[0] == k] for k in (None, "a", "b")}

    def want(tell):
        return {r[2]: v for mine in by_key.values() for r, v in zip(mine, tell(mine))}

    def told(frame, col):
        return {r["id"]: r[col] for r in frame.collect()}

    sessions = lambda mine: itertools.accumulate((int(i > 0 and mine[i][1] - mine[i - 1][1] > 6) for i in range(len(mine))))
    assert told(series.sessionize(df, "k", "t", 6, "id"), "session") == want(sessions)
    smooth = lambda mine: [sum(r[3] for r in mine[max(0, i - 3):i + 1]) / len(mine[max(0, i - 3):i + 1]) for i in range(len(mine))]
    assert told(triggers.smooth(df, "k", "t", "x", 4, "s", "id"), "s") == want(smooth)
    flags = lambda v: [v[i] >= 0.5 and sum(y >= 0.5 for y in v[max(0, i - 2):i + 1]) >= 2 for i in range(len(v))]
    assert told(triggers.k_of_n(df, "k", "t", "x", 0.5, 2, 3, "on", "id"), "on") == want(lambda mine: flags([r[3] for r in mine]))
    kept = []
    for mine in by_key.values():
        last = None
        for r, on in zip(mine, flags(smooth(mine))):
            if on and (last is None or r[1] - last >= 15):
                kept.append(r[2])
                last = r[1]
    assert sorted(r["id"] for r in triggers.detect(df, "k", "t", "x", 0.5, 15, 2, 3, 4, "id").collect()) == sorted(kept)
    runs = {k: max((len(list(g)) for on, g in itertools.groupby(r[3] > 0.5 for r in mine) if on), default=0) for k, mine in by_key.items()}
    assert {r["k"]: r["longest"] for r in series.longest_run(df, "k", ["t", "id"], F.col("x") > 0.5).collect()} == runs
    gaps = {k: (len(mine), max(b[1] - a[4] for a, b in itertools.pairwise(mine))) for k, mine in by_key.items()}
    assert {r["k"]: (r["n"], r["max_gap"]) for r in series.gaps_between(df, "k", "t", "e", "id").collect()} == gaps
    spacing = {k: min(b[1] - a[1] for a, b in itertools.pairwise(mine)) for k, mine in by_key.items()}
    assert {r["k"]: r["min_spacing"] for r in series.min_spacing(df, "k", "t").collect()} == spacing
    picked = {r[2] for mine in by_key.values() for r in (mine if len(mine) <= 20 else [mine[i] for i in {(2 * j * (len(mine) - 1) + 19) // 38 for j in range(20)}])}
    assert {r["id"] for r in series.linspace_cap(df, "k", ["t", "id"], 20).collect()} == picked
    union = {k: [] for k in by_key}
    for k, mine in by_key.items():
        for r in mine:
            if union[k] and r[1] <= union[k][-1][1]:
                union[k][-1][1] = max(union[k][-1][1], r[4])
            else:
                union[k].append([r[1], r[4]])
    merged = series.merge_intervals(df.withColumn("x", F.lit(0)), ["k"], "t", "e").collect()
    assert sorted((str(r["k"]), r["t"], r["e"]) for r in merged) == sorted((str(k), *x) for k, found in union.items() for x in found)
    whole = spark.createDataFrame([("a", 10, 880), ("b", 10, 880)], "k string, lo long, hi long")
    free = {(r["k"], r["free_start"], r["free_end"]) for r in intervals.subtract(whole, df, ["k"], "t", "e", "lo", "hi").collect()}
    covered = {r["k"]: r["covered"] for r in intervals.union_length(whole, df, ["k"], "t", "e", "lo", "hi").collect()}
    for k in ("a", "b"):
        taken = {x for a, b in union[k] for x in range(max(a, 10), min(b, 880))}
        assert covered[k] == len(taken)
        assert {x for key, a, b in free if key == k for x in range(a, b)} == set(range(10, 880)) - taken
        assert all((k, b, c) not in free for key, a, b in free if key == k for c in range(b, 881))


@pytest.mark.parametrize("k, radius", [(1, 2.0), (5, 3.0), (40, 50.0)])
def test_nearest_rows_in_cells(spark, k, radius):
    """A dense heap, repeated places, lonely rows and borders of cells against all distances; rows without a coordinate meet nothing."""
    rng = random.Random(k)
    heap = lambda n, wide: [(rng.gauss(0, wide), rng.gauss(0, wide)) for _ in range(n)]
    left = heap(60, 0.02) + heap(40, 4) + [(1.0, 1.0)] * 5 + [(90.0, 90.0), (-2.0, 0.0), (None, 1.0)]
    right = heap(150, 0.02) + heap(60, 4) + [(1.0, 1.0)] * 50 + [(0.0, 0.0), (2.0, 0.0), (1.0, None)]
    a = [(i, "ab"[i % 2], *p) for i, p in enumerate(left)]
    b = [(i, "ab"[i % 3 > 0], *p) for i, p in enumerate(right)]
    want = set()
    for i, key, x, y in a:
        dist = sorted(((x - bx) * (x - bx) + (y - by) * (y - by), j) for j, other, bx, by in b if key == other and None not in (x, y, bx, by))
        want |= {(i, j, n) for n, (d, j) in enumerate([c for c in dist if c[0] <= radius * radius][:k], 1)}
    got = joins.knn_band_join(spark.createDataFrame(a, "a_id long, g string, ax double, ay double"), spark.createDataFrame(b, "b_id long, g string, bx double, by double"), ["g"], k, radius)
    assert {(r["a_id"], r["b_id"], r["rank"]) for r in got.collect()} == want


def test_matching_of_one_busy_stream(spark, monkeypatch):
    """Zones of one stream in ranges are matched as in one window."""
    rng = random.Random(12)
    targets = spark.createDataFrame([("s", i, t, t + rng.randrange(5)) for i, t in enumerate(rng.randrange(3000) for _ in range(150))], "k string, e_id long, a long, b long")
    seen = spark.createDataFrame([("s", rng.randrange(3000), i) for i in range(170)], "k string, t long, o_id long")
    told = lambda: sorted(map(str, joins.one_to_one_match(targets, seen, "k", 2, 9).collect()))
    plain = told()
    monkeypatch.setattr(ranks, "ROWS", 11)
    assert told() == plain and sum("o_id=None" not in r for r in plain) > 60


@pytest.mark.parametrize("c, n", [(5, 5), (6, 5), (7, 3), (100, 20), (21, 20), (9, 1), (1000, 7)])
def test_even_picks(spark, c, n):
    got = sorted(r["i"] for r in series.linspace_cap(spark.range(c).select(F.col("id").alias("i"), F.lit(1).alias("k")), "k", ["i"], n).collect())
    assert got == (list(range(c)) if c <= n else sorted({(2 * j * (c - 1) + (n - 1)) // (2 * max(1, n - 1)) for j in range(n)}))


def test_fingerprints_see_moved_separators(spark):
    from spanlab.functions.keys import frame_fingerprint

    a, b, c = (spark.createDataFrame([x], "p string, q string") for x in (("a|b", "c"), ("a", "b|c"), ("a\\", "|b|c")))
    assert len({frame_fingerprint(x, "p", "q").first() for x in (a, b, c)}) == 3


def test_cutoffs_on_grid_points(spark):
    """Probabilities right at, under and over points of the grid."""
    rows = [("g", float(p), True) for i in range(201) for p in (i / 200, np.nextafter(i / 200, 0), np.nextafter(i / 200, 1))]
    df = spark.createDataFrame(rows, "g string, p double, wrong boolean")
    for target in (0.0, 0.1, 0.5):
        want = next((i / 200 for i in range(201) if sum(p >= i / 200 for _, p, _ in rows) / len(rows) <= target), 1.0)
        assert metrics.choose_cutoff(df, "g", "p", F.col("wrong"), target).first()["cutoff"] == want
