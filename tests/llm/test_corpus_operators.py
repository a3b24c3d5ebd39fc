"""Near-dedup, line dedup, mixing, search, HTML, classifier and the pipeline."""

import html
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanlab.llm import common, components, cotraining, html_extract, line_dedup, minhash_dedup, mixing, topk_search
from tests.llm.fixtures import documents, empty, row, save, words

SPACES = r"[^\x20\x09-\x0D]+"


def shingle_set(text):
    w = re.findall(SPACES, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows, percent=85):
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def check_near(spark, df):
    got = minhash_dedup.near_duplicates(df).collect()
    want = brute_components([(r["doc_id"], r["text"]) for r in df.collect() if r["doc_id"] is not None])
    assert len(got) == df.count()
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])


def test_near_dedup_awkward_rows(spark):
    check_near(spark, documents(spark))
    assert minhash_dedup.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("edits", [1, 3])
def test_near_dedup_large_group(spark, edits, monkeypatch):
    """A group beyond the merged length, around a text that isn't its smallest id, with pairs on both sides of the threshold."""
    random.seed(edits)
    monkeypatch.setattr(minhash_dedup, "MERGED", 8)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 1500)
    base = words(90, 4).split()
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(random.randint(0, edits)):
            w[random.randrange(90)] = f"x{random.randrange(12)}"
        rows.append((i, " ".join(w)))
    check_near(spark, spark.createDataFrame(rows, "doc_id long, text string"))


def similar(base, edits):
    """``base`` with a word in every tenth place changed, ``edits`` times: each takes five shingles."""
    w = base.split()
    for k in range(edits):
        w[10 + 10 * k] = f"edit{k}"
    return " ".join(w)


def test_near_dedup_percent(spark):
    """The pipeline's stage links from 80 % on and op1 from 85 %; pairs under 80 % stay in both."""
    base = [words(204, 50 + i) for i in range(3)]
    rows = [(10 * i + k, t) for i, edits in enumerate((2, 4, 5)) for k, t in enumerate((base[i], similar(base[i], edits)))]
    shares = [len(a & b) / len(a | b) for a, b in ((shingle_set(t), shingle_set(u)) for (_, t), (_, u) in zip(rows[::2], rows[1::2]))]
    assert shares[0] > 0.85 > shares[1] > 0.8 > shares[2]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in minhash_dedup.near_duplicates(df).where("kept").collect()) == [0, 10, 11, 20, 21]
    assert sorted(r["doc_id"] for r in corpus_pipeline.near(spark, df, "").collect()) == [0, 10, 20, 21]


def test_near_dedup_large_group_percent(spark, monkeypatch):
    """Members of a skipped list on both sides of 80 % against brute force."""
    random.seed(8)
    monkeypatch.setattr(minhash_dedup, "MERGED", 8)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 1500)
    base = words(90, 4).split()
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(random.randint(0, 4)):
            w[random.randrange(90)] = f"x{random.randrange(12)}"
        rows.append((i, " ".join(w)))
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80).collect()
    want = brute_components(rows, 80)
    assert want != brute_components(rows) and all((r["n_shingles"], r["component_id"]) == want[r["doc_id"]] for r in got) and len(got) == 60


def test_near_dedup_repeated_ids(spark):
    """Texts that share an id are documents of their own; equal rows are one; every row gets the smallest id that its text reaches."""
    a, b, c = words(80, 21), words(80, 22), words(80, 23)
    rows = [(5, a), (5, b), (7, b + " more"), (9, a), (9, a), (3, c), (5, c), (8, None), (8, a)]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash"))).collect())
    n = len(shingle_set(a))
    assert got == sorted([(5, n, 5, True), (5, n, 5, True), (7, n + 1, 5, False), (9, n, 5, False), (9, n, 5, False), (3, n, 3, True), (5, n, 3, False), (8, 0, 8, True), (8, n, 5, False)])


def test_near_dedup_hot_copies(spark, monkeypatch):
    """A third of all rows are copies of one text, and keys are dealt to salts."""
    monkeypatch.setattr(common, "HOT", 4)
    monkeypatch.setattr(minhash_dedup, "MERGED", 4)
    monkeypatch.setattr(minhash_dedup, "ROWS", 8)
    base = words(90, 4)
    rows = [(i, base) for i in range(20)] + [(20 + i, similar(base, i % 4)) for i in range(12)] + [(40 + i, words(70, 300 + i)) for i in range(20)]
    check_near(spark, spark.createDataFrame(rows, "doc_id long, text string"))


def test_components(spark):
    random.seed(5)
    pairs = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    assert got == {x: find(x) for p in pairs if p[0] != p[1] for x in p}


def test_line_dedup(spark):
    docs = documents(spark)
    got = line_dedup.line_dedup(docs, into="line").select("doc_id", "text", "line.*", "n_words").collect()
    assert len(got) == docs.count() and all(r["n_words"] == -1 for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    notice = "shared notice line"
    assert notice in by[11][0]["text"] and all(notice not in by[100 + i][0]["text"] and by[100 + i][0]["n_removed"] == 1 for i in range(6))
    assert by[1][0]["n_removed"] == 0 and by[5][0]["text"] is None and by[6][0]["text"] == "" and not by[7][0]["left"]
    assert all(r["n_removed"] == 0 for r in by[13]) and by[None][0]["n_removed"] == 0
    assert line_dedup.line_dedup(empty(spark)).count() == 0


def test_line_dedup_frequent_line(spark, monkeypatch):
    """A line with a third of all places is dealt to salts and still keeps its first place alone; one on a single site stays everywhere."""
    monkeypatch.setattr(common, "HOT", 4)
    monkeypatch.setattr(line_dedup, "FREQUENT", 5)
    rows = [(i, f"a line of all sites\nown words number {i} here\none site says this" if i % 2 == 0 else f"a line of all sites\nother words number {i} here", f"s{i % 2 * (i % 7 + 1)}") for i in range(60)]
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")).select("doc_id", "text", "lines.*").collect()}
    assert got[0]["text"] == rows[0][1] and all(got[i]["text"] == rows[i][1].split("\n", 1)[1] and got[i]["n_removed"] == 1 and got[i]["removed_words"] == 5 for i in range(1, 60))


def brute_targets(sizes):
    """Share the excess again and again, as the contract words it."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, budget = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values())
    open_ = set(names)
    while budget > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in list(open_):
            target[s] += budget * weight[s] / total
        budget = 0.0
        for s in list(open_):
            if target[s] >= 2 * sizes[s]:
                budget += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def test_mixing(spark):
    docs = documents(spark)
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(5)).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == docs.count()
    texts = docs.select("doc_id", "text", "source").collect()
    sizes = defaultdict(int)
    for r in texts:
        sizes[r["source"]] += len(re.findall(SPACES, r["text"] or ""))
    want = brute_targets(sizes)
    source = {r["doc_id"]: r["source"] for r in texts}
    taken, longest = defaultdict(int), defaultdict(int)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and math.isclose(r["target"], want[s], rel_tol=1e-9, abs_tol=1e-6)
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
        longest[s] = max(longest[s], r["size"])
    assert all(abs(taken[s] - want[s]) <= longest[s] for s in sizes)
    assert mixing.mix(empty(spark)).count() == 0


def test_fit_counts_reaches_the_budget():
    random.seed(2)
    for _ in range(200):
        sizes = sorted(random.sample(range(1, 400), random.randint(1, 12)))
        counts = [random.randint(1, 6) for _ in sizes]
        budget = random.randint(0, sum(s * n for s, n in zip(sizes, counts)))
        take = mixing.fit_counts(sizes, counts, budget)
        used = sum(s * n for s, n in zip(sizes, take))
        assert all(0 <= t <= c for t, c in zip(take, counts)) and 0 <= budget - used <= max(sizes)


@pytest.mark.parametrize(("largest", "most"), [(60, 4), (5000, 3), (300_000, 2)])
def test_fit_counts_equals_an_exhaustive_subset_sum(largest, most):
    """Small and large sizes, few and many copies: no choice of documents comes nearer."""
    assert mixing.fit_counts([60_000, 130_000, 130_001], [1, 1, 1], 260_001) == [0, 1, 1] and mixing.fit_counts([400_000, 1_000_000], [1, 3], 1_500_000) == [1, 1]
    random.seed(largest)
    for _ in range(150):
        sizes = sorted(random.sample(range(1, largest), random.randint(1, 8)))
        counts = [random.randint(0, most) for _ in sizes]
        budget = random.randint(0, sum(s * n for s, n in zip(sizes, counts)))
        sums = {0}
        for s, n in zip(sizes, counts):
            sums = {x + k * s for x in sums for k in range(n + 1)}
        take = mixing.fit_counts(sizes, counts, budget)
        assert all(0 <= t <= c for t, c in zip(take, counts))
        assert sum(s * t for s, t in zip(sizes, take)) == max(x for x in sums if x <= budget)


def test_fit_counts_many_sizes():
    """Even sizes and an odd budget: every size is offered, and one word stays over."""
    sizes = list(range(2, 40_000, 2))
    take = mixing.fit_counts(sizes, [1] * len(sizes), 30_000_001)
    assert 30_000_001 - sum(s * t for s, t in zip(sizes, take)) == 1


def brute_search(docs, queries, k=10):
    bags = {i: Counter(topk_search.words_of(t)) for i, t in docs}
    n, df = len(bags), Counter(w for b in bags.values() for w in b)
    mean = sum(sum(b.values()) for b in bags.values()) / max(1, n)
    out = {}
    for q, t in queries:
        scores = []
        for i, b in bags.items():
            s = sum(c * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * sum(b.values()) / mean)) for w, c in Counter(topk_search.words_of(t)).items() if w in b)
            if s > 0:
                scores.append((-round(s, 6), i))
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


@pytest.mark.parametrize("first, few, dense", [(1, 1.0, 1 / 16), (2, 0.0, 1 / 16), (4, 0.1, 1 / 16), (2, 0.1, 2), (1, 0.3, 0)])
def test_shard_equals_full_scoring(first, few, dense, monkeypatch):
    """Pruning by blocks and pivots against scores of every document, with copies, ties and queries of one and many terms."""
    monkeypatch.setattr(topk_search, "DENSE", dense)
    monkeypatch.setattr(topk_search, "FIRST", first)
    monkeypatch.setattr(topk_search, "FEW", few)
    rng = random.Random(first)
    shard, bags = topk_search.Shard(20.0), {}
    for i in range(700):
        bags[i] = Counter(min(int(rng.expovariate(0.05)), 400) for _ in range(rng.randint(0, 40))) if i % 7 else Counter({i % 3: 2, 5: 1})
        terms = np.array(sorted(bags[i]), np.int64)
        shard.add(i, sum(bags[i].values()), terms.tobytes(), np.array([bags[i][t] for t in terms], np.uint16).tobytes())
    shard.close()
    for _ in range(60):
        terms = rng.sample(range(450), rng.randint(1, 120))
        weights = {t: rng.choice([0.01, 0.5, 3.0, 9.0]) * rng.random() for t in terms}
        want = sorted((-round(s, 6), i) for i, b in bags.items() for s in [sum(w * b[t] * 2.2 / (b[t] + 1.2 * (0.25 + 0.75 * sum(b.values()) / 20.0)) for t, w in weights.items() if t in b)] if s > 0)[:10]
        got = shard.search(np.array(list(weights), np.int64), np.array(list(weights.values())), 10)
        assert [i for i, _ in got] == [i for _, i in want] and np.allclose([s for _, s in got], [-s for s, _ in want], atol=2e-6)


@pytest.mark.parametrize("dense, room, run", [(1 / 16, 10**7, 10**6), (2, 10**7, 500), (0, 10**7, 10**6), (1 / 16, 5000, 500)])
def test_batches_equal_full_scoring(dense, room, run, monkeypatch):
    """A batch against several shards and scores of every document: copies, ties, counts over 16 bits, terms that no document has, and a shard without documents."""
    for name, value in (("DENSE", dense), ("ROOM", room), ("RUN", run), ("BATCH", 7), ("FEW_TERMS", 3)):
        monkeypatch.setattr(topk_search, name, value)
    rng = random.Random(room)
    bags = {i: Counter(min(int(rng.expovariate(0.05)), 400) for _ in range(rng.randint(0, 40))) if i % 7 else Counter({i % 3: 2, 5: 1}) for i in range(900)}
    bags[11][5] = 70_000
    weights = [{t: rng.choice([0.01, 0.5, 3.0, 9.0]) * rng.random() for t in rng.sample(range(450), rng.randint(1, 120) if i % 5 else 2)} for i in range(40)] + [{1000: 1.0}]
    asked = topk_search.Asked(10)
    for i, w in enumerate(weights):
        asked.add(i, -i, np.array(list(w), np.int64).tobytes(), np.array(list(w.values())).tobytes())
    for part in ([i for i in bags if i % 3 == 1], [], [i for i in bags if i % 3 == 0], [i for i in bags if i % 3 == 2]):
        shard = topk_search.Shard(20.0)
        for i in part:
            terms, counts = np.array(sorted(bags[i]), np.int64), np.array([bags[i][t] for t in sorted(bags[i])])
            shard.add(i, sum(bags[i].values()), terms.tobytes(), counts.astype(np.uint16 if counts.max(initial=0) < 65536 else np.int32).tobytes())
        asked.ask(shard)
    got = defaultdict(list)
    for row in (r for b in asked.best() for r in b.to_pylist()):
        assert row["said"] == -row["query_id"]
        got[row["query_id"]].append((row["doc_id"], row["score"]))
    for q, w in enumerate(weights):
        want = sorted((-round(s, 6), i) for i, b in bags.items() for s in [sum(x * b[t] * 2.2 / (b[t] + 1.2 * (0.25 + 0.75 * sum(b.values()) / 20.0)) for t, x in w.items() if t in b)] if s > 0)[:10]
        assert [i for i, _ in got[q]] == [i for _, i in want] and np.allclose([s for _, s in got[q]], [-s for s, _ in want], atol=2e-6)


def test_queries_are_copied_once_for_several_shards(spark, monkeypatch):
    """Queries are copied to lots of several shards, not to each shard, and meet every document."""
    docs = spark.createDataFrame([(i, words(30 + i % 40, i % 25)) for i in range(300)], "doc_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    postings = sum(len(set(topk_search.words_of(t))) for _, t in rows)
    copies, queries = [], topk_search._queries
    monkeypatch.setattr(topk_search, "_queries", lambda asked, df, n, lots: copies.append(lots) or queries(asked, df, n, lots))
    got = defaultdict(list)
    for r in topk_search.search(docs, docs.where("doc_id % 9 = 0"), shard_size=postings // 60).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["doc_id"], r["score"]))
    assert copies[0] <= 60 / 4 + 1
    for q, hits in brute_search(rows, [(i, t) for i, t in rows if i % 9 == 0]).items():
        assert [i for i, _ in got[q]] == [i for i, _ in hits] and np.allclose([s for _, s in got[q]], [s for _, s in hits], atol=2e-6)


def test_search_awkward_rows(spark):
    """Rows without an id count nowhere; texts under one id are queries of their own, and equal rows are one query and several documents."""
    docs = spark.createDataFrame([(1, "a b c", 0), (1, "a b c", 0), (1, "d e", 0), (None, "a a a", 0), (2, "a", 0), (3, None, 0), (4, "x " * 70_000 + "a", 0)], "doc_id long, text string, score int")
    got = topk_search.search(docs, docs.where("doc_id <> 4")).orderBy("query_id", "rank", "doc_id").collect()
    want = brute_search([(i, t) for i, (d, t) in enumerate([(1, "a b c"), (1, "a b c"), (1, "d e"), (2, "a"), (3, ""), (4, "x " * 70_000 + "a")])], [(0, "a b c"), (2, "d e"), (3, "a")])
    ids = [1, 1, 1, 2, 3, 4]
    got, want = sorted((r["query_id"], r["doc_id"], r["score"]) for r in got), sorted((ids[q], ids[i], s) for q, hits in want.items() for i, s in hits)
    assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want], atol=2e-6)


def test_topk_search(spark):
    docs = documents(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select("doc_id", "text")
    more = spark.createDataFrame([(1000 + i, words(30 + i % 40, i % 25)) for i in range(300)], "doc_id long, text string")
    docs = docs.unionByName(more)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = defaultdict(list)
    for r in topk_search.search(docs, docs.where("doc_id % 5 = 0"), shard_size=500).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["doc_id"], r["score"]))
    want = brute_search(rows, [(i, t) for i, t in rows if i % 5 == 0])
    assert set(got) == {q for q, hits in want.items() if hits}
    for q, hits in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in hits] and np.allclose([s for _, s in got[q]], [s for _, s in hits], atol=2e-6)
    assert topk_search.search(docs.limit(0), docs.limit(0)).count() == 0


PAGE = "<html><head><title>t</title><style>p{}</style></head><body><div class='top-menu'><a href=/>Home</a></div>{body}<div id=footer>&copy; all</div></body></html>"


def test_html_pages(spark):
    article = lambda x: PAGE.replace("{body}", f"<article><h1>Head {x}</h1><p>One &amp; <b>two</b> {x}<p>last<br>line<aside>see also</aside><div class='comments'><p>nice</p></div></article>")
    plain = lambda x: PAGE.replace("{body}", f"<div><span>Site of things</span></div><div class=content><p>Own text {x}</p><script>no()</script></div><div>Read our shop offers</div>")
    rows = [(1, "http://a.org/x/1", article(1)), (2, "http://a.org/x/2", article(2)), (3, "https://www.b.org/p/1", plain(1)), (4, "https://b.org/p/2", plain(2)), (5, None, None), (6, "http://c.org/", ""), (7, "http://d.org/1", "<p>Only <i>one</i>\n page"), (7, "http://d.org/1", "<p>Only <i>one</i>\n page"), (None, "http://e.org", "<article>x</article>")]
    got = defaultdict(list)
    for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect():
        got[r["page_id"]].append(r)
    assert got[1][0]["text"] == "Head 1 One & two 1 last line" and got[2][0]["text"] == "Head 2 One & two 2 last line"
    assert got[3][0]["text"] == "Own text 1" and got[4][0]["text"] == "Own text 2"
    assert got[5][0]["text"] == "" and got[6][0]["n_chars"] == 0 and len(got[7]) == 2 and got[None][0]["text"] == "x"
    assert all(r["n_chars"] == len(r["text"]) for rs in got.values() for r in rs)
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_differences_decide_outside_an_article(spark):
    """Text beside a small article stays unless the neighbour has it too; an advert goes by its markup and a quoted text stays in the article."""
    body = "<div>Site of things</div><article><h2>Teaser {x}</h2><p>Quoted</p></article><div class=ad>New advert {x}</div><div><p>Main text {x}</p><p>Second part {x}</p></div><section>Read our shop offers</section>"
    rows = [(i, f"http://a.org/x/{i}", PAGE.replace("{body}", body.replace("{x}", str(i)))) for i in (1, 2)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Teaser {i} Quoted Main text {i} Second part {i}" for i in (1, 2)}


def test_html_pairs_do_not_depend_on_ranges(spark, monkeypatch):
    rows = [(i, f"http://a.org/s{i // 9}/{i}", f"<body><div>top {i // 9}</div><p>own {i}</p><div>sold by {i // 27}</div>") for i in range(120)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = []
    for n in (1, 3, 16):
        monkeypatch.setattr(html_extract, "partitions", lambda _s, n=n: n)
        found.append(sorted((r["page_id"], r["text"]) for r in html_extract.extract(df).collect()))
    assert found[0] == found[1] == found[2] and found[0][5] == (5, "own 5")


ARTICLE = "<article><p>Share this</p><h2 id='search-results'>Results {x}</h2><p id=share-prices>Share prices fell {x}</p><div class='post-header'><h1>Title {x}</h1></div><p class=notice>Note {x}</p><math><mi>y</mi></math><object>chart {x}</object><p>Quoted</p><p>own {x}</p><div class='comment-list'><p>nice {x}</p></div><div>Read on</div></article>"


def test_html_templates_inside_articles(spark):
    """Lines at an article's ends that all four nearest pages have go; quoted lines between own ones, ids of headings and names of a post stay."""
    rows = [(i, f"http://a.org/x/{i}", PAGE.replace("{body}", ARTICLE.replace("{x}", str(i)))) for i in range(6)]
    rows += [(10 + i, f"http://b.org/x/{i}", PAGE.replace("{body}", ARTICLE.replace("{x}", str(i)))) for i in range(2)]
    rows += [(20 + i, f"http://c.org/x/{i}", PAGE.replace("{body}", ARTICLE.replace("{x}", "0"))) for i in range(6)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    own = lambda x: f"Results {x} Share prices fell {x} Title {x} Note {x} y chart {x} Quoted own {x}"
    assert [got[i] for i in (2, 3)] == [own(2), own(3)]
    whole = lambda x: f"Share this {own(x)} Read on"
    assert got[0] == whole(0) and got[11] == whole(1), "too few pages on both sides tell nothing"
    assert {got[20 + i] for i in range(6)} == {whole(0)}, "copies of one article protect it"


def brute_article(page):
    """The article of a page of the given tables: what stands between its tags, cut at blocks."""
    inner = re.search(r"<article>(.*?)</article>", page or "", re.DOTALL)
    cut = re.split(r"</?(?:p|h1|div|ul|li)\b[^>]*>", inner[1] if inner else "")
    return " ".join(t for t in (" ".join(html.unescape(re.sub("<[^>]*>", "", re.sub("<br[^>]*>", " ", x))).split()) for x in cut) if t)


def test_html_query_matches_brute_force(spark):
    d = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    got = html_extract.op6_html_extract(spark, d).collect()
    assert len(got) == len(pages) and all(r["text"] == brute_article(pages[r["page_id"]]["html"]) and r["url"] == pages[r["page_id"]]["url"] for r in got)


def test_html_broken_tags():
    lines = lambda page: [t for z, t in html_extract.page_lines(page) if z != html_extract.DROPPED]
    assert lines('<article><p class="a"">Hello</p><p title=\'it\'s\'>you</p><input value=">">x</article>') == ["Hello", "you", "x"]
    assert lines('<p>1 < 2 <a href="x>never</p><p>closed</p>') == ["1 < 2 never", "closed"]
    assert lines('<script>if(a<b)"</scripts>"</script >z<b a=c/>y<!-- > -->x<p') == ["zyx"] and lines("a <b c=") == ["a"]
    assert lines("<article><p>x</p><p class='ad'>Buy</p><a class=sponsored href=/>now</a><p class='notice' id='ad'>y</p></article>") == ["x", "y"]
    rng = random.Random(3)
    for _ in range(300):
        told = lines("".join(rng.choice(["<p", "<a", "</p", ">", '"', "'", "=", " ", "w", "/", "class", "</", "<!--", "-->", "<b>"]) for _ in range(60)) + '"\'-->>done')
        assert not any(re.search("</?[pab]", t) for t in told)


@pytest.mark.parametrize("piece", ["<a ", "<div>", "</p>", "<p><b>", "<a b='", "<script></script ", "<svg></svg ", "<!--", "<a x" + " " * 50, "&", "<a =\"'"])
def test_html_pages_take_linear_time(piece):
    """A megabyte of broken markup; a quadratic scan takes hours."""
    begun = time.monotonic()
    html_extract.page_lines("<div>" * 20_000 + "<b>" + piece * (1_000_000 // len(piece)) + "</p>" * 20_000)
    assert time.monotonic() - begun < 20


def test_html_long_pages(spark):
    lines = [f"<p>line {i % 97}</p>" for i in range(20_000)]
    rows = [(i, f"http://a.org/{i}", "".join(lines) + f"<p>own {i}</p>") for i in range(2)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: "own 0", 1: "own 1"}


@pytest.mark.parametrize("kept", [2, 256])
def test_lcs(kept, monkeypatch):
    monkeypatch.setattr(html_extract, "KEPT_ROWS", kept)
    random.seed(1)
    for _ in range(300):
        a, b = [[random.randrange(5) for _ in range(random.randrange(12))] for _ in range(2)]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        kept = sorted(html_extract.lcs_shared(a, b))
        assert len(kept) == table[-1][-1] == len(set(kept))
        rest = iter(b)
        assert all(any(a[i] == y for y in rest) for i in kept)


def test_cotraining_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    fit = labels.where("doc_id % 3 > 0")
    told = cotraining.score_documents(docs, cotraining.train(docs, fit)).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    assert len(told) > 50 and sum(r["kept"] == (r["quality"] == 1) for r in told) / len(told) > 0.9


def test_cotraining_sees_content(spark):
    """Texts alike in every statistic and in their metadata, told apart by their words; the native score equals the one from the matrix."""
    rng = random.Random(6)
    pools = ["alpha beta gamma delta sigma".split(), "kappa theta omega lamda zetas".split()]
    rows = [(i, " ".join(rng.choice(pools[i % 2]) for _ in range(40)), "en", "s", 200, "clash") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, label string")
    model = cotraining.train(docs, spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int"))
    told = cotraining.score_documents(docs, model).where("doc_id >= 300").collect()
    assert len(told) == 300 and sum(r["kept"] == (r["doc_id"] % 2 == 1) for r in told) > 285


def test_cotraining_cuts_and_pseudo_labels():
    """Cuts by histogram against a sort; what a row was given does not change later, and each view teaches the other."""
    rng = np.random.default_rng(5)
    x = rng.normal(0, 6, (5000, 2))
    counts = np.bincount(cotraining._bins(x[:, 0]), minlength=cotraining.BINS)
    high, low = cotraining.cuts(counts, 250)
    bins = cotraining._bins(x[:, 0])
    by_sort = np.sort(bins)
    assert high == by_sort[-250] and low == by_sort[249] and (cotraining.sigmoid(x[bins >= high, 0]) >= cotraining.SURE).all()
    weak_high, weak_low = cotraining.cuts(np.bincount(cotraining._bins(x[:, 0] / 20), minlength=cotraining.BINS), 250)
    assert not ((cotraining._bins(x[:, 0] / 20) >= weak_high) | (cotraining._bins(x[:, 0] / 20) <= weak_low)).any()
    views, w = [x[:, :1], x[:, 1:]], np.array([1.0, 0.0])
    first = cotraining.Round([w, w], [high, high], [low, low])
    given = cotraining.pseudo_labels(views, [first])
    assert (given[1][bins >= high] == 1).all() and (given[1][bins <= low] == 0).all() and (given[1] >= 0).sum() == ((bins >= high) | (bins <= low)).sum()
    later = cotraining.pseudo_labels(views, [first, cotraining.Round([-w, -w], [high, high], [low, low])])
    assert all((b[a >= 0] == a[a >= 0]).all() for a, b in zip(given, later))


def test_cotraining_mends_a_view(spark):
    """Words of one half of the vocabulary carry no label in text; the metadata view teaches the text view what they mean, from rows all over the table."""
    rng = random.Random(8)
    seen = ["alpha beta gamma".split(), "kappa theta omega".split()]
    other = ["stone river cloud".split(), "plane metal glass".split()]
    rows = [(i, " ".join(rng.choice((seen if i < 200 else other)[i % 2]) for _ in range(40)), ("en", "fr")[i % 2], "s", 200) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    right = {}
    for rounds in (0, 3):
        told = cotraining.score_documents(docs, cotraining.train(docs, labels, rounds=rounds)).where("doc_id >= 200").collect()
        right[rounds] = sum((r["text_score"] >= 0.5) == (r["doc_id"] % 2 == 1) for r in told) / len(told)
    assert right[3] > 0.95 and right[3] >= right[0]
    model = cotraining.train(docs, labels)
    ways = [{r["doc_id"]: r["score"] for r in f.collect()} for f in (cotraining.score_documents(docs, model), cotraining.score_views(cotraining.views(docs), model))]
    assert ways[0].keys() == ways[1].keys() and all(abs(ways[0][i] - ways[1][i]) < 1e-3 for i in ways[0])


def test_cotraining_awkward_rows(spark):
    docs = documents(spark).withColumn("label", F.lit("clash"))
    assert cotraining.train(docs.limit(0), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")) is None
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert cotraining.train(docs, none) is None
    assert {r["score"] for r in cotraining.score_documents(docs, None).collect()} == {1.0}
    model = cotraining.train(docs, spark.createDataFrame([(i, i % 2) for i in (1, 2, 3, 4, 8, 9, 10, 11, 14, 15, 16, *range(100, 106))] + [(1, None), (2, 7)], "doc_id long, quality int"))
    scored = cotraining.score_documents(docs, model).collect()
    assert len(scored) == docs.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert cotraining.score_documents(docs.limit(0), model).count() == 0


def test_stages_with_helper_names_as_columns(spark):
    """Columns called like the helpers, null ids and extra columns together: same rows, and the columns keep their values."""
    docs = documents(spark)
    names = ["__id", "__HASH", "__gone", "__places", "__q", "__l", "__text", "__row", "__proof", "__times", "__n"]
    extra = docs.withColumns({c: F.concat(F.lit(c), F.coalesce("source", F.lit("?"))) for c in names})
    told = lambda df: sorted(map(repr, df.select(docs.columns).collect()))
    for stage in (corpus_pipeline.quality, corpus_pipeline.lines, corpus_pipeline.near):
        after = stage(spark, extra, "")
        assert after.columns == extra.columns and told(after) == told(stage(spark, docs, ""))
        assert after.where(F.col("__id") != F.concat(F.lit("__id"), F.coalesce("source", F.lit("?")))).count() == 0
    mixed = corpus_pipeline.mixture(spark, extra, "")
    assert mixed.columns == extra.columns and mixed.where(~F.col("__n").startswith("__n")).count() == 0
    check_mixture(docs.collect(), mixed.select(docs.columns).collect())


def test_line_dedup_of_many_lines(spark):
    """A text of 40,000 lines of which 20,000 go."""
    shared = [f"shared notice number {i} here" for i in range(20_000)]
    long = "\n".join(x for i, s in enumerate(shared) for x in (s, f"own{i}"))
    rows = [(1, "\n".join(shared), "a"), *((2 + i, "\n".join(shared), s) for i, s in enumerate("bcd")), (9, long, "e")]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("doc_id = 9").first()
    assert got["text"] == "\n".join(f"own{i}" for i in range(20_000)) and got["lines"]["n_removed"] == 20_000


def check_mixture(before, after):
    """Whole rows, each up to twice, and every source near its target by brute force: within its longest document."""
    count = lambda r: len(re.findall(SPACES, r["text"] or ""))
    sizes, taken, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in before:
        sizes[r["source"]] += count(r)
        longest[r["source"]] = max(longest[r["source"]], count(r))
    for r in after:
        taken[r["source"]] += count(r)
    held, stand = Counter(map(tuple, before)), Counter(map(tuple, after))
    assert all(n <= 2 * held[r] for r, n in stand.items())
    for s, target in brute_targets(sizes).items():
        assert 0 <= target - taken[s] + 0.5 and target - taken[s] <= longest[s]


def test_mixture_of_awkward_rows(spark):
    """Rows without an id, several texts under one id and equal rows each have a place of their own."""
    rows = [row(None, words(20 + i, i), source="a") for i in range(6)] + [row(7, words(30 + i, 40 + i), source="b") for i in range(6)] + [row(8, words(25, 90), source="c")] * 4 + [row(9, None), row(10, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long, taken boolean, c long, d string, e string")
    after = corpus_pipeline.mixture(spark, docs, "").collect()
    check_mixture(docs.collect(), after)
    assert Counter(map(tuple, after)) == Counter(map(tuple, corpus_pipeline.mixture(spark, docs.repartition(7), "").collect()))
    assert {r["source"] for r in after} == {"a", "b", "c"} and corpus_pipeline.mixture(spark, docs.limit(0), "").count() == 0


def test_pipeline(spark, tmp_path):
    """Stage by stage against brute force on a small corpus."""
    plain = "It was the first of many days on which the river rose and nobody in the town had thought of what to do about it until then. "
    rows = [row(i, plain + words(60, i), source=f"s{i % 4}", n_chars=1) for i in range(30)]
    rows += [row(50, plain + words(60, 7).replace("dolor", "dolour", 1), source="s9"), row(51, "### " * 50), row(52, None), row(None, plain + words(60, 99))]
    rows += [row(60 + i, plain + words(50, 60 + i) + "\na notice that stands on all of the sites of this network for all to see", source=f"t{i}") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, a long, b boolean, c long, d string, e string").select("doc_id", "text", "lang", "source", "n_chars")
    d = save(docs, tmp_path, "documents")
    seen, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, d).persist()
        seen[name] = now.collect()
        if name != "bpe":
            assert now.columns == docs.columns
    ids = lambda n: [r["doc_id"] for r in seen[n]]
    assert sorted(map(str, ids("quality_rules"))) == sorted(map(str, [*range(30), 50, None, *range(60, 65)]))
    assert sorted(map(str, ids("line_dedup"))) == sorted(map(str, ids("quality_rules")))
    assert sum("a notice that stands" in r["text"] for r in seen["line_dedup"]) == 1
    want = brute_components([(r["doc_id"], r["text"]) for r in seen["line_dedup"] if r["doc_id"] is not None])
    assert sorted(map(str, ids("near_dedup"))) == sorted(map(str, [None, *[i for i, (_, c) in want.items() if i == c]]))
    times = Counter(ids("mixing"))
    assert set(times.values()) <= {1, 2} and set(times) <= set(ids("near_dedup"))
    check_mixture(seen["near_dedup"], seen["mixing"])
    assert Counter(ids("bpe")) == times
    assert Counter(map(tuple, corpus_pipeline.run(spark, d).collect())) == Counter(map(tuple, seen["bpe"]))
