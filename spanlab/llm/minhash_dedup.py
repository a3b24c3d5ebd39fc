"""MinHash near-dedup by a signature-coordinate inverted join.

A document's set holds its distinct 5-word shingles (A-Z lower-cased, words cut at white space); with fewer words, the
whole sequence as one. Null or empty texts have an empty set and no links. Documents link when
100 * intersection >= percent * union, confirmed on full sets (64-bit shingle hashes); percent is 85 where the caller names none.

1. Equal sets fold into one class, a node of its own.
2. Every class gets a signature of 32 coordinates, each mixed from 4 minima. A pair that collides in MATCHES of them does so in any 32 - MATCHES + 1, so
   it is posted under that many coordinate-value pairs, the prefix; of the others only 16 bits each go along. A pair at
   85 % has fewer than MATCHES collisions with a probability of 3.5e-8 (1.2e-5 at 80 %): without a skipped list it is missed then.
3. Prefix and skip merging: lists of one are dropped, lists of up to MERGED are merged, and pairs with enough collisions, those outside the prefix
   included, become candidates. Longer lists are skipped; each gets a hub, its member with most collisions, and all
   members are compared with that one. One collision is enough for documents of skipped lists.
4. Candidates are confirmed and joined to components. Where a hub's members are still apart, those outside its
   component are compared on full sets with all other members, in blocks, so no link is lost: a member's rarest shingles in a block find whom it
   can link with at all, and one link to a component is enough.

Keys, classes and hubs that hold many rows are dealt to salts or blocks. Rows with a null doc_id are linked with nothing and stay. Equal rows are one document
and stay or go together; texts that share an id are documents of their own, each under the smallest id that it reaches. An empty table gives an
empty result; texts are taken whole, however long; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlab.llm.common import discard, hot_keys, read_table, salted_join, saved
from spanlab.llm.components import components

SHINGLE = 5
PERCENT = 85
COORDINATES, WIDTH = 32, 4
#: Longest list that is merged into pairs.
MERGED = 32
#: Collisions that make a candidate.
MATCHES = 3
#: Coordinates that are posted: whoever collides in MATCHES of all collides in one of these.
PREFIX = COORDINATES - MATCHES + 1
#: Shingles and members on each side of a block of the exact comparison.
BLOCK, ROWS = 1 << 20, 256

_MIX = np.random.default_rng(20240229).integers(1, 2**63, (2, COORDINATES * WIDTH), dtype=np.uint64)
_A, _B = (_MIX[0] | np.uint64(1))[:, None], _MIX[1][:, None]
_PLACES = [np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) & 0xFFFFFFFFFFFFFFFF | 1) for k in range(SHINGLE)]


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    known = {w: xxhash.xxh3_64_intdigest(w) for w in set(words)}
    h = np.fromiter((known[w] for w in words), np.uint64, len(words))
    n = len(words) - SHINGLE + 1
    total = np.zeros(n, np.uint64)
    for k, place in enumerate(_PLACES):
        total = _finish(total + h[k : k + n] * place)
    return np.unique(total)


def signature(found: np.ndarray) -> np.ndarray:
    """COORDINATES signed 64-bit values, each mixed from WIDTH minima."""
    least = np.full(COORDINATES * WIDTH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 1024):
        np.minimum(least, (found[None, at : at + 1024] * _A + _B).min(axis=1), out=least)
    out = np.zeros(COORDINATES, np.uint64)
    for column in least.reshape(COORDINATES, WIDTH).T:
        out = _finish(out * np.uint64(3) + column)
    return out.view(np.int64)


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n (size of the set), same (equal for equal sets) and sig of every row."""

    @F.pandas_udf("n long, same binary, sig binary")
    def signed(texts: pd.Series) -> pd.DataFrame:
        import xxhash

        rows = [(len(s), xxhash.xxh3_128_digest(s.tobytes()), signature(s).tobytes()) for s in map(shingles, texts)]
        return pd.DataFrame(rows, columns=["n", "same", "sig"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), signed("text").alias("s")).select("doc_id", "text_hash", "s.*")


def _full_sets(texts: DataFrame) -> DataFrame:
    """node and shingles of (node, same, text), for the rows whose text has that set."""

    def full(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for b in batches:
            sets = [shingles(t) for t in b["text"]]
            own = [xxhash.xxh3_128_digest(s.tobytes()) == same for s, same in zip(sets, b["same"])]
            yield pd.DataFrame({"node": b["node"][own], "shingles": [s.view(np.int64) for s, x in zip(sets, own) if x]})

    return texts.mapInPandas(full, "node long, shingles array<long>")


def _posts(classes: DataFrame) -> DataFrame:
    """(key, node, n, held): a class under each coordinate-value pair of its prefix, with 16 bits of each other coordinate."""
    value = lambda i: F.substring(F.col("sig"), i * 8 + 1, F.lit(8))
    key = F.explode(F.transform(F.sequence(F.lit(0), F.lit(PREFIX - 1)), lambda i: F.xxhash64(i, value(i)))).alias("key")
    held = F.lit(0).cast("long")
    for i in range(PREFIX, COORDINATES):
        held = held * 65536 + F.pmod(F.hash(value(i)), F.lit(65536))
    return classes.select("node", "n", held.alias("held"), key).select("key", "node", "n", "held")


def _held_alike(a: str, b: str):
    """How many of the coordinates outside the prefix seem equal, by their 16 bits."""
    bits = lambda c, k: F.shiftright(F.col(c), 16 * k).bitwiseAND(F.lit(65535))
    return sum(((bits(a, k) == bits(b, k)).cast("int") for k in range(COORDINATES - PREFIX)), F.lit(0))


def _alike(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("both"))
    return both.where(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def _apart(members: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links between members of a hub that no link found so far joins, for those outside the hub's component."""
    sizes = members.groupBy("hub").agg(F.count("*").alias("c"))
    hot = hot_keys(sizes, ["hub"], "c", members.count())
    own = sizes.select("hub").join(labels.toDF("hub", "hub_label"), "hub", "left").withColumn("hub_label", F.coalesce("hub_label", "hub"))
    labelled = members.join(labels, "node", "left").select("hub", "node", "n", F.coalesce("label", "node").alias("label"))
    labelled = salted_join(labelled, own, ["hub"], hot, ["node"])
    outside = F.col("label") != F.col("hub_label")
    parts = lambda rows, words: F.greatest(F.ceil(rows / ROWS), F.ceil(words / BLOCK)).cast("int")
    told = labelled.groupBy("hub").agg(F.count("*").alias("rows"), F.sum("n").alias("words"), F.count_if(outside).alias("asks"), F.sum(F.when(outside, F.col("n"))).alias("asked"))
    told = told.where("asks > 0").select("hub", parts(F.col("asks"), F.col("asked")).alias("xs"), parts(F.col("rows"), F.col("words")).alias("ys"))
    rows = salted_join(labelled, told, ["hub"], hot, ["node"]).withColumn("h", F.xxhash64("node"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda n: F.pmod("h", F.col(n)).cast("int")
    asking = rows.where(outside).select("hub", place("xs").alias("x"), every("ys").alias("y"), "node", "label", F.lit(1).alias("asks"))
    asked = rows.select("hub", every("xs").alias("x"), place("ys").alias("y"), "node", "label", F.lit(0).alias("asks"))
    dealt = asking.unionByName(asked).join(sets, "node")

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        ask, has = g[g["asks"] == 1], g[g["asks"] == 0]
        found = []
        if len(ask) and len(has):
            held = has["shingles"].to_list()
            sizes = np.array([len(s) for s in held])
            tokens, owner = np.concatenate(held), np.repeat(np.arange(len(has)), sizes)
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            ids, label = has["node"].to_numpy(), has["label"].to_numpy()
            for node, mine, s in zip(ask["node"], ask["label"], ask["shingles"]):
                # Whoever links with s shares percent of it, so one at least of any others; its rarest here have the shortest lists.
                lo, hi = np.searchsorted(tokens, s, "left"), np.searchsorted(tokens, s, "right")
                rare = np.argsort(hi - lo, kind="stable")[: len(s) - -(-percent * len(s) // 100) + 1]
                near = np.unique(np.concatenate([owner[lo[k] : hi[k]] for k in rare]))
                near = near[(label[near] != mine) & (100 * np.minimum(sizes[near], len(s)) >= percent * np.maximum(sizes[near], len(s)))]
                linked = set()
                for k in near:
                    if label[k] not in linked:
                        both = len(np.intersect1d(s, held[k], assume_unique=True))
                        if 100 * both >= percent * (sizes[k] + len(s) - both):
                            linked.add(label[k])
                            found.append((node, ids[k]))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return dealt.groupBy("hub", "x", "y").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and text_hash (xxhash64) for each row of (doc_id, text); documents link from ``percent`` on."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = saved(_signed(docs), "signed")
    filled = signed.where("n > 0 AND doc_id IS NOT NULL")
    folded = filled.groupBy("same").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.max("sig").alias("sig"), F.count("*").alias("copies"))
    classes = saved(folded.withColumn("node", F.monotonically_increasing_id()), "classes")
    size = classes.agg(F.count("*").alias("classes"), F.coalesce(F.sum("copies"), F.lit(0)).alias("rows")).first()
    posts = _posts(classes)
    counted = saved(posts.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "counted")
    hot = hot_keys(counted, ["key"], "c", size["classes"] * PREFIX)
    posted = saved(salted_join(posts, counted, ["key"], hot, ["node"]), "posted")

    short = posted.where(F.col("c") <= MERGED)
    a, b = (short.select("key", F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("held").alias(f"h{x}")) for x in "ab")
    met = a.join(b, "key").where((F.col("a") < F.col("b")) & _alike("na", "nb", percent)).groupBy("a", "b").agg(F.count("*").alias("matches"), F.first("ha").alias("ha"), F.first("hb").alias("hb"))
    met = met.select("a", "b", (F.col("matches") + _held_alike("ha", "hb")).alias("matches"))
    skipped = posted.where(F.col("c") > MERGED).select("key", "node", "n", "c")
    standing = skipped.groupBy("node").agg(F.sum("c").alias("standing"))
    few = met.where(F.col("matches") < MATCHES).join(standing.select(F.col("node").alias("a")), "a", "left_semi")
    hubs = skipped.join(standing, "node").groupBy("key").agg(F.max_by(F.struct("node", "n"), F.struct("standing", -F.col("node"))).alias("hub"))
    members = saved(salted_join(skipped.drop("c"), hubs, ["key"], hot, ["node"]).select("hub.node", "hub.n", F.col("node").alias("m"), F.col("n").alias("mn")).toDF("hub", "hub_n", "node", "n").distinct(), "members")
    stars = members.where(F.col("hub") != F.col("node")).where(_alike("n", "hub_n", percent)).select(F.col("hub").alias("a"), F.col("node").alias("b"))
    pairs = saved(met.where(F.col("matches") >= MATCHES).unionByName(few).select("a", "b").unionByName(stars).distinct(), "pairs")

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(members.select("node")).distinct()
    # The list of wanted documents grows with the table, so it is never broadcast: one plan at every size.
    wanted = classes.select("node", "doc_id", "same").join(wanted.hint("merge"), "node", "left_semi")
    sets = saved(_full_sets(docs.join(wanted.hint("merge"), "doc_id").select("node", "same", "text")).dropDuplicates(["node"]), "sets")
    links = saved(_confirmed(pairs, sets, percent), "confirmed")
    labels = components(links)
    more = saved(_apart(members, sets, labels, percent), "apart")
    if not more.isEmpty():
        discard(labels)
        labels = components(links.unionByName(more))
    for old in (counted, posted, members, pairs, sets, links, more):
        discard(old)
    labelled = classes.select("same", "doc_id", "copies", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    roots = labelled.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    told = saved(labelled.join(roots, "label").select("same", "copies", "component_id"), "told")
    for old in (classes, labels):
        discard(old)
    often = hot_keys(told, ["same"], "copies", size["rows"])
    joined = salted_join(filled.select("doc_id", "text_hash", "n", "same"), told.drop("copies"), ["same"], often, ["doc_id"]).select("doc_id", "text_hash", "n", "component_id")
    alone = signed.where("n = 0 OR doc_id IS NULL").select("doc_id", "text_hash", "n", F.col("doc_id").alias("component_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return joined.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"), "text_hash")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents")).drop("text_hash")
