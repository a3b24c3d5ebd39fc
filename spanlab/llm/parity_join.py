"""Jaccard join of texts on word shingles by parity sketches.

A document's set holds its distinct 5-word shingles (A-Z lower-cased, words cut at white space); with fewer words, the whole sequence as one. Null or empty texts
have an empty set and no links. Two documents link when 100 * intersection >= percent * union, on 64-bit shingle hashes.

1. Equal sets fold into one class, a node of its own; all that follows is between classes.
2. Size bands are powers of two. A pair belongs to the band of its smaller set, so a set stands in its own band, and in the one below if a smaller partner can
   come from there.
3. In a band a set is a sketch of blocks of 2**16 bits, and each shingle flips one bit. Shingles that both sets hold flip the same bits, so the Hamming distance of two sketches is at most the
   symmetric difference, which is at most (a + b) * (100 - percent) / (100 + percent) for linked sets of a and b shingles. Call that bound, for the largest partner, t.
   Pigeonhole: a set with more than t blocks that hold bits agrees with each partner in all of them but t, so two sets that put their blocks in one order (those with most bits
   first) meet in the first t + 1. Those are posted, each as a hash of its bits. Bands have so many blocks that a set with fewer than t + 1 in use has a probability below 1e-13.
4. Lists of up to MERGED are merged into pairs. Longer ones are skipped: each gets a hub, its member in most such lists, and all members are compared with that one.
   Members that stay outside the hub's component are compared with the others on full sets, by their rarest shingles, so no component falls apart.
5. Pairs whose folded sketches (two bits a shingle and more) differ in more bits than a link allows are dropped; the rest is verified on full sets, and components come from
   rounds of joins.

Keys, classes and hubs that hold many rows are dealt to salts or blocks. Rows with a null doc_id are linked with nothing. Equal rows are one class; texts that share an
id are documents of their own, each under the smallest id that it reaches. Texts are taken whole, however long; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlab.llm.common import discard, hot_keys, read_table, salted_join, saved
from spanlab.llm.components import components
from spanlab.llm.minhash_dedup import _alike, _apart, _confirmed, _finish, _full_sets, shingles

PERCENT = 80
#: Longest list that is merged into pairs.
MERGED = 32
#: Members that a piece of a longer list holds, about.
PIECE = 1000
#: Bits of a block, as a power of two.
BLOCK_BITS = 16
_BLOCK, _FOLD = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def blocks_of_band(band: int) -> int:
    """Blocks of a sketch for sets of 2**band up to 2**(band + 1) - 1 shingles: so many that few are empty, and so few that most hold several bits."""
    top = 2 << band
    if top <= 32:
        return 1 << 16
    return top if top <= 64 else top // 2 if top <= 512 else top * 5 // 16


def most_apart(a: int, b: int, percent: int) -> int:
    """The largest symmetric difference of linked sets of ``a`` and ``b`` shingles."""
    return (a + b) * (100 - percent) // (100 + percent)


def block_keys(found: np.ndarray, band: int, t: int) -> np.ndarray:
    """The first ``t + 1`` blocks in use of a set's sketch, as hashes of their bits."""
    h = _finish(found * _BLOCK)
    block = ((h >> np.uint64(32)) * np.uint64(blocks_of_band(band))) >> np.uint64(32)
    bits, times = np.unique((block << np.uint64(BLOCK_BITS)) | (h & np.uint64((1 << BLOCK_BITS) - 1)), return_counts=True)
    bits = bits[times % 2 == 1]
    if not len(bits):
        return np.empty(0, np.uint64)
    at = np.flatnonzero(np.r_[True, bits[1:] >> np.uint64(BLOCK_BITS) != bits[:-1] >> np.uint64(BLOCK_BITS)])
    value = _finish(np.bitwise_xor.reduceat(_finish(bits * _FOLD + np.uint64(1)), at) + np.uint64(band))
    order = np.lexsort((value, -np.diff(np.r_[at, len(bits)])))
    return value[order[: t + 1]]


def keys(found: np.ndarray, percent: int) -> np.ndarray:
    """What a set is posted under: blocks of its own band, and of the one below where a smaller partner can stand there."""
    n = len(found)
    if not n:
        return np.empty(0, np.uint64)
    band = n.bit_length() - 1
    out = [block_keys(found, band, most_apart(n, 100 * n // percent, percent))]
    below = (1 << band) - 1
    if band and 100 * below >= percent * n:
        out.append(block_keys(found, band - 1, most_apart(n, below, percent)))
    return np.concatenate(out)


def folded(found: np.ndarray) -> np.ndarray:
    """The parity sketch for verification: 4 * 2**band bits in 64-bit words, so that a larger one folds onto a smaller by the XOR of its halves."""
    width = max(64, 4 << max(len(found).bit_length() - 1, 0))
    at = _finish(found * _FOLD) & np.uint64(width - 1)
    odd = np.bincount(at.astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def hamming(a: str, b: str) -> Column:
    """Bits in which two folded sketches differ, the larger one folded once if they differ in size."""
    x, y = F.col(a), F.col(b)
    half = lambda s: F.zip_with(F.slice(s, 1, F.greatest(F.floor(F.size(s) / 2), F.lit(1))), F.slice(s, F.floor(F.size(s) / 2) + 1, F.greatest(F.floor(F.size(s) / 2), F.lit(1))), lambda p, q: p.bitwiseXOR(q))
    x, y = F.when(F.size(x) > F.size(y), half(x)).otherwise(x), F.when(F.size(y) > F.size(x), half(y)).otherwise(y)
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)


def _signed(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, n (size of the set), same (equal for equal sets), keys and sketch of every row."""

    @F.pandas_udf("n long, same binary, keys array<long>, sketch array<long>")
    def signed(texts: pd.Series) -> pd.DataFrame:
        import xxhash

        sets = [shingles(t) for t in texts]
        return pd.DataFrame({
            "n": [len(s) for s in sets], "same": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
            "keys": [keys(s, percent).view(np.int64) for s in sets], "sketch": [folded(s) for s in sets],
        })

    return docs.select("doc_id", signed("text").alias("s")).select("doc_id", "s.*")


def _near(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sketches allow a link."""
    sketches = classes.select("node", "n", "sketch")
    both = pairs.join(sketches.toDF("a", "na", "sa"), "a").join(sketches.toDF("b", "nb", "sb"), "b")
    return both.where((100 + percent) * hamming("sa", "sb") <= (100 - percent) * (F.col("na") + F.col("nb"))).select("a", "b")


def _long_lists(skipped: DataFrame) -> DataFrame:
    """(key, nodes, best): lists in pieces of about PIECE members, each with its member that stands in most long lists, by their lengths.

    A member carries its keys, no more than its text has, so neither a list nor its members are joined row by row.
    """
    standing = skipped.groupBy("node", "n").agg(F.sum("c").alias("standing"), F.collect_list(F.struct("key", "c")).alias("keys"))
    rows = standing.select("node", "n", "standing", F.explode("keys").alias("k"))
    piece = F.pmod(F.xxhash64("node"), F.ceil(F.col("k.c") / PIECE)).alias("piece")
    best = F.max(F.struct("standing", (-F.col("node")).alias("order"), "n")).alias("best")
    return saved(rows.groupBy(F.col("k.key").alias("key"), piece).agg(F.collect_list(F.struct("node", "n")).alias("nodes"), best).drop("piece"), "lists")


def jaccard_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of (doc_id, text); documents link from ``percent`` on."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = saved(_signed(docs, percent), "signed")
    filled = signed.where("n > 0 AND doc_id IS NOT NULL")
    one = F.first(F.struct("n", "keys", "sketch")).alias("one")
    folded_sets = filled.groupBy("same").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), one).select("same", "doc_id", "copies", "one.*")
    classes = saved(folded_sets.withColumn("node", F.monotonically_increasing_id()), "classes")
    size = classes.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0)).alias("posts"), F.coalesce(F.sum("copies"), F.lit(0)).alias("rows")).first()
    posts = classes.select(F.explode("keys").alias("key"), "node", F.col("n").cast("int").alias("n"))
    counted = saved(posts.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "counted")
    hot = hot_keys(counted, ["key"], "c", size["posts"])
    posted = saved(salted_join(posts, counted, ["key"], hot, ["node"]), "posted")

    short = posted.where(F.col("c") <= MERGED)
    a, b = (short.select("key", F.col("node").alias(x), F.col("n").alias(f"n{x}")) for x in "ab")
    met = a.join(b, "key").where((F.col("a") < F.col("b")) & _alike("na", "nb", percent)).select("a", "b")
    lists = _long_lists(posted.where(F.col("c") > MERGED))
    hubs = lists.groupBy("key").agg(F.max("best").alias("best"))
    listed = lists.drop("best").join(hubs, "key").select(F.col("best.n").alias("hub_n"), (-F.col("best.order")).alias("hub"), F.explode("nodes").alias("m"))
    members = saved(listed.select("hub", "hub_n", "m.node", "m.n").distinct(), "members")
    stars = members.where(F.col("hub") != F.col("node")).where(_alike("n", "hub_n", percent)).select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"))
    pairs = saved(_near(met.unionByName(stars).distinct(), classes, percent), "pairs")
    discard(counted)
    discard(posted)

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(members.select("node")).distinct()
    wanted = classes.select("node", "doc_id", "same").join(wanted.hint("merge"), "node", "left_semi")
    sets = saved(_full_sets(docs.join(wanted.hint("merge"), "doc_id").select("node", "same", "text")).dropDuplicates(["node"]), "sets")
    links = saved(_confirmed(pairs, sets, percent), "confirmed")
    labels = components(links)
    more = saved(_apart(members, sets, labels, percent), "apart")
    if not more.isEmpty():
        discard(labels)
        labels = components(links.unionByName(more))
    labelled = classes.select("same", "doc_id", "copies", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    roots = labelled.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    told = saved(labelled.join(roots, "label").select("same", "copies", "component_id"), "told")
    for old in (lists, members, pairs, sets, links, more, labels, classes):
        discard(old)
    often = hot_keys(told, ["same"], "copies", size["rows"])
    joined = salted_join(filled.select("doc_id", "n", "same"), told.drop("copies"), ["same"], often, ["doc_id"]).select("doc_id", "n", "component_id")
    alone = signed.where("n = 0 OR doc_id IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return joined.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"))
