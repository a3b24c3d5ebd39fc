"""Exact top-k search by BM25: an inverted index per shard, batches of long queries, block-max WAND pruning for short ones, merged by global statistics.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased; a query's word counts as often as
the query has it. Documents are dealt to lots by hashed id, one lot a task, as many as their postings ask for, and a lot is cut into shards. Each lot gets a copy of the
queries, which its task keeps in a file and asks shard by shard; the k-th score so far goes on to the next shard. A shard keeps, for each term, its postings in
document order with their impacts. A frequent term has a cell for each document instead, and its largest impact in each block of BLOCK documents.

The bounds of a query of many terms stay far above its k-th score, so all documents are scored for it, for a batch of queries at once: frequent terms by one product of
matrices in single precision, the others posting by posting. Documents as near to the k-th score as that product can be wrong are scored again in double precision.

A query of up to FEW_TERMS terms visits blocks in the order of their bounds (the sum of its terms' block maxima) until that falls under the k-th score so far, in growing
groups, so that numpy does the work. In a block, terms stand in an order (short lists first, then frequent terms by bound), and a document goes on behind a term only
where its score so far and the block maxima of the terms left reach the k-th score: where they don't, those terms are the ones behind its pivot.

Scores are rounded to six decimals; ties go to the smaller doc_id. Inverse document frequencies and the mean length are global,
so merging the shards' k best gives the k best of all.

A null or empty text matches nothing and, as a query, finds nothing. Rows with a null doc_id are no documents: they count nowhere. Equal rows are documents
of their own, and one query; texts that share an id are queries of their own under that id. Other columns are not read; empty tables give an empty result.
"""

from __future__ import annotations

import math
import pickle
import tempfile
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanlab.llm.common import read_table, saved
from spanlab.llm.license_scan import words_of

K1, B = 1.2, 0.75
TOP = 10
#: Postings of a shard, shards of a lot, and the least number of lots. A shard sorts its postings in runs of RUN.
SHARD, LOT, LOTS, RUN = 5_000_000, 5, 12, 1_000_000
#: Most documents of a shard, whose places have 16 bits.
PLACES = 1 << 16
#: Queries of a batch. Up to so many terms, a query goes by bounds.
BATCH, FEW_TERMS = 128, 4
#: Terms of this share of a shard's documents or more have a cell for every document, the most frequent ones where there is no room for all.
DENSE, ROOM = 1 / 16, 9_000_000
#: Documents of a block, and blocks that are scored first; eight times as many come with each step.
BLOCK, FIRST = 64, 4
#: Places among a query's frequent terms where documents are given up, and the share of documents from which on the others are scored one by one.
CHECKS, FEW = 6, 0.1
#: Scores this far under the k-th one still count as equal to it, as scores are rounded.
SLACK = 2e-6
EVERY = 100
#: Words whose hashes a worker keeps at once.
KEPT = 100_000


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= KEPT:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word) - (1 << 63)
        return found


_hashes = _Hashes()


def term_counts(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of a text's terms, ascending, their counts, and the number of words."""
    words = words_of(text)
    counts = Counter(words)
    terms = np.array([_hashes[w] for w in counts], np.int64)
    order = np.argsort(terms)
    return terms[order], np.array(list(counts.values()), np.int32)[order], len(words)


def _vectors(docs: DataFrame) -> DataFrame:
    """id, words, terms and counts (as bytes) of every document."""

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"]):
                terms, counts, n = term_counts(text)
                rows.append((doc_id, n, terms.tobytes(), counts.astype(np.uint16).tobytes() if n < 65536 else counts.tobytes()))
            yield pd.DataFrame(rows, columns=["id", "words", "terms", "weights"])

    return docs.mapInPandas(vectors, "id long, words long, terms binary, weights binary")


def _frequencies(vectors: DataFrame) -> DataFrame:
    """(term, df): documents of each term, summed inside a task before anything is shuffled."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        size = 0

        def out() -> pd.DataFrame:
            terms, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pd.DataFrame({"term": terms, "df": n})

        for b in batches:
            for blob in b["terms"]:
                held.append(np.frombuffer(blob, np.int64))
                size += len(held[-1])
                if size > 4_000_000:
                    yield out()
                    size = 0
        if held:
            yield out()

    return vectors.select("terms").mapInPandas(counted, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def _queries(queries: DataFrame, df: DataFrame, n_docs: int, lots: int) -> DataFrame:
    """Query vectors with the weight (idf times count) of each term, one copy for each lot. Those with the same most frequent term stand together."""

    def exploded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for query_id, said, text in zip(b["doc_id"], b["said"], b["text"]):
                terms, counts, _ = term_counts(text)
                yield pd.DataFrame({"query_id": query_id, "said": said, "term": terms, "n": counts.astype("int64")})

    terms = queries.withColumn("said", F.xxhash64("text")).mapInPandas(exploded, "query_id long, said long, term long, n long")
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = terms.join(df, "term").select("query_id", "said", "term", "df", F.struct((F.col("n") * idf).alias("w"), "term").alias("t"))
    grouped = weighed.groupBy("query_id", "said").agg(F.sort_array(F.collect_set("t"), asc=False).alias("ts"), F.max_by("term", "df").alias("place"))

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({
                "id": b["query_id"],
                "words": b["said"],
                "place": b["place"],
                "terms": [np.array(list(x), np.int64).tobytes() for x in b["terms"]],
                "weights": [np.array(list(x), np.float64).tobytes() for x in b["weights"]],
            })

    flat = grouped.select("query_id", "said", "place", F.col("ts.term").alias("terms"), F.col("ts.w").alias("weights"))
    blobs = flat.mapInPandas(packed, "id long, words long, place long, terms binary, weights binary")
    return blobs.select(F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("lot"), F.lit(0).alias("kind"), "place", "id", "words", "terms", "weights")


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each of the ranges, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


class Shard:
    """The inverted index of one shard. Add documents, then ``close`` and ``search`` or ``search_long``."""

    def __init__(self, mean_words: float):
        self.mean, self.size = mean_words, 0
        self.ids, self.words = [], []
        self.terms, self.counts, self.lengths, self.runs = [], [], [], []

    def full(self, size: float) -> bool:
        return self.size >= size or len(self.ids) == PLACES

    def add(self, doc_id: int, words: int, terms: bytes, counts: bytes) -> None:
        found = np.frombuffer(terms, np.int64)
        self.ids.append(doc_id)
        self.words.append(words)
        self.terms.append(found)
        self.counts.append(np.frombuffer(counts, np.uint16 if memoryview(counts).nbytes == 2 * len(found) else np.int32))
        self.lengths.append(len(found))
        self.size += len(found)
        if self.size >= RUN * (len(self.runs) + 1):
            self._fold()

    def _fold(self) -> None:
        """Put the postings that came last in the order of terms: terms, their numbers of postings, documents, counts."""
        terms = np.concatenate([np.zeros(0, np.int64), *self.terms])
        docs = np.repeat(np.arange(len(self.ids) - len(self.lengths), len(self.ids), dtype=np.uint16), self.lengths)
        order = np.argsort(terms, kind="stable")
        terms, docs, counts = terms[order], docs[order], np.concatenate([np.zeros(0, np.uint16), *self.counts])[order]
        starts = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])) if len(terms) else np.zeros(0, np.int64)
        self.runs.append((terms[starts], np.diff(np.append(starts, len(terms))), docs, counts))
        self.terms, self.counts, self.lengths = [], [], []

    def close(self) -> None:
        """Build the index. Each array goes as soon as the next is made, since this is where a shard is largest."""
        self._fold()
        self.n, self.doc_ids = len(self.ids), np.array(self.ids, np.int64)
        self.blocks = -(-self.n // BLOCK)
        self.norm = np.ones(self.blocks * BLOCK)
        self.norm[: self.n] = K1 * (1 - B + B * np.array(self.words, np.float64) / max(self.mean, 1e-9))
        self.known = np.unique(np.concatenate([terms for terms, *_ in self.runs]))
        sizes = np.zeros(len(self.known), np.int64)
        for terms, many, *_ in self.runs:
            sizes[np.searchsorted(self.known, terms)] += many
        at = np.cumsum(sizes) - sizes
        docs, tf = np.empty(self.size, np.uint16), np.empty(self.size, np.result_type(*(counts for *_, counts in self.runs)))
        for terms, many, run_docs, run_counts in self.runs:
            code = np.searchsorted(self.known, terms)
            to = _spread(at[code], many)
            docs[to], tf[to] = run_docs, run_counts
            at[code] += many
        del self.runs, self.terms, self.counts, self.lengths, self.ids, self.words
        # Frequent terms have a cell for every document, the others postings.
        often = sizes >= max(DENSE * self.n, BLOCK)
        if (most := ROOM // max(1, self.blocks * BLOCK)) < np.count_nonzero(often):
            often = np.isin(np.arange(len(sizes)), np.argsort(-sizes, kind="stable")[:most])
        self.row = np.where(often, np.cumsum(often) - 1, -1).astype(np.int32)
        dense = np.repeat(often, sizes)
        row, doc, count = np.repeat(self.row[often], sizes[often]), docs[dense], tf[dense]
        self.docs, tf = docs[~dense], tf[~dense]
        del docs, dense
        self.impacts = self._impact(tf, self.docs)
        del tf
        self.tf = np.zeros((np.count_nonzero(often), self.blocks * BLOCK), count.dtype)
        self.tf[row, doc] = count
        self.cells = np.zeros(self.tf.shape, np.float32)
        self.cells[row, doc] = self._impact(count, doc)
        del row, doc, count
        # Bounds may be coarse but not too low, so they are rounded up.
        most = self.cells.reshape(len(self.cells), self.blocks, BLOCK).max(axis=2)
        self.cells_most = np.where(most > 0, np.nextafter(most, np.float32(np.inf)), np.float32(0))
        self.first = np.append(0, np.cumsum(np.where(often, 0, sizes)))
        self.most = np.zeros(len(self.known))
        if len(self.impacts):
            self.most[~often] = np.maximum.reduceat(self.impacts, self.first[:-1][~often])
        if len(self.cells):
            self.most[often] = self.cells_most.max(axis=1)

    def _impact(self, tf: np.ndarray, docs: np.ndarray) -> np.ndarray:
        out = self.norm[docs]
        out += tf
        np.divide(tf, out, out=out)
        out *= K1 + 1
        return out

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, least: float = -np.inf) -> list[tuple[int, float]]:
        """The k best documents and their scores; some of those under ``least`` may be missing."""
        if not len(terms) or not len(self.known):
            return []
        at = np.minimum(np.searchsorted(self.known, terms), len(self.known) - 1)
        here = self.known[at] == terms
        at, weights = at[here], weights[here]
        if not len(at):
            return []
        order = np.argsort(-weights * self.most[at], kind="stable")
        at, weights = at[order], weights[order]
        often, rare = np.flatnonzero(self.row[at] >= 0), np.flatnonzero(self.row[at] < 0)
        rows, often_weights = self.row[at[often]], weights[often]
        often_bound = self.cells_most[rows] * often_weights[:, None]
        # Documents and scores of the other terms' postings, and the best of each term in each block.
        counts = self.first[at[rare] + 1] - self.first[at[rare]]
        posting, term = _spread(self.first[at[rare]], counts), np.repeat(np.arange(len(rare)), counts)
        doc, score = self.docs[posting].astype(np.int64), self.impacts[posting] * weights[rare][term]
        block = doc // BLOCK
        starts = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (block[1:] != block[:-1]))) if len(doc) else np.zeros(0, np.int64)
        whole = np.bincount(block[starts], np.maximum.reduceat(score, starts) if len(doc) else None, minlength=self.blocks) + often_bound.sum(axis=0)
        ranked = np.argsort(-whole, kind="stable")[: np.count_nonzero(whole)]
        docs, scores = np.zeros(0, np.int64), np.zeros(0)
        done, step = 0, FIRST
        while done < len(ranked) and whole[ranked[done]] >= least - SLACK:
            taken = ranked[done : done + step]
            taken = np.sort(taken[whole[taken] >= least - SLACK])
            done, step = done + step, 8 * step
            slot = np.full(self.blocks, -1)
            slot[taken] = np.arange(len(taken))
            here = slot[block] >= 0
            cell = slot[block[here]] * BLOCK + doc[here] % BLOCK
            more_docs, more_scores, least = self._score(rows, often_weights, often_bound[:, taken], taken, cell, score[here], scores, least, k)
            docs, scores = np.append(docs, more_docs), np.append(scores, more_scores)
            good = scores >= least - SLACK
            docs, scores = docs[good], scores[good]
        told = np.round(scores, 6)
        best = np.lexsort((self.doc_ids[docs], -told))[:k]
        return [(int(self.doc_ids[docs[i]]), float(told[i])) for i in best]

    def _score(self, rows, weights, bound, taken, cell, cell_scores, scores, least, k) -> tuple[np.ndarray, np.ndarray, float]:
        """Documents of the blocks ``taken`` that can still be hits, their scores, and the k-th score known now.

        Short lists of a block are read whole, frequent terms in the order of their bounds. In between, a document goes on only where its score and the block maxima of
        the terms left reach the k-th score; what is scored so far may raise that, as it is a lower bound.
        """
        part = np.bincount(cell, cell_scores, minlength=len(taken) * BLOCK).astype(float).reshape(-1, BLOCK)
        rest = np.append(bound, np.zeros((1, len(taken))), axis=0)[::-1].cumsum(axis=0)[::-1]
        stride, i = max(1, -(-len(rows) // CHECKS)), 0
        while True:
            known = np.append(scores, part)
            if len(known) >= k:
                least = max(least, np.partition(known, len(known) - k)[len(known) - k])
            alive = part + rest[i][:, None] >= least - SLACK
            if i == len(rows) or np.count_nonzero(alive) < FEW * alive.size:
                break
            on = alive.any(axis=1)
            if not on.all():
                part, taken, rest = part[on], taken[on], rest[:, on]
            docs = taken[:, None] * BLOCK + np.arange(BLOCK)
            for row, weight in zip(rows[i : i + stride], weights[i : i + stride]):
                part += self._impact(self.tf[row, docs], docs) * weight
            i = min(i + stride, len(rows))
        slot, place = np.nonzero(alive)
        docs = taken[slot] * BLOCK + place
        found = part[slot, place] + self._dense_scores(rows[i:], weights[i:], docs)
        hit = found > 0
        least = max(least, np.partition(known, len(known) - k)[len(known) - k]) if len(known := np.append(scores, found)) >= k else least
        return docs[hit], found[hit], least

    def _dense_scores(self, rows: np.ndarray, weights: np.ndarray, docs: np.ndarray) -> np.ndarray:
        return weights @ self._impact(self.tf[rows[:, None], docs], np.broadcast_to(docs, (len(rows), len(docs))))

    def search_long(self, terms: np.ndarray, code: np.ndarray, weights: np.ndarray, ends: np.ndarray, k: int, least: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Place, doc_ids and scores of all that can be among the k best, for a batch of queries of so many terms that bounds spare them nothing.

        ``terms`` are those of the batch, ascending; a query has ``terms[code]`` up to its end. All documents are scored: by one product of matrices in single precision for
        frequent terms, by postings for the others. Those that come as near to the k-th score as such a product can be wrong get their exact scores.
        """
        if not len(terms) or not len(self.known):
            return
        at = np.minimum(np.searchsorted(self.known, terms), len(self.known) - 1)
        at = np.where(self.known[at] == terms, at, -1)[code]
        row = np.where(at >= 0, self.row[at], -1)
        often, rare = row >= 0, (at >= 0) & (row < 0)
        query = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        used, column = np.unique(row[often], return_inverse=True)
        matrix = np.zeros((len(ends), len(used)), np.float32)
        matrix[query[often], column] = weights[often]
        dense = matrix @ (self.cells if len(used) == len(self.cells) else self.cells[used])
        wrong = np.bincount(query[often], weights[often] * self.most[at[often]], minlength=len(ends)) * (len(used) + 8) * 2.0**-24 + SLACK
        for q, (begin, end) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
            some = rare[begin:end]
            sparse = self._sparse_scores(at[begin:end][some], weights[begin:end][some])
            whole = sparse + dense[q]
            near = np.flatnonzero(whole > max(least[q] - wrong[q], 0.0))
            if len(near) > 4 * k:
                kth = np.partition(whole[near], len(near) - k)[len(near) - k]
                near = near[whole[near] >= kth - 2 * wrong[q]]
            if len(near):
                some = often[begin:end]
                yield q, self.doc_ids[near], sparse[near] + self._dense_scores(row[begin:end][some], weights[begin:end][some], near)

    def _sparse_scores(self, at: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Scores of every document by the postings of the terms ``at``. Lists are joined as bytes, since numpy takes longer for each of them."""
        starts, ends = self.first[at], self.first[at + 1]
        lists = list(map(slice, starts.tolist(), ends.tolist()))
        docs, impacts = (np.frombuffer(b"".join(map(memoryview(x).__getitem__, lists)), x.dtype) for x in (self.docs, self.impacts))
        return np.bincount(docs, impacts * np.repeat(weights, ends - starts), minlength=self.blocks * BLOCK)


class Asked:
    """The queries of a lot, in a file of the task's own, and what is best for each so far."""

    def __init__(self, k: int):
        self.k, self.file, self.batches = k, tempfile.TemporaryFile(), 0
        self.query_ids, self.said, self.held = [], [], ([], [])
        self.scores, self.doc_ids = np.zeros((0, k)), np.zeros((0, k), np.int64)

    def add(self, query_id: int, said: int, terms: bytes, weights: bytes) -> None:
        terms, weights = np.frombuffer(terms, np.int64), np.frombuffer(weights, np.float64)
        held = self.held[len(terms) > FEW_TERMS]
        held.append((len(self.query_ids), terms, weights))
        self.query_ids.append(query_id)
        self.said.append(said)
        if len(held) == BATCH:
            self._write(held)

    def _write(self, held: list) -> None:
        places, terms, weights = zip(*held)
        known, code = np.unique(np.concatenate(terms), return_inverse=True)
        pickle.dump((np.array(places), known, code.astype(np.int32), np.concatenate(weights), np.cumsum([len(x) for x in terms])), self.file, protocol=5)
        self.batches += 1
        held.clear()

    def ask(self, shard: Shard) -> None:
        """Close a shard and ask it all queries."""
        for held in self.held:
            if held:
                self._write(held)
        more = len(self.query_ids) - len(self.scores)
        self.scores = np.append(self.scores, np.full((more, self.k), -np.inf), axis=0)
        self.doc_ids = np.append(self.doc_ids, np.zeros((more, self.k), np.int64), axis=0)
        shard.close()
        self.file.seek(0)
        for _ in range(self.batches):
            places, terms, code, weights, ends = pickle.load(self.file)
            if ends[0] > FEW_TERMS:
                for q, docs, scores in shard.search_long(terms, code, weights, ends, self.k, self.scores[places, -1]):
                    self._keep(places[q], docs, np.round(scores, 6))
                continue
            for place, begin, end in zip(places, [0, *ends[:-1]], ends):
                if found := shard.search(terms[code[begin:end]], weights[begin:end], self.k, self.scores[place, -1]):
                    self._keep(place, *map(np.array, zip(*found)))

    def _keep(self, place: int, docs: np.ndarray, scores: np.ndarray) -> None:
        good = scores >= self.scores[place, -1]
        if good.any():
            docs, scores = np.append(self.doc_ids[place], docs[good]), np.append(self.scores[place], scores[good])
            best = np.lexsort((docs, -scores))[: self.k]
            self.doc_ids[place], self.scores[place] = docs[best], scores[best]

    def best(self) -> Iterator[pa.RecordBatch]:
        query_ids, said = np.array(self.query_ids, np.int64), np.array(self.said, np.int64)
        for begin in range(0, len(self.scores), 10_000):
            place, i = np.nonzero(self.scores[begin : begin + 10_000] > -np.inf)
            place += begin
            found = {"query_id": query_ids[place], "said": said[place], "doc_id": self.doc_ids[place, i], "score": self.scores[place, i]}
            yield pa.RecordBatch.from_pydict({name: pa.array(x) for name, x in found.items()})


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """kind, id, words, terms and weights of each row, the last two as views."""
    numbers = zip(*(batch.column(x).to_pylist() for x in ("kind", "id", "words")))
    for row, *blobs in zip(numbers, batch.column("terms"), batch.column("weights")):
        yield *row, *(x.as_buffer() for x in blobs)


def search(docs: DataFrame, queries: DataFrame, k: int = TOP, shard_size: int = SHARD) -> DataFrame:
    """query_id, rank, doc_id and score: the k best rows of ``docs`` (doc_id, text) for each row of ``queries``."""
    named = lambda x: x.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    vectors = saved(_vectors(named(docs)), "vectors")
    one = vectors.agg(F.count("*").alias("n"), F.avg("words").alias("mean"), F.sum(F.length("terms") / 8).alias("postings")).first()
    postings, mean = one["postings"] or 0, float(one["mean"] or 0.0)
    lots = max(LOTS, math.ceil(postings / (LOT * shard_size)))
    # Shards of a lot are of one size; lots differ a little.
    size = 1.05 * postings / lots / max(1, math.ceil(postings / lots / shard_size))
    dealt = vectors.select(F.pmod(F.xxhash64("id"), F.lit(lots)).cast("int").alias("lot"), F.lit(1).alias("kind"), F.col("id").alias("place"), "*")
    rows = dealt.unionByName(_queries(named(queries), _frequencies(vectors), one["n"], lots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, shard = Asked(k), Shard(mean)
        for kind, *row in chain.from_iterable(map(_rows, batches)):
            if kind == 0:
                asked.add(*row)
                continue
            shard.add(*row)
            if shard.full(size):
                asked.ask(shard)
                shard = Shard(mean)
        asked.ask(shard)
        yield from asked.best()

    hits = rows.repartitionById(lots, "lot").sortWithinPartitions("kind", "place", "id").mapInArrow(run, "query_id long, said long, doc_id long, score double")
    best = W.partitionBy("query_id", "said").orderBy(F.col("score").desc(), "doc_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return search(docs, docs.where(F.col("doc_id") % EVERY == 0))
