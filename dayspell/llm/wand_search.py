"""Exact top-k search: BM25 over an inverted index with block-max pruning, per shard, merged exactly.

Counts and document frequencies are global, so a score does not depend on the shard. Shards are packed where the documents
are read, a row each, and meet the queries where both are read; no query is copied through a shuffle. In a shard, long lists
are columns with a greatest impact per block of documents of like length. For a query, the short lists are scored whole; a
document that these and its block's greatest impacts leave below the k-th best score known is skipped, the others are
scored on the long lists, and only what still can enter the top k is scored in full in double precision. The k best carry
over from shard to shard, so each must beat those before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dayspell.llm.common import staged
from dayspell.llm.shingles import pieces, word_hashes

K1, B = 1.2, 0.75
BLOCK = 2  # documents per block of a posting list
LONG = 16  # a list that holds this part of a shard's documents is long
SEED = 64  # documents that give a first threshold
SLACK = 1e-4  # for sums in single precision; what they let through is scored in double precision
TINY = 1e-12  # below every score of a shared term
QUERIES, QUERY_TERMS = 2048, 1_000_000  # queries in a row, and their terms
TASK_QUERIES = 8192  # queries that a task takes past its shards
LEAST_GROUPS = 3  # groups of queries, so that a few thousand give every core a task
AT_ONCE = 256  # queries whose weights of long lists are held at a time
PARTS = ("ids", "lengths", "vocabulary", "sizes", "docs", "counts")
STREAMS = 8  # parts of the shards; a task streams one of them past its queries
#: Rows of some MB each: the writer looks at its buffers after every row.
FEW_ROWS = {"parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}
_ASCII = bytes(ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(128)) + bytes(range(128, 256))


def _plain(text: str | None) -> str:
    """ASCII letters lower-cased, other ASCII signs as blanks."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_ASCII).decode("utf-8", "surrogatepass")


def term_rows(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per text: its distinct terms (hashes, sorted) and how often each occurs."""
    for _, hashes, counts in word_hashes([_plain(t) for t in texts]):
        for part in np.split(hashes, np.cumsum(counts)[:-1]):
            yield np.unique(part.view(np.int64), return_counts=True)


def _shards(most: int):
    """Per task: posting lists of its documents, a row for up to `most` postings (one document at least)."""

    def packed(held: list[tuple[int, np.ndarray, np.ndarray]]) -> dict:
        held.sort(key=lambda d: int(d[2].sum()))  # documents of like length share a block, which keeps its maxima near its impacts
        ids = np.array([i for i, _, _ in held], dtype=np.int64)
        lengths = np.array([n.sum() for _, _, n in held], dtype=np.int64)
        terms, counts = np.concatenate([t for _, t, _ in held]), np.concatenate([n for _, _, n in held])
        order = np.argsort(terms, kind="stable")
        terms = terms[order]
        first = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]])
        vocabulary, sizes = terms[first], np.diff(np.r_[first, len(terms)])
        docs = np.repeat(np.arange(len(held)), [len(t) for _, t, _ in held])[order]
        row = {"ids": ids.tobytes(), "lengths": lengths.tobytes(), "vocabulary": vocabulary.tobytes(), "sizes": _small(sizes),
               "docs": _small(docs), "counts": _small(counts[order])}
        return {"shard": hashlib.blake2b(b"|".join(row.values()), digest_size=16).hexdigest(), **row}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in pieces(batches):
            for doc_id, (terms, counts) in zip(batch["doc_id"].tolist(), term_rows(batch["text"].tolist()), strict=True):
                if not len(terms):
                    continue
                if held and size + len(terms) > most:
                    yield pd.DataFrame([packed(held)])
                    held, size = [], 0
                held.append((doc_id, terms, counts.astype(np.uint32)))
                size += len(terms)
        if held:
            yield pd.DataFrame([packed(held)])

    return run


def _small(numbers: np.ndarray) -> bytes:
    """Numbers from 0 on, in as few bytes each as the greatest needs."""
    return numbers.astype(np.min_scalar_type(int(numbers.max(initial=0)))).tobytes()


def _packed(data: bytes, n: int) -> np.ndarray:
    """What `_small` packed, `n` numbers, in the bytes it took."""
    return np.frombuffer(data, dtype=f"u{max(1, len(data) // max(1, n))}")


def _wide(data: bytes, n: int) -> np.ndarray:
    return _packed(data, n).astype(np.int64)


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Document counts of the shards' terms."""
    for batch in batches:
        for terms, sizes in zip(batch["vocabulary"], batch["sizes"], strict=True):
            terms = np.frombuffer(terms, dtype=np.int64)
            yield pd.DataFrame({"term": terms, "n": _wide(sizes, len(terms))})


def _totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        lengths = [np.frombuffer(x, dtype=np.int64) for x in batch["lengths"]]
        yield pd.DataFrame({"docs": [len(x) for x in lengths], "words": [int(x.sum()) for x in lengths]})


def _terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in pieces(batches):
        own = [t for t, _ in term_rows(batch["text"].tolist())]
        yield pd.DataFrame({"query_id": np.repeat(batch["doc_id"].to_numpy(), [len(t) for t in own]),
                            "term": np.concatenate(own) if own else np.zeros(0, dtype=np.int64)})


class Shard:
    """Posting lists of some documents, by term and by document."""

    def __init__(self, row: dict[str, bytes], mean_length: float):
        ids, self.vocabulary = (np.frombuffer(row[c], dtype=np.int64) for c in ("ids", "vocabulary"))
        lengths = np.frombuffer(row["lengths"], dtype=np.int64).astype(np.float64)
        sizes = _wide(row["sizes"], len(self.vocabulary))
        postings = int(sizes.sum())
        # documents of like length share a block: block b holds the places b, b + blocks, ...; places left over stay empty
        blocks = -(-len(ids) // BLOCK)
        self.n = blocks * BLOCK
        place = np.arange(len(ids)) % BLOCK * blocks + np.arange(len(ids)) // BLOCK
        self.ids, self.norm = np.full(self.n, -1), np.ones(self.n)
        self.ids[place], self.norm[place] = ids, K1 * (1 - B + B * lengths / mean_length)
        doc, count = place.astype(np.min_scalar_type(self.n))[_packed(row["docs"], postings)], _packed(row["counts"], postings)
        impact = self.norm.astype(np.float32)[doc]
        impact += count
        np.divide(count * np.float32(K1 + 1), impact, out=impact)
        # by document: terms ascend in each, so equal texts get equal sums
        owner = np.repeat(np.arange(len(self.vocabulary), dtype=np.int32), sizes)
        order = np.argsort(doc, kind="stable")
        self.term, self.count = owner[order], count[order]
        del order
        self.begin = np.r_[0, np.cumsum(np.bincount(doc, minlength=self.n))]
        # the long lists as columns, and the greatest impact of each in every block
        long = sizes * LONG >= len(ids)
        self.column = np.where(long, np.cumsum(long) - 1, -1)
        held = long[owner]
        at = np.flatnonzero(held)
        self.table = np.zeros((self.n, int(long.sum())), dtype=np.float32)
        self.table[doc[at], self.column[owner[at]]] = impact[at]
        self.block_most = self.table.reshape(BLOCK, blocks, -1).max(axis=0)
        # the short lists one behind the other, document and impact side by side
        at = np.flatnonzero(~held)
        self.posting = np.empty(len(at), dtype=[("doc", np.uint32), ("impact", np.float32)])
        self.posting["doc"], self.posting["impact"] = doc[at], impact[at]
        self.size = np.where(long, 0, sizes)
        self.start = np.cumsum(self.size) - self.size
        self.weight, self.asked = np.zeros(len(self.vocabulary)), np.zeros(len(self.vocabulary), dtype=bool)
        self.steps = np.arange(1 << 16)

    def places(self, terms: np.ndarray) -> np.ndarray:
        """The terms' lists; -1 for a term that no document here has."""
        at = np.minimum(np.searchsorted(self.vocabulary, terms), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == terms, at, -1)

    def _runs(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Positions of runs, one behind the other."""
        ends = np.cumsum(size)
        n = int(ends[-1]) if len(ends) else 0
        if n > len(self.steps):
            self.steps = np.arange(2 * n)
        at = np.repeat(start - ends + size, size)
        at += self.steps[:n]
        return at

    def search(self, places: np.ndarray, idf: np.ndarray, ends: np.ndarray, floors: list[float], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, document places, scores) of the k best for queries whose lists and weights end at `ends`; equal scores by id. Documents
        below a query's floor, the least score that still counts, may be left out, and queries without others."""
        here = np.flatnonzero(places >= 0)
        owner, places, idf = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[here], places[here], idf[here]
        ends, weight = np.searchsorted(owner, np.arange(len(ends))), idf.astype(np.float32)
        column, size = self.column[places], self.size[places]
        heavy = np.zeros((len(ends) - 1, self.table.shape[1]), dtype=np.float32)
        at = np.flatnonzero(column >= 0)
        heavy[owner[at], column[at]] = weight[at]
        most = heavy @ self.block_most.T
        at = np.flatnonzero(size)
        start, size, short = self.start[places[at]], size[at], weight[at]
        cut = np.searchsorted(owner[at], np.arange(len(ends))).tolist()
        for i in np.flatnonzero(np.diff(ends)).tolist():
            own = slice(cut[i], cut[i + 1])
            found = self._beyond(self._partial(start[own], size[own], short[own]), heavy[i], most[i], floors[i], k)
            if len(found):
                own = slice(ends[i], ends[i + 1])
                self.weight[places[own]], self.asked[places[own]] = idf[own], True
                docs, score = self._best(found, k)
                self.asked[places[own]] = False
                if len(docs):
                    yield i, docs, score

    def _partial(self, start: np.ndarray, size: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Every document's score on short lists."""
        found = self.posting.view(np.int64).take(self._runs(start, size)).view(self.posting.dtype)
        return np.bincount(found["doc"], np.repeat(weight, size) * found["impact"], self.n)

    def _beyond(self, partial: np.ndarray, heavy: np.ndarray, most: np.ndarray, floor: float, k: int) -> np.ndarray:
        """Documents that may reach the floor and the k best, by single precision."""

        def near(docs: np.ndarray) -> np.ndarray:
            return partial[docs] + self.table[docs] @ heavy

        if floor <= 0 and self.n > SEED > k:  # a first threshold from the documents that reach farthest
            reach = partial + np.tile(most, BLOCK)
            floor = np.partition(near(np.argpartition(reach, self.n - SEED)[self.n - SEED :]), SEED - k)[SEED - k] * (1 - SLACK)
        floor = max(floor, TINY) / (1 + SLACK)
        found = np.flatnonzero(partial.reshape(BLOCK, -1) >= floor - most)
        if len(found):  # what the blocks let through is scored on the long lists
            score = near(found)
            if len(score) > k:
                floor = max(floor, np.partition(score, len(score) - k)[len(score) - k] * (1 - SLACK) / (1 + SLACK))
            found = found[score >= floor]
        return found

    def _best(self, docs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        size = self.begin[docs + 1] - self.begin[docs]
        at = self._runs(self.begin[docs], size)
        term = self.term[at]
        asked = np.flatnonzero(self.asked[term])
        owner, count = np.repeat(np.arange(len(docs)), size)[asked], self.count[at[asked]].astype(np.float64)
        impact = count * (K1 + 1) / (count + self.norm[docs][owner])
        score = np.bincount(owner, self.weight[term[asked]] * impact, len(docs))
        docs, score = docs[score > 0], score[score > 0]
        if len(docs) > k:
            keep = score >= np.partition(score, len(score) - k)[len(score) - k]
            docs, score = docs[keep], score[keep]
        order = np.lexsort((self.ids[docs], -score))[:k]
        return docs[order], score[order]


def _search(mean_length: float, k: int):
    """Over pairs of a shard and a batch of queries: each query's k best of the shards that the task has seen, which bound what
    the next shard must reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, index, best = None, None, {}
        for batch in batches:
            for at in range(batch.num_rows):
                if (shard := batch.column("shard")[at].as_py()) != now:
                    index = None  # one index at a time
                    now, index = shard, Shard({c: batch.column(c)[at].as_buffer() for c in PARTS}, mean_length)
                queries, asked, terms, idf, own = (batch.column(c)[at].as_buffer() for c in ("query_ids", "asked", "terms", "weights", "own"))
                queries, terms, idf = np.frombuffer(queries, np.int64), np.frombuffer(terms, np.int64), np.frombuffer(idf, np.float64)
                ends = np.r_[0, np.cumsum(_wide(asked, len(queries)))]
                own, places = _packed(own, int(ends[-1])), index.places(terms)
                for lo in range(0, len(queries), AT_ONCE):
                    some = queries[lo : lo + AT_ONCE].tolist()
                    mine = own[ends[lo] : ends[lo + len(some)]]
                    floors = [_floor(best.get(query, _NONE)[1], k) for query in some]
                    for i, docs, found in index.search(places[mine], idf[mine], ends[lo : lo + len(some) + 1] - ends[lo], floors, k):
                        ids, score = best.get(some[i], _NONE)
                        ids, score = np.r_[ids, index.ids[docs]], np.r_[score, found]
                        order = np.lexsort((ids, -score))[:k]
                        best[some[i]] = ids[order], score[order]
        if best:
            yield pa.RecordBatch.from_pydict({
                "query_id": np.repeat(np.fromiter(best, dtype=np.int64), [len(i) for i, _ in best.values()]),
                "doc_id": np.concatenate([i for i, _ in best.values()]), "score": np.concatenate([s for _, s in best.values()])})

    return run


def _floor(score: np.ndarray, k: int) -> float:
    """What a document must reach to be among the k best beside these, falling scores; 0 where fewer are known."""
    return score[-1] * (1 - 1e-12) if len(score) == k else 0.0


_NONE = np.zeros(0, dtype=np.int64), np.zeros(0)


def _query_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Queries packed by the thousands: their different terms ascending, with weights, and each query's positions among these."""

    def packed(held: list[tuple[int, np.ndarray, np.ndarray]]) -> pd.DataFrame:
        every = np.concatenate([t for _, t, _ in held])
        terms, first, own = np.unique(every, return_index=True, return_inverse=True)
        return pd.DataFrame([{"query_ids": np.array([q for q, _, _ in held], dtype=np.int64).tobytes(), "asked": _small(np.array([len(t) for _, t, _ in held])),
                              "terms": terms.tobytes(), "weights": np.concatenate([w for _, _, w in held])[first].tobytes(), "own": _small(own)}])

    held, size = [], 0
    for batch in batches:
        for query, terms, weights in zip(batch["query_id"].tolist(), batch["terms"], batch["weights"], strict=True):
            if held and (len(held) == QUERIES or size + len(terms) > QUERY_TERMS):
                yield packed(held)
                held, size = [], 0
            held.append((query, np.asarray(terms, dtype=np.int64), np.asarray(weights, dtype=np.float64)))
            size += len(terms)
    if held:
        yield packed(held)


def top_matches(documents: DataFrame, queries: DataFrame, k: int = 10, shard_terms: int = 2_000_000) -> DataFrame:
    """query_id, rank, doc_id, score: the `k` best rows of `documents` (doc_id, text) for each of `queries` (doc_id, text).

    Terms are words (ASCII letters lower-cased, other ASCII signs blanks; whole texts); a query's different terms count
    once. BM25 with k1 = 1.2, b = 0.75, idf = ln(1 + (N - df + 0.5) / (df + 0.5)). Equal scores go by doc_id. Rows without
    an id or without a term are neither found nor asked; queries of equal id are one query; repeated rows are found
    one by one. Fewer than k rows come back where fewer share a term. An empty table gives an empty result.
    """
    known, asking = (df.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text") for df in (documents, queries))
    shards = staged(known.mapInPandas(_shards(shard_terms), "shard string, ids binary, lengths binary, vocabulary binary, sizes binary, "
                                      "docs binary, counts binary"), **FEW_ROWS)
    total = shards.select("lengths").mapInPandas(_totals, "docs long, words long").agg(F.sum("docs"), F.sum("words")).first()
    count, mean_length = int(total[0] or 0), (total[1] or 0) / (total[0] or 1) or 1.0

    frequency = (shards.select("vocabulary", "sizes").mapInPandas(_frequencies, "term long, n long")
                 .groupBy("term").agg(F.sum("n").alias("df")))
    asked = asking.mapInPandas(_terms, "query_id long, term long").distinct()
    idf = F.log(1 + (F.lit(count) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    groups = max(LEAST_GROUPS, -(-asking.count() // TASK_QUERIES))
    weighed = (asked.join(frequency, "term").select("query_id", F.struct("term", idf.alias("idf")).alias("w"))
               .groupBy("query_id").agg(F.sort_array(F.collect_list("w")).alias("w"))
               .select("query_id", F.col("w.term").alias("terms"), F.col("w.idf").alias("weights")).repartition(groups)
               .mapInPandas(_query_rows, "query_ids binary, asked binary, terms binary, weights binary, own binary"))
    weighed = staged(weighed, **FEW_ROWS)

    # every shard meets every query where both are read, so neither is copied through a shuffle; a fixed number of streams of
    # shards, each with its own k best, lets the rows found grow as the queries only
    found = (shards.coalesce(STREAMS).hint("shuffle_replicate_nl").crossJoin(weighed.coalesce(groups))
             .mapInArrow(_search(mean_length, k), "query_id long, doc_id long, score double"))
    conf, rows = documents.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(rows)
    try:  # a pair of some 20 MB is a batch of its own
        conf.set(rows, "1")
        found = staged(found)
    finally:
        conf.set(rows, before)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "doc_id", F.round("score", 9).alias("score")))
