"""Importance resampling towards a target set: log-ratio weights, Gumbel noise, exact selection of the best share.

Runs of words are counted in hashed buckets over the corpus and over the target; a bucket's gain is the logarithm of the two
smoothed shares' ratio. The gains are one array of fixed size, and a document's weight is the mean of its runs' gains.
Adding Gumbel noise, drawn from a hash of the id, makes "the best k" a sample without replacement.

The cutoff is located without sorting the scores: a quantile sketch names a bracket, exact counts of the rows above and
inside it accept or widen it, and only the rows inside are ranked. Drawn rows are then ranked by score value, whose
counts are a small table, and within a value by id, so no window holds more than one score's rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayspell.llm.common import staged

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
REMEMBERED = 500_000  # runs whose buckets a task keeps; when it has more it starts anew, which costs time only


class Buckets(dict):
    """Bucket of every run of words seen so far."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, run: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[run] = found = zlib.crc32(run.encode("utf-8", "surrogatepass")) % self.buckets
        return found

    def of(self, text: str | None, longest: int) -> tuple[int, list[int]]:
        """Number of words, and the buckets of all runs of 1 to `longest` words, repeats included."""
        words = WORD.findall(text.translate(LOWER)) if text else []
        out = list(map(self.__getitem__, words))
        for n in range(2, longest + 1):
            out += map(self.__getitem__, map(" ".join, zip(*(words[i:] for i in range(n)), strict=False)))
        return len(words), out


def bucket_counts(texts: DataFrame, column: str, buckets: int, longest: int) -> np.ndarray:
    """How often each bucket occurs in all of `texts`; a task sends one row per bucket, the driver gets `buckets` rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Buckets(buckets), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                found = [known.of(t, longest)[1] for t in batch.column(0)[lo : lo + 256].to_pylist()]
                total += np.bincount(np.fromiter(chain.from_iterable(found), dtype=np.int64), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    by_task = texts.select(F.col(column).cast("string")).mapInArrow(count, "bucket long, n long")
    out = np.zeros(buckets, dtype=np.int64)
    for r in by_task.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


@dataclass(frozen=True)
class Gains:
    """floor(1000 * ln) of the smoothed ratio of shares, by bucket."""

    by_bucket: np.ndarray
    longest: int = 1

    @classmethod
    def learn(cls, corpus: DataFrame, target: DataFrame, column: str = "text", buckets: int = 10_000, longest: int = 1) -> Gains:
        s, t = (bucket_counts(x, column, buckets, longest) for x in (corpus, target))
        ratio = (t + 1.0) * float(s.sum() + buckets) / ((s + 1.0) * float(t.sum() + buckets))
        return cls(np.floor(1000 * np.log(ratio)).astype(np.int64), longest)


def weighted(documents: DataFrame, gains: Gains, ident: str = "doc_id", column: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row; without a run the weight is 0."""
    by_bucket, longest = gains.by_bucket, gains.longest

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Buckets(len(by_bucket))
        for batch in batches:
            words, sizes, sums = [], [], []
            for lo in range(0, batch.num_rows, 256):
                found = [known.of(t, longest) for t in batch.column(1)[lo : lo + 256].to_pylist()]
                size = np.array([len(runs) for _, runs in found], dtype=np.int64)
                total = np.r_[0, np.cumsum(by_bucket[np.fromiter(chain.from_iterable(r for _, r in found), dtype=np.int64)])]
                ends = np.cumsum(size)
                words += [n for n, _ in found]
                sizes.append(size)
                sums.append(total[ends] - total[ends - size])
            size = np.concatenate(sizes) if sizes else np.zeros(0, dtype=np.int64)
            total = np.concatenate(sums) if sums else size
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words, pa.int64()), pa.array(size), pa.array(np.floor_divide(total, np.maximum(size, 1)))],
                names=["doc_id", "n_words", "n_features", "weight"])

    rows = documents.select(F.col(ident).alias("doc_id"), F.col(column).cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")


def gumbel(ident: Column, seed: int) -> Column:
    """floor(1000 * Gumbel noise) from the first 32 bits of sha256("seed:id"); a null id counts as empty text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, above: int = 0) -> DataFrame:
    """`rows` with rank: `above` plus their turn by falling score, then by rising id (null last).

    A score is a whole number within some ten thousands, so the counts by score are a small table whatever the number of
    rows; a window holds the rows of one score.
    """
    by_score = rows.groupBy("score").agg(F.count("*").alias("r_n"))
    ahead = by_score.select(F.col("score").alias("r_score"), (F.sum("r_n").over(
        Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("r_n") + above).alias("r_ahead"))
    turn = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last()))
    return (rows.withColumn("r_turn", turn).join(ahead, F.col("score") == F.col("r_score"))
            .withColumn("rank", (F.col("r_ahead") + F.col("r_turn")).cast("long")).drop("r_turn", "r_score", "r_ahead"))


@dataclass(frozen=True)
class Bracket:
    """Scores low to high hold the row of the wanted rank; `above` rows score higher, `inside` lie within."""

    low: int
    high: int
    above: int
    inside: int
    tries: int


def bracket(eligible: DataFrame, wanted: int, n: int, accuracy: int = 1000) -> Bracket:
    """A narrow range of scores around the `wanted`-th highest of `n`: two sketched quantiles, checked by exact counts
    and widened until they hold it; the widest range is all scores."""
    margin, tries = 1.0 / accuracy, 0
    while True:
        tries += 1
        shares = [max(0.0, 1 - wanted / n - margin), min(1.0, 1 - wanted / n + margin)]
        low, high = eligible.agg(F.percentile_approx("score", shares, accuracy).alias("q")).first()["q"]
        if shares == [0.0, 1.0]:
            low, high = eligible.agg(F.min("score"), F.max("score")).first()
        above, inside = eligible.agg(F.count_if(F.col("score") > high), F.count_if(F.col("score").between(low, high))).first()
        if above < wanted <= above + inside:
            return Bracket(low, high, above, inside, tries)
        margin *= 4


def draw(scored: DataFrame, percent: int = 10, least_words: int = 20, accuracy: int = 1000) -> DataFrame:
    """`scored` (doc_id, n_words, score, ...) with rank 1, 2, 3... for the best floor(percent * N / 100) of the N rows with
    at least `least_words` words, null for the others. `scored` is read several times and should be a table."""
    undrawn = F.lit(None).cast("long").alias("rank")
    eligible = scored.where(F.col("n_words") >= least_words)
    n = eligible.count()
    wanted = n * percent // 100
    if wanted == 0:
        return scored.select("*", undrawn)
    if wanted == n:
        return ranked(eligible).unionByName(scored.where(F.col("n_words") < least_words).select("*", undrawn))
    found = bracket(eligible, wanted, n, accuracy)
    inside = ranked(eligible.where(F.col("score").between(found.low, found.high)), found.above)
    cut = inside.where(F.col("rank") == wanted).select("score", "doc_id").first()
    same = F.col("score") == cut["score"]
    earlier = F.lit(True) if cut["doc_id"] is None else F.coalesce(F.col("doc_id") <= F.lit(cut["doc_id"]), F.lit(False))
    best = (F.col("n_words") >= least_words) & ((F.col("score") > cut["score"]) | (same & earlier))
    # rows that repeat the last drawn id may go beyond the number wanted
    drawn = ranked(scored.where(best)).withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return drawn.unionByName(scored.where(~best).select("*", undrawn))


def resample(documents: DataFrame, target: DataFrame, ident: str = "doc_id", column: str = "text", percent: int = 10,
             least_words: int = 20, seed: int = 2024, buckets: int = 10_000, longest: int = 1) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of `documents`; `target` has the texts to come near.

    Whole texts are read; a null, empty or wordless text has no runs and weight 0, and is never drawn. Every row counts
    for itself: equal texts with different ids differ in their noise only, repeated ids have equal noise and take one rank each in any order,
    null ids share the noise of an empty id and come last among equal scores. An empty target makes rare runs
    heaviest; an empty corpus gives an empty result. Other columns are not read.
    """
    gains = Gains.learn(documents, target, column, buckets, longest)
    scored = weighted(documents, gains, ident, column).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    return draw(staged(scored), percent, least_words).select("doc_id", "n_features", "weight", "score", "rank")
