"""Toxicity by a support vector machine over a subsequence string kernel, with Nyström landmarks.

The kernel compares two words by the runs of four letters that both hold in order, gaps allowed: a run weighs `decay`
for each letter it skips. An insult with inserted characters keeps many of its runs, so it stays close. A sentence is
as toxic as its worst word, a text as its worst sentence; training picks the words to blame in the labelled sentences
(multiple-instance learning) and sets them against words of clean sentences, hard ones first.

Landmarks are words; a word's features are its kernel values with them. The machine is linear in these, so its value for
a word is a weighted sum over the word's own runs: scoring needs one table of run weights and no landmark.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dayspell.llm.common import held_out, learnable, staged

ORDER, GAPS = 4, 2  # letters of a run, and how many others it may skip
PLACES = 1 << 18  # runs are hashed to so many weights
LETTERS = 64  # the alphabet: 0 begins a word, 1 to 62 are the commonest letters, 63 is any other
LONGEST = 16  # longer words are seen through overlapping windows of this many letters
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "$": "s", "@": "a"}
SPELLED = re.compile(r"(?<= )\w(?: \w){3,}(?= )")


class _Folding(dict):
    """Letters lower-cased, look-alikes as letters, blanks as a space, everything else dropped."""

    def __missing__(self, c: int) -> str:
        s = chr(c)
        out = LEET.get(s) or (s if s.isalpha() else " " if s.isspace() else "")
        self[c] = out
        return out


_FOLD = _Folding()


def words_of(text: str | None) -> list[str]:
    """The words of a whole text as runs of letters; letters that stand alone in a row make up one word more."""
    folded = f" {(text or '').lower().translate(_FOLD)} "
    words = folded.split()
    words += [m.replace(" ", "") for m in SPELLED.findall(folded)]
    return words


def windows_of(word: str) -> list[str]:
    if len(word) <= LONGEST:
        return ["^" + word]
    starts = [*range(0, len(word) - LONGEST, LONGEST // 2), len(word) - LONGEST]
    return [("^" if s == 0 else "") + word[s : s + LONGEST] for s in starts]


@dataclass
class Kernel:
    """Runs of `ORDER` letters in order, over an alphabet: a run weighs `decay` for every letter it skips, up to `GAPS`
    skipped ones. A word's length divides its kernel values by the norm of a word whose runs all differ, to the power
    `evenness`."""

    alphabet: dict[str, int]
    decay: float = 0.4
    evenness: float = 0.5
    shapes: dict[int, tuple] = field(default_factory=dict)

    def codes(self, units: list[str]) -> np.ndarray:
        return np.array([[0 if c == "^" else self.alphabet.get(c, LETTERS - 1) for c in u] for u in units], dtype=np.int64)

    def runs(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows x runs) table places and the runs' weights, divided by the norm, for rows of equally many letters."""
        n = letters.shape[1]
        if n not in self.shapes:
            at = np.array([(i, *[i + k for k in rest]) for i in range(n - ORDER + 1)
                           for rest in combinations(range(1, min(ORDER + GAPS, n - i)), ORDER - 1)], dtype=np.int64)
            weight = self.decay ** (at[:, -1] - at[:, 0] + 1 - ORDER)
            self.shapes[n] = (at, (weight / np.sqrt((weight**2).sum()) ** self.evenness).astype(np.float32))
        at, weight = self.shapes[n]
        code = letters[:, at[:, 0]]
        for k in range(1, ORDER):
            code = code * LETTERS + letters[:, at[:, k]]
        return (code * 0x9E3779B1 >> 7) & (PLACES - 1), weight

    def value(self, units: list[str], tables: np.ndarray, place_of: np.ndarray | None = None) -> np.ndarray:
        """Inner products of units with rows of run weights (units x rows); 0 below `ORDER` letters. `place_of` says where
        the rows hold a run."""
        out = np.zeros((len(units), len(tables)), dtype=np.float64)
        by_length: dict[int, list[int]] = {}
        for i, u in enumerate(units):
            by_length.setdefault(len(u), []).append(i)
        for n, rows in by_length.items():
            if n < ORDER:
                continue
            for lo in range(0, len(rows), 2048):
                part = rows[lo : lo + 2048]
                places, weight = self.runs(self.codes([units[i] for i in part]))
                if place_of is not None:
                    places = place_of[places]
                for k, table in enumerate(tables):
                    out[part, k] = table[places] @ weight
        return out

    def table(self, unit: str) -> np.ndarray:
        """A unit's own run weights."""
        places, weight = self.runs(self.codes([unit]))
        return np.bincount(places[0], weight, PLACES).astype(np.float32)


class Tables:
    """Run weights of the landmarks, kept only for runs that a landmark holds: the last column is any other run."""

    def __init__(self, kernel: Kernel, units: list[str]):
        self.kernel = kernel
        found = [kernel.runs(kernel.codes([u])) for u in units]
        self.runs = np.unique(np.concatenate([places[0] for places, _ in found])) if found else np.zeros(0, dtype=np.int64)
        self.place_of = np.full(PLACES, len(self.runs), dtype=np.int32)
        self.place_of[self.runs] = np.arange(len(self.runs))
        self.rows = np.zeros((len(units), len(self.runs) + 1), dtype=np.float32)
        for row, (places, weight) in zip(self.rows, found, strict=True):
            np.add.at(row, self.place_of[places[0]], weight)

    def values(self, units: list[str]) -> np.ndarray:
        return self.kernel.value(units, self.rows, self.place_of)

    def spread(self, coefficients: np.ndarray) -> np.ndarray:
        """One table of run weights over all places."""
        out = np.zeros(PLACES, dtype=np.float32)
        out[self.runs] = (coefficients @ self.rows)[:-1]
        return out


@dataclass
class Model:
    kernel: Kernel
    weights: np.ndarray  # of runs
    bias: float
    middle: float
    slope: float

    def unit_scores(self, units: list[str]) -> np.ndarray:
        return self.kernel.value(units, self.weights[None, :])[:, 0] + self.bias

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (margin - self.middle), -30, 30)))


def squared_hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Linear support vector machine in the primal (squared hinge), by Newton steps; the last weight is the bias."""
    x1 = np.c_[x, np.ones(len(x))]
    w, penalty = np.zeros(x1.shape[1]), np.r_[np.full(x.shape[1], ridge), 1e-8]

    def loss(v: np.ndarray) -> float:
        return float(penalty @ (v * v) + cost @ np.maximum(0, 1 - y * (x1 @ v)) ** 2)

    now = loss(w)
    for _ in range(60):
        slack = 1 - y * (x1 @ w)
        live = slack > 0
        grad = penalty * w - x1[live].T @ (cost[live] * y[live] * slack[live])
        step = np.linalg.solve(np.diag(penalty + 1e-9) + (x1[live].T * cost[live]) @ x1[live], grad)
        tries = [(loss(w - size * step), size) for size in 0.5 ** np.arange(16)]
        best, size = min(tries)
        if best > now * (1 - 1e-9):
            break
        w, now = w - size * step, best
    return w[:-1], float(w[-1])


@dataclass
class Sample:
    """Labelled texts as numbers: text i holds the units `names[texts[i]]`."""

    toxic: np.ndarray
    key: np.ndarray  # the same for most near copies
    texts: list[np.ndarray]
    names: list[str]

    @classmethod
    def of(cls, rows: pd.DataFrame) -> Sample:
        """From rows of (toxic, key, units)."""
        index: dict[str, int] = {}
        texts = [np.array([index.setdefault(u, len(index)) for u in units], dtype=np.int64) for units in rows["units"]]
        return cls(rows["toxic"].to_numpy(dtype=bool), rows["key"].to_numpy(), texts, list(index))

    def ordered(self) -> Sample:
        """The same whatever the order of rows and names."""
        rank = np.argsort(np.array(self.names, dtype=object), kind="stable") if self.names else np.zeros(0, dtype=np.int64)
        place = np.empty(len(rank), dtype=np.int64)
        place[rank] = np.arange(len(rank))
        texts = [np.sort(place[t]) for t in self.texts]
        order = sorted(range(len(texts)), key=lambda i: (self.key[i], len(texts[i]), self.toxic[i], texts[i].tolist()))
        return Sample(self.toxic[order], self.key[order], [texts[i] for i in order], [self.names[i] for i in rank])


def sample_units(documents: DataFrame, labels: DataFrame, per_class: int) -> Sample:
    """At most `per_class` labelled documents of either class, by a hash of their ids, one row per id.

    Labels are taken only from ids that are not held out; of several labels of an id the higher one counts, of several
    texts the one with the least hash. Texts reach the driver as numbers of their distinct words, and each word once. `key`
    is the unit with the least hash."""
    known = (labels.where("doc_id is not null and toxic in (0, 1)").where(learnable())
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    turn = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = known.withColumn("k", F.row_number().over(turn)).where(F.col("k") <= per_class).select("doc_id", "toxic")
    texts = documents.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            units = [sorted({u for w in words_of(t) for u in windows_of(w)}) for t in batch["text"]]
            yield pd.DataFrame({"toxic": batch["toxic"].astype("int32"), "units": units})

    rows = texts.select("toxic", "text").mapInPandas(cut, "toxic int, units array<string>").where("size(units) > 0")
    rows = staged(rows.withColumn("codes", F.transform("units", lambda u: F.xxhash64(u))))
    coded = rows.select("toxic", F.array_min("codes").alias("key"), "codes").toArrow()
    names = rows.select(F.explode("units").alias("unit")).distinct().select("unit", F.xxhash64("unit").alias("code")).toArrow()
    code = names.column("code").to_numpy()
    order = np.argsort(code, kind="stable")
    flat = order[np.searchsorted(code, coded.column("codes").combine_chunks().flatten().to_numpy(), sorter=order)] if len(code) else []
    ends = np.cumsum([len(x) for x in coded.column("codes")])
    return Sample(coded.column("toxic").to_numpy().astype(bool), coded.column("key").to_numpy(),
                  np.split(flat, ends[:-1]) if len(ends) else [], names.column("unit").to_pylist())


def fit(documents: DataFrame, labels: DataFrame, per_class: int = 2500, **sizes: int) -> Model:
    """Learn from a bounded sample (at most `per_class` labelled documents of either class; whole texts)."""
    return learn(sample_units(documents, labels, per_class), **sizes)


def learn(sample: Sample | pd.DataFrame, landmarks: int = 96, rounds: int = 4, most_negatives: int = 12_000, seed: int = 5) -> Model:
    """The model for a sample of labelled texts, as a `Sample` or as rows of (toxic, key, units)."""
    sample = (Sample.of(sample) if isinstance(sample, pd.DataFrame) else sample).ordered()
    toxic, names, texts = sample.toxic, sample.names, sample.texts
    uses = np.bincount(np.concatenate(texts), minlength=len(names)) if texts else np.zeros(0, dtype=np.int64)
    letters: dict[str, int] = {}
    for u, n in zip(names, uses.tolist(), strict=True):
        for c in u:
            letters[c] = letters.get(c, 0) + n
    letters.pop("^", None)
    alphabet = {c: i + 1 for i, c in enumerate(sorted(letters, key=lambda c: (-letters[c], c))[: LETTERS - 2])}
    kernel = Kernel(alphabet)
    if not toxic.any() or toxic.all():  # one class or none: its rate for every text
        rate = np.clip(toxic.mean() if len(toxic) else 0.0, 1e-6, 1 - 1e-6)
        return Model(kernel, np.zeros(PLACES, dtype=np.float32), float(np.log(rate / (1 - rate))), 0.0, 1.0)

    # every fourth key sets the threshold, the others train; near copies count once
    judge = sample.key % 4 == 0
    if not (toxic & judge).any() or not (toxic & ~judge).any():
        judge = np.zeros(len(toxic), dtype=bool)
    copies = pd.DataFrame({"key": sample.key, "toxic": toxic})
    share = 1 / copies.groupby(["key", "toxic"])["toxic"].transform("size").to_numpy()
    dirty, clean = np.zeros(len(names)), np.zeros(len(names))
    for units, bad, w, j in zip(texts, toxic, share, judge, strict=True):
        if not j:
            (dirty if bad else clean)[units] += w
    weight_of = [share[toxic & ~judge].sum(), share[~toxic & ~judge].sum()]
    lift = np.log((dirty + 0.1) / weight_of[0]) - np.log((clean + 0.1) / weight_of[1])
    evidence = dirty * np.maximum(0, lift)

    rng = np.random.default_rng(seed)
    blamed = np.flatnonzero((evidence >= max(20.0, 0.05 * evidence.max())) & (lift > 2))
    if not len(blamed):
        blamed = np.argsort(-evidence, kind="stable")[:10]
    blamed = blamed[np.argsort(-evidence[blamed], kind="stable")][:2000]
    ordinary = np.flatnonzero(clean > 0)
    if not len(ordinary):
        ordinary = np.setdiff1d(np.arange(len(names)), blamed)
    negative = np.sort(rng.choice(ordinary, min(len(ordinary), most_negatives // 2), replace=False))
    names_of = np.array(names, dtype=object)
    half = landmarks // 2
    long_enough = np.array([len(u) >= 4 for u in names])
    marks = [*[i for i in blamed if long_enough[i]][:half]]
    marks += [i for i in rng.permutation(negative) if long_enough[i]][: landmarks - len(marks)]
    tables = Tables(kernel, [names[i] for i in marks])
    own = tables.values([names[i] for i in marks])
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    keep = values > 1e-6
    whiten = vectors[:, keep] / np.sqrt(values[keep])

    features: dict[int, np.ndarray] = {}

    def nystrom(rows: Iterable[int]) -> np.ndarray:
        rows = list(rows)
        new = [i for i in rows if i not in features]
        if new:
            for i, x in zip(new, tables.values([names[i] for i in new]) @ whiten, strict=True):
                features[i] = x
        return np.array([features[i] for i in rows])

    model = Model(kernel, np.zeros(PLACES, dtype=np.float32), 0.0, 0.0, 4.0)
    everything = np.zeros(len(names))
    for turn in range(rounds):
        rows = np.r_[blamed, negative]
        y = np.r_[np.ones(len(blamed)), -np.ones(len(negative))]
        cost = np.r_[np.minimum(dirty[blamed], 20) / max(1e-9, np.minimum(dirty[blamed], 20).sum()),
                     np.full(len(negative), 2 / len(negative))] * 200
        w, bias = squared_hinge(nystrom(rows), y, cost)
        model.weights = tables.spread(whiten @ w)
        model.bias = bias
        everything = model.unit_scores(names)
        if turn == rounds - 1:
            break
        # who is to blame: the worst unit of each toxic text, where enough other texts hold it or it looks like those
        worst = {int(units[np.argmax(everything[units])]) for units, bad, j in zip(texts, toxic, judge, strict=True) if bad and not j}
        found = [i for i in worst if clean[i] < 0.02 * dirty[i] + 0.5 and (everything[i] > 0.5 or evidence[i] >= 20)]
        likely = np.flatnonzero((everything > 0.5) & (clean == 0) & (dirty >= 1))
        blamed = np.union1d(blamed[lift[blamed] > 2], np.union1d(np.array(found, dtype=int), likely)).astype(int)
        hard = ordinary[np.argsort(-everything[ordinary], kind="stable")[: most_negatives // 2]]
        negative = np.setdiff1d(np.union1d(negative[: most_negatives // 2], hard), blamed)

    margin = np.array([everything[units].max() for units in texts])
    at = judge if judge.any() else ~judge
    model.middle = best_cut(margin[at], toxic[at], share[at])
    return model


def best_cut(margin: np.ndarray, toxic: np.ndarray, share: np.ndarray) -> float:
    """The threshold with the best F1, in the widest gap that has it: rather near its lower end, because words with
    inserted characters lie inside it."""
    order = np.argsort(margin)[::-1]
    m, t = margin[order], toxic[order]
    hit, miss = np.cumsum(share[order] * t), np.cumsum(share[order] * ~t)
    f1 = 2 * hit / (hit + miss + (share * toxic).sum())
    below = np.r_[m[1:], m[-1] - 1]
    good = np.flatnonzero((f1 >= f1.max() - 1e-9) & (m > below))
    k = good[np.argmax(m[good] - below[good])] if len(good) else int(np.argmax(f1))
    return float(0.35 * m[k] + 0.65 * below[k])


def score(documents: DataFrame, model: Model, most_cached: int = 1_000_000) -> DataFrame:
    """Every row of `documents` (doc_id, text) with score and predicted (1 from 0.5 on) added; all columns stay.

    Whole texts are read; a null text or one without a word of three letters gets the score of the bias alone.
    """

    @F.pandas_udf("double")
    def worst(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen: dict[str, float] = {}
        for batch in batches:
            out = []
            for lo in range(0, len(batch), 256):
                texts = [set(words_of(t)) for t in batch.iloc[lo : lo + 256]]
                new = list(set().union(*texts).difference(seen))
                if len(seen) + len(new) > most_cached:
                    seen.clear()
                    new = list(set().union(*texts))
                for part in range(0, len(new), 20_000):
                    chunk = new[part : part + 20_000]
                    units = [windows_of(w) for w in chunk]
                    flat = model.unit_scores([u for us in units for u in us])
                    ends = np.cumsum([0, *map(len, units)])[:-1]
                    seen.update(zip(chunk, np.maximum.reduceat(flat, ends).tolist() if chunk else [], strict=True))
                out += [max(map(seen.__getitem__, ws), default=model.bias) for ws in texts]
            yield pd.Series(model.probability(np.array(out)))

    scored = documents.withColumn("score", worst("text"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(documents: DataFrame, model: Model) -> DataFrame:
    """The rows of `documents` that `model` does not reject; all columns stay, whatever their names."""
    whole = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("t_row"), "text")
    return score(whole, model).where("predicted = 0").select(*[F.col("t_row")[c].alias(c) for c in documents.columns])


def toxicity(documents: DataFrame, labels: DataFrame, **sizes: int) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of `documents` (doc_id, text), learned from `labels` (doc_id,
    toxic) of ids that are not held out. Repeated rows, equal and null ids give a row each. Without labels of both
    classes every text gets the same score. An empty table gives an empty result; other columns are not read."""
    model = fit(documents, labels, **sizes)
    return score(documents.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
