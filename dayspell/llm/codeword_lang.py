"""Language identification with error-correcting output codes.

Every language gets a codeword of bits; one linear classifier over hashed character n-grams predicts each bit. The
codeword with the least loss, summed over bits, names the language; a small distance to the next one is flagged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dayspell.llm.common import held_out, learnable

UNKNOWN = "und"


def codebook(n: int, seed: int = 11) -> np.ndarray:
    """Codewords of `n` classes as rows of -1 and 1: the exhaustive code for up to seven classes, else the best of
    many random ones by the least distance between two codewords."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 7:
        columns = [[-1] + [1 if bits >> k & 1 else -1 for k in range(n - 1)] for bits in range(1, 2 ** (n - 1))]
        return np.array(columns, dtype=float).T
    rng, width = np.random.default_rng(seed), 10 * int(np.ceil(np.log2(n)))
    best, best_gap = None, -1.0
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, width))
        gap = (width - (code @ code.T - 2 * width * np.eye(n)).max()) / 2
        if gap > best_gap:
            best, best_gap = code, gap
    return best


def _kinds() -> np.ndarray:
    """Lower-cased code point of every letter; 32 for everything else."""
    table = np.full(0x110000, 32, dtype=np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            table[c] = ord(low[0])
    return table


_TABLE: list[np.ndarray] = []


def features(text: str, dims: int) -> np.ndarray:
    """Square roots of the counts of hashed letters, pairs and triples (non-letters count as a space), of length 1."""
    if not _TABLE:
        _TABLE.append(_kinds())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    c = np.concatenate(([32], _TABLE[0][np.minimum(points, 0x10FFFF)], [32])).astype(np.uint64)
    mul = np.uint64(0x9E3779B97F4A7C15)
    shift = np.uint64(64 - int(dims).bit_length() + 1)
    one = c[1:-1] * mul
    two = (c[:-1] * np.uint64(0x1F123BB5) + c[1:] + np.uint64(1 << 40)) * mul
    three = ((c[:-2] * np.uint64(0x1F123BB5) + c[1:-1]) * np.uint64(0x1F123BB5) + c[2:] + np.uint64(1 << 41)) * mul
    letters = c != 32
    keep = (one[letters[1:-1]], two[letters[:-1] | letters[1:]], three[letters[1:-1]])
    x = np.sqrt(np.bincount((np.concatenate(keep) >> shift).astype(np.int64), minlength=dims).astype(np.float32))
    norm = np.sqrt(float(x @ x))
    return x / norm if norm else x


@dataclass
class CodewordModel:
    """Codewords of the learned languages and the weights of the bit classifiers."""

    langs: list[str]
    dims: int
    code: np.ndarray = field(default_factory=lambda: np.ones((0, 1)))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), dtype=np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def losses(self, text: str) -> np.ndarray:
        """Per language: the squared hinge losses of its codeword's bits, averaged."""
        margins = features(text, self.dims) @ self.weights + self.bias
        return (np.maximum(0, 1 - self.code * margins) ** 2).mean(axis=1)


def fit(documents: DataFrame, per_lang: int = 300, most_rows: int = 3000, dims: int = 1 << 14,
        ridge: float = 0.05) -> CodewordModel:
    """Learn from a bounded sample: at most `per_lang` rows of each language and about `most_rows` in all, taken by
    a hash of the row, out of rows with a language, a text and an id that is not held out. Only hashed counts
    reach the driver. The bits' weights are ridge regressions on the bits."""
    usable = documents.where(learnable() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in usable.groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return CodewordModel([], dims)
    each = max(1, min(per_lang, most_rows // len(langs)))
    shares = F.create_map(*[F.lit(v) for name, n in counts.items() for v in (name, min(1.0, 2 * each / n))])
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    order = Window.partitionBy("lang").orderBy("draw", "text")
    keys = (usable.select("lang", "text", draw.alias("draw")).where(F.col("draw") < shares[F.col("lang")])
            .withColumn("k", F.row_number().over(order)).where(F.col("k") <= each))

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = [features(t, dims) for t in part["text"]]
            at = [np.flatnonzero(x) for x in rows]
            yield pd.DataFrame({"lang": part["lang"], "at": [a.astype("int32") for a in at],
                                "x": [x[a].astype("float32") for x, a in zip(rows, at, strict=True)]})

    sample = keys.select("lang", "text").mapInPandas(sparse, "lang string, at array<int>, x array<float>").toPandas()
    sample = sample.iloc[np.argsort([f"{a}|{len(b)}|{b[:4]}" for a, b in zip(sample["lang"], sample["at"], strict=True)])]
    design = np.zeros((len(sample), dims), dtype=np.float32)
    for i, (at, x) in enumerate(zip(sample["at"], sample["x"], strict=True)):
        design[i, at] = x
    code = codebook(len(langs))
    own = np.array([langs.index(v) for v in sample["lang"]])
    share = 1 / np.bincount(own, minlength=len(langs))[own]  # each language weighs the same
    share *= len(own) / share.sum()
    target = code[own]
    bias = (target * share[:, None]).sum(axis=0) / share.sum()
    kernel = (design @ design.T).astype(np.float64)
    dual = np.linalg.solve(kernel + ridge * np.diag(1 / share), target - bias)
    return CodewordModel(langs, dims, code, (design.T @ dual).astype(np.float32), bias)


def identify(documents: DataFrame, model: CodewordModel, ambiguous_below: float = 0.15) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for every row of `documents` (doc_id, text).

    `und` with score 0 where the text is null, has no letter or nothing was learned. `score` is the share that the
    best codeword has of exp(-4 x loss); `ambiguous` marks rows whose best and second codeword lie closer than
    `ambiguous_below`. Rows are taken one by one, whole texts, other columns are not read.
    """
    langs = model.langs

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for text in texts:
                loss = model.losses(text)
                order = np.argsort(loss, kind="stable")
                share = np.exp(-4 * (loss - loss[order[0]]))
                gap = loss[order[1]] - loss[order[0]] if len(loss) > 1 else 1.0
                out.append((langs[order[0]], float(1 / share.sum()), bool(gap < ambiguous_below)))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "ambiguous"])

    base = documents.select("doc_id", held_out().alias("held_out"), "text")
    speaks = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    none = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous"))
    if not langs:
        return base.select("doc_id", "held_out", none.alias("p")).select("doc_id", "held_out", "p.*")
    found = base.withColumn("speaks", speaks).withColumn(
        "p", F.when(F.col("speaks"), decode(F.when(F.col("speaks"), F.col("text")).otherwise(F.lit("a")))).otherwise(none))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.ambiguous")
