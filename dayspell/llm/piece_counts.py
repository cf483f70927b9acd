"""Token counts by byte-pair merging, without identifiers.

A text is cut into symbols (characters); the adjacent pair whose union has the best rank is merged again and again,
found through a heap over a linked list of symbols. The number of tokens is the number of initial symbols less the
merges. A character outside the vocabulary counts as its UTF-8 bytes (byte fallback).
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Parts that no merge can join: a run of spaces with the word behind it, the rest of a line's first word, a line end.
PARTS = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")


def merge_ranks(model_file: str) -> dict[str, int]:
    """Rank of every piece that merging can make; the best one has rank 0."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    usable = [i for i in range(model.get_piece_size())
              if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    order = sorted(usable, key=lambda i: -model.get_score(i))
    ranks = {model.id_to_piece(i): rank for rank, i in enumerate(order)}
    crossing = [p for p in ranks if SPACE in p.lstrip(SPACE) or "\n" in p]
    if crossing:
        raise ValueError(f"pieces such as {crossing[0]!r} cross word borders; this vocabulary needs whole-text merging")
    return ranks


def merged_length(part: str, ranks: dict[str, int]) -> int:
    """Tokens of one part: its symbols' weights, less what each merge saves."""
    n = len(part)
    symbols = list(part)
    weight = [1 if c in ranks else len(c.encode("utf-8", "surrogatepass")) for c in symbols]
    total = sum(weight)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    heap: list[tuple[int, int, int, str]] = []

    def offer(left: int) -> None:
        right = after[left]
        if right >= 0:
            union = symbols[left] + symbols[right]
            rank = ranks.get(union)
            if rank is not None:
                heapq.heappush(heap, (rank, left, right, union))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, left, right, union = heapq.heappop(heap)
        if after[left] != right or symbols[left] + symbols[right] != union:
            continue  # one of the two was merged meanwhile
        total -= weight[left] + weight[right] - 1
        symbols[left], weight[left], symbols[right] = union, 1, ""
        after[left] = follower = after[right]
        if follower >= 0:
            before[follower] = left
        after[right] = -2
        offer(left)
        if before[left] >= 0:
            offer(before[left])
    return total


class PartCounts(dict):
    """Counts of parts seen so far; emptied when it holds `most` parts, which costs time only."""

    def __init__(self, model_file: str, most: int = 1_000_000, longest: int = 64):
        super().__init__()
        self.ranks, self.most, self.longest = merge_ranks(model_file), most, longest

    def __missing__(self, part: str) -> int:
        n = merged_length(part, self.ranks)
        if len(part) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[part] = n
        return n

    def of(self, text: str | None) -> int:
        if not text:
            return 0
        return sum(map(self.__getitem__, PARTS.findall(SPACE + text.replace(" ", SPACE))))


_COUNTS: dict[str, PartCounts] = {}


def piece_count(text: Column | str, model_file: str) -> Column:
    """Number of tokens of a text, null counting as empty. `model_file` must be readable on every executor."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counts = _COUNTS.get(model_file)
        if counts is None:
            counts = _COUNTS[model_file] = PartCounts(model_file)
        for texts in batches:
            yield pd.Series([counts.of(t) for t in texts], dtype="int64")

    return count(text)


def token_counts(documents: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of `documents` (doc_id, text).

    A null or empty text has no bytes and no tokens. Rows are taken one by one: repeated rows, equal ids and null
    ids give a row each; other columns are not read. Very long words are merged whole, in n log n steps.
    """
    counted = documents.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        piece_count(F.col("text"), model_file).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
