"""Vector codes by product quantisation, with memoised grid cells.

A vector is cut into equal parts; each part is replaced by the number of its nearest codebook entry. Nearest entries are
found through a grid: a part's coarse cell is hashed, and a cell that has not been met yet gets the list of entries which
no other entry beats everywhere in the cell's box (an entry stays where its least distance to the box is not above the
smallest of all entries' largest distances). Only these entries are evaluated exactly, so the result is that of a full
search. Codebooks are trained by rounds of assigning and averaging in whole numbers; one round is one pass over the
vectors, which returns a task's sums per entry and never its rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayspell.llm.common import joined_by_key, staged

MOST = 1 << 50  # scaled components beyond it count as it
LONGEST = (1 << 63) - 1
CHUNK = 512  # cells and rows are worked on in blocks of so many


@dataclass
class Cells:
    """Nearest-entry search in one codebook (entries x dimensions, whole numbers).

    The cell width follows from the codebook: a box's diagonal is half the median distance between an entry and its
    nearest neighbour. Known cells are kept up to `most_entries` listed entries, then forgotten, which costs time only.
    """

    book: np.ndarray
    most_entries: int = 4_000_000
    known: dict[bytes, int] = field(default_factory=dict)
    evaluated: int = 0  # exact distances so far
    met: int = 0  # cells listed so far

    def __post_init__(self) -> None:
        k, dims = self.book.shape
        near = np.asarray(self.book, dtype=np.float64)
        gaps = (near**2).sum(1)[:, None] + (near**2).sum(1)[None, :] - 2 * near @ near.T
        gaps[np.arange(k), np.arange(k)] = np.inf
        gap = math.sqrt(max(0.0, float(np.median(gaps.min(1))))) if k > 1 else 0.0
        self.width = max(1, int(gap / (2 * math.sqrt(dims))) if math.isfinite(gap) else 1)
        self.forget()

    def forget(self) -> None:
        self.known, self.lists, self.listed = {}, [], 0

    def exact(self, rows: np.ndarray) -> type:
        """Doubles where squared distances, times the number of entries, are exact in them; Python numbers otherwise."""
        largest = max(int(np.abs(rows).max(initial=0)), int(np.abs(self.book).max(initial=0))) + self.width
        return np.float64 if self.book.shape[1] * (2 * largest) ** 2 * (len(self.book) + 1) < 1 << 53 else object

    def bounds(self, cells: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest squared distance of every cell's box to every entry, summed up dimension by dimension from
        one row of numbers per coarse coordinate."""
        least = np.zeros((len(cells), len(self.book)), dtype=kind)
        most = np.zeros_like(least)
        for d in range(cells.shape[1]):
            level, at = np.unique(cells[:, d], return_inverse=True)
            low = (level.astype(kind) * self.width)[:, None]
            high = low + (self.width - 1)
            entry = self.book[None, :, d].astype(kind)
            short = np.maximum(np.maximum(low - entry, entry - high), 0)
            far = np.maximum(abs(entry - low), abs(high - entry))
            least += (short * short)[at]
            most += (far * far)[at]
        return least, most

    def list_cells(self, keys: list[bytes], cells: np.ndarray, kind: type) -> None:
        for lo in range(0, len(keys), CHUNK):
            least, most = self.bounds(cells[lo : lo + CHUNK], kind)
            row, entry = np.nonzero(least <= most.min(axis=1)[:, None])
            ends = np.searchsorted(row, np.arange(1, len(least)))
            for key, entries in zip(keys[lo : lo + CHUNK], np.split(entry, ends), strict=True):
                self.known[key] = len(self.lists)
                self.lists.append(entries)
            self.listed += len(entry)
        self.met += len(keys)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of every row; ties go to the lower entry."""
        if not len(rows):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        kind = self.exact(rows)
        cells = np.ascontiguousarray(np.floor_divide(rows, self.width))
        keys = cells.view(f"V{cells.shape[1] * cells.itemsize}").ravel().tolist()
        if self.listed > self.most_entries:
            self.forget()
        new = {key: i for i, key in enumerate(keys) if key not in self.known}
        if new:
            self.list_cells(list(new), cells[list(new.values())], kind)
        lists = [self.lists[self.known[key]] for key in keys]
        best, error = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=kind)
        for lo in range(0, len(rows), CHUNK):
            part = lists[lo : lo + CHUNK]
            sizes = np.fromiter(map(len, part), dtype=np.int64, count=len(part))
            entry = np.concatenate(part)
            gap = np.repeat(rows[lo : lo + CHUNK].astype(kind), sizes, axis=0) - self.book[entry].astype(kind)
            ranked = (gap * gap).sum(axis=1) * len(self.book) + entry
            first = np.minimum.reduceat(ranked, np.cumsum(sizes) - sizes)
            best[lo : lo + CHUNK], error[lo : lo + CHUNK] = first % len(self.book), first // len(self.book)
            self.evaluated += len(entry)
        return best, error


def scaled(values: pa.ListArray, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x) of every component (rows x dims); missing places at the end are zeros."""
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        whole = np.floor(flat * scale)
    huge = np.abs(whole) > MOST
    if huge.any():
        whole[huge] = [float(max(-MOST, min(MOST, math.floor(Fraction(x) * scale)))) for x in flat[huge]]
    sizes = np.diff(values.offsets.to_numpy())
    if (sizes == dims).all():
        return whole.astype(np.int64).reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), dtype=np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = whole
    return out


def kept_vectors(table: DataFrame, ident: str, vector: str, label: str | None) -> DataFrame:
    """(vec_id, label, vector) of rows whose vector is known and holds finite numbers only."""
    named = table.select(F.col(ident).alias("vec_id"), (F.col(label) if label else F.lit(None).cast("int")).alias("label"),
                         F.col(vector).cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return named.where(F.col("vector").isNotNull() & ~bad)


@dataclass(frozen=True)
class Codec:
    """Codebooks (parts x entries x dimensions of a part) of whole numbers."""

    books: np.ndarray
    scale: int

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def initial(kept: DataFrame, parts: int, entries: int, scale: int) -> Codec | None:
    """The parts of the vectors with the smallest ids; None for an empty table. A row of `kept` has the longest
    vector's length, rounded up to whole parts."""
    longest = kept.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        return None
    dims = max(1, -(-longest // parts)) * parts
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    rows = scaled(pa.array([r["vector"] for r in first], pa.list_(pa.float64())), dims, scale)
    return Codec(np.ascontiguousarray(rows.reshape(len(rows), parts, -1).transpose(1, 0, 2)), scale)


def averaged(kept: DataFrame, codec: Codec) -> Codec:
    """One round: parts go to their nearest entries, entries to the floor of their parts' mean; unused ones stay."""
    parts, entries, width = codec.books.shape
    books, scale = codec.books, codec.scale

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Cells(book) for book in books]
        total = np.zeros((parts, entries, width), dtype=object)
        count = np.zeros((parts, entries), dtype=np.int64)
        for batch in batches:
            rows = scaled(batch.column(0), parts * width, scale)
            for p in range(parts):
                mine = rows[:, p * width : (p + 1) * width]
                best, _ = search[p].nearest(mine)
                order = np.argsort(best, kind="stable")
                used, start = np.unique(best[order], return_index=True)
                # up to 4096 components of at most 2**50 fit a long
                for lo, hi, e in zip(start, [*start[1:], len(order)], used, strict=True):
                    group = mine[order[lo:hi]]
                    total[p, e] += group.astype(object).sum(axis=0) if len(group) > 4096 else group.sum(axis=0).astype(object)
                    count[p, e] += hi - lo
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([
            pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e], pa.int64()),
            pa.array([[Decimal(int(x)) for x in total[i, j]] for i, j in zip(p, e, strict=True)], pa.list_(pa.decimal128(38, 0)))],
            names=["part", "entry", "n", "sums"])

    by_task = kept.select("vector").mapInArrow(sums, "part int, entry int, n long, sums array<decimal(38,0)>")
    found = by_task.groupBy("part", "entry").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]).cast("decimal(38,0)") for i in range(width)]).alias("sums"))
    books = codec.books.copy()
    for r in found.collect():  # at most one row per entry
        books[r["part"], r["entry"]] = [int(s) // r["n"] for s in r["sums"]]
    return Codec(books, scale)


def fit(kept: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> Codec | None:
    """Codebooks after `rounds` rounds over all of `kept` (see `kept_vectors`); None for an empty table."""
    codec = initial(kept, parts, entries, scale)
    for _ in range(rounds if codec is not None else 0):
        codec = averaged(kept, codec)
    return codec


def encode(kept: DataFrame, codec: Codec) -> DataFrame:
    """(vec_id, label, code, error) of every row of `kept`: two hexadecimal digits per part."""
    parts, entries, width = codec.books.shape
    books, scale = codec.books, codec.scale
    digits = max(2, len(f"{entries - 1:x}"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Cells(book) for book in books]
        names = np.array([f"{i:0{digits}x}" for i in range(entries)], dtype=object)
        for batch in batches:
            rows = scaled(batch.column(2), parts * width, scale)
            code, error = "", 0
            for p in range(parts):
                best, gap = search[p].nearest(rows[:, p * width : (p + 1) * width])
                code, error = code + names[best], error + gap.astype(np.int64 if gap.dtype == np.float64 else object).astype(object)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(code, pa.string()) if len(rows) else pa.array([], pa.string()),
                pa.array([min(int(e), LONGEST) for e in error] if len(rows) else [], pa.int64())],
                names=["vec_id", "label", "code", "error"])

    kinds = dict(kept.dtypes)
    return kept.select("vec_id", "label", "vector").mapInArrow(
        assign, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def vector_codes(table: DataFrame, ident: str = "vec_id", vector: str = "embedding", label: str | None = "label",
                 **sizes: int) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every row of `table` with a finite vector.

    A row is left out only if its vector is null or holds a null, NaN or infinite component. A vector shorter than the
    longest one counts as one with zeros behind it, and so does a length that the parts do not divide; a scaled
    component beyond 2**50 counts as 2**50, an error beyond a long as the largest long. Repeated rows and equal ids give a row each;
    among equal ids the smaller vector comes first for the codebooks, null ids come last. Rows without a label share
    one label_error. With fewer rows than entries the codebooks are shorter. An empty table, or one without a finite
    vector, gives an empty result. Other columns are not read.
    """
    kept = kept_vectors(table, ident, vector, label)
    codec = fit(kept, **sizes)
    if codec is None:
        return kept.where("1 = 0").select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
                                          F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = staged(encode(kept, codec))
    total = F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit(LONGEST).cast("decimal(20,0)")).cast("long")
    by_label = coded.groupBy("label").agg(total.alias("label_error"))
    return joined_by_key(coded, by_label, "label").select(
        "vec_id", "code", "error", "label_error", F.lit(codec.sha256()).alias("codebooks_sha256"))
