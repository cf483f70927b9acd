"""Secret scans: fixed patterns, and values in credential context that are hard to guess.

A value that follows a credential word and a sign (`pwd: ...`, `passphrase => ...`) or stands as a password in a url is
cut into words, dates, repeats, keyboard walks and single characters so that the number of guesses, in bits, is least;
the cheapest cutting is found by dynamic programming over its places. A value that still costs `least_bits` is a secret.
How easily a word is guessed follows from its share in the corpus, counted over all documents.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayspell.llm.common import staged

FLAGS = re.ASCII | re.IGNORECASE
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", FLAGS)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
# credential context: a word for a credential, a sign, the value up to blank space or a quote
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)|pwd|secret|token|(?:api|access|private|secret|auth)[\x20_-]?key|credentials?|authorization|bearer)"""
    r"""["']?[\x20\t]*(?:=>|->|:=|[:=])[\x20\t]*["']?([^\s"'<>]+)""", FLAGS)
USERINFO = re.compile(r"://[^\s/:@\"'<>]*:([^\s/@\"'<>]+)@")

# Passwords that everybody tries first, rows of a keyboard.
COMMON = ("password", "passw", "pass", "admin", "root", "user", "test", "login", "welcome", "letmein", "iloveyou", "monkey",
          "dragon", "master", "secret", "changeme", "default", "guest", "hello", "sunshine", "princess", "football",
          "example", "none", "null", "true", "false", "xxxx")
KEY_ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LEET = {"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "$": "s", "@": "a", "!": "i"}
YEAR = re.compile(r"(?=((?:19|20)\d\d))", re.ASCII)
DATES = tuple(re.compile(f"(?=({part}))", re.ASCII) for part in (
    r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])",
    r"(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d",
    r"(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])[-/._]?(?:19|20)\d\d"))

LONGEST_WORD, LONGEST_BLOCK = 24, 32
SEGMENT = 1.0  # bits to say what kind of segment comes next


def neighbours() -> dict[str, str]:
    """The keys around every key, rows being shifted by half a key."""
    place = {c: (x + y / 2, y) for y, row in enumerate(KEY_ROWS) for x, c in enumerate(row)}
    return {c: "".join(d for d, (u, v) in place.items() if d != c and abs(u - x) <= 1 and abs(v - y) <= 1)
            for c, (x, y) in place.items()}


NEAR = neighbours()
STEP = math.log2(sum(map(len, NEAR.values())) / len(NEAR))


def single(c: str) -> float:
    """Bits of one character without a pattern, by its class."""
    if c.isascii():
        return math.log2(10 if c.isdigit() else 26 if c.isalpha() else 33)
    return 10.0


def walk_direction(a: str, b: str) -> int:
    """Nonzero where two characters follow each other: 1 and -1 along the alphabet or the digits, 2 on the keyboard."""
    step = ord(b) - ord(a)
    if abs(step) == 1 and ((a.isdigit() and b.isdigit()) or (a.isalpha() and b.isalpha())):
        return step
    return 2 if b in NEAR.get(a, "") else 0


@dataclass
class GuessCost:
    """Bits to guess a value; `words` has the bits of known words."""

    words: Mapping[str, float]
    costs: dict[str, float] = field(default_factory=dict)

    def word_bits(self, part: str) -> float | None:
        """A known word, in any case and with look-alike signs for letters."""
        plain = part.lower()
        bits = self.words.get(plain)
        swapped = 0
        if bits is None:
            swapped = sum(c in LEET for c in plain)
            if not swapped:
                return None
            bits = self.words.get("".join(LEET.get(c, c) for c in plain))
            if bits is None:
                return None
        upper = sum(c.isupper() for c in part)
        letters = sum(c.isalpha() for c in part)
        if upper in (0, letters) or (upper == 1 and part[0].isupper()):
            shape = float(upper > 0)
        else:
            shape = math.log2(math.comb(letters, upper)) + 1
        return bits + shape + swapped

    def segments(self, value: str) -> Iterator[tuple[int, int, float]]:
        """(start, end, bits) of every word, date, repeat and walk in `value`."""
        n, low = len(value), value.lower()
        if len(low) != n:  # a few letters have longer lower cases
            low = value
        for i in range(n):
            for j in range(i + 3, min(n, i + LONGEST_WORD) + 1):
                bits = self.word_bits(value[i:j])
                if bits is not None:
                    yield i, j, bits
        for pattern in DATES:
            for m in pattern.finditer(value):
                signs = sum(not c.isdigit() for c in m[1])
                yield m.start(), m.start() + len(m[1]), math.log2(365 * 119) + 2.0 * (signs > 0)
        for m in YEAR.finditer(value):
            yield m.start(), m.start() + 4, math.log2(119)
        yield from self.walks(low)
        yield from self.repeats(value)

    @staticmethod
    def walks(low: str) -> Iterator[tuple[int, int, float]]:
        start, n = 0, len(low)
        while start < n - 1:
            end, turns, before = start + 1, 0, 0
            costs = []
            while end < n and (way := walk_direction(low[end - 1], low[end])):
                turns += way == 2 or way != before
                before = way
                end += 1
                costs.append(math.log2(len(NEAR)) + turns * STEP + math.log2(end - start))
            for length, bits in enumerate(costs, 2):
                if length >= 3:
                    yield start, start + length, bits
            start = end if end > start + 1 else start + 1

    def repeats(self, value: str) -> Iterator[tuple[int, int, float]]:
        """Blocks that follow each other twice or more; a block is at most `LONGEST_BLOCK` long."""
        letters = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        n = len(value)
        for width in range(1, min(n // 2, LONGEST_BLOCK) + 1):
            same = np.r_[False, letters[:-width] == letters[width:], False]
            edges = np.flatnonzero(same[1:] != same[:-1])
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                block = value[a : a + width]
                if block in (block + block)[1:-1]:  # a shorter block repeats here
                    continue
                for end in range(a + max(2 * width, 3), b + width + 1):
                    times = (end - a) // width
                    if times < 2:
                        continue
                    start = end - times * width
                    if times * width >= 3:
                        yield start, end, self.bits(value[start : start + width]) + math.log2(times)

    def bits(self, value: str) -> float:
        """The least sum of bits over all ways to cut `value` into segments and single characters."""
        found = self.costs.get(value)
        if found is not None:
            return found
        by_end: dict[int, list[tuple[int, float]]] = {}
        for start, end, bits in self.segments(value):
            by_end.setdefault(end, []).append((start, bits))
        best = [0.0]
        for end in range(1, len(value) + 1):
            here = best[end - 1] + single(value[end - 1])
            for start, bits in by_end.get(end, ()):
                here = min(here, best[start] + bits + SEGMENT)
            best.append(here)
        if len(self.costs) > 100_000:
            self.costs.clear()
        if len(value) <= 256:
            self.costs[value] = best[-1]
        return best[-1]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def guessed_spans(text: str, cost: GuessCost, least_bits: float, least_length: int = 6) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of credential values that cost at least `least_bits`; closing punctuation is no part
    of a value."""
    found = set()
    for pattern in (CONTEXT, USERINFO):
        for m in pattern.finditer(text):
            value = m[1].rstrip(".,;:!?)]}")
            if len(value) >= least_length and cost.bits(value) >= least_bits:
                found.add((m.start(1), 3, m.start(1) + len(value)))
    return sorted(found)


def word_costs(documents: DataFrame, column: str = "text", most_bits: int = 16, least: int = 2) -> dict[str, float]:
    """Bits of the corpus's words of 3 to 24 letters a-z: -log2 of a word's share among all words.

    Counted over all rows, whole texts. Only words of at least `least` occurrences that make up 2**-most_bits of all
    words are returned, so at most 2**most_bits of them, whatever the corpus. The common passwords are always in.
    """
    cut = F.explode(F.split(F.lower(F.col(column).cast("string")), r"[^\p{L}\p{Nd}]+")).alias("word")
    words = documents.select(cut).where(F.col("word").rlike(f"^[a-z]{{3,{LONGEST_WORD}}}$"))
    counts = staged(words.groupBy("word").agg(F.count("*").alias("n")))
    everything = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = (F.col("n") >= least) & (F.col("n") >= everything / 2**most_bits)
    known = {r["word"]: math.log2((everything + 2**most_bits) / r["n"])
             for r in counts.where(often).collect()}
    for turn, w in enumerate(COMMON, 1):
        known[w] = min(known.get(w, math.inf), math.log2(turn + 1))
    return known


def scan(documents: DataFrame, words: Mapping[str, float], ident: str = "doc_id", column: str = "text",
         least_bits: float = 40.0) -> DataFrame:
    """doc_id, base and spans of every row: lists of (kind, start, end), in code points, end exclusive."""
    words = dict(words)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost = GuessCost(words)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                base = [base_spans(t) if t else [] for t in part.column(1).to_pylist()]
                more = [guessed_spans(t, cost, least_bits) if t else [] for t in part.column(1).to_pylist()]
                lists = [[[(KINDS[k], s, e) for s, k, e in sorted(x)] for x in group]
                         for group in (base, [b + m for b, m in zip(base, more, strict=True)])]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x] for x in group],
                                                pa.list_(span)) for group in lists]], names=["doc_id", "base", "spans"])

    rows = documents.select(F.col(ident).alias("doc_id"), F.col(column).cast("string").alias("text"))
    kind, listed = dict(rows.dtypes)["doc_id"], "array<struct<kind: string, start: long, end: long>>"
    return rows.mapInArrow(search, f"doc_id {kind}, base {listed}, spans {listed}")


def secrets(documents: DataFrame, ident: str = "doc_id", column: str = "text", least_bits: float = 40.0) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess of every row of `documents`.

    A null or empty text has no span. Spans are ordered by start, then kind, then end. Whole texts are read, however long; a
    value may be as long as its text. Repeated rows, equal ids and null ids give a row each; an empty table gives an empty
    result. Other columns are not read.
    """
    found = scan(documents, word_costs(documents, column), ident, column, least_bits)

    def joined(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(number, KINDS), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"),
                        joined("spans").alias("spans"))
