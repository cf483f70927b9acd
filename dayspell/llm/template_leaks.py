"""Benchmark decontamination by canonical templates.

Words of a text become template tokens: numbers, units behind numbers, and capitalised names turn into typed
placeholders, other words are lower-cased. Windows of template tokens are hashed and joined with those of the benchmark
items. Where windows meet, the values behind the placeholders are compared: a re-parameterised question replaces each
value by one other value throughout, a chance resemblance does not. A second stream of windows holds names as case-folded
words, so that a copy in other case is met as well; it has only the windows that hold a name, the others are the same in
both. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayspell.llm.common import staged

#: A token: a number with its inner separators, or a word.
TOKEN = r"(\p{Nd}+(?:[.,:/]\p{Nd}+)*|\p{L}[\p{L}\p{M}'’]*)"
#: Units told as such behind a number (fixed values).
UNITS = ("mm", "cm", "m", "km", "in", "inch", "inches", "ft", "feet", "yd", "yards", "mi", "mile", "miles", "meter", "meters",
         "metre", "metres", "kilometer", "kilometers", "g", "kg", "mg", "lb", "lbs", "oz", "gram", "grams", "kilogram", "kilograms",
         "pound", "pounds", "ton", "tons", "l", "ml", "liter", "liters", "litre", "litres", "s", "sec", "second", "seconds", "min",
         "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "percent",
         "dollar", "dollars", "euro", "euros", "cent", "cents", "usd", "eur", "mph", "kmh", "degree", "degrees", "c", "f", "k")
NUMBER, UNIT, NAME = 1, 2, 3
#: The filter that hits pass before they are joined has this many bits (128 KB), whatever the benchmark's size.
FILTER_BITS = 1 << 20
#: Rows of the smaller side up to which it is sent to every executor (some 200 bytes a row).
MOST_SENT = 200_000


def _held(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns behind a generator, so that they are computed once and not once per use."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _kind(token: Column, previous: Column) -> Column:
    """Template code of a token: a placeholder's number or the hash of the case-folded word."""
    first, second = F.substring(token, 1, 1), F.substring(token, 2, 1)
    low = F.lower(token)
    digit = first.between("0", "9")
    name = (F.lower(first) != first) & (second != "") & (F.lower(second) == second)
    unit = F.substring(previous, 1, 1).between("0", "9") & low.isin(*UNITS)
    return (F.when(digit, F.lit(NUMBER).cast("long")).when(name, F.lit(NAME).cast("long"))
            .when(unit, F.lit(UNIT).cast("long")).otherwise(F.xxhash64(F.lower(F.upper(token)))))


def templates(texts: DataFrame, key: str) -> DataFrame:
    """key, raw (tokens), code (template codes) and folded (the same with names as case-folded words) of every row with a text."""
    raw = _held(texts.where("text is not null").select(key, "text"),
                raw=F.regexp_extract_all("text", F.lit(TOKEN), F.lit(1))).drop("text")
    before = lambda i: F.coalesce(F.get(F.col("raw"), i - 1), F.lit(""))
    coded = _held(raw, code=F.transform("raw", lambda t, i: _kind(t, before(i))))
    # a name behind a number may be a unit for the folded stream, as in other case it would be
    word = lambda t, i: F.when(
        F.substring(before(i), 1, 1).between("0", "9") & F.lower(t).isin(*UNITS), F.lit(UNIT).cast("long")).otherwise(F.xxhash64(F.lower(F.upper(t))))
    return _held(coded, folded=F.transform("code", lambda c, i: F.when(c == NAME, word(F.get("raw", i), i)).otherwise(c)))


def _named_starts(width: int) -> Column:
    """Starts of the windows that hold a name: only there do the streams differ."""
    at = F.filter(F.transform("code", lambda c, i: F.when(c == NAME, i)), lambda i: i.isNotNull())
    starts = F.flatten(F.transform(at, lambda i: F.sequence(F.greatest(i - (width - 1), F.lit(0)), i)))
    return F.filter(F.array_distinct(starts), lambda i: i <= F.size("code") - width)


def _window_hash(i: Column, width: int, folded: bool) -> Column:
    """Hash of the window at `i`. A folded window has no name left, so it meets windows of either stream that hold none."""
    code = F.col("folded" if folded else "code")
    return F.xxhash64(*[F.get(code, i + k) for k in range(width)])


def _starts(width: int) -> Column:
    return F.when(F.size("code") >= width, F.sequence(F.lit(0), F.size("code") - width)).otherwise(F.array().cast("array<int>"))


def _slots(i: Column, width: int, folded: bool) -> Column:
    """Per token of the window: its raw text (lower-cased in the folded stream) at a placeholder, else null."""
    code, raw = F.col("folded" if folded else "code"), lambda k: F.get(F.col("raw"), i + k)
    return F.array(*[F.when(F.get(code, i + k).between(NUMBER, NAME), F.lower(raw(k)) if folded else raw(k)) for k in range(width)])


def _windows(starts: Column, width: int, folded: bool, at: str, slots: str) -> Column:
    return F.transform(starts, lambda i: F.struct(i.alias(at), F.lit(folded).alias("folded"), _window_hash(i, width, folded).alias("hash"),
                                                  _slots(i, width, folded).alias(slots)))


def _covered(starts: Column, width: int) -> Column:
    """How many tokens the windows at `starts` cover together."""
    return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda a: F.sequence(a, a + (width - 1))))))


def item_windows(benchmark: DataFrame, width: int, literals: int) -> DataFrame:
    """item_id, at, folded, hash, slots of every window that holds `literals` words at least, windows (how many of them the
    item's templates have) and tokens (how many tokens they and the folded ones cover)."""
    rows = templates(benchmark.select("item_id", "text"), "item_id")
    found = rows.select("item_id", F.explode(F.concat(
        _windows(_starts(width), width, False, "at", "slots"), _windows(_named_starts(width), width, True, "at", "slots"))).alias("w"))
    enough = F.size(F.filter("w.slots", lambda s: s.isNull())) >= literals
    found = found.where(enough).select("item_id", "w.at", "w.folded", "w.hash", "w.slots").dropDuplicates(["item_id", "at", "hash"])
    sizes = found.groupBy("item_id").agg(F.count_distinct(F.when(~F.col("folded"), F.col("at"))).alias("windows"),
                                         _covered(F.collect_set("at"), width).alias("tokens"))
    return found.join(sizes, found["item_id"].eqNullSafe(sizes["item_id"])).drop(sizes["item_id"])


def _filter_words(windows: DataFrame) -> list[int]:
    """The filter's bits as 64-bit numbers."""
    place = F.pmod("hash", F.lit(FILTER_BITS))
    words = (windows.groupBy(F.floor(place / 64).cast("int").alias("word"))
             .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))).alias("bits")).collect())
    out = [0] * (FILTER_BITS // 64)
    for r in words:
        out[r[0]] = r[1]
    return out


def leaks(documents: DataFrame, benchmark: DataFrame, width: int = 5, share: float = 0.8, literals: int = 2,
          agreement: float = 0.8, cover: float = 0.6) -> DataFrame:
    """doc_id, item_id, matched, windows, share_matched, slots, slots_kept, share_covered of every document that holds an item.

    An item is held if `share` of its template windows occur in the document, or if windows of either stream that lie in one
    stretch of the document, as long as the item or so, cover `cover` of the item's tokens (a copy in other case, with a word
    changed, or of a part). Windows count in alignments whose slots are consistent: of the different values the item has there,
    `agreement` stand for one value of the document and the other way round. Windows with fewer than `literals` words (others
    are placeholders) say nothing; an item without a telling window, so also one of fewer than `width` tokens, is never
    found. matched to slots_kept tell of templates, share_covered of both streams. Null texts hold nothing; rows of equal
    doc_id count as one document, null ids too; an empty table gives an empty result; other columns are not read.
    """
    known = staged(item_windows(benchmark, width, literals))
    bits = F.array(*[F.lit(v) for v in _filter_words(known)])
    near = F.broadcast(known) if known.count() <= MOST_SENT else known

    def passes(i: Column) -> Column:
        found = F.when(i >= 0, _window_hash(i, width, False)).otherwise(_window_hash(-1 - i, width, True))
        place = F.pmod(found, F.lit(FILTER_BITS)).cast("int")
        word = F.get(bits, F.call_function("shiftright", place, F.lit(6)))
        return F.call_function("shiftright", word, place % 64).bitwiseAND(F.lit(1)) == 1

    # one pass over both streams: the folded window at i is -1 - i, so that the plan holds the filter once
    every = F.concat(_starts(width), F.transform(_named_starts(width), lambda i: -1 - i))
    rows = _held(templates(documents.select("doc_id", "text"), "doc_id"), hits=F.filter(every, passes))
    hits = rows.select("doc_id", F.explode(F.concat(
        _windows(F.filter("hits", lambda i: i >= 0), width, False, "i", "seen"),
        _windows(F.transform(F.filter("hits", lambda i: i < 0), lambda i: -1 - i), width, True, "i", "seen"))).alias("h"))
    met = hits.select("doc_id", "h.i", F.col("h.folded").alias("told"), "h.hash", "h.seen").join(near, "hash").select(
        "doc_id", "item_id", "windows", "tokens", (F.col("folded") | F.col("told")).alias("folded"), "at", (F.col("i") - F.col("at")).alias("shift"), "seen", "slots")
    met = staged(met)

    pairs = (met.select("doc_id", "item_id", "folded", "shift", F.explode(F.arrays_zip("slots", "seen")).alias("s"))
             .where("s.slots is not null")
             .groupBy("doc_id", "item_id", "folded", "shift").agg(
                 F.count_distinct("s.slots").alias("values"), F.count_distinct("s.seen").alias("others"),
                 F.count_distinct("s.slots", "s.seen").alias("pairs")))
    broken = pairs.where((F.col("pairs") * agreement > F.least("values", "others"))).select(
        F.col("doc_id").alias("d"), F.col("item_id").alias("t"), F.col("folded").alias("f"), F.col("shift").alias("z"))
    same = (met["doc_id"].eqNullSafe(broken["d"]) & met["item_id"].eqNullSafe(broken["t"])
            & (met["shift"] == broken["z"]) & (met["folded"] | ~broken["f"]))  # folded windows fall with the templates of their alignment
    consistent = met.join(broken, same, "left_anti")
    values = pairs.where(~F.col("folded")).groupBy("doc_id", "item_id").agg(F.max("values").alias("slots"), F.max(
        F.when(F.col("pairs") * agreement <= F.least("values", "others"), F.col("values"))).alias("slots_kept"))
    # stretches that overlap by half: shifts that differ by less than half an item share one
    stretch = F.explode(F.array(*[F.struct(F.lit(half).alias("half"), F.floor(F.col("shift") / F.col("tokens") + half / 2).alias("n"))
                                  for half in (0, 1)]))
    parts = (consistent.select("doc_id", "item_id", "windows", "tokens", "folded", "at", stretch.alias("stretch"))
             .groupBy("doc_id", "item_id", "stretch").agg(
                 F.collect_set(F.when(~F.col("folded"), F.col("at"))).alias("kept"), _covered(F.collect_set("at"), width).alias("covered"),
                 F.max("windows").alias("windows"), F.max("tokens").alias("tokens")))
    found = (parts.groupBy("doc_id", "item_id").agg(
                 F.size(F.array_distinct(F.flatten(F.collect_list("kept")))).cast("long").alias("matched"), F.max("windows").alias("windows"),
                 (F.max("covered") / F.max("tokens")).alias("share_covered"))
             .where(((F.col("windows") > 0) & (F.col("matched") >= share * F.col("windows"))) | (F.col("share_covered") >= cover)))
    both = found["doc_id"].eqNullSafe(values["doc_id"]) & found["item_id"].eqNullSafe(values["item_id"])
    return found.join(values, both, "left").select(
        found["doc_id"], found["item_id"], "matched", "windows",
        F.when(F.col("windows") > 0, F.col("matched") / F.col("windows")).otherwise(0.0).alias("share_matched"),
        F.coalesce("slots", F.lit(0)).alias("slots"), F.coalesce("slots_kept", F.lit(0)).alias("slots_kept"), "share_covered")


def without_leaks(documents: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of `documents` whose id holds no item; all columns stay. Rows of one id stand or fall together; rows without an
    id are judged each by its own text."""
    key = F.coalesce(F.concat(F.lit("id:"), F.col("doc_id").cast("string")), F.concat(F.lit("text:"), F.md5(F.col("text").cast("binary"))))
    ids = staged(leaks(documents.select(key.alias("doc_id"), "text"), benchmark, **how).select(F.col("doc_id").alias("w_leak")).distinct())
    near = F.broadcast(ids) if ids.count() <= MOST_SENT else ids
    # a null key (no id, no text) meets nothing and stays
    return documents.join(near, key == F.col("w_leak"), "left_anti")
