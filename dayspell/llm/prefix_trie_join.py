"""Prefix-tree join of documents by the Jaccard similarity of their word n-grams.

N-gram sets are stored in one global order, rarest first. Two sets that are similar enough share one of their first
few n-grams (a prefix whose length follows from the set's size), so Spark deals documents by the n-grams of their
prefixes: these are the first branches of the tree. Below a branch the sets lie in a trie; a probe walks it once,
shares the overlap counted so far among all sets with the same beginning, and leaves a subtree as soon as the lengths
that remain cannot reach the threshold.

Equal sets are one class with one representative. Representatives that share a branch are first compared with the
branch's smallest one; only pairs of a branch that this leaves in different components are compared with each other,
after an exact lower bound on their difference. No link between different components is lost, and copies are never
expanded into all pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dayspell.llm.common import connected_components, staged
from dayspell.llm.shingles import pieces, shingle_rows

LEAST_BITS = 1024  # of a sketch; larger sets have more, half as many bits as members at least
#: Ids sent to every executor at most (8 MB); more are joined by a shuffle.
MOST_IDS = 1_000_000


# --- sets, order and prefixes -------------------------------------------------------------------------------------

def frequent_ngrams(documents: DataFrame, width: int, most: int = 1 << 18, block: int = 1 << 20,
                    share: float = 0.0005) -> np.ndarray:
    """The most frequent n-grams, rarest of them first; at most `most`, so the list has a fixed bound.

    Every block of n-grams counts its own ones and passes on those in at least three documents and in `share` of
    its documents; an n-gram that frequent over all is so in some block. The list only shapes the global order: any
    order gives the same result.
    """

    def counted(rows: list[np.ndarray]) -> pd.DataFrame:
        values, counts = np.unique(np.concatenate(rows), return_counts=True)
        keep = counts >= max(3, share * len(rows))
        return pd.DataFrame({"ngram": values[keep].view(np.int64), "n": counts[keep].astype("int64")})

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for batch in pieces(batches):
            for found in shingle_rows(batch["text"].tolist(), width):
                rows.append(np.unique(found))
                size += len(rows[-1])
                if size >= block:
                    yield counted(rows)
                    rows, size = [], 0
        if rows:
            yield counted(rows)

    sums = documents.select("text").mapInPandas(local, "ngram long, n long").groupBy("ngram").agg(F.sum("n").alias("n"))
    top = sums.orderBy(F.desc("n"), "ngram").limit(most).toPandas()
    return top["ngram"].to_numpy()[::-1].astype(np.int64).view(np.uint64).copy()


def prefix_length(n: int, percent: int) -> int:
    """How many first n-grams of a set of n must hold one of any similar set's."""
    return n + (-percent * n) // 100 + 1


def ordered(ngrams: np.ndarray, late: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """A set (sorted) in the global order: rare ones by hash, then the frequent ones by rank. `late` is sorted."""
    if not len(late):
        return ngrams
    at = np.searchsorted(late, ngrams)
    at[at == len(late)] = 0
    frequent = late[at] == ngrams
    return np.concatenate((ngrams[~frequent], ngrams[frequent][np.argsort(rank[at[frequent]])]))


def sketch(ngrams: np.ndarray) -> bytes:
    """Parity of the n-grams that fall on each bit: two sketches differ in no more bits than the sets in members. Folding
    a sketch's halves over each other gives the sketch of half the width."""
    width = max(LEAST_BITS, 1 << ((len(ngrams) + 1) // 2 - 1).bit_length())
    bits = np.bincount((ngrams & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def sketch_gaps(marks: list[bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits the sketches of rows a[k] and b[k] differ, at the narrower one's width."""
    size = np.array([len(m) for m in marks], dtype=np.int64)
    narrow = np.minimum(size[a], size[b])
    gaps = np.zeros(len(a), dtype=np.int64)
    for width in np.unique(narrow):
        at = np.flatnonzero(narrow == width)
        rows, place = np.unique(np.concatenate((a[at], b[at])), return_inverse=True)
        folded = []
        for row in rows:
            m = np.frombuffer(marks[row], dtype=np.uint64)
            while m.nbytes > width:
                m = m[: len(m) // 2] ^ m[len(m) // 2 :]
            folded.append(m)
        table = np.stack(folded)
        for lo in range(0, len(at), 4096):
            part = slice(lo, lo + 4096)
            left, right = table[place[: len(at)][part]], table[place[len(at) :][part]]
            gaps[at[part]] = np.bitwise_count(left ^ right).sum(axis=1, dtype=np.int64)
    return gaps


def profiles(documents: DataFrame, width: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """doc_id, n (set size), digest of the set, prefix and sketch of every document."""
    late = np.sort(frequent)
    rank = np.empty(len(late), dtype=np.int64)
    rank[np.searchsorted(late, frequent)] = np.arange(len(late))
    smallest = smallest_linkable(percent)

    def profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pieces(batches):
            n, digest, prefix, marks = [], [], [], []
            for found in shingle_rows(batch["text"].tolist(), width):
                ngrams = np.unique(found)
                size = len(ngrams)
                n.append(size)
                digest.append(hashlib.blake2b(ngrams.tobytes(), digest_size=16).digest())
                if size < smallest:
                    prefix.append(np.zeros(0, dtype=np.int64))
                    marks.append(b"")
                else:
                    prefix.append(ordered(ngrams, late, rank)[: prefix_length(size, percent)].view(np.int64))
                    marks.append(sketch(ngrams))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n": np.array(n, dtype=np.int64), "digest": digest,
                                "prefix": prefix, "sketch": marks})

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInPandas(
        profile, f"doc_id {kind}, n long, digest binary, prefix array<long>, sketch binary")


def smallest_linkable(percent: int) -> int:
    """Two different sets below this size cannot be similar: n of n + 1 must reach `percent`."""
    n = 1
    while 100 * n < percent * (n + 1):
        n += 1
    return n


# --- the trie ------------------------------------------------------------------------------------------------------

def trie_matches(probe: np.ndarray, stored: list[np.ndarray], percent: int) -> list[int]:
    """Indexes of the stored sets (each sorted, not empty) that are similar to `probe`.

    The trie is the sorted list of the sets with the depth that each shares with the one before. Walking it, the
    overlap of a shared beginning is taken over, and a branch dies at the depth where the members missed so far on
    either side leave too little: 100 * (|probe| - missed there) < percent * (|probe| + missed here).
    """
    n, found = len(probe), []
    order = sorted(range(len(stored)), key=lambda i: stored[i].byteswap().tobytes())
    path = np.zeros(0, dtype=np.int64)  # overlap after each depth of the current path
    before, dead = np.zeros(0, dtype=np.uint64), 0  # dead: depth at which the current path ended, or 0
    for i in order:
        own = stored[i]
        m = min(len(own), len(before))
        differ = np.flatnonzero(own[:m] != before[:m])
        shared = int(differ[0]) if len(differ) else m
        before = own
        if dead and shared >= dead:
            continue
        shared = min(shared, len(path))
        new = own[shared:]
        at = np.searchsorted(probe, new)
        hit = probe[np.minimum(at, n - 1)] == new
        overlap = (path[shared - 1] if shared else 0) + np.cumsum(hit)
        missed_here = np.arange(shared + 1, len(own) + 1) - overlap
        missed_there = at + hit - overlap
        over = np.flatnonzero(100 * (n - missed_there) < percent * (n + missed_here))
        path = np.concatenate((path[:shared], overlap))
        if len(over):
            dead = shared + int(over[0]) + 1
            path = path[:dead]
            continue
        dead = 0
        common = int(path[len(own) - 1])
        if 100 * common >= percent * (n + len(own) - common):
            found.append(i)
    return found


def verified(pairs: DataFrame, documents: DataFrame, width: int, percent: int, load: int = 1_500_000) -> DataFrame:
    """The pairs (a, b) whose sets are similar. Texts travel, which are half as long as their sets, and only those of
    documents in the pairs; a probe's partners are dealt to tasks of about `load` bytes, so no probe meets all of its
    partners in one."""
    ids = staged(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    few = ids.count() <= MOST_IDS
    texts = staged(documents.select("doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
                   .select(F.col("doc_id").alias("id"), "text").where("text is not null"))
    sizes = pairs.join(texts.select(F.col("id").alias("b"), F.octet_length("text").alias("n")), "b").groupBy("a").agg(F.sum("n").alias("n"))
    lots = staged(sizes.select("a", (F.floor(F.col("n") / load) + 1).cast("int").alias("lots")))
    stored = (pairs.join(lots, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("lots")).cast("int").alias("lot"))
              .join(texts.withColumnRenamed("id", "b"), "b").select("a", "lot", "b", "text", F.lit(False).alias("probe")))
    probes = (lots.join(texts.withColumnRenamed("id", "a"), "a")
              .select("a", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"),
                      F.col("a").alias("b"), "text", F.lit(True).alias("probe")))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in whole_groups(batches, ["a", "lot"]):
            probe, a, b = part["probe"].to_numpy(), part["a"].to_numpy(), part["b"].to_numpy()
            left, right = [], []
            for begin, end in group_bounds(part, ["a", "lot"]):
                sets = [np.unique(s) for s in shingle_rows(part["text"].iloc[begin:end].tolist(), width)]
                stored = [i for i in range(end - begin) if not probe[begin + i] and len(sets[i])]
                near = {stored[k] for i in range(end - begin) if probe[begin + i] and len(sets[i])
                        for k in trie_matches(sets[i], [sets[x] for x in stored], percent)}
                left += [a[begin + i] for i in near]
                right += [b[begin + i] for i in near]
            yield pd.DataFrame({"a": np.array(left, dtype=a.dtype), "b": np.array(right, dtype=b.dtype)})

    return (stored.union(probes).repartition("a", "lot").sortWithinPartitions("a", "lot")
            .mapInPandas(walk, f"a {kind}, b {kind}"))


def group_bounds(part: pd.DataFrame, keys: list[str]) -> list[tuple[int, int]]:
    """(begin, end) of the runs of equal keys; none without rows."""
    if not len(part):
        return []
    new = np.zeros(len(part), dtype=bool)
    new[:1] = True
    for k in keys:
        v = part[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    begin = np.flatnonzero(new)
    return list(zip(begin.tolist(), [*begin[1:].tolist(), len(part)], strict=True))


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Batches of sorted rows, dealt anew so that each holds whole groups: the last group waits for the next batch."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        last = group_bounds(batch, keys)[-1][0]
        same = held and all(held[-1][k].iloc[-1] == batch[k].iloc[0] for k in keys)
        if last == 0 and (same or not held):
            held.append(batch)
            continue
        yield pd.concat([*held, batch.iloc[:last]], ignore_index=True)
        held = [batch.iloc[last:]]
    if held:
        yield pd.concat(held, ignore_index=True)


# --- candidates ----------------------------------------------------------------------------------------------------

def _length_fits(n: str, m: str, percent: int) -> str:
    return f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m})"


def _unsettled(shared: DataFrame, components: DataFrame, percent: int) -> DataFrame:
    """Postings that have in their branch another one of a different component and of a length that fits. By length, the
    nearest ones of a different component on both sides tell."""
    known = shared.join(components.select(F.col("node").alias("rep"), "component"), "rep", "left")
    known = known.withColumn("component", F.coalesce("component", "rep"))
    own = Window.partitionBy("ngram")
    for name, w in (("lower", own.orderBy("n", "rep")), ("upper", own.orderBy(F.desc("n"), F.desc("rep")))):
        step = F.when(F.lag("component").over(w) != F.col("component"), F.lag("n").over(w))
        so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        known = known.withColumn("step", step).withColumn(name, F.last("step", ignorenulls=True).over(so_far))
    fits = " or ".join(f"({m} is not null and {_length_fits('n', m, percent)})" for m in ("lower", "upper"))
    return known.where(fits).select("ngram", "rep", "n", "component")


def _branch_pairs(postings: DataFrame, marks: DataFrame, percent: int, block: int) -> DataFrame:
    """Pairs of different components within each branch that the lengths and the sketches allow.

    A branch of more than `block` rows is dealt as pairs of blocks, so every pair meets in exactly one task and no
    task holds more than two blocks."""
    blocks = F.ceil(F.count("*").over(Window.partitionBy("ngram")) / block).cast("int")
    dealt = (postings.withColumn("blocks", blocks).join(marks, "rep").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("ngram", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own",
                     "rep", "n", "component", "sketch"))
    kind = postings.schema["rep"].dataType.simpleString()

    keys = ["ngram", "i", "j"]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in whole_groups(batches, keys):
            yield close_pairs(part, keys, percent)

    return (dealt.repartition(*keys).sortWithinPartitions(*keys, "n").mapInPandas(compare, f"a {kind}, b {kind}")
            .where("a <> b").distinct())


def close_pairs(part: pd.DataFrame, keys: list[str], percent: int) -> pd.DataFrame:
    """Pairs (a, b) of rows of one group that may be similar; rows are sorted by group and size. Every row is compared
    with the one `step` places on, for growing steps, until the group ends or the sizes differ too much."""
    rep, n, comp, own = (part[c].to_numpy() for c in ("rep", "n", "component", "own"))
    within_block = (part["i"] == part["j"]).to_numpy()
    marks = part["sketch"].tolist()
    group = np.zeros(len(part), dtype=np.int64)
    for g, (begin, end) in enumerate(group_bounds(part, keys)):
        group[begin:end] = g
    left, right, live, step = [], [], np.arange(len(part)), 0
    while len(live):
        step += 1
        live = live[live + step < len(part)]
        to = live + step
        live = live[(group[to] == group[live]) & (percent * n[to] <= 100 * n[live])]
        to = live + step
        ask = (comp[to] != comp[live]) & (within_block[live] | (own[to] != own[live]))
        a, b = live[ask], to[ask]
        near = sketch_gaps(marks, a, b) * (100 + percent) <= (100 - percent) * (n[a] + n[b])
        left.append(a[near])
        right.append(b[near])
    a, b = (rep[np.concatenate(x)] if x else rep[:0] for x in (left, right))
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()


#: Rows without an id get one from here on, made of their text; real ids are smaller.
NO_ID = 1 << 62


def with_keys(documents: DataFrame) -> DataFrame:
    """`documents` with k_key: the id, or for a row without one a number above all ids that equal texts share."""
    own = F.lit(NO_ID) + F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(NO_ID - 1))
    return documents.withColumn("k_key", F.coalesce(F.col("doc_id").cast("long"), own))


def similar_groups(documents: DataFrame, width: int = 4, percent: int = 85, stars: int = 12,
                   block: int = 2048, crowd: int = 16) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of `documents` (doc_id, text; doc_id a whole number below 2**62).

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; a set holds the distinct `width`-word shingles, of a shorter
    text the whole sequence. Documents link when 100 x intersection >= percent x union. component_id is the smallest
    id that links reach; a null or wordless text links with nothing and has its own id. Repeated rows and rows of equal
    id give a row each and share a component through their id. A row without an id links like any other and holds others
    together; its component_id is null where no row reached has an id. An empty table gives an empty result; other columns
    are not read.
    """
    kind = dict(documents.dtypes)["doc_id"]
    keyed = with_keys(documents.select("doc_id", "text")).select(F.col("k_key").alias("doc_id"), "text")
    named = [F.when(F.col(c) < NO_ID, F.col(c)).cast(kind).alias(c) for c in ("doc_id", "component_id")]
    return keyed_groups(keyed, width, percent, stars, block, crowd).select(named[0], "n_shingles", named[1])


def keyed_groups(documents: DataFrame, width: int, percent: int, stars: int = 12, block: int = 2048,
                 crowd: int = 16) -> DataFrame:
    """`similar_groups` of rows that all have an id."""
    if not 50 < percent <= 100:
        raise ValueError("percent must be above 50 and at most 100")
    documents = documents.select("doc_id", "text")
    known = staged(profiles(documents, width, percent, frequent_ngrams(documents, width)))
    classes = known.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    classes = staged(classes)
    alone = known.where("size(prefix) > 0").join(classes.withColumnRenamed("rep", "doc_id"), ["digest", "doc_id"])
    postings = alone.select(F.explode("prefix").alias("ngram"), F.col("doc_id").alias("rep"), "n")
    # a posting without another one of a length that fits in its branch leads nowhere
    order = Window.partitionBy("ngram").orderBy("n", "rep")
    fits = " or ".join(f"({m} is not null and {_length_fits('n', m, percent)})" for m in ("before", "after"))
    shared = (postings.withColumn("before", F.lag("n").over(order)).withColumn("after", F.lead("n").over(order))
              .where(fits).select("ngram", "rep", "n"))
    shared = staged(shared.distinct())

    components = shared.select(F.col("rep").alias("node"), F.col("rep").alias("component")).limit(0)

    def merged(found: DataFrame) -> DataFrame:
        """Components after more links; those already known are stars, so little is left to settle."""
        known_links = components.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        return staged(connected_components(known_links.union(found)))

    # stars: in branches of `crowd` rows or more all are compared with one, drawn anew each turn; a branch stays in
    # as long as a tenth of them link, so a group of near copies is not compared all with all
    own = Window.partitionBy("ngram")
    rest = staged(_unsettled(shared, components, percent))

    def crowded(postings: DataFrame) -> DataFrame:
        return staged(postings.withColumn("rows", F.count("*").over(own)).where(F.col("rows") >= crowd).drop("rows"))

    hot, merges = crowded(rest), 0
    for turn in range(stars):
        if hot.isEmpty():
            break
        pivot = F.min(F.struct(F.xxhash64("rep", F.lit(turn)).alias("draw"), "rep", "n", "component")).over(own)
        star = staged(hot.withColumn("pivot", pivot)
                      .where("component <> pivot.component and " + _length_fits("n", "pivot.n", percent))
                      .select("ngram", F.col("pivot.rep").alias("a"), F.col("rep").alias("b")))
        found = staged(verified(star.select("a", "b").distinct(), documents, width, percent).distinct())
        if found.isEmpty():
            break
        components, merges = merged(found), merges + 1
        share = F.avg(F.col("linked").isNotNull().cast("int"))
        alike = (star.join(found.withColumn("linked", F.lit(1)), ["a", "b"], "left").groupBy("ngram").agg(share.alias("share"))
                 .where("share >= 0.1").select("ngram"))
        hot = crowded(_unsettled(hot.join(alike, "ngram", "left_semi").drop("component"), components, percent))
    if merges:
        rest = _unsettled(rest.drop("component"), components, percent)
    marks = alone.select(F.col("doc_id").alias("rep"), "sketch")
    pairs = staged(_branch_pairs(rest, marks, percent, block))
    found = staged(verified(pairs, documents, width, percent))
    if not found.isEmpty():
        components = merged(found)

    # equal ids with different sets hold their classes together
    bridges = (known.where("n > 0 and doc_id is not null").select("doc_id", "digest").distinct()
               .join(classes, "digest").where("rep <> doc_id").select("doc_id", "rep", "digest"))
    several = (known.where("n > 0").groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high"))
               .where("low <> high").select("doc_id"))
    bridges = staged(bridges.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    if not bridges.isEmpty():
        components = merged(bridges)

    named = classes.join(components.withColumnRenamed("node", "rep"), "rep", "left").select(
        "digest", F.coalesce("component", "rep").alias("class_component"))
    result = known.select("doc_id", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest")).join(named, "digest", "left")
    return result.select("doc_id", F.col("n").alias("n_shingles"),
                         F.coalesce("class_component", "doc_id").alias("component_id"))


def without_copies(documents: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """One row of each component: those with its smallest id, or where no row of it has one, those of one text; rows that
    repeat id and text count once. Texts without a word all stay. All columns stay."""
    rows = with_keys(documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("k_row"), "doc_id", "text"))
    groups = staged(keyed_groups(rows.select(F.col("k_key").alias("doc_id"), "text"), width, percent))
    copies = staged(groups.where("component_id <> doc_id").select(F.col("doc_id").alias("copy")).distinct())
    near = F.broadcast(copies) if copies.count() <= MOST_IDS else copies
    repeated = staged(groups.where("n_shingles > 0").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("again")))
    few = F.broadcast(repeated) if repeated.count() <= MOST_IDS else repeated
    left = rows.join(near, F.col("k_key") == F.col("copy"), "left_anti").join(few, F.col("k_key") == F.col("again"), "left")
    once = left.where("again is not null").groupBy("k_key", F.md5(F.col("text").cast("binary"))).agg(
        F.min_by("k_row", F.xxhash64("k_row")).alias("k_row"))
    return left.where("again is null").select("k_row").union(once.select("k_row")).select(
        *[F.col("k_row")[c].alias(c) for c in documents.columns])
